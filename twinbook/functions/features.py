"""Features of a market's title: a table of rules, read as Spark columns.

A feature is data. Its kind says how its patterns are read on the lower-case
title without accents (``names`` features read the title as written):

* flag: whether the pattern occurs;
* set: the sorted distinct strings that the patterns' first groups collect;
* labels: the sorted labels whose pattern occurs;
* case: the first label whose pattern occurs, else null;
* groups: the groups of the first match, null without one.

A feature with ``context`` is empty (false, null) where the context pattern does
not occur. Patterns use what all regular-expression engines know: no look-around
and no back references, so that another engine can check them.

Many features of many titles are read from Arrow batches (``read``), by an engine
whose time does not grow with a pattern's alternatives; single ones are columns
(``column``). Both give the same.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinbook.functions.text import once

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_ORDINAL = r"(?:\d+(?:st|nd|rd|th)|first|second|third|fourth|fifth|last)"
_STATS = r"(?:points?|rebounds?|assists?|yards?|goals?|runs?|strikeouts?|hits?|touchdowns?|saves?|steals?|blocks?|receptions?|aces?)"
_BANKS = {
    "fed": r"\b(?:fed|fomc|federal reserve)\b", "ecb": r"\b(?:ecb|european central bank)\b", "boe": r"\b(?:boe|bank of england)\b",
    "boj": r"\b(?:boj|bank of japan)\b", "boc": r"\b(?:boc|bank of canada)\b", "rba": r"\b(?:rba|reserve bank of australia)\b", "snb": r"\b(?:snb|swiss national bank)\b",
}
_OFFICES = {
    "president": r"\b(?:president|presidential|presidency)\b", "vice president": r"\bvice[ -]president", "governor": r"\b(?:governor|gubernatorial)\b",
    "senate": r"\b(?:senate|senator)\b", "house": r"\b(?:house of representatives|congressional|house seat)\b", "mayor": r"\b(?:mayor|mayoral)\b",
    "prime minister": r"\bprime minister\b", "chancellor": r"\bchancellor\b", "attorney general": r"\battorney general\b",
}
_BRAZIL = (
    "acre alagoas amapa amazonas bahia ceara goias maranhao para paraiba parana pernambuco piaui rondonia roraima sergipe tocantins".split()
    + ["distrito federal", "espirito santo", "mato grosso", "mato grosso do sul", "minas gerais", "rio de janeiro", "rio grande do norte", "rio grande do sul", "santa catarina", "sao paulo"]
)


@dataclass(frozen=True)
class Feature:
    kind: str
    patterns: object  # a pattern, a tuple of them, or labels and patterns
    context: str = ""
    raw: bool = False


def flag(pattern: str, context: str = "") -> Feature:
    return Feature("flag", pattern, context)


def found(*patterns: str, context: str = "") -> Feature:
    return Feature("set", patterns, context)


def labels(table: dict[str, str], context: str = "") -> Feature:
    return Feature("labels", table, context)


def case(table: dict[str, str], context: str = "") -> Feature:
    return Feature("case", table, context)


def groups(pattern: str, context: str = "") -> Feature:
    return Feature("groups", pattern, context)


def words(names: str) -> dict[str, str]:
    """Each word as a label of its own."""
    return {w.replace("_", " "): rf"\b{w.replace('_', ' ')}\b" for w in names.split()}


NUMBERS = {
    "rates": found(r"(\d+(?:\.\d+)?) ?(?:%|percent\b|percentage points?\b)"),
    "above": flag(r"\b(?:above|over|more than|at least|exceeds?|greater than|higher than|or more|or higher)\b|\d\+"),
    "below": flag(r"\b(?:below|under|less than|at most|fewer than|lower than|or less|or fewer|or lower)\b"),
    "threshold": groups(rf"\b(above|over|more than|at least|exceeds?|greater than|higher than|below|under|less than|at most|fewer than|lower than) (\$?)({_NUMBER})( ?(?:%|[kmbt]\b|thousand|million|billion|trillion|percent)?)"),
    "bounds_lt": found(rf"\b(?:below|under|less than|fewer than|lower than|<) ?\$?({_NUMBER})"),
    "bounds_gt": found(rf"\b(?:above|over|more than|greater than|higher than|>) ?\$?({_NUMBER})"),
    "money_up": flag(r"\b(?:hit|reach|rise|climb|surge|top|all[ -]time high)\b|\babove \$"),
    "money_down": flag(r"\b(?:dip|drop|fall|crash|sink|all[ -]time low)\b|\bbelow \$"),
    "settles": case({"touch": r"\b(?:hit|reach|touch|trade at)\b", "hold": r"\b(?:close|settle|end|finish)[a-z]* (?:above|below|at|over|under)\b"}),
    "money_size": found(r"\$(\d[\d,.]* ?(?:[kmbt]|thousand|million|billion|trillion)\b\+?)"),
    "vote_share": found(r"(\d+(?:\.\d+)?) ?(?:%|percent) (?:or more )?of (?:the )?(?:vote|votes|popular vote)"),
    "is_vote_share": flag(r"(?:%|percent).*\bvotes?\b|\bvote share\b"),
    "bps": found(r"\b(\d+) ?(?:bps|basis points?)\b"),
    "bps_bucket": groups(r"\b(cut|hike|raise|lower|increase|decrease)[a-z]* (?:rates? )?(?:by )?(\d+)(?:-(\d+))? ?(?:bps|basis points?)"),
    "bps_more": flag(r">\s?\d+ ?bps|\bmore than \d+ (?:bps|basis points)\b|\b\d+\+ ?bps\b"),
    "bucket": groups(r"\b(\d{1,3}) ?(?:-|to) ?(\d{1,3})\b"),
    "cumulative": flag(r"\bor (?:below|above|less|more|fewer|higher|lower)\b|\d\+"),
    "rungs": found(r"\b(\d+)\+", r"\b(\d+) or (?:more|fewer|less|higher|lower)\b", r"\bat (?:least|most) (\d+)\b"),
    "price_race": flag(rf"\$?{_NUMBER}[kmb]? (?:or|before) \$?{_NUMBER}[kmb]?(?: first)?\b.*\b(?:first|before)\b|\bbefore (?:it |they )?(?:hits?|reach(?:es)?|drops? to) \$"),
    "rate_count": flag(r"\bhow many (?:fed |rate )?(?:rate )?(?:cuts|hikes)\b|\b(?:number of )?\d+ rate (?:cuts?|hikes?)\b"),
    "hurricane": groups(r"\bcategory (\d)( or (?:higher|above|stronger)| or (?:lower|below|weaker))?"),
    "review_score": flag(r"\b(?:rotten tomatoes|metacritic|tomatometer|review score)\b"),
}

#: A level that a price reaches, in the threshold's groups; a bound only with a dollar sign.
_REACHED = groups(rf"\b(hits?|reach(?:es)?|touch(?:es)?|tops?|surpass(?:es)?|cross(?:es)?) (\$)({_NUMBER})( ?(?:%|[kmbt]\b|thousand|million|billion|trillion|percent)?)")

TIMES = {
    "years": found(r"\b(20\d\d)\b"),
    "months": found(r"\b(" + "|".join(MONTHS) + r")\b"),
    "days": found(rf"\b({_MONTH} \d{{1,2}})(?:st|nd|rd|th)?\b"),
    "deadline": groups(rf"\b(?:by|before|until|through) ((?:{_MONTH} \d{{1,2}},? )?20\d\d|{_MONTH}(?: \d{{1,2}})?|end of (?:the )?(?:year|month|week))"),
    "deadline_years": found(r"\b(?:by|before) (?:[a-z]+ \d{1,2},? )?(20\d\d)\b"),
    "season_years": found(r"\b(20\d\d-\d{2})\b"),
    "occurrence": case({"deadline": r"\b(?:by|before|until|prior to)\b", "within": r"\b(?:in|during|this)\b"}, rf"\b(?:20\d\d|{_MONTH}|year|month|week)\b"),
    "fiscal": found(r"\b(q[1-4](?: 20\d\d)?)\b", r"\b(fy ?20\d\d)\b"),
    "grain": labels({"day": r"\b(?:daily|today|day)\b", "week": r"\b(?:weekly|week)\b", "month": r"\b(?:monthly|month)\b", "year": r"\b(?:yearly|annual|year)\b"}),
    "weekly": flag(r"\b(?:this|next) week\b|\bweek of\b|\bweekly\b"),
    "weeks": found(r"\bweek (\d+)\b"),
    "week_bucket": groups(r"\b(\d+) ?(?:-|to) ?(\d+) weeks?\b"),
    "duration": flag(r"\b(?:how long|length|runtime|duration)\b|\bminutes long\b", r"\b(?:song|album|movie|film|video|speech|track)\b"),
    "post_window": groups(rf"\b({_MONTH} \d{{1,2}}) ?(?:-|to|and) ?((?:{_MONTH} )?\d{{1,2}})\b"),
}

SCOPES = {
    "domains": labels({
        "sports": r"\b(?:game|match|season|playoffs?|championship|league|tournament|cup|finals?)\b", "election": r"\b(?:election|vote|primary|nominee|president|senate|governor|mayor)\b",
        "economic": r"\b(?:fed|inflation|cpi|gdp|unemployment|rate cut|rate hike|recession|jobs report|interest rates?)\b",
    }),
    "offices": labels(_OFFICES),
    "parties": labels({"republican": r"\b(?:republicans?|gop)\b", "democratic": r"\b(?:democrats?|democratic)\b", "conservative": r"\b(?:conservatives?|tory|tories)\b"}),
    "states": labels(words("alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada new_hampshire new_jersey new_mexico new_york north_carolina north_dakota ohio oklahoma oregon pennsylvania rhode_island south_carolina south_dakota tennessee texas utah vermont virginia washington wisconsin wyoming")),
    "countries": labels(words("argentina australia brazil britain canada china france germany india iran israel italy japan kenya mexico peru poland russia spain turkey ukraine venezuela")),
    "legislative": case({"control": r"\bcontrol (?:of )?(?:the )?(?:house|senate|congress)\b|\b(?:house|senate) majority\b", "seat": r"\b(?:house|senate|congressional) (?:seat|race|election)\b|\b[a-z]{2}-\d{1,2}\b"}),
    "chamber": labels({"upper": r"\b(?:senate|upper house|house of lords)\b", "lower": r"\b(?:house of representatives|lower house|house of commons|house)\b"}),
    "districts": found(r"\b([a-z]{2}-\d{1,2})\b"),
    "counties": found(r"\b([a-z]+) (?:county|parish)\b"),
    "below_state": flag(r"\b(?:county|parish|precinct|ward|borough)\b"),
    "candidacy": flag(r"\b(?:run for|running for|announce (?:a )?(?:candidacy|run|campaign)|declare candidacy|enter the race)\b"),
    "nomination": flag(r"\b(?:nominee|nominated|nomination|nominations|shortlist|shortlisted)\b"),
    "generic_winner": flag(r"^(?:who|which [a-z ]+) will win\b|\bwinner\?$"),
    "generic_place": flag(r"\bwhere will\b"),
    "place_option": flag(r"\bnext (?:meeting|summit)\b.*\bin [a-z]+"),
    "party_only": flag(r"\bwill (?:the )?(?:republicans?|democrats?|gop|republican party|democratic party) win\b"),
    "exit_poll": flag(r"\bexit polls?\b"),
    "dismissed": flag(r"\b(?:fired|dismissed|sacked|ousted|removed from office)\b"),
    "succession": flag(r"\b(?:who will be the next|next (?:prime minister|president|pope|leader|ceo|coach|manager|chair))\b"),
    "negated": flag(r"\b(?:not|no|never|fail|fails|without|won't|neither)\b"),
    "negative_state": flag(r"\b(?:banned|illegal|prohibited|blocked|rejected|denied|vetoed)\b"),
    "wave": case({"blue": r"\bblue wave\b", "red": r"\bred wave\b"}),
    "banks": labels(_BANKS),
    "policy": labels({"tariff": r"\btariffs?\b", "tax": r"\btax(?:es)?\b", "immigration": r"\b(?:immigration|deportations?|border)\b", "abortion": r"\babortion\b", "shutdown": r"\bshutdown\b", "cannabis": r"\b(?:marijuana|cannabis)\b", "ceasefire": r"\b(?:ceasefire|peace deal|truce)\b"}),
    "corporate": case({"no_ipo": r"\bno ipo\b|\bnot (?:go public|ipo)\b", "ipo": r"\b(?:ipo|go public|goes public)\b", "acquisition": r"\b(?:acquires?|acquired|acquisition|merger|buyout|takeover)\b", "bankruptcy": r"\b(?:bankrupt|bankruptcy|chapter 11)\b"}),
    "model_crown": case({"coding": r"\bcoding\b", "math": r"\bmath\b", "text": r"\btext\b", "general": r"\b(?:best|top) ai model\b"}, r"\bai (?:model|models)\b"),
    "products": labels({"chatgpt": r"\bchatgpt\b", "gpt": r"\bgpt-?\d", "gemini": r"\bgemini\b", "grok": r"\bgrok\b", "llama": r"\bllama\b", "deepseek": r"\bdeepseek\b"}),
    "orgs": labels(words("amazon apple google meta microsoft nvidia openai spacex tesla netflix boeing")),
    "brazil": found(r"\b(" + "|".join(sorted(_BRAZIL, key=lambda x: -len(x))) + r")\b", context=r"\bgovernor|governador"),
    "office_bundle": labels({k: _OFFICES[k] for k in ("president", "governor", "senate", "house", "mayor")}),
    "government": case({"coalition": r"\bcoalition\b", "membership": r"\b(?:part of|join|leave) (?:the )?(?:next )?government\b"}),
    "party_list": labels({"afd": r"\bafd\b", "cdu": r"\bcdu(?:/csu)?\b", "spd": r"\bspd\b", "greens": r"\bgreens?\b", "likud": r"\blikud\b", "labour": r"\blabou?r party\b"}),
    "judicial": case({"seated": r"\b(?:confirmed|seated|sworn in)\b", "nomination": r"\bnominat"}, r"\b(?:supreme court|scotus)\b"),
    "speech": labels({"earnings": r"\bearnings call\b", "video": r"\bvideo\b", "podcast": r"\bpodcast\b", "press": r"\bpress (?:conference|briefing)\b", "speech": r"\b(?:speech|address|remarks|rally)\b"}),
    "speaker": groups(r"\bwhat will ([a-z .'-]+?) say\b"),
    "first_endorsement": flag(r"\bfirst\b.*\bendors"),
    "founded_by": groups(r"\b(?:founded by|owned by|belonging to) ([a-z]+ [a-z]+)\b"),
    "featured_on": groups(r"\bfeatured on (?:the )?([a-z0-9 ]+)"),
    "action": labels({
        "win": r"\bwins?\b|\bwinner\b", "lose": r"\bloses?\b", "cut": r"\bcuts?\b", "hike": r"\b(?:hikes?|raises?)\b", "hold": r"\b(?:holds?|no change|unchanged|pauses?)\b", "resign": r"\b(?:resigns?|steps? down)\b",
        "nominate": r"\bnominat", "announce": r"\bannounc", "sign": r"\bsigns?\b", "pass": r"\b(?:passes|pass|passed)\b", "visit": r"\bvisits?\b", "meet": r"\bmeets?\b", "arrest": r"\b(?:arrest|charged|indict)", "launch": r"\b(?:launch|release)",
        "acquire": r"\bacqui", "ban": r"\bban(?:s|ned)?\b", "pardon": r"\bpardons?\b", "endorse": r"\bendors", "say": r"\b(?:say|says|mention)\b", "attend": r"\battends?\b",
    }),
    "verb_object": groups(r"\b([a-z]+) (visit|meet|pardon|endorse|nominate|fire|sue|invade)(?:s|ed)? (?:with )?([a-z]+(?: [a-z]+)?)"),
    "weather_source": labels({"nws": r"\b(?:national weather service|nws)\b", "noaa": r"\bnoaa\b", "wunderground": r"\b(?:weather underground|wunderground)\b", "accuweather": r"\baccuweather\b"}),
    "crypto_source": labels({"binance": r"\bbinance\b", "coinbase": r"\bcoinbase\b", "kraken": r"\bkraken\b", "coingecko": r"\bcoingecko\b", "cf": r"\b(?:cf benchmarks|brti)\b"}),
    "econ_source": labels({"bls": r"\b(?:bls|bureau of labor statistics)\b", "bea": r"\b(?:bea|bureau of economic analysis)\b", "fred": r"\bfred\b"}),
}

SPORTS = {
    "over_under": flag(r"\bover/under\b|\bo/u\b|\b(?:over|under) \d"),
    "spread": flag(r"\bo/u\b|\b(?:over|under) \d+\.5\b|\bwins? by (?:more than |over )?\d|[(][+-]\d+(?:\.5)?[)]|\bspread\b"),
    "win_market": flag(r"\b(?:wins?|winner|beats?|defeats?)\b"),
    "player_prop": flag(rf": {_STATS}\b|\b\d+\+ {_STATS}\b|\banytime (?:goalscorer|touchdown)\b"),
    "match_winner": flag(r"\b(?:match|set|game) winner\b|\bwho will win (?:the )?(?:match|game|set)\b"),
    "unselected": flag(r"^[a-z .'-]+ (?:vs?\.?|at) [a-z .'-]+(?:: winner|\?)?$"),
    "game_scope": flag(r"\b(?:vs?\.?|tonight|game \d+)\b"),
    "matchup": groups(r"\b([a-z]+(?: [a-z]+)?) (?:vs?\.?|at) ([a-z]+(?: [a-z]+)?)\b"),
    "beats": groups(r"\b([a-z]+(?: [a-z]+)?) (?:beats?|defeats?) (?:the )?([a-z]+(?: [a-z]+)?)\b"),
    "final_pairing": flag(r"\b(?:final|finals|super bowl|championship) matchup\b"),
    "womens": flag(r"\b(?:women'?s|wnba|ladies|lpga|wta)\b"),
    "superlative": flag(r"\b(?:most|fewest|lead the league in|leads? (?:the )?(?:nba|nfl|mlb|nhl) in)\b"),
    "leader_stats": labels({"points": r"\bpoints\b", "rebounds": r"\brebounds\b", "assists": r"\bassists\b", "goals": r"\b(?:goals|golden boot|top scorer)\b", "home runs": r"\bhome runs\b", "passing": r"\bpassing yards\b", "rushing": r"\brushing yards\b", "sacks": r"\bsacks\b"}, r"\b(?:most|leader|lead|leads|top scorer|golden boot)\b"),
    "stat_values": found(rf"\b(\d+)\+? {_STATS}\b"),
    "stat_line": flag(rf"\b\d+(?:\.5)?\+? {_STATS}\b"),
    "set_numbers": found(r"\bset (\d+)\b"),
    "picks": found(r"\bpick (?:no\. |#)?(\d+)\b", r"\b(\d+)(?:st|nd|rd|th) (?:overall )?pick\b"),
    "seeds": found(r"\b(?:no\. ?|#)?(\d+)(?:st|nd|rd|th)? seed\b"),
    "ranks": found(r"#(\d+)\b", r"\b(\d+)(?:st|nd|rd|th)\b", r"\btop[ -](\d+)\b"),
    "places": found(rf"\b({_ORDINAL}) place\b", rf"\bfinish(?:es)? ({_ORDINAL})\b"),
    "finish": labels({"top": r"\btop[ -]\d+\b", "winner": r"\bwin(?:s|ner)?\b", "runner-up": r"\brunner[ -]up\b|\bsecond place\b", "last": r"\blast place\b|\bwooden spoon\b"}),
    "qualify": flag(r"\b(?:qualify|qualifies|advance|make the playoffs|reach the)\b"),
    "relegated": flag(r"\b(?:relegated|relegation|eliminated|miss the playoffs)\b"),
    "runner_up": flag(r"\brunner[ -]up\b"),
    "stage": case({"league": r"\bleague phase\b", "group": r"\bgroup stage\b"}),
    "playoff": labels({"seed": r"\bseed\b", "division": r"\bdivision\b", "conference": r"\bconference\b"}),
    "tier": labels({"division": r"\bdivision (?:i|ii|iii|1|2|3|one|two|three)\b", "conference": r"\b(?:eastern|western|afc|nfc|american league|national league) ?(?:conference|championship)?\b"}),
    "champion": flag(r"\b(?:champions?|championship|win the (?:title|cup|world series|super bowl|stanley cup))\b"),
    "tournament": flag(r"\bwin (?:the )?(?:20\d\d )?[a-z' ]*(?:open|masters|cup|tournament|championship|classic)\b"),
    "league": labels({
        "nba": r"\bnba\b", "wnba": r"\bwnba\b", "nfl": r"\b(?:nfl|super bowl)\b", "mlb": r"\b(?:mlb|world series)\b", "nhl": r"\b(?:nhl|stanley cup)\b", "college": r"\b(?:ncaa|college (?:football|basketball)|march madness)\b", "epl": r"\b(?:epl|premier league)\b",
        "laliga": r"\bla liga\b", "seriea": r"\bserie a\b", "bundesliga": r"\bbundesliga\b", "ucl": r"\bchampions league\b", "mls": r"\bmls\b", "atp": r"\batp\b", "wta": r"\bwta\b", "ufc": r"\bufc\b", "f1": r"\b(?:f1|formula 1|grand prix)\b", "pga": r"\bpga\b",
    }),
    "rounds": labels({"final": r"\bfinal\b", "semifinal": r"\bsemi-?finals?\b", "quarterfinal": r"\bquarter-?finals?\b", "r16": r"\bround of 16\b", "r32": r"\bround of 32\b", "r64": r"\bround of 64\b", "round 1": r"\b(?:first round|round 1)\b", "round 2": r"\b(?:second round|round 2)\b", "round 3": r"\b(?:third round|round 3)\b", "round 4": r"\b(?:fourth round|round 4|final round)\b"}),
    "runoff": labels({"first": r"\bfirst round\b", "second": r"\bsecond round\b", "runoff": r"\brun-?off\b"}),
    "periods": labels({"h1": r"\b(?:1st|first) half\b|\bhalf-?time\b", "h2": r"\b(?:2nd|second) half\b", "q1": r"\b(?:1st|first) quarter\b", "q2": r"\b(?:2nd|second) quarter\b", "q3": r"\b(?:3rd|third) quarter\b", "q4": r"\b(?:4th|fourth) quarter\b", "p1": r"\b(?:1st|first) period\b", "p2": r"\b(?:2nd|second) period\b", "p3": r"\b(?:3rd|third) period\b"}),
    "half": found(r"\b(1st|2nd|first|second) half\b"),
    "halftime": flag(r"\bhalf-?time\b"),
    "bet": case({"margin": r"\b(?:margin|win by|wins by)\b", "total": r"\b(?:total|over/under|o/u)\b", "correct_score": r"\b(?:correct|exact) score\b", "score": r"\b(?:score|scores)\b", "prop": rf"\b\d+\+ {_STATS}\b", "moneyline": r"\b(?:win|wins|winner|beat|beats|vs)\b"}),
    "season": labels({"last_to_win": r"\blast (?:team )?to win\b", "winless": r"\bwinless\b", "undefeated": r"\b(?:undefeated|unbeaten)\b", "win_total": r"\bwin total\b|\b\d+\+? wins\b"}),
    "fantasy": labels({"qb": r"\b(?:quarterback|qb)\b", "rb": r"\b(?:running back|rb)\b", "wr": r"\b(?:wide receiver|wr)\b", "te": r"\b(?:tight end|te)\b", "k": r"\bkicker\b"}, r"\bfantasy\b"),
    "award_body": labels({"oscars": r"\b(?:oscars?|academy awards?)\b", "emmys": r"\bemmys?\b", "grammys": r"\bgrammys?\b", "globes": r"\bgolden globes?\b", "tonys": r"\btonys?\b", "baftas": r"\bbaftas?\b", "sag": r"\bsag awards?\b", "game awards": r"\bthe game awards\b"}),
    "award": labels({"picture": r"\bbest picture\b", "director": r"\bbest director\b", "actor": r"\bbest actor\b", "actress": r"\bbest actress\b", "song": r"\b(?:song|record) of the year\b", "album": r"\balbum of the year\b", "mvp": r"\bmvp\b", "rookie": r"\brookie of the year\b", "coach": r"\bcoach of the year\b"}),
    "award_phrases": found(r"\b(best [a-z]+)\b", r"\b([a-z]+ of the year)\b"),
    "honour": case({"heisman": r"\bheisman\b", "ballon": r"\bballon d'?or\b", "cy young": r"\bcy young\b", "mvp": r"\bmvp\b", "dpoy": r"\b(?:dpoy|defensive player of the year)\b", "rookie": r"\b(?:roty|rookie of the year)\b"}),
    "school": labels(words("state tech north south east west northern southern eastern western central"), r"\b(?:university|college|state|tech|ncaa)\b"),
    "league_outcome": case({"relegation": r"\brelegat", "champion": r"\b(?:champion|champions|win the league)\b"}),
    "f1_career": case({"retirement": r"\bretire", "next_team": r"\bnext team\b|\b(?:join|sign with)\b"}, r"\b(?:f1|formula 1)\b"),
    "golf_result": case({"hole_in_one": r"\bhole[ -]in[ -]one\b", "participant": r"\b(?:participate|compete|play) in\b", "winner": r"\bwin\b"}),
    "clubs": labels({"man utd": r"\bman(?:chester)? (?:utd|united)\b", "man city": r"\bman(?:chester)? city\b", "real madrid": r"\breal madrid\b", "atletico": r"\batletico\b", "barcelona": r"\bbarcelona\b", "bayern": r"\bbayern\b", "psg": r"\b(?:psg|paris saint-germain)\b", "inter": r"\binter(?: milan)?\b"}),
    "competition": case({"world cup": r"\bworld cup\b", "euro": r"\beuro 20\d\d\b", "ucl": r"\bchampions league\b", "europa": r"\beuropa league\b", "wimbledon": r"\bwimbledon\b", "us open": r"\bus open\b", "masters": r"\bmasters\b", "super bowl": r"\bsuper bowl\b"}),
    "relative": flag(r"\b(?:finish (?:above|ahead of|higher than)|more (?:wins|points|medals) than|better record than)\b"),
    "title_winner": flag(r"\bwin (?:the )?(?:[a-z]+ )?(?:championship|title|cup|finals|world series|super bowl)\b"),
}

NAMES = {
    "proper": Feature("set", (r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b",), raw=True),
    "selected": Feature("groups", r"^(?:Will )?([A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+)*) (?:vs?\.?|at) ", raw=True),
    "subject": Feature("groups", r"^Will (?:the )?([A-Z][a-z]+) (?:win|beat|defeat|be)\b", raw=True),
    "winner_subject": Feature("groups", r"^(?:Will )?(?:the )?([A-Z][A-Za-z.'-]*(?: [A-Z][A-Za-z.'-]*)*) (?:win|wins|to win|be the nominee)\b", raw=True),
    "tickers": Feature("set", (r"\b(BTC|ETH|SOL|XRP|DOGE|SPX|NDX|TSLA|NVDA|AAPL)\b",), raw=True),
    "commodities": Feature("labels", {"gold": r"(?i)\bgold\b", "silver": r"(?i)\bsilver\b", "oil": r"(?i)\b(?:oil|wti|brent|crude)\b", "gas": r"(?i)\bnatural gas\b"}, raw=True),
    "is_name": Feature("flag", r"^[A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+)+$", raw=True),
}

FAMILIES = {"numbers": NUMBERS, "times": TIMES, "scopes": SCOPES, "sports": SPORTS, "names": NAMES}


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    kept = [(c, base) for c, base in pairs if base != c and base.isascii()]
    return "".join(c for c, _ in kept), "".join(base for _, base in kept)


def ascii_lower(text: Column) -> Column:
    """Lower case, without accents, en and em dashes as hyphens; null as an empty text."""
    marked, plain = _accents()
    return F.lower(F.translate(F.coalesce(text, F.lit("")), marked + "–—", plain + "--"))


def squash(text: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", "")


def label_key(label: Column) -> Column:
    """A label squashed, what stands in parentheses removed."""
    return squash(F.regexp_replace(F.coalesce(label, F.lit("")), r"[(][^)]*[)]", ""))


def snapshot_text(*fields: Column) -> Column:
    """The fields that are not blank, one after the other."""
    return F.concat_ws(" ", *(F.when(F.trim(f) != "", f) for f in fields))


def same_label(a: Column, b: Column) -> Column:
    """Equal squashed labels of three characters or more."""
    return (label_key(a) == label_key(b)) & (F.length(label_key(a)) >= 3)


def anchors(name: Column) -> Column:
    """Words of three letters or more of a name."""
    return F.filter(F.split(ascii_lower(name), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def names_overlap(a: Column, b: Column) -> Column:
    """Whether two sets of names share one, or words of their names."""
    spread = lambda names: F.array_distinct(F.flatten(F.transform(names, anchors)))
    return F.arrays_overlap(a, b) | F.arrays_overlap(spread(a), spread(b))


def same_person(a: Column, b: Column) -> Column:
    """Equal last names, and first names that share three letters at least."""
    wa, wb = F.split(ascii_lower(a), r"\s+"), F.split(ascii_lower(b), r"\s+")
    return (F.element_at(wa, -1) == F.element_at(wb, -1)) & (F.length(wa[0]) >= 3) & (F.substring(wa[0], 1, 3) == F.substring(wb[0], 1, 3))


def different_names(a: Column, b: Column) -> Column:
    """Both are names, neither holds the other, and they are not variants of one person's."""
    la, lb = ascii_lower(a), ascii_lower(b)
    is_name = lambda x: x.rlike(NAMES["is_name"].patterns)
    return is_name(a) & is_name(b) & ~F.contains(la, lb) & ~F.contains(lb, la) & ~same_person(a, b)


def column(feature: Feature, title: Column, low: Column | None = None) -> Column:
    """A feature of a title. ``low`` is ``ascii_lower`` of it, if a column holds that already."""
    text = F.coalesce(title, F.lit("")) if feature.raw else ascii_lower(title) if low is None else low
    there = text.rlike(feature.context) if feature.context else None
    if feature.kind == "flag":
        hit = text.rlike(feature.patterns)
        return hit & there if feature.context else hit
    if feature.kind == "set":
        out = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in feature.patterns))
        out = F.array_sort(F.array_distinct(out))
    elif feature.kind == "labels":
        out = F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in feature.patterns.items()))))
    elif feature.kind == "case":
        out = F.coalesce(*(F.when(text.rlike(p), F.lit(n)) for n, p in feature.patterns.items()))
        return F.when(there, out) if feature.context else out
    else:
        out = F.array(*(F.regexp_extract(text, feature.patterns, k + 1) for k in range(n_groups(feature.patterns))))
        hit = text.rlike(feature.patterns)
        return F.when(hit & there if feature.context else hit, out)
    return F.when(there, out).otherwise(F.array().cast("array<string>")) if feature.context else out


def n_groups(pattern: str) -> int:
    """Capturing groups of a pattern."""
    return sum(1 for i, c in enumerate(pattern) if c == "(" and pattern[i + 1 : i + 2] != "?" and pattern[i - 1 : i] not in ("\\", "["))


#: Kind -> type of its column.
TYPES = {"flag": "boolean", "set": "array<string>", "labels": "array<string>", "case": "string", "groups": "array<string>"}


def _lists(found: list[list[str] | None]) -> pa.Array:
    offsets = pa.array([0, *accumulate(len(x or ()) for x in found)], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array([v for x in found for v in x or ()], pa.string()), mask=pa.array([x is None for x in found]))


def _batch(feature: Feature, text: pa.Array) -> pa.Array:
    """A feature of a batch of texts; only texts that hold a pattern are taken apart."""

    def hits(pattern: str) -> np.ndarray:
        return pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False).astype(bool)

    there = hits(feature.context) if feature.context else np.ones(len(text), bool)
    if feature.kind == "flag":
        return pa.array(hits(feature.patterns) & there)
    if feature.kind == "case":
        place = np.full(len(text), len(feature.patterns))
        for k, p in reversed(list(enumerate(feature.patterns.values()))):
            place[hits(p)] = k
        place[~there] = len(feature.patterns)
        return pa.array([*feature.patterns, None], pa.string()).take(pa.array(place))
    if feature.kind == "labels":
        names = sorted(feature.patterns)
        held = np.column_stack([hits(feature.patterns[n]) & there for n in names])
        offsets = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(names, pa.string()).take(pa.array(np.nonzero(held)[1])))
    if feature.kind == "set":
        found: list = [[] for _ in range(len(text))]
        for p in feature.patterns:
            one = re.compile(p, re.ASCII)
            for k in np.nonzero(hits(p) & there)[0]:
                found[k] += [m.group(1) or "" for m in one.finditer(text[k].as_py())]
        return _lists([sorted(set(x)) for x in found])
    groups_, one = [None] * len(text), re.compile(feature.patterns, re.ASCII)
    for k in np.nonzero(hits(feature.patterns) & there)[0]:
        groups_[k] = [g or "" for g in one.search(text[k].as_py()).groups()]
    return _lists(groups_)


def _kinds(table: dict[str, Feature]) -> str:
    return "struct<" + ", ".join(f"`{n}`: {TYPES[f.kind]}" for n, f in table.items()) + ">"


def _read(table: dict[str, Feature], title: pa.Array, low: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([_batch(f, title if f.raw else low) for f in table.values()], list(table))


def read(table: dict[str, Feature], title: Column, low: Column) -> Column:
    """Struct of a table's features of a title and ``low``, its folded form; as ``column`` gives them one by one."""

    def batch(title: pa.Array, low: pa.Array) -> pa.Array:
        return _read(table, pc.fill_null(title, ""), low)

    return F.arrow_udf(batch, _kinds(table))(title, low)


def read_pair(table: dict[str, Feature], a: Column, b: Column) -> Column:
    """Struct (a, b) of what ``read`` gives for two titles; a text that stands in several pairs of a batch is read once."""

    def batch(a: pa.Array, low_a: pa.Array, b: pa.Array, low_b: pa.Array) -> pa.Array:
        title, low = pc.fill_null(pa.concat_arrays([a, b]), ""), pa.concat_arrays([low_a, low_b])
        place = title.dictionary_encode().indices.to_numpy()
        first = pa.array(np.unique(place, return_index=True)[1])
        spec = _read(table, title.take(first), low.take(first))
        return pa.StructArray.from_arrays([spec.take(pa.array(p)) for p in (place[: len(a)], place[len(a) :])], ["a", "b"])

    return F.arrow_udf(batch, f"struct<a: {_kinds(table)}, b: {_kinds(table)}>")(a, ascii_lower(a), b, ascii_lower(b))


def spec(title: Column, low: Column | None = None, families: tuple[str, ...] = tuple(FAMILIES)) -> Column:
    return read({n: f for k in families for n, f in FAMILIES[k].items()}, title, ascii_lower(title) if low is None else low)


def offices(title: Column) -> Column:
    """Offices that a title names; a vice president's is not a president's."""
    named = column(SCOPES["offices"], title)
    return F.when(F.array_contains(named, "vice president"), F.array_remove(named, "president")).otherwise(named)


def threshold(title: Column) -> Column:
    """(up, value, unit) of a one-sided bound: unit usd, pct or count; null without one, or if the title names a range.

    Multipliers are applied; "more than 10" of a count is 11, the least that says yes.
    """
    table = {"bound": NUMBERS["threshold"], "reached": _REACHED, "bucket": flag(NUMBERS["bucket"].patterns), "between": flag(r"\bbetween\b")}
    return once(read(table, title, ascii_lower(title)), lambda f: _bound(F.coalesce(f["bound"], f["reached"]), f["bucket"] | f["between"]))


def _bound(found_: Column, ranged: Column) -> Column:
    """The bound of the parts ``found_`` of a title."""
    word, tail = found_[0], F.trim(found_[3])
    times = F.when(tail.isin("k", "thousand"), 1e3).when(tail.isin("m", "million"), 1e6).when(tail.isin("b", "billion"), 1e9).when(tail.isin("t", "trillion"), 1e12).otherwise(1.0)
    unit = F.when(found_[1] == "$", "usd").when(tail.isin("%", "percent"), "pct").otherwise("count")
    value = F.regexp_replace(found_[2], ",", "").cast("double") * times
    up = ~word.isin("below", "under", "less than", "at most", "fewer than", "lower than")
    strict = (unit == "count") & (value == F.floor(value))
    value = F.when(strict & up & (word != "at least"), value + 1).when(strict & ~up & (word != "at most"), value - 1).otherwise(value)
    return F.when(found_.isNotNull() & ~ranged, F.struct(up.alias("up"), value.alias("value"), unit.alias("unit")))


def threshold_equal(a: Column, b: Column) -> Column:
    """Bounds of one unit: dollars within a thousandth, percentages within 0.05, counts exactly; null if either is missing."""
    gap = F.abs(a["value"] - b["value"])
    near = F.when(a["unit"] == "usd", gap <= 0.001 * F.greatest(F.abs(a["value"]), F.abs(b["value"]))).when(a["unit"] == "pct", gap <= 0.05 + 1e-9).otherwise(gap == 0)
    return (a["unit"] == b["unit"]) & near


def confidence(similarity: Column, hours: Column, most: float) -> Column:
    """0.7 of the similarity and 0.3 of the closeness in time; the similarity alone if the gap is unknown."""
    if most <= 0:
        return similarity
    close = F.greatest(F.lit(0.0), 1 - F.abs(hours) / most)
    return F.when(hours.isNull(), similarity).otherwise(0.7 * similarity + 0.3 * close)
