"""Whether two contracts are one: read field by field, decided in one pass, with reasons.

A market is (id, label, event, question, close): the outcome's label, the
event's title, the whole question and the closing time; each may be null. Its
contract is read once (``with_contract``). A decision compares two of them:
guards, identity, time, numbers and polarity reject with a reason; contracts
that are each other's complement match inverted; what is left needs a ground to
be accepted. All of it is columns: a decision costs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbook.functions import features
from twinbook.functions.text import jaccard
from twinbook.operators.conflicts import CONFLICTS, fires

LEAST, HORIZON, MOST_HOURS = 0.30, 72.0, 24 * 400.0
ALIKE = 0.8
# Cues of opposite states, of paths of a price, of deadlines, weather and shapes of labels.
ANTONYMS = (
    (r"\b(banned|ban|prohibited|outlawed|illegal|blocked|shut down|shutdown)\b", r"\b(legal|legally|operating|allowed|permitted|available|stay online|remain online)\b"),
    (r"\bnot\s+reach\b|\bfails?\s+to\b|\bmiss(?:es)?\b", r"\breach(?:es)?\b|\bhits?\b|\bachiev(?:e|es)\b"),
)
HOLDS = r"\b(?:stay|stays|remain|remains)\s+(?:above|below|under|over)\b|\bfor all of\b"
TOUCHES = r"\b(?:hit|hits|touch|touches|touched|dip|dips|dipped|pass|passes|surpass|surpasses|top|tops|topping|breach|breaches|cross|crosses)\b|\bat any point\b"
REACHES, PERIOD = r"\b(?:above|below|over|under|reach|reaches|exceed|exceeds)\b", r"\bby\b|\b(?:in|during|throughout)\s+20\d{2}\b"
WEATHER = r"\b(?:highest|lowest|maximum|minimum|high|low) temperature\b|\bwill it (?:rain|snow)\b|\bprecipitation\b|\brainfall\b"
SUCCESSION = r"\bnext\b|\bsucceeds?\b|\bsuccessor\b|\breplaces?\b|\bcast as\b"
DOWN = r"\b(?:negative|contraction|recession|shrinks?|shrinking|below zero|sub[- ]?zero)\b"
BEST, AWARDS = r"\b(?:best|biggest|largest|strongest)(?![-\w])", r"\b(?:awards?|oscars?|emmys?|grammys?|tonys?|baftas?)\b"
SHAPING = "win wins winner winning lose loses loser losing yes no above below over under more less make makes making miss misses".split()
# Words that no name has, and that say nothing about a contract's likeness.
NO_NAME = (
    "election primary nominee nomination winner senate house governor president presidential democratic republican democrats cup league series award awards party states united "
    "championship champion act court supreme round overall draft pick general vice will who what which when where does did is are can the"
).split()
STOP = "a an the will be to of in on at by for and or is are do does did with from as it its this that who what which there".split()
ONE_NAME = {"btc": "bitcoin", "eth": "ethereum", "sol": "solana", "xrp": "ripple", "doge": "dogecoin", "gpt6": "gpt", "scotus": "supreme court", "gop": "republican", "dem": "democratic"}
#: Conflicts that even an equal event and label do not outweigh, those of time, and those that a complement has by nature.
GUARDS = frozenset(
    ("award", "award phrase", "ceremony", "honour", "policy", "relative standing", "region", "league outcome", "government", "result", "competition", "speech venue", "match period", "price race")
    + ("vote share or place", "advance or fall", "fantasy position", "season outcome", "bucket or bound", "judicial stage", "club", "party list", "career", "superlative", "review score", "below state")
)
TIMES = frozenset(("year", "deadline year", "month", "day"))
NUMBERS = frozenset(("settlement", "direction", "rate", "money size"))
RATES, RAISED = r"\b(?:fed|fomc|ecb|boe|interest|rates?|bps)\b", r"\b(?:hik(?:e|es|ed|ing)|rais(?:e|es|ed|ing)|increas(?:e|es|ed|ing)|ris(?:e|es|ing)|rose)\b"
CUT = r"\b(?:cuts?|cutting|lower(?:s|ed|ing)?|reduc(?:e|es|ed|ing)|decreas(?:e|es|ed|ing)|falls?|falling|fell)\b"
_NAME = r"([A-Z][\w'’.-]+(?: [A-Z][\w'’.-]+)*)"
_BY_NAME = {r.name: r for r in CONFLICTS}


def _names(field: Column) -> Column:
    """Runs of two capitalised words or more in a field, in lower case, question words before them and what stands in parentheses left out."""
    text = F.regexp_replace(F.coalesce(field, F.lit("")), r"[(][^)]*[)]", " ")
    text = F.regexp_replace(text, r"(?i)^\s*(?:will|who|what|which|does|did|is|are|can)\s+(?:the\s+)?", "")
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][\w'’-]+(?: (?:[A-Z]\. )?[A-Z][\w'’-]+)+)"), F.lit(1))
    return F.filter(F.transform(found, features.ascii_lower), lambda n: ~F.arrays_overlap(F.split(n, " "), F.array(*map(F.lit, NO_NAME))))


def _winner(field: Column) -> Column:
    """Who wins, as a field that begins with it says; an empty array without one."""
    found = F.regexp_extract(F.coalesce(field, F.lit("")), rf"^(?:Will |Can )?(?:the |The )?{_NAME} (?:to )?wins?\b", 1)
    return F.when(found != "", F.array(features.ascii_lower(found))).otherwise(F.array().cast("array<string>"))


def _beats(text: Column) -> Column:
    """(winner, loser) of "A beats B", or null."""
    pattern = rf"(?!(?:Will|Can|Does|Did)\b)\b{_NAME}\s+(?:to\s+)?(?:beats?|defeats?|upsets?)\s+(?:the\s+)?{_NAME}"
    sides = [features.squash(F.regexp_extract(text, pattern, i)) for i in (1, 2)]
    return F.when(text.rlike(pattern), F.array(*sides))


def _spelt_out(word: Column) -> Column:
    """80k as 80000, without a dollar sign."""
    word = F.regexp_replace(word, "[$]", "")
    number, unit = F.regexp_extract(word, r"^(\d+(?:\.\d+)?)[kmb]$", 1).try_cast("double"), F.substring(word, -1, 1)
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1e9)
    return F.when(number.isNotNull(), (number * times).cast("decimal(30, 0)").cast("string")).otherwise(word)


def _capitals(text: Column) -> Column:
    """Capitalised words of three letters or more, in lower case, tickers and short forms spelt out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9]{2,})\b"), F.lit(1)), features.ascii_lower)
    known = F.create_map(*(F.lit(x) for pair in ONE_NAME.items() for x in pair))
    found = F.filter(found, lambda w: ~w.isin(*NO_NAME, *STOP, *features.MONTHS))
    return F.array_distinct(F.transform(found, lambda w: F.coalesce(F.try_element_at(known, w), w)))


def _tokens(text: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ONE_NAME.items() for x in pair))
    plain = F.regexp_replace(features.ascii_lower(text), r"(?<=\d),(?=\d{3})", "")
    words = F.transform(F.split(plain, "[^a-z0-9$.%+]+"), lambda w: _spelt_out(F.regexp_replace(w, r"^[.]+|[.]+$", "")))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP)), lambda w: F.coalesce(F.try_element_at(known, w), w)))


def settlement(low: Column) -> Column:
    """How a price settles: touch (reached at any point), hold (kept all the time), or null (read at one point)."""
    return F.when(low.rlike(HOLDS), "hold").when(low.rlike(TOUCHES), "touch").when(F.contains(low, F.lit("$")) & low.rlike(REACHES) & low.rlike(PERIOD), "touch")


def signature(spec: Column) -> Column:
    """What a contract settles on, as sorted marks: actions, statistics, sets, picks, bounds, rates and times."""
    mark = lambda n: F.transform(spec[n], lambda x: F.concat(F.lit(f"{n}:"), x))
    marks = [mark(n) for n in ("action", "leader_stats", "set_numbers", "picks", "bounds_lt", "bounds_gt", "rates", "days", "months", "years")]
    return F.array_sort(F.array_distinct(F.concat(*marks)))


def with_contract(markets: DataFrame) -> DataFrame:
    """``markets`` (label, event, question, close) with the struct ``contract``."""
    fields = [F.col(c) for c in ("label", "event", "question")]
    text = features.snapshot_text(*fields)
    rows = markets.withColumn("_text", text).withColumn("_low", features.ascii_lower(F.col("_text")))
    rows = rows.withColumn("_spec", features.spec(F.col("_text"), F.col("_low")))
    low, text, label = F.col("_low"), F.col("_text"), F.coalesce("label", F.lit(""))
    flags = {f"{side}{i}": low.rlike(p) for i, pair in enumerate(ANTONYMS) for side, p in zip(("no", "yes"), pair, strict=True)}
    flags |= {"weather": low.rlike(WEATHER), "succession": low.rlike(SUCCESSION), "down": low.rlike(DOWN), "best": low.rlike(BEST) & ~low.rlike(AWARDS), "emergency": low.rlike(r"\bemergency\b"), "dollars": F.contains(low, F.lit("$"))}
    flags |= {"rates": low.rlike(RATES), "raised": low.rlike(RAISED), "cut": low.rlike(CUT)}
    flags |= {"removal": low.rlike(r"\bremov(?:ed|al)\b"), "plain_win": low.rlike(r"\b(?:wins?|winner|champions?)\b")}
    names = F.array_distinct(F.concat(*(_names(f) for f in fields)))
    number = r"(-?\d{1,2}(?:\.\d+)?)\s*%?\s*(?:to|[-–—])\s*(-?\d{1,2}(?:\.\d+)?)(?!\d)"
    ends = [F.regexp_extract(low, r"(?<![\d-])" + number, i).try_cast("double") for i in (1, 2)]
    contract = F.struct(
        F.col("_spec").alias("spec"), _tokens(text).alias("tokens"), F.coalesce(F.col("event"), F.lit("")).alias("event"), features.squash(F.col("event")).alias("event_key"), _tokens(F.col("event")).alias("event_tokens"),
        features.label_key(label).alias("label_key"), label.alias("label"), _tokens(label).alias("label_tokens"), names.alias("names"), F.array_distinct(F.concat(*map(_winner, fields))).alias("winner"), _beats(text).alias("beats"), F.array_distinct(F.concat(names, _capitals(text))).alias("entities"),
        features.threshold(text).alias("bound"), settlement(low).alias("settles"), F.when(ends[0].isNotNull() & ends[1].isNotNull(), F.struct(F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi"))).alias("range"),
        signature(F.col("_spec")).alias("signature"), F.col("close").cast("timestamp").alias("close"), *(v.alias(k) for k, v in flags.items()),
    )
    return rows.withColumn("contract", contract).drop("_text", "_low", "_spec")


def hours_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a["close"]) - F.unix_micros(b["close"])) / 3.6e9


def same_label(a: Column, b: Column) -> Column:
    """Equal labels of three letters or more, parentheses left out."""
    return (a["label_key"] == b["label_key"]) & (F.length(a["label_key"]) >= 3)


def same_event(a: Column, b: Column) -> Column:
    return (a["event_key"] == b["event_key"]) & (a["event_key"] != "")


def events_agree(a: Column, b: Column) -> Column:
    """Do two events' titles say the same? A missing one does not speak against it."""
    x, y = a["event_key"], b["event_key"]
    as_winner = lambda t: F.array_distinct(F.transform(t, lambda w: F.when(w.isin("champion", "champions"), "winner").otherwise(w)))
    return (x == "") | (y == "") | (jaccard(as_winner(a["event_tokens"]), as_winner(b["event_tokens"])) >= 0.45) | F.contains(x, y) | F.contains(y, x)


def complement(a: Column, b: Column) -> Column:
    """Bounds of one level and opposite directions, of which one is touched and the other held: one is true exactly when the other is not."""
    x, y = a["bound"], b["bound"]
    level = F.abs(x["value"] - y["value"]) / F.greatest(F.abs(x["value"]), F.abs(y["value"]), F.lit(1.0)) <= 0.001
    path = ((a["settles"] == "touch") & (b["settles"] == "hold")) | ((a["settles"] == "hold") & (b["settles"] == "touch"))
    return F.coalesce((x["unit"] == y["unit"]) & (x["up"] != y["up"]) & level & path, F.lit(False))


def opposite_states(a: Column, b: Column) -> Column:
    """One side states the negative, the other the positive state of a pair of cues, neither both."""
    found = F.lit(False)
    for i in range(len(ANTONYMS)):
        no, yes = f"no{i}", f"yes{i}"
        found = found | (a[no] & b[yes] & ~a[yes] & ~b[no]) | (b[no] & a[yes] & ~b[yes] & ~a[no])
    return found


def inverted_pair(a: Column, b: Column) -> Column:
    """Is YES of one contract NO of the other? Read from the texts alone, never from prices."""
    return complement(a, b) | opposite_states(a, b)


def close_exempt(a: Column, b: Column) -> Column:
    """Pairs whose closes may lie any time apart: sports, successions of one name, near-equal titles, and equal events with equal labels."""
    sports = (F.size(a["spec"]["league"]) > 0) | (F.size(b["spec"]["league"]) > 0) | F.array_contains(a["spec"]["domains"], "sports") | F.array_contains(b["spec"]["domains"], "sports")
    return sports | (same_label(a, b) & a["succession"] & b["succession"]) | (jaccard(a["tokens"], b["tokens"]) >= ALIKE) | (same_event(a, b) & same_label(a, b))


def close_compatible(a: Column, b: Column, most: float = MOST_HOURS) -> Column:
    """Do the closes allow one contract? Beyond ``most`` hours only those that are exempt."""
    return F.coalesce(hours_apart(a, b) <= most, F.lit(True)) | close_exempt(a, b)


def settlement_risk(a: Column, b: Column) -> Column:
    """Why the same event may settle differently on two venues, or null."""
    limited = lambda s: s["spec"]["deadline"].isNotNull()
    return (
        F.when(a["weather"] | b["weather"], "weather: venues may settle on different stations").when(limited(a) != limited(b), "horizon: only one venue has a deadline")
        .when(hours_apart(a, b) > MOST_HOURS, "horizon: venue deadlines differ by more than a year")
    )


def _person(names: Column) -> Column:
    return F.filter(F.transform(names, lambda n: F.split(n, " ")), lambda t: F.size(t) == 2)


def _different_label(a: Column, b: Column) -> Column:
    """Both labels are names, and not variants of one: neither holds the other, no shared pair of words of which one is part."""
    shape = r"^[A-Z][\w'’.-]*(?: [A-Z][\w'’.-]*)+(?: [(].*[)])?$"
    la, lb, ta, tb = a["label_key"], b["label_key"], a["label_tokens"], b["label_tokens"]
    shared = F.size(F.array_intersect(ta, tb))
    part = (shared >= 2) & ((shared == F.size(ta)) | (shared == F.size(tb)))
    named = a["label"].rlike(shape) & b["label"].rlike(shape) & (F.length(la) >= 5) & (F.length(lb) >= 5)
    return named & ~F.contains(la, lb) & ~F.contains(lb, la) & ~features.same_person(a["label"], b["label"]) & ~part


def decide(a: Column, b: Column, least: float = LEAST) -> Column:
    """Struct (match, inverted, confidence, reasons, risk, eligible) of two contracts.

    A rejection has one reason, the first that holds; an acceptance has all its
    grounds. ``eligible`` pairs also settle on the same marks and name the same
    entities; a risk does not reject.
    """
    sim, label, event = jaccard(a["tokens"], b["tokens"]), same_label(a, b), same_event(a, b)
    near = F.coalesce(hours_apart(a, b) <= HORIZON, F.lit(False))
    agree, turned, flipped = events_agree(a, b), complement(a, b), opposite_states(a, b)
    shared = F.arrays_overlap(a["entities"], b["entities"])
    inverted = turned | (flipped & (shared | (sim >= least)))
    x, y = a["bound"], b["bound"]
    equal = F.coalesce(features.threshold_equal(x, y) & (x["up"] == y["up"]), F.lit(False))
    rule = lambda names, unless=F.lit(False): [F.when(fires(_BY_NAME[r.name], a["spec"], b["spec"]) & ~unless, F.lit(r.name)) for r in CONFLICTS if r.name in names]
    others = frozenset(_BY_NAME) - GUARDS - TIMES - NUMBERS
    guards = F.coalesce(*rule(GUARDS, turned))
    people = [_person(s["names"]) for s in (a, b)]
    firsts, lasts = [F.transform(p, lambda t: t[0]) for p in people], [F.transform(p, lambda t: t[1]) for p in people]
    collision = F.arrays_overlap(*firsts) & ~F.arrays_overlap(*lasts)
    gap = F.abs(F.get(a["spec"]["years"], F.lit(0)).cast("int") - F.get(b["spec"]["years"], F.lit(0)).cast("int"))
    year_apart = (F.size(a["spec"]["league"]) > 0) & (F.size(b["spec"]["league"]) > 0) & (gap == 1)
    dollars = a["dollars"] | b["dollars"]
    ra, rb = a["range"], b["range"]
    positive = lambda s: F.coalesce(s["range"]["lo"], F.when(s["bound"]["up"], s["bound"]["value"])) > 0
    rungs = [F.transform(s["spec"]["rungs"], lambda v: v.cast("double")) for s in (a, b)]
    rungs_apart = (F.size(rungs[0]) > 0) & (F.size(rungs[1]) > 0) & ~F.exists(rungs[0], lambda v: F.exists(rungs[1], lambda w: F.abs(v - w) <= 1))
    rounds = [s["spec"]["runoff"] for s in (a, b)]
    one_round = ~F.arrays_overlap(*rounds) & ((F.size(rounds[0]) > 0) | (F.size(rounds[1]) > 0))
    plain = F.when(F.size(rounds[0]) > 0, b["plain_win"]).otherwise(a["plain_win"])
    bare = lambda s, t: (F.size(s["label_tokens"]) > 0) & (F.size(s["label_tokens"]) <= 5) & ~s["label"].rlike(r"\d") & ~F.arrays_overlap(s["label_tokens"], F.array(*map(F.lit, SHAPING))) & (F.size(F.array_intersect(s["label_tokens"], t["tokens"])) >= 0.6 * F.size(s["label_tokens"]))
    ranks = [s["spec"]["ranks"] for s in (a, b)]
    odd_rank = ~F.arrays_overlap(*ranks) & ((F.size(ranks[0]) > 0) | (F.size(ranks[1]) > 0))
    occurs = [s["spec"]["occurrence"] for s in (a, b)]
    recession = lambda s: F.array_contains(s["tokens"], "recession") & ~F.exists(s["tokens"], lambda w: F.startswith(w, F.lit("declare")))
    rejected = F.coalesce(
        *rule(others),
        F.when(_different_label(a, b), "different named outcome"),
        F.when(~label & (F.size(a["names"]) > 0) & (F.size(b["names"]) > 0) & ~features.names_overlap(a["names"], b["names"]), "different names"),
        F.when(~label & collision, "different person: shared first name"),
        F.when(~label & (F.size(a["winner"]) > 0) & (F.size(b["winner"]) > 0) & ~features.names_overlap(a["winner"], b["winner"]), "different winner"),
        F.when((a["beats"] != b["beats"]) & (a["beats"] == F.reverse(b["beats"])), "reversed head-to-head"),
        F.when(a["beats"] != b["beats"], "different head-to-head"),
        F.when(a["rates"] & b["rates"] & ((a["raised"] & ~a["cut"] & b["cut"] & ~b["raised"]) | (a["cut"] & ~a["raised"] & b["raised"] & ~b["cut"])), "raise vs cut"),
        F.when(a["emergency"] != b["emergency"], "emergency on one side only"),
        F.when(a["removal"] != b["removal"], "removal on one side only"),
        *rule(TIMES & {"year", "deadline year"}, near | year_apart),
        *rule(TIMES - {"year", "deadline year"}, near | dollars),
        F.when((ra["hi"] <= rb["lo"] + 1e-9) | (rb["hi"] <= ra["lo"] + 1e-9), "numeric range"),
        F.when((a["down"] != b["down"]) & F.when(a["down"], positive(b)).otherwise(positive(a)), "negative vs positive"),
        F.when(x.isNotNull() & y.isNotNull() & ~equal & ~turned, "threshold"),
        F.when(a["dollars"] & b["dollars"] & ~turned & (a["settles"].isNull() != b["settles"].isNull()), "settlement shape"),
        *rule(NUMBERS - {"settlement", "direction"}, inverted | (x.isNotNull() & y.isNotNull())),
        F.when(rungs_apart, "rung"),
        F.when(~event & (a["best"] != b["best"]), "superlative vs plain win"),
        F.when(~event & one_round & plain, "round scope"),
        F.when(~event & (occurs[0] != occurs[1]) & recession(a) & recession(b), "deadline vs period"),
        F.when(~event & ~agree & (bare(a, b) | bare(b, a)) & odd_rank, "rank on a bare name"),
    )
    shared_name = F.exists(F.array_intersect(a["names"], b["names"]), lambda n: F.contains(n, F.lit(" ")))
    single = lambda s, t: (F.size(s["label_tokens"]) == 1) & F.exists(t["names"], lambda n: F.arrays_overlap(F.split(n, " "), s["label_tokens"]))
    grounds = F.array_compact(F.array(
        F.when(turned, "complementary bounds"), F.when(flipped & inverted & ~turned, "opposite states"), F.when(equal, "equal bounds"), F.when(label & agree & (F.length(a["label_key"]) >= 4) & ~inverted, "equal labels"),
        F.when(sim >= least, "similar"), F.when((equal | turned) & shared & near, "equal bounds, shared entity, one horizon"), F.when(shared_name & shared & near & (sim >= 0.25), "shared name, one horizon"),
        F.when((single(a, b) | single(b, a)) & near & (sim >= 0.15), "one name, one horizon"),
    ))
    enough = F.exists(grounds, lambda g: ~g.isin("complementary bounds", "opposite states", "equal bounds"))
    best = F.when(F.exists(grounds, lambda g: ~g.isin("complementary bounds", "opposite states", "equal bounds", "similar")), F.greatest(sim, F.lit(0.5))).otherwise(sim)
    both = event & label
    reasons = (
        F.when(guards.isNotNull(), F.array(guards)).when(both, F.array(F.lit("equal event and label"))).when(rejected.isNotNull(), F.array(rejected))
        .when(enough, grounds).otherwise(F.array(F.lit("too unlike")))
    )
    match = guards.isNull() & (both | (rejected.isNull() & enough))
    eligible = match & (F.size(a["signature"]) > 0) & (a["signature"] == b["signature"]) & (F.array_sort(a["entities"]) == F.array_sort(b["entities"]))
    return F.struct(
        match.alias("match"), (match & inverted & ~both).alias("inverted"), F.when(match & both, 1.0).when(match, best).when(guards.isNull() & rejected.isNull(), sim).otherwise(0.0).alias("confidence"),
        reasons.alias("reasons"), settlement_risk(a, b).alias("risk"), eligible.alias("eligible"),
    )


def decide_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """``pairs`` (id_a, id_b) of markets (id, label, event, question, close) with ``decision`` and ``close_ok``."""
    # Reading and deciding cost far more than a row's bytes tell, so that all partitions are kept, however little they hold.
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    a, b = (with_contract(s.repartition(parts, "id")).select(F.col("id").alias(f"id_{n}"), F.col("contract").alias(f"_{n}")) for s, n in ((left, "a"), (right, "b")))
    pairs = pairs.repartition(parts, "id_a")
    # A contract is far larger than its columns' types tell Spark, so that no side may be broadcast on its word.
    rows = pairs.join(a.hint("merge"), "id_a").repartition(parts, "id_b").join(b.hint("merge"), "id_b")
    return rows.withColumns({"decision": decide(F.col("_a"), F.col("_b"), least), "close_ok": close_compatible(F.col("_a"), F.col("_b"))}).drop("_a", "_b")
