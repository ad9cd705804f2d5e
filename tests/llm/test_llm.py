"""Training-data operators against brute force on small tables, with edge cases."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinbook.llm import audio, cap_filters, html_text, jaccard_join, packing, queries, repeated_spans, rule_quality, sentencepieces, url_rules, warc
from twinbook.llm.common import components
from tests.conftest import DATA
from tests.test_queries import canonical, duck  # noqa: F401

SF = f"{DATA}/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, key string, node int, removed int"


def docs_of(spark, texts):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    assert canonical(queries.QUERIES[name](spark, SF).toPandas()) == canonical(duck.execute(queries.ORACLE_SQL[name]).df())


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (None, 1), (7, 7), (50, 40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40, 60: 40}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(rng, n):
    return [f"w{rng.integers(400)}" for _ in range(n)]


def jaccard_brute(texts, share=75):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_jaccard_join(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", " \t\n", "One two", "one TWO", "one two three four five", "x" * 5000]
    line = words(rng, 12)
    for _ in range(6):
        base = words(rng, int(rng.integers(8, 90)))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[rng.integers(len(copy))] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(copy))
        texts.append(" ".join([*words(rng, 10), *line]))
    texts += texts[8:11]
    df = docs_of(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == jaccard_brute(texts)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}
    assert jaccard_join.jaccard_classes(df.limit(0)).count() == 0


def test_keep_one_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(8)
    a, b, c, d, e = (" ".join(words(rng, 40)) for _ in range(5))
    near = lambda t: t + " end"
    rows = [(1, a), (5, near(a)), (5, b), (None, c), (None, c), (None, near(c)), (None, d), (7, near(d)), (9, e), (9, e), (None, None), (None, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    of_c = [t for t in (c, near(c)) if got[None, t]]
    assert len(of_c) == 1
    assert got == Counter([(1, a), (5, b), (None, of_c[0]), (7, near(d)), (9, e), (None, None), (None, "")])


def spans_brute(texts, length):
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        hit = np.zeros(len(b) + 2, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i + 1 : i + length + 1] = 1
        edge = np.flatnonzero(np.diff(hit))
        out.append([(int(s), int(e)) for s, e in zip(edge[::2], [*edge[1::2], len(b)], strict=False)])
    return out


def test_repeated_spans(spark):
    rng = np.random.default_rng(8)
    letter = lambda n: "".join(rng.choice(list("abcdeé "), n))
    shared = [letter(90), letter(140), letter(61)]
    texts = [None, "", "short", letter(300), "a" * 200, "a" * 61, "ab" * 100]
    texts += [letter(int(rng.integers(0, 80))) + shared[i % 3] + letter(int(rng.integers(0, 80))) + (shared[1][20:] if i % 2 else "") for i in range(14)]
    texts += [texts[3], texts[9]]
    df = docs_of(spark, texts)
    rows = repeated_spans.with_removed(df.drop("removed"), length=60).orderBy("doc_id")
    got = [[(r["start"], r["end"]) for r in row["removed"]] for row in rows.collect()]
    assert got == spans_brute(texts, 60)
    kept = rows.select(repeated_spans.kept_bytes(F.col("text"), F.col("removed")).alias("b"), repeated_spans.kept_text(F.col("text"), F.col("removed")).alias("t")).collect()
    for text, runs, row in zip(texts, got, kept, strict=True):
        mask = np.ones(len((text or "").encode()), bool)
        for s, e in runs:
            mask[s:e] = False
        assert bytes(row["b"]) == np.frombuffer((text or "").encode(), np.uint8)[mask].tobytes()
        assert len(row["t"].encode()) >= len(row["b"])
    assert repeated_spans.with_removed(df.limit(0), length=60).count() == 0


def test_cap_filters(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((200, 16))
    near = base[:60] + 0.03 * rng.standard_normal((60, 16))
    x = np.concatenate([base, near, base[:10], 3 * base[10:12]])
    rows = [(i, [float(v) for v in e], int(i % 3 == 0) if i < 200 else int((i - 200) % 60 % 3 == 0)) for i, e in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, [None, *rows[0][1][1:]], 1), (None, rows[0][1], 1), (905, [], 1), (906, [1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in cap_filters.cosine_classes(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    assert [got[i]["n_links"] for i in range(len(x))] == linked.sum(1).tolist()
    for i in range(len(x)):
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    for i in range(900, 907):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("b.com", "/", "block"), ("a.b.com", "/x", "allow"), ("b.com", "/x/y", "block"), ("", "/", "block"), (None, "/", "block")]
    urls = ["http://A.b.com/x/y?q", "http://a.b.com/z", "https://bb.com/x", "http://com/", "http://b.com", "nothing", None, "x://a.b.com#f/x", "http://c.b.com/x/y", "http:///", "http://b.com./x"] * 2
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, row string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=3).collect()}
    for i, u in enumerate(urls):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert got[i] == (host, path, best[2], best[3]), u
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0


def test_audio():
    x = bytes(range(256)) * 3
    rate, back = audio.from_wav(audio.to_wav(x + b"\1"))
    assert (rate, bytes(back)) == (audio.RATE, x + b"\1")
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFFxxxx")
    tone = (128 + 100 * np.sin(np.arange(40000) * 2 * np.pi * 1000 / audio.RATE)).astype(np.uint8)
    tone[15000:25000] = 128
    f = audio.clip_features(audio.to_wav(tone.tobytes()))
    assert f["patches"][0]["start"] == 0 and f["patches"][-1]["end"] == f["seconds"] == 5.0
    assert all(len(p["values"]) == audio.PATCH * audio.BANDS for p in f["patches"])
    tensor = audio.patch_tensor([bytes(audio.PATCH * audio.BANDS) for _ in f["patches"]])
    assert tensor.type.shape == [audio.PATCH, audio.BANDS] and len(tensor) == len(f["patches"])
    assert audio.clip_features(audio.to_wav(b""))["patches"] == []
    long_ = np.random.default_rng(1).integers(0, 256, 2 * audio.PIECE * audio.DOWN + 12345, np.uint8)
    whole = audio.resample(long_.astype(np.float32) / 128 - 1)
    pieces = np.concatenate([audio._resampled_piece(long_, at) for at in range(0, len(long_), audio.PIECE * audio.DOWN)])
    assert np.allclose(whole, pieces, atol=1e-5)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""),
        ("<nav><a href=x>menu</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three <b>four</b><p>five</article><footer>f</footer>", "T & U\n\nOne two three four\n\nfive"),
        ('<body><div class="cookie-notice">We use cookies.</div><main><p>Body text</p><aside>see also</aside><form>mail<input></form><div id="comments"><p>nice post and many more words here</p></div></main>', "Body text"),
        ("<article><p>a<script>var x='</p>';</script>b</p><style>p{}</style><p>c &am", "ab\n\nc &am"),
        ("<article><header><h1>Head</h1></header><p>x</p></article><header>site</header>", "Head\n\nx"),
        ("<article><p>open <b", "open"),
    ],
)
def test_html_text(html, want):
    assert html_text.main_text(html) == want


ARTICLE = "<article><h1>T</h1><p>Body</p></article>"
LONG = "Many words that make a sentence of an article. " * 4


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<body class="single has-sidebar">{ARTICLE}', "T\n\nBody"),
        (f'<body class="sidebar">{ARTICLE}<div class="sidebar"><p>{LONG}</p></div>', "T\n\nBody"),
        ('<div class="content-sidebar-wrap"><main><p>Body</p></main><div class="sidebar"><p>more</p></div></div>', "Body"),
        ('<main class="with-sidebar"><p>Body</p></main>', "Body"),
        (f'<form id="f"><nav>menu</nav>{ARTICLE}<footer>f</footer></form>', "T\n\nBody"),
        (f'<form><nav>menu</nav><div id="content"><p>Body</p></div><p>{LONG}</p></form>', f"Body\n\n{LONG.strip()}"),
        (f"<body><form><p>{LONG}</p></form>", LONG.strip()),
        (f'{ARTICLE}<form><div class="form-content"><p>{LONG}</p></div></form>', "T\n\nBody"),
        ('<article><div class="article-header"><h1>T</h1></div><header class="entry-header">U</header><p>Body</p></article>', "T\n\nU\n\nBody"),
        (f"<nav>menu{ARTICLE}", "T\n\nBody"),
        ('<article class="post tag-social"><p>Body</p></article>', "Body"),
        (f'{ARTICLE}<div id="comments"><article class="comment-body"><p>{LONG}</p></article></div><aside>{ARTICLE}</aside>', "T\n\nBody"),
        (f"<head><title>t</title><body>{ARTICLE}", "T\n\nBody"),
        (f"<html><head><meta charset=x><title>t</title><style>p{{}}</style><script>'</head>'</script>{ARTICLE}", "T\n\nBody"),
    ],
)
def test_html_text_keeps_whole_articles(html, want):
    assert html_text.main_text(html) == want


@pytest.mark.parametrize("wide", [False, True])
def test_zip_packages(wide):
    members = [("a/b.txt", b"x" * 300), (warc.MEMBERS[0], b"\0\1\2" * 50), ("é", b"")]
    blob = warc.zip_package(members, zip64=wide)
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == members
    read = lambda offset, length: blob[offset : offset + length]
    found = warc.zip_members(read, len(blob))
    assert {n: read(o, k) for n, (o, k, _) in found.items()} == dict(members)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z, z.open(zipfile.ZipInfo("m"), "w", force_zip64=True) as f:
        f.write(b"payload")
    raw = other.getvalue()
    at, size, method = warc.zip_members(lambda o, k: raw[o : o + k], len(raw))["m"]
    assert (raw[at : at + size], method) == (b"payload", 0)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ü\n", "x" * 1000), (2, None, "x" * 1000), (3, "u", "y"), (4, "u", "y"), (5, "u", None), (None, "u", "x" * 1000), (2, "v", "x" * 1000)]
    warc.write_packages(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_packages(spark, f"{tmp_path}/w").collect())
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    x = sha("x" * 1000)
    assert got == Counter([(1, 1000, x, "revisit", 2), (2, 1000, x, "response", None), (2, 1000, x, "response", None), (None, 1000, x, "revisit", 2), (3, 1, sha("y"), "response", None), (4, 1, sha("y"), "response", None), (5, 0, sha(""), "response", None)])


def brute_padding(lengths, buckets):
    levels = sorted(set(lengths))
    best = {0: 0}
    cost = lambda i, j: sum(levels[j - 1] - x for x in lengths if (levels[i - 1] if i else -1) < x <= levels[j - 1])
    best = [0] + [float("inf")] * len(levels)
    for _ in range(buckets):
        best = [0] + [min([best[j], *(best[i] + cost(i, j) for i in range(j))]) for j in range(1, len(levels) + 1)]
    return best[-1]


def test_packing(spark):
    rng = np.random.default_rng(6)
    for buckets in (1, 2, 4, 30):
        lengths = rng.integers(0, 40, 60)
        values, counts = np.unique(lengths, return_counts=True)
        ends = packing.optimal_boundaries(values, counts, buckets)
        assert len(ends) <= buckets and ends[-1] == lengths.max()
        assert sum(min(e for e in ends if e >= x) - x for x in lengths) == brute_padding(lengths.tolist(), buckets)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 50, 80)] + [None, "", " \n"]
    rows = packing.pack(docs_of(spark, texts), packing.word_count(F.col("text")), buckets=3, budget=100).toPandas()
    assert sorted(rows.doc_id) == list(range(len(texts)))
    assert rows.n_tokens.tolist() == [len((texts[i] or "").split()) for i in rows.doc_id]
    for _, b in rows.groupby(["bucket", "batch"]):
        assert sorted(b.slot) == list(range(len(b))) and len(b) * b.bucket_tokens.iloc[0] <= 100 and (b.n_tokens <= b.bucket_tokens).all()
    assert packing.pack(docs_of(spark, texts).limit(0), packing.word_count(F.col("text"))).count() == 0


def test_sentencepieces(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    texts = ["", " ", "  a  b ", "a\nb\n\nc", "日本語 é́ ﬁ ２", "\0x", "hello▁world", "x" * 400 + " " + "ab" * 300, "don't stop-believing 12345 🙂", "the the  there"]
    bpe, lib = sentencepieces.PieceModel.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = bpe.encode([*texts, None])
    assert ids.to_pylist() == [*(lib.encode(t) for t in texts), None]
    assert bpe.decode(ids) == [*(lib.decode(i) for i in ids.to_pylist()[:-1]), None]
    # The same pieces as a unigram model, whose best path Viterbi finds.
    proto = pb.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # the library adds scores in single precision
        p.score = max(p.score, -40000.0) / 64
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    uni, lib = sentencepieces.PieceModel.load(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    plain = ["hello world of equal words", "there is nothing", "tokenisation by viterbi advances together", "  deep   spaces"]
    score = lambda ids: sum(uni.scores[i] for i in ids)
    for t, ids in zip(plain, uni.encode(plain).to_pylist(), strict=True):
        assert score(ids) == pytest.approx(score(lib.encode(t))) and lib.decode(ids) == t
    assert pa.types.is_list(uni.encode([]).type)


def test_quality_rules(spark):
    got = queries.QUERIES["op1_quality_rules"](spark, f"{DATA}/sf0.01").toPandas()
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert got.score.between(0, 1).all() and (held.predicted == held.quality).mean() > 0.95
    docs = docs_of(spark, [None, "", "Some text here."])
    none = rule_quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [r["score"] for r in none] == [0.5] * 3
    assert rule_quality.keep_good(docs, spark.createDataFrame([(0, 0), (1, None)], "doc_id long, quality int")).columns == docs.columns


def test_pipeline(spark, small_table):
    """run() against brute force, the classifier's decisions taken as given."""
    import corpus_pipeline

    rng = np.random.default_rng(21)
    prose = lambda n: " ".join(f"{w}{rng.integers(3000)}" for w in rng.choice(["alpha", "beta", "gamma", "delta"], n))
    passage = prose(60)
    texts = []
    for i in range(60):
        t = prose(int(rng.integers(20, 120)))
        texts.append(f"{t} {passage} {prose(30)}" if i % 10 == 0 else t)
    texts += [texts[3], texts[4] + " end", texts[5].upper(), None, ""]
    texts += [f"BUY NOW!!! {i} $$$ click click http://x.y/{i} !!! free free" for i in range(30)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sf = small_table("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    small_table("labels", [(i, int(i < 65)) for i in range(len(rows)) if i % 2 or i > 60], "doc_id long, quality int")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, sf).orderBy("doc_id").collect()
    scored = {r["doc_id"]: r["predicted"] for r in rule_quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert [r["doc_id"] for r in good] == [i for i in range(len(rows)) if scored[i] == 1] and len(good) >= 55

    root = jaccard_brute([r["text"] for r in good])
    kept = [r for i, r in enumerate(good) if not root[i][0] or root[i][1] == i]
    near = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(good, docs.schema), sf)
    assert sorted(r["doc_id"] for r in near.collect()) == [r["doc_id"] for r in kept] and len(kept) < len(good)

    spans = spans_brute([r["text"] for r in kept], 200)
    want = {}
    for r, runs in zip(kept, spans, strict=True):
        raw, at = (r["text"] or "").encode(), 0
        parts = []
        for s, e in runs:
            parts.append(raw[at:s])
            at = e
        want[r["doc_id"]] = b"".join([*parts, raw[at:]]).decode() if runs else r["text"]
    assert any(spans)
    cut = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(kept, docs.schema), sf)
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == want

    packed = corpus_pipeline.run(spark, sf).toPandas()
    lengths = {i: len((t or "").split()) for i, t in want.items()}
    assert dict(zip(packed.doc_id, packed.n_tokens, strict=True)) == lengths
    assert int((packed.bucket_tokens - packed.n_tokens).sum()) == brute_padding(list(lengths.values()), packing.BUCKETS)
    assert not packed.duplicated(["bucket", "batch", "slot"]).any()


def test_repeated_spans_of_production_length(spark, monkeypatch):
    """200 bytes, a text beyond one chunk, own columns of inner names, by broadcasts and by shuffles."""
    rng = np.random.default_rng(31)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, long_ = letters(450), letters(700_000)
    texts = [letters(300) + shared + letters(90), letters(50) + shared[100:], shared[:199], shared[:200], letters(900), "z" * 1000, long_ + shared[:300], long_[:250] + letters(100), None]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in enumerate(texts)], "doc_id int, text string, _row int, _key int, _removed int, doc int")
    want = spans_brute([t if i != 6 else None for i, t in enumerate(texts)], 200)
    for limit in (repeated_spans.BROADCAST_ROWS, 0):
        monkeypatch.setattr(repeated_spans, "BROADCAST_ROWS", limit)
        out = repeated_spans.with_removed(df)
        assert out.columns == [*df.columns, "removed"]
        got = [[(r["start"], r["end"]) for r in row["removed"]] for row in out.orderBy("doc_id").collect()]
        # The long text meets the others in its first 250 bytes and its last 300.
        assert got[6] == [(0, 250), (700_000, 700_300)] and got[7] == [(0, 250)]
        assert [got[i] for i in (0, 1, 2, 3, 4, 5, 8)] == [want[i] for i in (0, 1, 2, 3, 4, 5, 8)]


LINKS = "".join(f"<div><a href='/{i}'>Topic {i}</a></div>" for i in range(4))


def test_html_pages(spark):
    """Layouts without an article element: neighbours decide."""
    pages = {
        "<body><p>Short one.</p></body>": "Short one.",
        "<body><h1>Title</h1><p>Hello there.</p><p>Bye.</p></body>": "Title\n\nHello there.\n\nBye.",
        f"<body>{LINKS}<h1>The title</h1><p>{LONG}</p><p>Short.</p>{LINKS}</body>": f"The title\n\n{LONG.strip()}\n\nShort.",
        f"<div>{LINKS}</div><h2><a href=u>Linked head</a></h2><p>By Ann</p><p>{LONG}</p>": f"By Ann\n\n{LONG.strip()}",
        f"<h2><a href=u>Linked head</a></h2><p>By Ann</p><p>{LONG}</p><p><a href=s>Source</a></p><p>{LONG}</p>": f"Linked head\n\nBy Ann\n\n{LONG.strip()}\n\nSource\n\n{LONG.strip()}",
        f"<table><tr><td>{LINKS}</td><td><h1>T</h1><p>{LONG}<a href=x>more</a></p></td></tr></table>": f"T\n\n{LONG} more".replace(".  more", ". more"),
        "<main><p>&lt;b&gt; &eacute;&#233;&#xe9; &nbsp;x</p></main>": "<b> ééé x",
    }
    rows = [(i, h, "own", 5, "kept") for i, h in enumerate([*pages, None, "", f"<p>{'word ' * 200_000}</p>", *list(pages)[:2]])]
    got = html_text.with_text(spark.createDataFrame(rows, "page_id int, html string, text string, n_chars int, kind string"))
    assert got.columns == ["page_id", "html", "kind", "text", "n_chars"]
    texts = [r["text"] for r in got.orderBy("page_id").collect()]
    n = len(pages)
    assert texts[:n] == list(pages.values())
    assert texts[n : n + 2] == ["", ""] and texts[n + 2] == ("word " * 200_000).strip() and texts[n + 3 :] == texts[:2]
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert html_text.with_text(got.limit(0)).count() == 0


def test_html_tree_asks_neighbours():
    """Both neighbours' words and link density decide somewhere in the tree."""
    def asked(node):
        return set() if isinstance(node, int) else {node[0]} | asked(node[2]) | asked(node[3])

    assert {0, 1, 2, 3, 5} <= asked(html_text.tree())


def test_sentencepieces_of_all_documents(spark):
    """Both columns against the library, with long units, nulls, an own column of the output's name and no rows."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = sentencepieces.PieceModel.load(MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("ids"), F.lit("x").alias("row"))
    odd = [(-1, None), (-2, ""), (-3, "ab" * 3000), (-4, "日本語" * 500 + " x"), (-5, "🙂" * 70), (-6, "a" * 65), (-6, "a" * 65)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, 1, "x") for i, t in odd], docs.schema))
    got = sentencepieces.decode_column(sentencepieces.encode_column(docs, model), model)
    assert got.columns == ["doc_id", "text", "row", "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == (None if r["text"] is None else lib.encode(r["text"])), r["doc_id"]
        assert r["decoded"] == (None if r["text"] is None else lib.decode(r["ids"]))
    assert sentencepieces.encode_column(docs.limit(0), model).count() == 0


def test_jaccard_join_of_names_that_clash(spark, monkeypatch):
    """Sets whose 64-bit names are equal are told apart by the other half of the hash; long and short texts, groups of near copies."""
    rng = np.random.default_rng(12)
    name = jaccard_join._name

    base = words(rng, 60)
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 60, 3)] * 2 + [" ".join(words(rng, 20_000))] * 2 + ["a b c d e", "a b c d", "a b c d e f"]
    df = docs_of(spark, texts)
    want = jaccard_brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == want
    assert name(np.arange(3, dtype=np.uint64), frozenset({name(np.arange(3, dtype=np.uint64))[0]})) == name(np.arange(3, dtype=np.uint64))[::-1]
    monkeypatch.setattr(jaccard_join, "BROADCAST_NODES", 0)  # everything by shuffles
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(df).collect()}
    assert got == want


def test_met_keeps_what_two_nodes_share():
    """Across batches, with repeated rows and frequent n-grams."""
    rng = np.random.default_rng(3)
    t = np.sort(np.concatenate([rng.integers(0, 40, 200), np.array([jaccard_join.RANKED + 1] * 3)]))
    node = rng.integers(0, 4, len(t))
    cols = lambda i, j: pa.RecordBatch.from_arrays([pa.array(t[i:j]), pa.array(node[i:j]), pa.array(node[i:j].astype(np.int32)), pa.array(np.arange(i, j, dtype=np.int32))], ["t", "node", "n", "pos"])
    several = {x for x in set(t.tolist()) if len(set(node[t == x].tolist())) > 1 or x > jaccard_join.RANKED}
    for step in (1, 2, 7, 1000):
        out = [r for b in jaccard_join._met([cols(i, min(i + step, len(t))) for i in range(0, len(t), step)]) for r in b.to_pylist()]
        assert len({r["pos"] for r in out}) == len(out)
        assert {(r["t"], r["node"]) for r in out} == {(a, b) for a, b in zip(t.tolist(), node.tolist()) if a in several}


def test_packing_is_exact_and_keeps_names(spark):
    """Lengths beyond any limit, repeated rows, columns named like the outputs."""
    lengths = np.array([1, 5, 70_000, 70_001, 70_003, 200_000, 200_001])
    ends = packing.optimal_boundaries(lengths, np.ones(7, int), 4)
    assert sum(min(e for e in ends if e >= x) - x for x in lengths) == brute_padding(lengths.tolist(), 4)
    df = spark.createDataFrame([(1, 4, "b", 9)] * 50 + [(2, 7, "b", 9), (None, None, "b", 9)], "doc_id int, n int, bucket string, _shard int")
    out = packing.pack(df, F.coalesce("n", F.lit(0)), buckets=2, budget=21)
    assert out.columns == ["doc_id", "n", "_shard", "n_tokens", "bucket", "bucket_tokens", "batch", "slot"]
    rows = out.toPandas()
    assert len(rows) == 52 and not rows.duplicated(["bucket", "batch", "slot"]).any()


def test_audio_against_direct_sums():
    """Resampling against the sum over the upsampled signal, frames against one whole transform, for clips of any length."""
    rng = np.random.default_rng(7)
    phases = audio._FILTER[:, ::-1]
    h = np.zeros(phases.size)
    for p in range(audio.UP):
        h[p :: audio.UP] = phases[p]
    for n in (1, 2, 3, 50, 191, 192, 1000):
        x = rng.standard_normal(n).astype(np.float32)
        up = np.zeros(n * audio.UP)
        up[:: audio.UP] = x
        full = np.convolve(up, h)[(len(h) - 1) // 2 :][:: audio.DOWN]
        want = np.concatenate([full, np.zeros(4)])[: -(-n * audio.UP // audio.DOWN)]
        assert np.allclose(audio.resample(x), want, atol=1e-5)
    for n in (0, 1, 127, 128, 129, 192, 193, 5000):
        x = rng.standard_normal(n).astype(np.float32)
        whole = audio.log_mel([(x, True)])
        assert len(whole) == (0 if not n else max(1, -(-(n - audio.FRAME) // audio.HOP) + 1))
        for size in (64, 100, 1000):
            parts = [(x[i : i + size], i + size >= n) for i in range(0, n, size)]
            assert np.allclose(audio.log_mel(parts), whole, atol=1e-4)


def test_audio_query(spark, small_table):
    texts = [None, "", "a", "x" * 191, "y" * 192, "z" * 193, "é" * 400_000, "a"]
    sf = small_table("documents", [(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_audio_features"](spark, sf).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r, media = rows[i], audio.to_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert r["patches"][-1]["end"] == len(payload) / audio.RATE and {len(p["values"]) for p in r["patches"]} == {audio.PATCH * audio.BANDS}
    same = lambda i: (rows[i]["feature"], rows[i]["patches"])
    assert same(2) == same(7) and same(0) == same(1)
    odd = spark.createDataFrame([(b"",), (None,)], "m binary").where("m is null").select(audio.payload_and_feature("m").alias("f")).first()
    assert odd["f"]["payload"] is None and odd["f"]["feature"] is None


def test_cosine_classes_over_many_blocks(spark):
    """A group larger than a block: links counted, none lost; clashing names, no rows."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(12)
    x = np.concatenate([centre + 0.02 * rng.standard_normal((600, 12)), rng.standard_normal((300, 12))])
    df = spark.createDataFrame([(i, [float(v) for v in e], 1, "r", 0) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int, rep string, f int")
    got = cap_filters.cosine_classes(df).orderBy("vec_id").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    found, want = sum(r["n_links"] for r in got), int(linked.sum())
    assert want > 100_000 and want >= found >= 0.99 * want
    assert {r["component_id"] for r in got[:600]} == {0} and [r["component_id"] for r in got[600:]] == list(range(600, 900))
    assert cap_filters.cosine_classes(df.limit(0)).count() == 0


def test_urls_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "h", "p", 3)], "page_id int, path string, host string, verdict string, rule int")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, rules, url_col="path")
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == (1, "a.com", "/en/x", "com/en/", "block")
