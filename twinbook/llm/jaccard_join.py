"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order puts n-grams that are frequent in the corpus last and all
others in the order of their hashes. It is cut into fragments, and so is each
text's sorted set of n-grams: a segment for each fragment. The overlap of a pair
of texts is counted in each fragment separately, and the partial counts are
summed per pair: first over the segments of the prefixes (the least part of a
set in which linked texts must meet), where the sum bounds the overlap and most
pairs end, then over all segments, where it is the overlap.

Pairs come from texts that meet in an n-gram of their prefixes. They are never
all pairs of a group: each n-gram's hub (the text that shares most) is compared
first; then, exactly, what is still unconnected.

Edge cases: a null, empty or blank text has no n-grams and links with nothing;
equal n-gram sets are one node (copies and repeated rows are never expanded into
pairs); rows with a null id get a null component, but link as all others do; rows
of one id with different texts are documents of their own; an empty table gives
an empty result. Columns other than id and text are ignored, whatever their names.
Sets are told apart by 128-bit hashes, the n-grams inside a pair by 62 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, components, numbers, tidy
from .shingles import Shingler

#: Per worker and block of this many n-grams, those seen at least LOCAL times
#: are reported; of the corpus-wide sums, the MOST_FREQUENT largest go last in
#: the order. Both only choose the order; every choice gives the same result.
BLOCK, LOCAL, MOST_FREQUENT = 1 << 22, 3, 1 << 19
#: Positions from here on are those of frequent n-grams.
RANKED = 1 << 62
#: Tasks over which the rows of one frequent n-gram are dealt.
SALTS = 64
#: Up to this many texts (16 MB of keys) are fetched by a broadcast of their
#: keys; more by a shuffle of the texts.
BROADCAST_NODES = 1_000_000
#: A node as a hub: the share of its n-grams that others may have (10 bits), its size (20) and the end of its name (33).
#: The greatest of an n-gram's nodes is its hub; _SIZES reads size and m (rounded up) back.
_HUB = "shiftleft(cast(m * 1000L / n as long), 53) + shiftleft(least(cast(n as long), 1048575L), 33) + (node & 8589934591L)"
_SIZES = ("shiftright(hub, 33) & 1048575L as h_n", "(shiftright(hub, 53) + 1) * (shiftright(hub, 33) & 1048575L) / 1000 as h_m")
#: Nodes that a worker remembers, to emit the prefix of copies once.
REMEMBERED = 1 << 20
#: Rows of n-grams that a worker gives at a time.
ROWS = 1 << 16
#: Fragments of the order.
FRAGMENTS = 8


def _name(grams: np.ndarray, clash: frozenset = frozenset()) -> tuple[int, int]:
    """The two halves of the set's 128-bit hash; the first names its node, the second if the first is in ``clash``."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    node, check = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
    return (check, node) if node in clash else (node, check)


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """One pass over (id, text, key): a row (id, key, node, check, n) per text and rows (t, c) of local n-gram counts.

    Only n-grams that recur within a worker's block leave it, so that the
    corpus-wide sum sees few rows.
    """
    names, kinds = ["id", "key", "node", "check", "n", "t", "c"], [*[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64()]

    def rows(size, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names)

    def survey(batches):
        shingler, held, size = Shingler(width), [], 0

        def flush():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LOCAL
            return rows(int(keep.sum()), t=values[keep].view(np.int64), c=n[keep])

        for batch in batches:
            found, sizes = [], []
            for grams in shingler.sets(batch.column(1)):
                found.append(_name(grams) if len(grams) else (None, None))
                sizes.append(len(grams))
                held.append(grams)
                size += len(grams)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
            yield rows(len(sizes), id=batch.column(0), key=batch.column(2), node=[x for x, _ in found], check=[x for _, x in found], n=sizes)
        if held:
            yield flush()

    return docs.mapInArrow(survey, "id long, key long, node long, check long, n int, t long, c long")


def _frequent(survey: DataFrame) -> np.ndarray:
    """Hashes of the n-grams in most texts, rarest first; at most MOST_FREQUENT of them (4 MB)."""
    sums = survey.where("t is not null").groupBy("t").agg(F.sum("c").alias("c"))
    return numbers(sums.orderBy(F.desc("c"), "t").limit(MOST_FREQUENT).select("t"))[::-1, 0].copy()


class _Order:
    """Maps n-gram hashes to positions of the global order (63 bits, as int64)."""

    def __init__(self, frequent: np.ndarray):
        values = frequent.view(np.uint64)
        self.by = np.argsort(values)
        self.values = values[self.by]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        keys = (grams >> np.uint64(2)).astype(np.int64)
        if len(self.values) and len(grams):
            at = np.searchsorted(self.values, grams).clip(max=len(self.values) - 1)
            hit = self.values[at] == grams
            keys[hit] = RANKED + self.by[at[hit]]
        return np.sort(keys)


def _need(share: int, n):
    """Least overlap that a set of n can have with one it links to: ceil(share/100 * n)."""
    return -(-share * n // 100)


def _prefixes(batches, order, width: int, share: int, clash: frozenset):
    """(t, node, n, pos): the prefix of each set, each once per task."""
    shingler, rank, seen = Shingler(width), _Order(order.value), set()
    for batch in batches:
        nodes, sizes, parts = [], [], []
        for grams in shingler.sets(batch.column(0)):
            if not (n := len(grams)) or (name := _name(grams, clash)) in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(name)
            nodes.append(name[0])
            sizes.append(n)
            parts.append(rank(grams)[: n - _need(share, n) + 1])
        if parts:
            count = [len(p) for p in parts]
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(parts)), pa.array(np.repeat(np.array(nodes, np.int64), count)),
                    pa.array(np.repeat(np.array(sizes, np.int32), count)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in count])),
                ],
                ["t", "node", "n", "pos"],
            )
            yield from (rows.slice(at, ROWS) for at in range(0, rows.num_rows, ROWS))


def _met(batches):
    """Of rows (t, node, ..) in the order of t, those of frequent n-grams and those whose n-gram two nodes have at least.

    Rows of an n-gram that has shown one node so far are held as one row.
    """
    held, done = None, False  # the last n-gram's first row; whether it has been given already
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns, strict=True)], batch.schema.names)
        t, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        size = np.diff(np.append(first, len(t)))
        group = np.repeat(np.arange(len(first)), size)
        other = node != node[first][group]
        several = np.zeros(len(first), bool)
        several[group[other]] = True
        several[0] |= done
        keep = (several | (t[first] >= RANKED))[group]
        given, done, held = done, bool(keep[-1]), batch.slice(first[-1], 1)
        keep[0] &= not given
        yield batch.filter(pa.array(keep))


def _shared(docs: DataFrame, order, width: int, share: int, clash: frozenset) -> DataFrame:
    """(node, n, m, grams): each node's prefix n-grams (pos, t) that others may have too, by position.

    m bounds what the node can share with any other: its n-grams but those of the prefix that are its own.
    """
    rows = docs.select("text").mapInArrow(lambda b: _prefixes(b, order, width, share, clash), "t long, node long, n int, pos int")
    # An n-gram in very many texts is a frequent one, which needs no test; its rows go to several tasks.
    salt = F.when(F.col("t") >= RANKED, F.pmod("node", F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    met = rows.repartition(F.col("t"), salt).sortWithinPartitions("t").mapInArrow(_met, "t long, node long, n int, pos int")
    lists = met.groupBy("node", "n").agg(F.sort_array(F.collect_set(F.struct("pos", "t"))).alias("grams"))
    return lists.select("node", "n", F.expr(f"cast(ceil({share} * n / 100) as int) - 1 + size(grams)").alias("m"), "grams")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 75, width: int = 5) -> DataFrame:
    """Per row: id, n_shingles, component_id under Jaccard >= share/100.

    Two texts link when 100 * intersection >= share * union of their n-gram
    sets; component_id is the smallest id reachable by links, itself included.
    """
    return _members(docs, id_col, text_col, share, width).select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("kept.id", "id")).alias("component_id"),
    )


def _key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _members(docs: DataFrame, id_col: str, text_col: str, share: int, width: int) -> DataFrame:
    """Per row: id, key (hash of its text), node, n, and kept: the (no_id, id, key) of its component's least row, null without n-grams."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _key(F.col(text_col)).alias("key"))
    survey = scratch.keep(_survey(docs, width), "survey")
    order = spark.sparkContext.broadcast(_frequent(survey))
    named = survey.where("t is null").select("id", "key", "node", "check", "n")
    # Different sets whose nodes have one name (at 64 bits, some hundred among 10 ** 11 texts) take the other half of their hash.
    clash = frozenset(r["node"] for r in named.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo < hi").select("node").collect())
    if clash:
        named = named.withColumn("node", F.when(F.col("node").isin(*clash), F.col("check")).otherwise(F.col("node")))
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    first = named.where("node is not null").groupBy("node").agg(F.min(row).alias("doc"))

    shared = scratch.keep(_shared(docs, order, width, share, clash), "shared")
    tidy(spark)
    repeated = not named.where("node is not null").groupBy("id", "key").count().where("count > 1").isEmpty()
    found = _Found(scratch, first, docs, order, width, share, clash, shared, repeated)

    # First each n-gram's hub (of most shared n-grams for its size) against the
    # others: a large group becomes one component by these links, without all its
    # pairs.
    # Rows go at once if all other texts of the n-gram are too long for the node, or it for them.
    placed, longest = _placed(shared), f"(cast(floor({100 + share} * m / {share}) as int) - n)"
    hub = placed.groupBy("t").agg(F.max(F.expr(_HUB)).alias("hub"), F.min("n").alias("least"), F.max(F.expr(longest)).alias("most"))
    useful = placed.join(hub, "t").where(f"least <= {longest} and n <= most").drop("least", "most")
    useful = scratch.keep(useful, "useful")
    near = useful.where(F.col("hub") != F.expr(_HUB)).selectExpr("*", *_SIZES)
    near = near.where(_may_link("", "h_", share)).where(_place("", "h_", share)).select("node", "n", "hub").distinct()
    hubs = shared.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.expr(_HUB).alias("hub"))
    found.test(near.join(hubs, "hub").select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb"))

    # Then, exactly, every pair of nodes that have no common neighbour yet.
    rooted = found.rooted(useful.drop("hub"))
    split = rooted.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("t")
    left = scratch.keep(rooted.join(split, "t"), "left")
    x, y = left.alias("x"), left.alias("y")
    met = (F.col("x.t") == F.col("y.t")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    others = x.join(y, met & _may_link("x.", "y.", share) & _places("x.", "y.", share))
    found.test(others.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct())
    roots = components(found.links)
    order.destroy()
    member = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = member.groupBy("root").agg(F.min("doc").alias("kept"))
    classes = scratch.keep(named.join(member.join(lowest, "root").select("node", "kept"), "node", "left").drop("check"), "classes")
    scratch.free("survey", "shared", "useful", "left", "met0", "met1", "nodes0", "nodes1", "pieces0", "pieces1", "tried0", "tried1", "links0", "links1")
    tidy(spark)
    return classes


def _placed(shared: DataFrame) -> DataFrame:
    """One row per node and n-gram: t, its position in the whole set, and how many of the node's n-grams before it others may have too (seen)."""
    own = [c for c in shared.columns if c != "grams"]
    return shared.select(*own, F.posexplode("grams").alias("seen", "g")).select(*own, "seen", "g.pos", "g.t")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 75, width: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of least id (null last), then of least text hash. Rows without n-grams stay."""
    rows = _members(docs, id_col, text_col, share, width).where("node is not null").groupBy("id", "key", "kept").agg(F.count("*").alias("c"))
    names = [F.col("id").alias("_id"), F.col("key").alias("_key")]
    mine = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("key") == F.col("kept.key"))
    gone, twice = rows.where(~mine).select(*names), rows.where(mine & (F.col("c") > 1)).select(*names)

    def same(side):
        return docs[id_col].cast("long").eqNullSafe(side["_id"]) & (_key(docs[text_col]) == side["_key"])

    if gone.count() <= BROADCAST_NODES:
        gone = F.broadcast(gone)
    kept = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return kept
    # Equal rows cannot be told apart by name.
    return kept.join(twice, same(twice), "left_anti").unionByName(docs.join(twice, same(twice), "left_semi").dropDuplicates([id_col, text_col]))


class _Found:
    """Pairs tested so far, the links among them, and the segments fetched for the tests."""

    def __init__(self, scratch: Scratch, first: DataFrame, docs: DataFrame, order, width: int, share: int, clash: frozenset, shared: DataFrame, repeated: bool):
        self.scratch, self.first, self.docs, self.order, self.width, self.share, self.clash = scratch, first, docs, order, width, share, clash
        # The prefixes' segments, of what others may have too.
        frag = lambda g: F.least(F.floor(g["t"] / F.lit(_WIDE)), F.lit(FRAGMENTS - 1)).cast("int")
        part = lambda f: F.struct(f.alias("frag"), F.transform(F.filter("grams", lambda g: frag(g) == f), lambda g: g["t"]).alias("grams"))
        parts = F.array(*(part(F.lit(f)) for f in range(FRAGMENTS)))
        self.heads = shared.select("node", F.explode(F.filter(parts, lambda s: F.size(s["grams"]) > 0)).alias("s")).select("node", "s.frag", "s.grams")
        self.tried, self.links, self.pieces, self.round = None, None, None, 0
        self.repeated = repeated  # whether an id and text occur in several rows

    def rooted(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with each one's root: its neighbour of most links, or itself.

        Nodes of one root are linked to it, and so lie in one component.
        """
        ends = self.links.union(self.links.select("b", "a"))
        degree = ends.groupBy("a").agg(F.count("*").alias("degree"))
        best = F.max(F.struct("degree", F.col("a").alias("root"))).alias("best")
        near = ends.join(degree, "a").groupBy(F.col("b").alias("node")).agg(best).join(degree.withColumnRenamed("a", "node"), "node")
        own = F.struct("degree", F.col("node").alias("root"))
        roots = near.select("node", F.greatest("best", own)["root"].alias("root"))
        if self.links.count() <= BROADCAST_NODES // 2:  # a link roots two nodes
            roots = F.broadcast(roots)
        return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def test(self, pairs: DataFrame) -> None:
        """Test distinct pairs (a, b, na, nb), but those tested before, and add the links among them."""
        if self.tried is not None:
            pairs = pairs.join(self.tried.union(self.tried.select("b", "a")), ["a", "b"], "left_anti")
        name = lambda kind: f"{kind}{self.round}"
        pairs = self.scratch.keep(pairs, name("met"))
        pairs = self.scratch.keep(_summed(pairs, self.heads).where(_promising(self.share)).drop("o"), name("tried"))
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.pieces is not None:
            nodes = nodes.join(self.pieces.select("node").distinct(), "node", "left_anti")
        nodes = self.scratch.keep(nodes.join(self.first, "node").select(F.col("doc.id").alias("_id"), F.col("doc.key").alias("_key"), "node"), name("nodes"))
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
        texts = self.docs.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, same).select("node", "text")
        texts = texts.dropDuplicates(["node"]) if self.repeated else texts
        pieces = self.scratch.keep(_segments(texts, self.order, self.width, self.clash), name("pieces"))
        self.pieces = pieces if self.pieces is None else self.pieces.union(pieces)
        links = self.scratch.keep(_summed(pairs, self.pieces).where(f"100 * o >= {self.share} * (na + nb - o)").select("a", "b"), name("links"))
        self.links = links if self.links is None else self.links.union(links)
        self.tried = pairs.select("a", "b")
        self.round += 1
        tidy(pairs.sparkSession)


def _promising(share: int) -> str:
    """Can texts of na and nb n-grams that share o in their prefixes link?

    What they share beyond is at most the longer remainder, and a remainder has
    ceil(share/100 * n) - 1 n-grams.
    """
    return f"{100 + share} * (o + ceil({share} * greatest(na, nb) / 100) - 1) >= {share} * (na + nb)"


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _overlap(a: str, b: str, share: int) -> str:
    """Least overlap of linked sets of these sizes."""
    return f"ceil({share} * ({a}n + {b}n) / {100 + share})"


def _may_link(a: str, b: str, share: int):
    """Sizes that allow a link, and neither side can share less than it takes (``m``)."""
    return F.expr(f"100 * least({a}n, {b}n) >= {share} * greatest({a}n, {b}n) and least({a}m, {b}m) >= {_overlap(a, b, share)}")


def _places(a: str, b: str, share: int):
    """Can rows of one n-gram belong to texts that link?

    Linked texts have an n-gram in common that leaves each as many more as the
    overlap needs. Before any n-gram they have in common at most what either may
    share (``seen``), and from it on at most the shorter remainder.
    """
    need = _overlap(a, b, share)
    return F.expr(f"{a}pos <= {a}n - {need} and {b}pos <= {b}n - {need} and least({a}seen, {b}seen) + least({a}n - {a}pos, {b}n - {b}pos) >= {need}")


def _place(a: str, b: str, share: int):
    """The same, judged by the place in the first alone."""
    need = _overlap(a, b, share)
    return F.expr(f"{a}pos <= {a}n - {need} and {a}seen + {a}n - {a}pos >= {need}")


#: Width of a fragment of the order; the last one holds the frequent n-grams.
_WIDE = RANKED // (FRAGMENTS - 1)


def _segments(texts: DataFrame, order, width: int, clash: frozenset) -> DataFrame:
    """(node, frag, grams): the n-grams of each row's text, cut into the FRAGMENTS of the order."""

    def cut_sets(batches):
        shingler, rank = Shingler(width), _Order(order.value)
        edges = np.arange(1, FRAGMENTS) * _WIDE
        for batch in batches:
            node, frag, parts = [], [], []
            for key, grams in zip(batch.column(0).to_pylist(), shingler.sets(batch.column(1)), strict=True):
                if not len(grams) or _name(grams, clash)[0] != key:
                    continue  # another text under the same id and hash
                keys = rank(grams)
                for f, piece in enumerate(np.split(keys, np.searchsorted(keys, edges))):
                    if len(piece):
                        node.append(key)
                        frag.append(f)
                        parts.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(frag, pa.int32()), _lists(parts)], ["node", "frag", "grams"])

    return texts.mapInArrow(cut_sets, "node long, frag int, grams array<long>")


def _summed(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``pairs`` (a, b, na, nb) with o: their partial overlaps in each fragment, summed over the fragments (pairs of none are left out)."""
    few = pairs.count() <= BROADCAST_NODES

    def side(end: str) -> DataFrame:
        mine = pairs.select(F.col(end).alias("node")).distinct()
        own = segments.join(F.broadcast(mine), "node", "left_semi") if few else segments
        return own.select(F.col("node").alias(end), "frag", F.col("grams").alias(f"g{end}"))

    a, b = side("a"), side("b")
    part = pairs.join(a, "a").join(b, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("o"))
    return part.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
