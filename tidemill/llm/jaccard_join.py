"""Exact n-gram Jaccard join with set-relation skipping.

A document is the set of its ``K``-word shingles; two link when
100 * |intersection| >= ``PERCENT`` * |union|.

1. Equal sets are one class, its smallest doc_id stands for it.
2. Index: all sets are ordered alike, rare shingles first (the frequent ones are
   counted over all documents; the order affects cost only).  Similar sets share a
   shingle of their prefixes, so only prefixes are indexed, with position and size.
3. Answers of hubs: each list of the index has its smallest set as hub; every set is
   compared with the smallest hub of its lists, one comparison for each set.  Links of
   hubs already make most components.
4. Skipping: a list whose sets are in one component is done.  A pair that can link meets
   in the list of the first shingle of both, so a list whose sets all have the same list
   before it is done too, and a pair that has one of the last ``EARLIER`` lists before this
   one in common is left to that list: near copies, which share most of their prefixes,
   make about one row and not one for each list.  The other lists are cut into blocks of
   about ``BLOCK`` sets of like size and position.  From the bounds of two blocks follows
   the largest overlap that any of their sets can have by size and position; block pairs
   that cannot reach a link are skipped as a whole, before any set of theirs is looked at.
   Each block pair left is a task of its own, so a long list is spread over the cluster.
   Inside, only pairs of two components are left, and of these the answers of the hub rule
   out more: with d = 1 - Jaccard, a metric, d(s, t) >= |d(s, hub) - d(t, hub)|, so a
   set's answer is derived from the answers of a similar set instead of being computed.
5. Sketches: bit i of a set's sketch is the parity of its shingles with hash i.  Two
   sketches differ in at most as many bits as the sets differ in shingles, so pairs
   with more differing bits than a link allows are ruled out, exactly, before any
   set is read; no row is made for them.  A long sketch, whose bits grow with the set,
   rules out pairs of large sets in the same way.
6. Remaining pairs are compared; components follow from all links.

Nothing is dropped: a pair is skipped only if it cannot link or is connected already.

Defined results: null, empty and blank texts have the empty set, size 0, and stand
alone; texts of fewer than k words have one shingle, the whole sequence; rows that
share a doc_id are one document: each has its own n_shingles, and the links of all of
them are the document's; rows with a null doc_id link with nothing, have a null
component_id, and stay in ``keep_one``; other columns are ignored, and pass through
``keep_one``.

k and percent are parameters; 4 and 85 are those of the registered query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.tables import discard, few, first_of_copies, named, stored
from tidemill.llm.textbatch import mix, segment_hash, slices, words_of

K = 4
PERCENT = 85
SKETCH = ["s0", "s1", "s2", "s3"]  # columns of 64 bits
BLOCK = 128
EARLIER = 8  # lists before a list, by which pairs are known that meet in an earlier one
MAX_BROADCAST_TOKENS = 2_000_000  # of 8 bytes
FOLD_BITS = 2  # bits of the long sketch for each shingle, at least
HOT_FROM = 32
HOT_MOST = 200_000


def _sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all distinct shingles, ordered by both."""
    w = words_of(part, lower=True)
    at, h = w.windows(k)
    row = w.row()[at]
    short = np.flatnonzero((w.n > 0) & (w.n < k))
    if len(short):
        h = np.concatenate([h, segment_hash(w.hash, w.first[short], w.first[short + 1])])
        row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, h = _sets(part, k)
                n = np.bincount(row, minlength=part.num_rows)
                first = np.concatenate(([0], np.cumsum(n)))
                sums = []
                for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))))
                    sums.append(mix(total[first[1:]] - total[first[:-1]]).view(np.int64))
                bits = 64 * len(SKETCH)
                parity = np.zeros((part.num_rows, len(SKETCH)), np.int64)
                for r in range(0, part.num_rows, 4096):  # so many rows at a time, as each takes a counter for each bit
                    a, b, rows = first[r], first[min(r + 4096, part.num_rows)], min(4096, part.num_rows - r)
                    seen = np.bincount((row[a:b] - r) * bits + (mix(h[a:b]) % np.uint64(bits)).astype(np.int64), minlength=rows * bits)
                    parity[r : r + rows] = np.packbits((seen & 1).astype(np.uint8).reshape(rows, bits), axis=1).view(np.int64)
                # The long sketch: a power of two of words, with at least FOLD_BITS bits for each shingle.
                words = (1 << np.ceil(np.log2(np.maximum(1, FOLD_BITS * n / 64))).astype(np.int64)).astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(words)))
                bit = 64 * ends[row] + (mix(h) & (64 * words[row] - 1).astype(np.uint64)).astype(np.int64)
                long = np.packbits((np.bincount(bit, minlength=64 * ends[-1]) & 1).astype(np.uint8)).view(np.int64)
                folds = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(long))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *map(pa.array, sums), *(pa.array(np.ascontiguousarray(parity[:, j])) for j in range(len(SKETCH))), folds], ["doc_id", "n", "a", "b", *SKETCH, "fold"])

    return run


def _prefixes(k: int, percent: int, hot: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = hot.value if hot is not None else np.zeros(0, np.uint64)  # sorted hashes, then their ranks
        for batch in batches:
            for part in slices(batch):
                row, h = _sets(part, k)
                n = np.bincount(row, minlength=part.num_rows)
                if len(last):
                    i = np.minimum(np.searchsorted(last[0], h), len(last[0]) - 1)
                    rank = np.where(last[0][i] == h, last[1][i], 0)
                    order = np.lexsort((h, rank, row))
                    row, h = row[order], h[order]
                pos = np.arange(len(h)) - np.concatenate(([0], np.cumsum(n)))[row]
                size = n[row]
                keep = pos <= size - -(-percent * size // 100)
                doc = part.column(0).take(pa.array(row[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), doc, pa.array(size[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], ["h", "doc", "n", "pos"])

    return run


def _contents(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, h = _sets(part, k)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))], ["doc_id", "tokens"])

    return run


@dataclass(frozen=True)
class Rule:
    """Shingle length and the percentage of the union that the intersection of two linked sets reaches."""

    k: int = K
    percent: int = PERCENT

    def fits(self, n1: str, p1: str, n2: str, p2: str) -> str:
        """Whether sizes and positions of a common shingle allow the overlap that a link needs."""
        need = f"{self.percent} * ({n1} + {n2})"  # (100 + percent) * overlap must reach this
        return f"100 * least({n1}, {n2}) >= {self.percent} * greatest({n1}, {n2}) AND {100 + self.percent} * least({n1} - {p1}, {n2} - {p2}) >= {need}"

    def near(self, x: str, y: str) -> str:
        """Whether the sketches of x and y leave a link possible: their differing bits are at most the differing shingles."""
        bits = " + ".join(f"bit_count({x}.{s} ^ {y}.{s})" for s in SKETCH)
        return f"{100 + self.percent} * ({bits}) <= {100 - self.percent} * ({x}.n + {y}.n)"


def _folded(mine: str, other: str) -> str:
    """The long sketch ``mine`` at the length of ``other`` if that is half: bit i of the half is the parity of bits i and i + half."""
    half = f"(size({mine}) div 2)"
    return f"CASE WHEN size({mine}) > size({other}) THEN zip_with(slice({mine}, 1, {half}), slice({mine}, {half} + 1, {half}), (p, q) -> p ^ q) ELSE {mine} END"


def _nearer(sets: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """pairs (a, b), of sets whose sizes allow a link, without those that the long sketches rule out.

    Such sizes differ by less than half, so the sketches have one length or one has twice the other's.
    """
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidates")
    some = sets.join(few(ids), "doc_id", "left_semi")
    x, y = (some.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("fold").alias(f"fold_{k}")) for k in "ab")
    differ = f"aggregate(zip_with({_folded('fold_a', 'fold_b')}, {_folded('fold_b', 'fold_a')}, (p, q) -> bit_count(p ^ q)), 0, (sum, v) -> sum + v)"
    out = pairs.join(x, "a").join(y, "b").where(f"{100 + rule.percent} * {differ} <= {100 - rule.percent} * (n_a + n_b)").select("a", "b").distinct()
    out = stored(out, "nearer")
    discard(ids)
    return out


def _compared(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """pairs (a, b) with d = 1 - Jaccard, and whether they link."""
    hubs = pairs.select(F.col("a").alias("doc_id")).distinct()
    ids = stored(hubs.union(pairs.select("b")).distinct(), "involved")
    sets = stored(docs.join(few(ids), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_contents(rule.k), "doc_id long, tokens array<long>"), "sets")
    left = stored(sets.join(few(hubs), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "hub-sets")
    n, tokens = left.agg(F.count("*"), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    # One hub may have a large part of all pairs: its set goes to the pairs where hub sets are counted to be small.
    left = F.broadcast(left) if n + tokens <= MAX_BROADCAST_TOKENS else left
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
    found = both.select("a", "b", (1 - F.col("i") / (F.col("s") - F.col("i"))).alias("d"), (100 * F.col("i") >= rule.percent * (F.col("s") - F.col("i"))).alias("link"))
    out = stored(found.groupBy("a", "b").agg(F.min("d").alias("d"), F.bool_or("link").alias("link")), "compared")
    discard(ids, sets)
    return out


def _first_met(lists: DataFrame, sketches: DataFrame) -> DataFrame:
    """lists (h, doc, pos, c, d, last) with n, sketches and ``earlier``, but no lists whose pairs all meet in one earlier list.

    last is the list before h in the set's order, earlier the last ones of those kept.  All
    sets have their shingles in one order, so what two sets have in common before h they
    have before any later shingle.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    ends = lists.groupBy("h").agg(F.min("last").alias("x"), F.max("last").alias("y"), F.bool_or(F.col("last").isNull()).alias("starts"))
    wanted = stored(ends.where("starts OR x < y").select("h"), "first-lists")
    out = lists.drop("last").join(few(wanted), "h", "left_semi").withColumn("earlier", F.collect_list("h").over(order.rowsBetween(-EARLIER, -1)))
    out = stored(out.join(sketches.withColumnRenamed("doc_id", "doc"), "doc"), "first-met")
    discard(wanted)
    return out


def _block_pairs(left: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of two components in one list that sizes, positions, sketches and hub answers allow.

    left: h, doc, n, pos, c (component), d (distance to the list's hub or null), earlier
    (the lists just before h in the set's order) and the sketch columns of all sets of the
    open lists.
    """
    width = max(1e-3, -math.log(rule.percent / 100) * 1.0001)  # sizes of a link are in one band or in neighbours
    band = left.withColumn("g", F.floor(F.log(F.col("n")) / width).cast("int")).withColumn("q", F.expr(f"cast(400 * pos / (n * {100 - rule.percent} + 100) as int)"))
    bounds = band.groupBy("h", "g", "q").agg(F.count("*").alias("m"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    bounds = stored(bounds.withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")), "bounds")
    x = bounds.withColumn("near_g", F.explode(F.array(F.col("g"), F.col("g") + 1))).alias("x")
    reach = f"{100 + rule.percent} * least(x.rest, y.rest) >= {rule.percent} * (x.n0 + y.n0) AND 100 * y.n1 >= {rule.percent} * x.n0 AND 100 * x.n1 >= {rule.percent} * y.n0"
    several = "(x.c0 < x.c1 OR y.c0 < y.c1 OR x.c0 <> y.c0)"
    once = "(x.g < y.g OR x.q <= y.q)"
    blocks = x.join(bounds.alias("y"), F.expr(f"x.h = y.h AND x.near_g = y.g AND {once} AND {reach} AND {several}"))
    blocks = blocks.select("x.h", F.col("x.g").alias("xg"), F.col("x.q").alias("xq"), F.col("y.g").alias("yg"), F.col("y.q").alias("yq"), F.explode(F.expr("sequence(0, x.parts - 1)")).alias("xs"), F.col("y.parts").alias("ys_n"))
    blocks = blocks.withColumn("ys", F.explode(F.expr("sequence(0, ys_n - 1)"))).where("xg <> yg OR xq <> yq OR xs <= ys").drop("ys_n")
    blocks = stored(blocks, "blocks")
    parts = bounds.select("h", "g", "q", "parts")
    member = stored(band.join(parts, ["h", "g", "q"]).withColumn("s", F.expr("cast(pmod(xxhash64(doc), parts) as int)")).drop("parts"), "members")
    key = ["h", "xg", "xq", "xs", "yg", "yq", "ys"]
    names = ["doc", "n", "pos", "c", "d", *SKETCH, "earlier"]

    def side(p: str) -> DataFrame:
        own = member.select("h", *(F.col(c).alias(p + c) for c in ("g", "q", "s")), F.struct(*names).alias(p))
        return blocks.join(own, ["h", f"{p}g", f"{p}q", f"{p}s"])

    far = f"coalesce(abs(x.d - y.d) > {1 - rule.percent / 100 + 1e-9}, false)"
    one_block = "(xg <> yg OR xq <> yq OR xs <> ys OR x.doc < y.doc)"
    pairs = side("x").join(side("y"), key).where(f"{one_block} AND x.c <> y.c AND {rule.fits('x.n', 'x.pos', 'y.n', 'y.pos')} AND NOT {far} AND {rule.near('x', 'y')} AND NOT arrays_overlap(x.earlier, y.earlier)")
    out = stored(pairs.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct(), "pairs")
    discard(bounds, blocks, member)
    return out


def _join(docs: DataFrame, rule: Rule) -> DataFrame:
    """join of docs (doc_id, text) whose ids are neither null nor shared."""
    spark = docs.sparkSession
    sets = stored(docs.mapInArrow(_describe(rule.k), f"doc_id long, n long, a long, b long, {', '.join(f'{s} long' for s in SKETCH)}, fold array<long>"), "described")
    sketches = sets.select("doc_id", "n", *SKETCH)
    copies = stored(first_of_copies(sets.where("n > 0").select("a", "b", "doc_id"), ["a", "b"], "doc_id").select("doc_id", F.col("first").alias("node")), "copies")
    fresh = docs.join(few(copies.select("doc_id")), "doc_id", "left_anti").select("doc_id", "text")

    index = "h long, doc long, n int, pos int"
    often = fresh.mapInArrow(_prefixes(rule.k, rule.percent, None), index).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_FROM)
    often = often.orderBy(F.desc("c"), "h").limit(HOT_MOST).collect()  # at most HOT_MOST numbers
    by_hash = sorted((r[0] & 0xFFFFFFFFFFFFFFFF, r[1]) for r in often)
    hot = spark.sparkContext.broadcast((np.array([h for h, _ in by_hash], np.uint64), np.array([c for _, c in by_hash], np.int64))) if by_hash else None

    # Lists of two sets at least, with the hub and its size and position.  Aggregates are stored before
    # they are joined, so that a long list is split between tasks when Spark finds it skewed.
    postings = stored(fresh.mapInArrow(_prefixes(rule.k, rule.percent, hot), index), "postings")
    hubs = postings.groupBy("h").agg(F.min(F.struct("doc", "n", "pos")).alias("hub"), F.max("doc").alias("most")).where("hub.doc < most")
    hubs = stored(hubs.select("h", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")), "lists-hubs")
    lists = stored(postings.join(hubs, "h"), "lists")
    discard(postings, hubs)
    stars = stored(lists.where("doc <> hub").where(rule.fits("n", "pos", "hub_n", "hub_pos")).groupBy(F.col("doc").alias("b")).agg(F.min("hub").alias("a")).select("a", "b"), "hubs")
    hopeful = stars.join(sketches.alias("x"), F.expr("x.doc_id = b")).join(sketches.alias("y"), F.expr(f"y.doc_id = a AND {rule.near('x', 'y')}")).select("a", "b").distinct()
    nearest = stored(hopeful, "stars")
    discard(stars)
    stars = nearest
    answers = _compared(docs, stars, rule)
    discard(stars)
    links = answers.where("link").select("a", "b")
    parts = components(links)

    # What the hubs leave open: pairs of two components in one list.
    own = parts.select(F.col("node").alias("doc"), "component")
    known = answers.select(F.col("a").alias("hub"), F.col("b").alias("doc"), "d")
    placed = lists.join(own, "doc", "left").join(known, ["hub", "doc"], "left").select("h", "doc", "n", "pos", F.coalesce("component", "doc").alias("c"), F.when(F.col("doc") == F.col("hub"), 0.0).otherwise(F.col("d")).alias("d"))
    placed = stored(placed, "placed")
    open_lists = stored(placed.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("h"), "open-lists")
    opened = stored(placed.join(open_lists, "h", "left_semi").drop("n").withColumn("last", F.lag("h").over(Window.partitionBy("doc").orderBy("pos"))), "open")
    discard(lists, placed, open_lists)
    left = _first_met(opened, sketches)
    discard(opened)
    found = _block_pairs(left, rule)
    pairs = stored(found.join(answers.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    discard(left, found)
    nearer = _nearer(sets, pairs, rule)
    discard(pairs)
    if nearer.limit(1).count():
        late = _compared(docs, nearer, rule).where("link").select("a", "b")
        parts = components(links.unionByName(late)) if late.limit(1).count() else parts
    discard(nearer)

    named = sets.select("doc_id", "n").join(copies, "doc_id", "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node"))
    return named.join(parts, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def _join_shared(docs: DataFrame, rule: Rule) -> DataFrame:
    """join of docs whose ids may be shared: rows are nodes, and those of one id are one document."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    found = rows.select("row", F.col("doc_id").alias("id")).join(_join(rows.select(F.col("row").alias("doc_id"), "text"), rule).withColumnRenamed("doc_id", "row"), "row")
    found = stored(found, "by-row")
    least = found.groupBy("component_id").agg(F.min("id").alias("least"))
    edges = found.join(least, "component_id").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    return found.join(components(edges).withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rule = Rule(k, percent)
    key_type = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    shared = known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    out = (_join_shared if shared else _join)(known, rule)
    if nameless.limit(1).count():
        sizes = nameless.mapInArrow(_describe(k), f"doc_id long, n long, a long, b long, {', '.join(f'{s} long' for s in SKETCH)}, fold array<long>")
        out = out.unionByName(sizes.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("doc_id").cast(key_type).alias("doc_id"), "n_shingles", F.col("component_id").cast(key_type).alias("component_id"))


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Rows of docs whose document has the smallest doc_id of its component, unchanged."""
    gone = stored(join(docs, k, percent).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(few(gone), "doc_id", "left_anti").select(*named(docs))
