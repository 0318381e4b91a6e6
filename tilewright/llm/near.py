"""N-gram Jaccard join with a count-vector R-tree.

A text's set is that of its word 5-grams. Their hashes fall into groups; how many of a
set fall into each group is a point, and the sum over groups of the smaller coordinate
bounds two sets' overlap. RTree indexes such points: a box is passed over when the sum of
minima against its upper corner is under the overlap that the threshold asks for.
Surviving pairs are verified on the sets themselves.

One tree over all points can't prune here: at Jaccard 0.8 the overlap asked for is so low
that, for long texts, the boxes of unrelated texts pass. So points are dealt into blocks
first: two sets with Jaccard >= t share one of their first n - ceil(t * n) + 1 elements in
any common order (no link is lost), and the order puts grams that the whole corpus repeats
last, by a count sketch over all documents, so that common passages don't make blocks.

A block's hub is the set that meets most others; every set is first compared with the hub it
shares most blocks with (one pair a set, never all pairs); sets so linked fold into components. Only where a block still has sets of
several components are its other pairs searched, by the trees, in chunks of CHUNK sets, and
verified. Every pair that shares a block is so either in one component or has been bounded
or verified: the components are exact."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import drop_scratch, scratch
from tilewright.llm.wordhash import SPACE_SEPARATORS, Tokenizer, chunks, sequence_hash

K = 5
PERCENT = 80
#: Counters of the sketch, and bits of the filter of sets that share a block. Their sizes are fixed; more only saves work.
SLOTS = 1 << 18
FILTER_BITS = 1 << 25
#: From this level (times 2 ** level the mean count) blocks are salted.
HOT_LEVEL = 4
CHUNK = 2048
LEAF = 32


# ---- points, boxes, bounds


def n_groups(n: int) -> int:
    """Groups of the trees for sets of n elements; powers of two, so that a finer point folds into a coarser one."""
    return max(64, 1 << (n // 2).bit_length())


def point(elements: np.ndarray) -> np.ndarray:
    """About two groups for an element, so that counts are far below 255; trees fold it to n_groups."""
    g = max(64, 1 << int(2 * len(elements) - 1).bit_length())
    return np.bincount((elements & np.uint64(g - 1)).astype(np.int64), minlength=g).astype(np.uint8)


def bound(a: bytes, b: bytes) -> int:
    """The most that two sets can share, by their points."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    g = min(len(x), len(y))
    return int(np.minimum(fold(x, g) if len(x) > g else x, fold(y, g) if len(y) > g else y).sum(dtype=np.int64))


def coarse(elements: np.ndarray) -> np.ndarray:
    """The trees' point; groups hold one or two elements on average, so counts stay below 255."""
    g = n_groups(len(elements))
    return np.bincount((elements & np.uint64(g - 1)).astype(np.int64), minlength=g).astype(np.uint8)


def fold(p: np.ndarray, g: int) -> np.ndarray:
    return p.reshape(*p.shape[:-1], -1, g).sum(axis=-2, dtype=np.int64)


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The least overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


class RTree:
    """Points with the sizes of their sets, packed by sorting on the widest coordinates, LEAF to a leaf and a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = self._pack(points, np.arange(len(points)))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []
        top, small = self.points, self.sizes
        while len(top) > 1:
            at = np.arange(0, len(top), LEAF)
            top, small = np.maximum.reduceat(top, at), np.minimum.reduceat(small, at)
            self.levels.append((top, small))
            if len(at) == 1:
                break

    @staticmethod
    def _pack(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(rows) <= LEAF:
            return rows
        own = points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        rows = rows[np.argsort(own[:, axis], kind="stable")]
        half = (len(rows) // 2 + LEAF - 1) // LEAF * LEAF
        return np.concatenate([RTree._pack(points, rows[:half]), RTree._pack(points, rows[half:])]) if half < len(rows) else rows

    def search(self, p: np.ndarray, n: int, percent: int = PERCENT) -> np.ndarray:
        """Rows whose bound reaches what the threshold asks for."""
        live = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, small = self.levels[depth]
            live = live[np.minimum(top[live], p).sum(axis=1) >= needed(small[live], n, percent)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            live = (live[:, None] * LEAF + np.arange(LEAF)).ravel()
            live = live[live < below]
        live = live[np.minimum(self.points[live], p).sum(axis=1) >= needed(self.sizes[live], n, percent)]
        return self.order[live]


# ---- sets


class Sets:
    """Sets of texts, their elements in the common order: the sketch's level in the top 6 bits, hash bits below."""

    def __init__(self, levels: np.ndarray | None) -> None:
        self.tok, self.levels = Tokenizer(SPACE_SEPARATORS), levels

    def hashes(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, hashes of all grams, where each text's grams begin and the last ends)"""
        for at, data, offsets in chunks(column):
            w = self.tok.words(data, offsets)
            h, ok = w.grams(K)
            counts = np.diff(w.first)
            for i in np.flatnonzero((counts > 0) & (counts < K)):
                j = w.first[i]
                h[j], ok[j] = sequence_hash(w.hashes[j : w.first[i + 1]])[0], True
            kept = np.concatenate([[0], np.cumsum(ok)])
            yield at, h[ok], kept[w.first]

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, h, first in self.hashes(column):
            e = (self.levels[(h & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))
            for a, b in zip(first[:-1], first[1:], strict=True):
                yield np.unique(e[a:b])


def set_id(elements: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


PARTS = 64


def _summed(parts: DataFrame, dtype: str, op: np.ufunc, width: int) -> np.ndarray:
    """Combine the (part, body) rows of all tasks; PARTS rows of fixed width come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(body, dtype)
                total[part] = op(total[part], got) if part in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "body"])

    out = np.zeros((PARTS, width), dtype)
    for r in parts.repartition(PARTS, "part").mapInArrow(run, "part int, body binary").collect():
        out[r.part] = np.frombuffer(r.body, dtype)
    return out.ravel()


def levels_of(df: DataFrame, text_col: str) -> np.ndarray:
    """By hash slot: log2 of how often grams of that slot come in the corpus, in units of the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, counts = Sets(None), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, h, _ in sets.hashes(batch.column(0)):
                counts += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in counts.astype(np.uint32).reshape(PARTS, -1)], pa.binary())], names=["part", "body"])

    parts = df.select(text_col).mapInArrow(run, "part int, body binary")
    wide = lambda a, b: a.astype(np.uint64) + b
    counts = _summed(parts, "<u4", lambda a, b: np.minimum(wide(a, b), 0xFFFFFFFF).astype("<u4"), SLOTS // PARTS).astype(np.float64)
    return np.clip(np.log2(np.maximum(counts / max(counts.mean(), 1e-9), 1)), 0, 62).astype(np.uint8)


def filter_of(sids: DataFrame) -> np.ndarray:
    """Bits of the given set ids, FILTER_BITS of them whatever the input; a wrongly set bit only costs work."""
    width = FILTER_BITS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(FILTER_BITS - 1)] = True
        bodies = [np.packbits(x) for x in bits.reshape(PARTS, width)]
        live = [i for i, x in enumerate(bodies) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([bodies[i].tobytes() for i in live], pa.binary())], names=["part", "body"])

    return np.unpackbits(_summed(sids.mapInArrow(run, "part int, body binary"), "u1", np.bitwise_or, width // 8)).astype(bool)


# ---- components


def roots(parents: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(sid, comp) from a forest (sid, parent), by pointer jumping."""
    now, path = scratch(parents.select("sid", F.col("parent").alias("comp")), name)
    while True:
        up = now.select(F.col("sid").alias("_s"), F.col("comp").alias("_c"))
        after, new_path = scratch(now.join(up, now["comp"] == up["_s"], "left").select("sid", F.coalesce("_c", "comp").alias("comp"), F.col("_c").isNotNull().alias("moved")), name)
        moved = after.where("moved").limit(1).count()
        drop_scratch(parents.sparkSession, path)
        now, path = after.select("sid", "comp"), new_path
        if not moved:
            return now, path


def components(edges: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(sid, comp), comp being the least id of the component, from edges (a, b): large stars and small stars in turn."""
    spark = edges.sparkSession
    now, path = scratch(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after, new_path = scratch(small, name)
        drop_scratch(spark, path)
        now, path = after, new_path
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        if got == mark:
            return now.select(F.col("u").alias("sid"), F.col("v").alias("comp")), path
        mark = got


# ---- the join


def _sets_table(df: DataFrame, id_col: str, text_col: str, levels, percent: int) -> DataFrame:
    """id, n, sid and, for the first row of a task that has the set, the elements that make blocks and the point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = Sets(levels.value), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, n, sid, keys, points, rough = batch.slice(at, 512), [], [], [], [], []
                for e in sets.of(part.column(1)):
                    k = len(e)
                    s = set_id(e) if k else None
                    n.append(k)
                    sid.append(s)
                    new = k and s not in seen
                    if new and len(seen) < 2_000_000:
                        seen.add(s)
                    keys.append(e[: k - (-(-percent * k // 100)) + 1].view(np.int64) if new else None)
                    points.append(point(e).tobytes() if new else None)
                    rough.append(coarse(e).tobytes() if new else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.binary()), pa.array(rough, pa.binary())], names=[id_col, "n", "sid", "keys", "point", "coarse"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n long, sid long, keys array<long>, point binary, coarse binary")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each value of the first column."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for s in batch.column(0).to_pylist():
            new.append(s not in seen)
            seen.add(s)
        yield batch.filter(pa.array(new, pa.bool_()))


def _elements(df: DataFrame, text_col: str, levels, sids: DataFrame) -> DataFrame:
    """(sid, elements) of the given sets, each once, from the texts."""
    bits = df.sparkSession.sparkContext.broadcast(filter_of(sids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, own = Sets(levels.value), set(), bits.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, bodies = [], []
                for e in sets.of(batch.slice(at, 512).column(0)):
                    if len(e) and own[(s := set_id(e)) & (FILTER_BITS - 1)] and s not in seen:
                        if len(seen) < 2_000_000:
                            seen.add(s)
                        ids.append(s)
                        bodies.append(e.tobytes())
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], names=["sid", "elements"])

    types = "sid long, elements binary"
    return df.select(text_col).mapInArrow(run, types).repartition("sid").mapInArrow(_once, types)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose points' bound reaches the overlap asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, pa_, nb, pb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                keep.append(bound(pa_, pb) >= needed(na, nb, percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x = points.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    y = points.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    both = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, points: DataFrame, texts: DataFrame, levels, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that link, texts being one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    bounded, _ = scratch(_bounded(pairs, points, percent), "near-bounded")
    sids = bounded.select(F.explode(F.array("a", "b")).alias("sid"))
    full, _ = scratch(_elements(texts, texts.columns[0], levels, sids), "near-elements")
    x = full.select(F.col("sid").alias("a"), F.col("elements").alias("ea"))
    y = full.select(F.col("sid").alias("b"), F.col("elements").alias("eb"))
    return bounded.join(x, "a").join(y, "b").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def _rest(blocks: DataFrame, comps: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components in a block, as the trees give them."""
    own = blocks.join(comps, "sid", "left").select("key", "sid", F.coalesce("comp", "sid").alias("comp")).distinct()
    several = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", F.ceil(F.col("m") / CHUNK).cast("int").alias("c"))
    inside = own.join(several, "key")
    # A pair is given in the first only of the blocks that both sets are in.
    places = inside.groupBy("sid").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    rows = inside.withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "sid", "comp").join(points.select("sid", "n", "coarse").join(places, "sid"), "sid")

    def pairs_of(group: list) -> Iterator[tuple[int, int]]:
        i, j = group[0][1], group[0][2]
        if len({r[5] for r in group}) == 1:
            return
        g = min(n_groups(r[6]) for r in group)
        pts = np.stack([fold(np.frombuffer(r[7], np.uint8).astype(np.int64), g) for r in group])
        n = np.array([r[6] for r in group])
        tree = RTree(pts, n)
        for x, r in enumerate(group):
            for y in tree.search(pts[x], r[6], percent):
                s = group[y]
                if r[4] < s[4] and r[5] != s[5] and (i == j or r[3] != s[3]) and 100 * min(r[6], s[6]) >= percent * max(r[6], s[6]) and bound(r[7], s[7]) >= needed(r[6], s[6], percent):
                    if r[0] == min(set(r[8]).intersection(s[8])):
                        yield r[4], s[4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def put() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])
            out.clear()
            return got

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != now:
                    if len(group) > 1:
                        out.extend(pairs_of(group))
                    now, group = r[:3], []
                    if len(out) > 100_000:
                        yield put()
                group.append(r)
        if len(group) > 1:
            out.extend(pairs_of(group))
        yield put()

    rows = rows.select("key", "i", "j", "mine", "sid", "comp", "n", "coarse", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(run, "a long, b long").distinct()


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id (the least id reachable by links, its own included).

    Texts link when 100 * shared >= percent * union of their word 5-grams; a text of fewer words is one gram; null,
    empty and blank texts link with nothing and have their own id. Repeated rows stay, each with the same result.
    A null id takes part in links, and its component is that of the others or null. Other columns are not read."""
    spark: SparkSession = df.sparkSession
    levels = spark.sparkContext.broadcast(levels_of(df, text_col))
    docs, _ = scratch(_sets_table(df, id_col, text_col, levels, percent), "near-sets")

    level = F.shiftrightunsigned("key", 58)
    rows = docs.where(F.col("keys").isNotNull()).select("sid", F.explode("keys").alias("key"))
    salt = F.when(level >= HOT_LEVEL, F.pmod(F.xxhash64("sid"), F.pow(F.lit(2.0), level - HOT_LEVEL + 1).cast("long")).cast("int")).otherwise(0)
    rows = rows.withColumn("salt", salt)
    w = Window.partitionBy("key", "salt")
    celled = rows.withColumn("lo", F.min("sid").over(w)).withColumn("hi", F.max("sid").over(w))
    blocks, _ = scratch(celled.where((F.col("lo") != F.col("hi")) | (level >= HOT_LEVEL)).select("key", "salt", "sid").distinct(), "near-blocks")
    # Of blocks with the same sets one is enough; it counts as many.
    alike = blocks.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")).where("m > 1")
    alike = alike.groupBy("m", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("w")).select("key", "m", "w")
    blocks, _ = scratch(blocks.join(alike, "key"), "near-alike")

    # A block's hub is the set that meets most others over all its blocks: of edited copies, their original.
    score = blocks.groupBy("sid").agg(F.sum(F.col("m") * F.col("w")).alias("score"))
    scored, _ = scratch(blocks.join(score, "sid").select("key", "salt", "sid", "score", "w"), "near-scored")
    hubs = scored.groupBy("key", "salt").agg(F.max(F.struct("score", "sid")).alias("hub"))
    firsts = scored.join(hubs, ["key", "salt"]).select("sid", "hub", "w")
    # Of salted blocks, each cell's hub is compared with the block's.
    cells = hubs.where(level >= HOT_LEVEL)
    tops = cells.select("key", F.col("hub.sid").alias("sid"), F.lit(1).cast("long").alias("w")).join(cells.groupBy("key").agg(F.max("hub").alias("hub")), "key").select("sid", "hub", "w")
    firsts = firsts.unionByName(tops).where(F.col("sid") != F.col("hub.sid")).groupBy("sid", "hub").agg(F.sum("w").alias("count"))
    best = firsts.groupBy("sid").agg(F.max(F.struct("count", "hub")).alias("best")).select(F.col("sid").alias("a"), F.col("best.hub.sid").alias("b"))

    shared = blocks.select("sid").distinct()
    types = "sid long, n long, point binary, coarse binary"
    points, _ = scratch(docs.where("point is not null").select("sid", "n", "point", "coarse").join(shared, "sid", "left_semi").repartition("sid").mapInArrow(_once, types), "near-points")
    texts = df.select(text_col)
    best, _ = scratch(best, "near-best")
    first_links = verified(best, points, texts, levels, percent)
    comps, _ = roots(first_links.select(F.col("a").alias("sid"), F.col("b").alias("parent")), "near-roots")

    tested = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more, _ = scratch(verified(_rest(blocks, comps, points, percent).join(tested, ["a", "b"], "left_anti"), points, texts, levels, percent), "near-links")
    if more.limit(1).count():
        at = lambda c: F.coalesce(F.col("comp"), F.col(c))
        joined = more.join(comps, more["a"] == comps["sid"], "left").select(at("a").alias("a"), "b")
        joined = joined.join(comps, joined["b"] == comps["sid"], "left").select("a", at("b").alias("b"))
        over, _ = components(joined, "near-over")
        over = over.select(F.col("sid").alias("_s"), F.col("comp").alias("_c"))
        every = shared.join(comps, "sid", "left").select("sid", F.coalesce("comp", "sid").alias("comp"))
        comps = every.join(over, every["comp"] == over["_s"], "left").select("sid", F.coalesce("_c", "comp").alias("comp"))

    per_set = docs.where("n > 0").groupBy("sid").agg(F.min(id_col).alias("_id"))
    per_set = per_set.join(comps, "sid", "left").select("sid", F.coalesce("comp", "sid").alias("comp"), "_id")
    least = per_set.groupBy("comp").agg(F.min("_id").alias("component_id"))
    named = per_set.join(least, "comp").select("sid", "component_id")
    return docs.select(id_col, "n", "sid").join(named, "sid", "left").select(id_col, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))
