"""Hard negatives by an R-tree over integer vectors.

Rows are packed sort-tile-recursively: the two coordinates that vary most cut space into tiles (at
quantiles of a bounded sample; every row is indexed), Spark sorts tiles by the third and by id over all
partitions, and runs of 1,024 rows in that order become blocks. Inside, a block is sorted and cut again
until its leaves hold 64 rows. So copies of one vector, however many, are spread over blocks like all
others. A node's minimum bounding box bounds each coordinate, so the inner product with an anchor lies
between the sums of the least and the largest products of the coordinates.

Anchors travel in groups to chunks of blocks by a join; nothing is broadcast or collected but the
sample. A task keeps, for each anchor and score window, the best rows met so far, and takes a block's nodes
from a queue, the most promising first: a node whose interval lies outside an anchor's windows, or
strictly below the worst of a full list, is not opened for it. Lists of all chunks are merged at the end.
Positives are one window without ends over rows of the same label, negatives one window for each positive.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import small_batches
from ridgeline.session import stage, unstage, use_package

SAMPLE = 20_000
"""Rows (about so many, by a hash of the id) that the tiles are fitted on."""
BLOCK, LEAF, FAN = 1024, 64, 4
GROUP = 512
"""Anchors that travel together."""
ROWS_A_TASK = 4096
GROUPS_AT_ONCE = 64
"""Groups whose lists a task keeps before it hands them on."""
LEAST, LARGEST = -(2**63 - 1), 2**63 - 1
BLOCKS = "chunk int, ids array<bigint>, labels array<bigint>, vectors binary, low binary, high binary"
GROUPS = "ids array<bigint>, keys array<bigint>, labels array<bigint>, vectors binary, lo binary, hi binary"
FOUND = "anchor_id bigint, key bigint, place int, best array<struct<minus:bigint,id:bigint>>"


def quantiles(values: np.ndarray, parts: int) -> list[int]:
    """Values that cut sorted values into ``parts`` of like size."""
    ordered = np.sort(values)
    return [int(ordered[len(ordered) * k // parts]) for k in range(1, parts)] if len(ordered) else []


def tiled(rows: DataFrame, n: int) -> tuple[DataFrame, list[int]]:
    """Append ``tile`` and ``third`` to rows (id, label, v); also the coordinates by falling variance."""
    seen = rows.where(F.expr(f"pmod(xxhash64(id), {max(n, 1)}) < {SAMPLE}")).select("v").limit(2 * SAMPLE)
    sample = np.array([r["v"] for r in seen.collect()] or [[0]], np.float64)
    order = [int(k) for k in np.argsort(-sample.var(0), kind="stable")]
    a, b, c = (order * 3)[:3]
    parts = max(1, math.isqrt(min(n // (4 * BLOCK), len(sample) // 64)))
    slabs = quantiles(sample[:, a], parts)
    slab_of = np.searchsorted(slabs, sample[:, a], side="right")
    cuts = [quantiles(sample[slab_of == k, b], parts) for k in range(parts)]
    past = lambda x, limits: F.size(F.filter(limits, lambda q: q <= x))
    numbers = lambda q: F.array(*map(F.lit, q)).cast("array<bigint>")
    slab = past(F.col("v")[a], numbers(slabs))
    out = rows.withColumn("_slab", slab)
    tile = F.col("_slab") * parts + past(F.col("v")[b], F.get(F.array(*map(numbers, cuts)), F.col("_slab")))
    return out.withColumn("tile", tile).withColumn("third", F.col("v")[c]).drop("_slab"), order


def leaves(v: np.ndarray, order: list[int]) -> np.ndarray:
    """The rows of a block in the order of its leaves: sorted and cut into FAN runs, coordinate by coordinate."""

    def cut(at: np.ndarray, depth: int) -> list[np.ndarray]:
        if len(at) <= LEAF:
            return [at]
        at = at[np.argsort(v[at, order[depth % len(order)]], kind="stable")]
        step = max(LEAF, -(-len(at) // FAN // LEAF) * LEAF)  # whole leaves, so that all but the last are full
        return [x for k in range(0, len(at), step) for x in cut(at[k : k + step], depth + 1)]

    return np.concatenate(cut(np.arange(len(v)), 3))


def arrays(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, ...]:
    """id, key, label as vectors and v as a matrix."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return (*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key", "label")), flat.reshape(batch.num_rows, dims))


def packed(rows: DataFrame, tasks: int, dims: int, kind: str, order: list[int], windows: bool) -> DataFrame:
    """Rows (id, key, label, v, tile, third) in sorted runs: BLOCKS, or GROUPS of anchors (with ``windows``: the
    columns lo and hi of each). Repeated rows stand side by side and count once."""
    size = GROUP if windows else BLOCK
    by = ["tile", "third", "id", "label", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by], 1)
            fresh = np.ones(len(marks), bool)
            fresh[1:] = (marks[1:] != marks[:-1]).any(1)
            if last is not None and len(marks):
                fresh[0] = (marks[0] != last).any()
            last = marks[-1] if len(marks) else last
            batch = batch.filter(pa.array(fresh))
            start = 0
            while batch.num_rows - start + count >= size:
                held.append(batch.slice(start, size - count))
                start += size - count
                yield emit(held)
                held, count = [], 0
            if start < batch.num_rows:
                held.append(batch.slice(start))
                count += batch.num_rows - start
        if held:
            yield emit(held)

    def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ids, keys, labels, v = arrays(batch, dims)
        if windows:
            bounds = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("lo", "hi")]
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.list_(pa.int64())) for x in (ids, keys, labels)), *(pa.array([x], pa.binary()) for x in (v.astype(kind).tobytes(), *bounds))], names=[c.split()[0] for c in GROUPS.split(", ")])
        at = leaves(v, order)
        v = v[at].astype(kind)
        starts = np.arange(0, len(v), LEAF)
        boxes = (np.minimum.reduceat(v, starts).tobytes(), np.maximum.reduceat(v, starts).tobytes())
        chunk = pa.array([TaskContext.get().partitionId()], pa.int32())
        return pa.RecordBatch.from_arrays([chunk, *(pa.array([x[at]], pa.list_(pa.int64())) for x in (ids, labels)), *(pa.array([x], pa.binary()) for x in (v.tobytes(), *boxes))], names=[c.split()[0] for c in BLOCKS.split(", ")])

    extra = ["lo", "hi"] if windows else []
    laid = rows.select(*by, "v", *extra).repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    return laid.mapInArrow(run, GROUPS if windows else BLOCKS)


class Lists:
    """The best rows of each anchor of a group in each of its windows."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
        self.ids, self.keys, self.labels, self.q, self.lo, self.hi = ids, keys, labels, q, lo, hi
        self.up, self.down = np.maximum(q, 0), np.minimum(q, 0)
        self.scores = np.full((*lo.shape, k), LEAST, np.int64)
        self.rows = np.full((*lo.shape, k), LARGEST, np.int64)

    def least(self, at: np.ndarray) -> np.ndarray:
        """Scores strictly below these change nothing."""
        return np.maximum(self.lo[at], self.scores[at, :, -1])

    def visit(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> None:
        """Take in what a block holds, the most promising nodes first."""
        levels = [(low, high)]
        while len(levels[0][0]) > 1:
            starts = np.arange(0, len(levels[0][0]), FAN)
            levels.insert(0, (np.minimum.reduceat(levels[0][0], starts), np.maximum.reduceat(levels[0][1], starts)))
        queue: list[tuple[float, int, int, np.ndarray]] = []

        def offer(level: int, node: int, at: np.ndarray) -> None:
            a, b = levels[level][0][node], levels[level][1][node]
            upper, lower = self.up[at] @ b + self.down[at] @ a, self.up[at] @ a + self.down[at] @ b
            wanted = ((upper[:, None] >= self.least(at)) & (lower[:, None] <= self.hi[at]) & (self.lo[at] <= self.hi[at])).any(1)
            if wanted.any():
                heapq.heappush(queue, (-upper[wanted].max(), level, node, at[wanted], upper[wanted]))

        offer(0, 0, np.arange(len(self.ids)))
        while queue:
            _, level, node, at, upper = heapq.heappop(queue)
            at = at[(upper[:, None] >= self.least(at)).any(1)]  # lists may have filled since
            if not len(at):
                continue
            if level + 1 < len(levels):
                for child in range(FAN * node, min(FAN * node + FAN, len(levels[level + 1][0]))):
                    offer(level + 1, child, at)
            else:
                part = slice(LEAF * node, LEAF * node + LEAF)
                self.take(at, ids[part], labels[part], v[part], same)

    def take(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, same: bool) -> None:
        """Score the rows of a leaf."""
        s = (self.q[at] @ v.T).astype(np.int64)
        fits = ((labels == self.labels[at, None]) == same) & (ids != self.ids[at, None])
        least, k = self.least(at), self.scores.shape[2]
        for w in range(self.lo.shape[1]):
            good = fits & (s >= least[:, w, None]) & (s <= self.hi[at, w, None])
            some = np.nonzero(good.any(1))[0]
            if not len(some):
                continue
            rows = at[some]
            scores = np.concatenate([self.scores[rows, w], np.where(good[some], s[some], LEAST)], 1)
            names = np.concatenate([self.rows[rows, w], np.where(good[some], ids, LARGEST)], 1)
            best = np.lexsort((names, -scores), axis=-1)[:, :k]
            self.scores[rows, w], self.rows[rows, w] = np.take_along_axis(scores, best, 1), np.take_along_axis(names, best, 1)

    def found(self) -> pa.RecordBatch:
        """Rows of FOUND."""
        there = self.scores > LEAST
        anchor, place = np.nonzero(there.any(2))
        full = there[anchor, place]
        pairs = pa.StructArray.from_arrays([pa.array(-self.scores[anchor, place][full]), pa.array(self.rows[anchor, place][full])], ["minus", "id"])
        ends = np.concatenate([[0], np.cumsum(full.sum(1))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[anchor]), pa.array(self.keys[anchor]), pa.array(place.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["anchor_id", "key", "place", "best"])


def search(blocks: DataFrame, groups: DataFrame, chunks: int, dims: int, kind: str, k: int, same: bool, exact: str) -> DataFrame:
    """(anchor_id, key, place, best): the first ``k`` rows (minus the score, id) of each window of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_lists: dict[tuple, Lists] = {}
        matrix = lambda x: np.frombuffer(x, kind).reshape(-1, dims).astype(exact)
        ints = lambda x: np.array(x, np.int64)
        for batch in batches:
            for n in range(batch.num_rows):
                r = {c: batch.column(c)[n] for c in batch.schema.names}
                name = r["a_ids"][0].as_py(), r["a_keys"][0].as_py()
                if name not in open_lists:
                    if len(open_lists) >= GROUPS_AT_ONCE:
                        yield from (x.found() for x in open_lists.values())
                        open_lists.clear()
                    a = [r[f"a_{c}"].as_py() for c in ("ids", "keys", "labels", "vectors", "lo", "hi")]
                    lo, hi = (np.frombuffer(x, np.int64).reshape(len(a[0]), -1) for x in a[4:])
                    open_lists[name] = Lists(*map(ints, a[:3]), matrix(a[3]), lo, hi, k)
                open_lists[name].visit(*(ints(r[c].as_py()) for c in ("ids", "labels")), *(matrix(r[c].as_py()) for c in ("vectors", "low", "high")), same)
        yield from (x.found() for x in open_lists.values())

    sent = groups.select(*(F.col(c).alias(f"a_{c}") for c in groups.columns), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    # by number, so that small tables still use all cores
    met = blocks.repartition(2 * chunks, "chunk").join(sent.repartition(2 * chunks, "chunk").hint("merge"), "chunk").drop("chunk")
    parts = met.mapInArrow(run, FOUND).groupBy("anchor_id", "key", "place").agg(F.flatten(F.collect_list("best")).alias("best"))
    return parts.select("anchor_id", "key", "place", F.slice(F.array_sort("best"), 1, k).alias("best"))


def percent_of(score: Column, percent: int, up: bool) -> Column:
    """percent * score / 100, rounded up or down, exactly."""
    hundred = F.lit(100).cast("bigint")
    rest = F.pmod(score, hundred)
    whole = F.call_function("div", score - rest, hundred)
    return percent * whole + F.call_function("div", percent * rest + (99 if up else 0), hundred)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "id", label_col: str = "label", vector_col: str = "vector", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of integer vectors (array<bigint>). Higher scores come first, ties by the smaller id. An
    anchor's positives are its first other rows of the same label; a positive's negatives the first rows of
    another label with low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null id, label, vector or component take no part, nor do those with a component beyond
    what keeps scores within 63 bits. Shorter vectors are padded with zeros; an empty one is all zeros.
    Rows repeated as a whole count once; rows that share an id but differ are rows of their own, and never each
    other's partners. No rows give no rows; other columns are ignored.
    """
    use_package(rows.sparkSession)
    small_batches(rows.sparkSession)
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    taken = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<bigint>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole)
    dims = max(1, taken.agg(F.max(F.size("v"))).first()[0] or 1)
    most = math.isqrt((2**63 - 1) // dims)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("v")))
    fits = taken.where(~F.exists("v", lambda x: (x > most) | (x < -most))).withColumn("v", padded)
    table = stage(fits.withColumn("key", F.xxhash64("label", "v")), "vectors")
    stats = table.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    n, top = stats["n"], stats["top"] or 0
    kind = next(t for t, bits in (("int16", 15), ("int32", 31), ("int64", 63)) if top < 1 << bits)
    exact = "float64" if dims * top * top < 1 << 53 else "int64"
    tasks = max(1, min(-(-n // ROWS_A_TASK), 4 * rows.sparkSession.sparkContext.defaultParallelism))

    laid, order = tiled(table, n)
    blocks = stage(packed(laid, tasks, dims, kind, order, False), "blocks")
    anchors = laid.where("asks").drop("asks")
    some = max(1, min(tasks, n // ROWS_A_TASK))
    everything = [F.array(F.lit(x).cast("bigint")) for x in (LEAST, LARGEST)]
    first = stage(packed(anchors.withColumn("lo", everything[0]).withColumn("hi", everything[1]), some, dims, kind, order, True), "groups")
    own = stage(search(blocks, first, tasks, dims, kind, positives, True, exact).select(F.col("anchor_id").alias("id"), "key", "best"), "positives")
    fill = F.array_repeat(F.struct(F.lit(1).cast("bigint").alias("minus"), F.lit(None).cast("bigint").alias("id")), positives)  # an empty window
    windows = own.select("id", "key", F.slice(F.concat("best", fill), 1, positives).alias("best"))
    windows = windows.select("id", "key", F.transform("best", lambda p: percent_of(-p["minus"], low, True)).alias("lo"), F.transform("best", lambda p: percent_of(-p["minus"], high, False)).alias("hi"))
    second = stage(packed(anchors.join(windows.hint("merge"), ["id", "key"]), some, dims, kind, order, True), "groups")
    theirs = stage(search(blocks, second, tasks, dims, kind, negatives, False, exact), "negatives")
    for x in (table, blocks, first, second):
        unstage(x)
    wanted = own.select(F.col("id").alias("anchor_id"), "key", F.posexplode("best").alias("place", "p")).select("anchor_id", "key", "place", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"))
    met = wanted.join(theirs, ["anchor_id", "key", "place"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "n"))
    return met.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.minus")).alias("negative_score"))
