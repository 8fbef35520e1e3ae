"""Surfaces that drain: pits filled over blocks of a tile, and directions for flats.

Filling floods every block of a tile by itself, from its rim and from cells beside NoData or the tile's edge.
A flooded cell keeps the label of the rim cell its water left by. What it costs to leave is then a
question between labels alone: neighbouring cells of different labels make an edge whose weight is the
higher of the two, and a forest of lowest edges, grown by joins in Boruvka's rounds, gives each label the lowest level
at which it reaches the outside. Labels are some hundredths of the cells, rounds their logarithm.

A filled surface has flats. Two distances inside a flat, from where it drains and from higher ground, are
spread in blocks that exchange rims until nothing changes, and give every flat cell a direction.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.routing import CELL, D8, SIDES, accumulate, d8_direction, places, pointed
from ridgeline.operators.stencil import BLOCK, eight_neighbours
from ridgeline.session import in_packs, stage, unstage, use_package

OUTSIDE = -1
"""The label of what drains over the tile's edge or into NoData."""
FAR = 1 << 30
STEPS = [(dj, di) for _, di, dj in D8]


def around(prefix: str) -> list[Column]:
    """The eight neighbours' columns in the order of D8."""
    return [F.col(f"{prefix}_{SIDES[code]}") for code, _, _ in D8]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def at_rim(block: int) -> Column:
    """Whether a cell lies on the rim of its block."""
    return any_of([F.col(x) % block == e for x in "ji" for e in (0, block - 1)])


def grid_of(rows: pd.DataFrame, pad: int = 0) -> tuple[tuple[np.ndarray, np.ndarray], tuple[int, int]]:
    """Where a block's cells lie in an array with ``pad`` cells around, and the array's shape."""
    j, i = (rows[c].to_numpy() - rows[c].min() + pad for c in "ji")
    return (j, i), (j.max() + 1 + pad, i.max() + 1 + pad)


def flood(rows: pd.DataFrame) -> pd.DataFrame:
    """Cells of some blocks (z, seed: a label or NaN) with ``label`` and ``level``: the seed whose water reaches a cell
    lowest, and how high it has to stand."""
    n, size, place = places(rows)
    j, i = rows["j"].to_numpy(), rows["i"].to_numpy()
    at = place(n, j, i)
    known, seeded = rows["z"].notna().to_numpy(), rows["seed"].notna().to_numpy()
    level = np.full(size, np.nan)
    level[at] = rows["z"]
    closed = np.ones(size, bool)
    closed[at[known & ~seeded]] = False
    label = np.full(size, OUTSIDE - 1, np.int64)  # stays where z is not known
    label[at[seeded]] = rows["seed"].to_numpy()[seeded].astype(np.int64)
    level, label, closed = level.tolist(), label.tolist(), closed.tolist()
    by_block = np.nonzero(seeded)[0]
    by_block = by_block[np.argsort(n[by_block], kind="stable")]
    for starts in np.split(by_block, np.nonzero(np.diff(n[by_block]))[0] + 1):
        if not len(starts):
            continue
        first = starts[0]
        wide = int(place(n[first], j[first] + 1, i[first]) - at[first])
        steps = [dj * wide + di for dj, di in STEPS]
        heap = [(level[k], k) for k in at[starts[np.lexsort((i[starts], j[starts]))]].tolist()]
        heapq.heapify(heap)
        while heap:
            height, k = heapq.heappop(heap)
            of = label[k]
            for step in steps:
                to = k + step
                if not closed[to]:
                    closed[to] = True
                    if level[to] < height:
                        level[to] = height
                    label[to] = of
                    heapq.heappush(heap, (level[to], to))
    return rows[[*CELL, "z"]].assign(label=np.array(label)[at], level=np.array(level)[at])


def fill_pits(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Append ``filled``: elevations raised until every cell drains to the edge or to NoData, no higher than needed.

    NULL where z is. Cells without a row count as NoData."""
    use_package(cells.sparkSession)
    near = eight_neighbours(cells.select(*CELL, "z"), "z", "n")
    seed = F.when(F.col("z").isNull(), None).when(any_of([c.isNull() for c in around("n")]), OUTSIDE).when(at_rim(block), F.col("j").cast("bigint") * (1 << 31) + F.col("i"))
    dealt = near.select(*CELL, "z", seed.cast("double").alias("seed"), F.floor(F.col("j") / block).alias("bj"), F.floor(F.col("i") / block).alias("bi"))
    kind = cells.schema["tile_id"].dataType.simpleString()
    flooded = stage(in_packs(dealt, ["tile_id", "bj", "bi"], flood, f"tile_id {kind}, j int, i int, z double, label bigint, level double"), "flooded")
    filled = flooded.select(*CELL, "z", F.col("level").alias("filled"))
    inner = flooded.where((F.col("label") != OUTSIDE) & F.col("level").isNotNull())
    if not inner.isEmpty():  # water of blocks inside a tile; a tile of one block has drained already
        filled = flooded.join(leaving(flooded.where("level IS NOT NULL")).hint("merge"), ["tile_id", "label"], "left").select(*CELL, "z", F.greatest("level", "spill").alias("filled"))
    if set(cells.columns) == {*CELL, "z"}:
        return filled.select(*cells.columns, "filled")
    return cells.join(filled.drop("z").hint("merge"), CELL, "left").select(*cells.columns, "filled")


def leaving(flooded: DataFrame) -> DataFrame:
    """(tile_id, label, spill): the least level at which each label's water reaches the outside."""
    beside = eight_neighbours(flooded.withColumn("c", F.struct("label", "level")), "c", "c")
    other = F.explode(F.filter(F.array(*around("c")), lambda c: c["label"] != F.col("label")))
    pairs = beside.select("tile_id", "label", "level", other.alias("c"))
    edges = pairs.groupBy("tile_id", F.least("label", "c.label").alias("a"), F.greatest("label", "c.label").alias("b")).agg(F.min(F.greatest("level", "c.level")).alias("w"))
    return spill_levels(edges).select("tile_id", F.col("node").alias("label"), F.col("level").alias("spill"))


def spill_levels(edges: DataFrame) -> DataFrame:
    """(tile_id, a, b, w), a < b, one row a pair -> (tile_id, node, level): the least, over all ways from a node
    to OUTSIDE, of the heaviest edge on the way.

    In each round every component picks its lightest edge. All ways out of it cost as much, and beyond that
    edge what it costs from the other end; so a node's level is the heaviest pick on its way through the rounds,
    and edges between components keep their weights."""
    live = stage(edges, "spills")
    state = stage(live.select("tile_id", F.explode(F.array("a", "b")).alias("node")).where(F.col("node") != OUTSIDE).distinct().select("tile_id", "node", F.col("node").alias("part"), F.lit(None).cast("double").alias("level")), "levels")
    while not live.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("a").alias("part"), F.col("b").alias("to")), F.struct(F.col("b").alias("part"), F.col("a").alias("to"))))
        both = live.select("tile_id", "w", F.struct("w", "a", "b").alias("edge"), ends.alias("e")).select("tile_id", "e.part", F.struct("edge", "e.to").alias("pick"))
        best = both.where(F.col("part") != OUTSIDE).groupBy("tile_id", "part").agg(F.min("pick").alias("p"))
        picks = stage(best.select("tile_id", "part", F.col("p.to").alias("to"), F.col("p.edge.w").alias("w")), "picks")
        back = picks.select("tile_id", F.col("part").alias("to"), F.col("to").alias("back"))
        root = (F.col("back") == F.col("part")) & (F.col("part") < F.col("to"))  # of two that pick each other
        led = picks.join(back.hint("merge"), ["tile_id", "to"], "left").where(~F.coalesce(root, F.lit(False))).select("tile_id", "part", "to", "w")
        led = to_roots(led)
        new_state = state.join(led.hint("merge"), ["tile_id", "part"], "left").select("tile_id", "node", F.coalesce("to", "part").alias("part"), F.greatest("level", "w").alias("level"))
        new_live = live
        for x in "ab":
            new_live = new_live.join(led.select("tile_id", F.col("part").alias(x), F.col("to").alias(f"to_{x}")).hint("merge"), ["tile_id", x], "left").withColumn(x, F.coalesce(f"to_{x}", x)).drop(f"to_{x}")
        joined = new_live.where("a <> b").groupBy("tile_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
        old = state, live, picks, led
        state, live = stage(new_state, "levels"), stage(joined, "spills")
        for table in old:
            unstage(table)
    unstage(live)
    return state.select("tile_id", "node", "level")


def to_roots(pointers: DataFrame, jumps: int = 4) -> DataFrame:
    """(tile_id, part, to, w) with ``to`` followed until it points nowhere: each round follows ``jumps`` + 1 of the
    last round's pointers."""
    state = stage(pointers, "pointers")
    while True:
        ahead = state.select("tile_id", F.col("part").alias("to"), F.col("to").alias("next"))
        new = state
        for _ in range(jumps):
            new = new.drop("moved").join(ahead.hint("merge"), ["tile_id", "to"], "left").select("tile_id", "part", F.coalesce("next", "to").alias("to"), "w", F.col("next").isNotNull().alias("moved"))
        new = stage(new, "pointers")
        unstage(state)
        state = new
        if new.where("moved").isEmpty():
            return state


# ---- flats


def spread(rows: pd.DataFrame, block: int) -> pd.DataFrame:
    """Distances t and a of a block's flat cells, lowered by those of equal neighbours; ``moved``: whether
    another block has to hear of it."""
    first = rows.iloc[0]
    at, shape = grid_of(rows, 1)
    z = np.full(shape, np.nan)
    z[at] = rows["z"]
    inside = (slice(1, -1), slice(1, -1))
    shift = [(slice(1 + dj, shape[0] - 1 + dj), slice(1 + di, shape[1] - 1 + di)) for dj, di in STEPS]
    same = [z[s] == z[inside] for s in shift]
    out = {}
    for name in ("t", "a"):
        d = np.full(shape, FAR)
        d[at] = rows[name].fillna(FAR)
        while True:
            lower = d[inside].copy()
            for s, ok in zip(shift, same, strict=True):
                np.minimum(lower, np.where(ok, d[s] + 1, FAR), out=lower)
            if (lower == d[inside]).all():
                break
            d[inside] = lower
        out[name] = d[at]
    changed = np.any([(out[n] < rows[n].fillna(FAR).to_numpy()) for n in out], axis=0)
    rim = np.any([rows[c] % block == e for c in "ji" for e in (0, block - 1)], axis=0)
    own = (rows["j"] // block == first["bj"]) & (rows["i"] // block == first["bi"])
    values = {n: pd.array(np.where(x < FAR, x, 0), dtype="Int32") for n, x in out.items()}
    for n, x in out.items():
        values[n][x >= FAR] = pd.NA
    return rows[[*CELL, "z"]].assign(**values, moved=changed & rim)[own]


def flat_distances(flats: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tile_id, j, i, z, t, a) of flat cells, t and a 1 at their starts -> the same with all distances; NULL
    where none leads. Rounds grow with the blocks that a flat runs through."""
    use_package(flats.sparkSession)
    reach = lambda x: F.explode(F.sequence(F.greatest(F.floor((F.col(x) - 1) / block), F.lit(0)), F.floor((F.col(x) + 1) / block)))
    kind = flats.schema["tile_id"].dataType.simpleString()
    state = stage(flats, "flats")
    while True:
        dealt = state.select(*CELL, "z", "t", "a").withColumn("bj", reach("j")).withColumn("bi", reach("i"))
        new = stage(dealt.groupBy("tile_id", "bj", "bi").applyInPandas(lambda rows: spread(rows, block), f"tile_id {kind}, j int, i int, z double, t int, a int, moved boolean"), "flats")
        unstage(state)
        state = new
        if new.where("moved").isEmpty():
            return state


def drain_flats(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """``fd`` of flat cells filled in: of a flat's cells, the one nearest to where it drains and farthest from higher
    ground, where cells that drain come first. cells: tile_id, j, i, z, fd.

    Cells beside NoData or the tile's edge keep a NULL direction, they drain outside; so do pits, which nothing
    level leads out of. Twice the distance to the drain less that from higher ground falls on every step, so no cycle arises."""
    near = eight_neighbours(cells.select(*CELL, "z", "fd"), "z", "n")
    flat = F.col("z").isNotNull() & F.col("fd").isNull() & ~any_of([c.isNull() for c in around("n")])
    marked = stage(near.select(*CELL, "z", "fd", flat.alias("flat")), "marked")
    beside = eight_neighbours(marked.withColumn("c", F.struct("z", "flat")), "c", "c").where("flat")
    level = lambda c: c["z"] == F.col("z")
    low, high = any_of([level(c) & ~c["flat"] for c in around("c")]), any_of([c["z"] > F.col("z") for c in around("c")])
    flats = flat_distances(beside.select(*CELL, "z", F.when(low, 1).alias("t"), F.when(high, 1).alias("a")), block)
    rank = flats.where("t IS NOT NULL").select(*CELL, (2 * F.col("t") - F.coalesce("a", F.lit(0))).alias("rank"))
    ranked = marked.join(rank.hint("merge"), CELL, "left").withColumn("c", F.struct("z", F.when(F.col("flat"), F.col("rank")).otherwise(-FAR).alias("rank")))
    met = eight_neighbours(ranked, "c", "c")
    offers = F.array(*(F.when(level(c) & c["rank"].isNotNull(), F.struct(c["rank"].alias("rank"), F.lit(n).alias("n"), F.lit(D8[n][0]).alias("code"))) for n, c in enumerate(around("c"))))
    best = F.array_min(F.filter(offers, lambda o: o.isNotNull()))["code"]
    found = met.where("flat AND rank IS NOT NULL").select(*CELL, best.alias("over_flat"))
    return cells.join(found.hint("merge"), CELL, "left").withColumn("fd", F.coalesce("fd", "over_flat")).select(*cells.columns)


def filled_flow(cells: DataFrame, dx: float, block: int = BLOCK) -> DataFrame:
    """D8 direction and drainage area of a filled surface (z): columns fd and area appended, flats drained."""
    directed = drain_flats(stage(d8_direction(cells, dx), "directed"), block)
    return accumulate(pointed(directed), dx * dx).select(*directed.columns, "area")
