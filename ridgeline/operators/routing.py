"""Flow routing: D8 and D-infinity directions, receivers, drainage area, channel elevations.

Directions are window stencils. What follows paths (drainage area, elevations along channels, falls) is followed inside
blocks of a tile, by pointer doubling; what crosses between blocks is joined where it enters, by doubling too, so a path takes about
log2 of the blocks it enters in rounds. D-infinity area is handed on in blocks that exchange what crosses between them; only D-infinity
channels, whose result depends on the order of a queue, run tile by tile in Python workers. Filling and flats are in ``drainage``.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.stencil import BLOCK, eight_neighbours
from ridgeline.session import in_packs, stage, unstage, use_package

# D8 codes, column step, row step; the order breaks ties.
D8 = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (8, -1, 1), (16, -1, 0), (32, -1, -1), (64, 0, -1), (128, 1, -1)]
SIDES = {1: "e", 2: "se", 4: "s", 8: "sw", 16: "w", 32: "nw", 64: "n", 128: "ne"}
# Cardinal code, diagonal code and reported base angle (in eighths of a turn) of each facet.
FACETS = [(1, 128, 0), (64, 128, 1), (64, 32, 2), (16, 32, 3), (16, 8, 4), (4, 8, 5), (4, 2, 6), (1, 2, 7)]
STEP = {code: (di, dj) for code, di, dj in D8}
QUARTER = math.pi / 4
CELL = ["tile_id", "j", "i"]


def d8_direction(cells: DataFrame, dx: float) -> DataFrame:
    """Append ``fd``: the D8 code of the steepest fall, NULL where nothing is lower.

    Ties go to the first of E, SE, S, SW, W, NW, N, NE."""
    return with_d8(eight_neighbours(cells), cells.columns, dx)


def with_d8(near: DataFrame, kept: list[str], dx: float) -> DataFrame:
    """Columns ``kept`` and ``fd`` of cells with their neighbours' elevations."""
    df = near.select(*kept, *(F.coalesce((F.col("z") - F.col(f"z_{SIDES[code]}")) / (dx * math.hypot(di, dj)), F.lit(-1.0)).alias(f"_s{code}") for code, di, dj in D8))
    df = df.withColumn("_best", F.greatest(*(F.col(f"_s{code}") for code, _, _ in D8)))
    first = F.when(F.col("_best") <= 0, None)
    for code, _, _ in D8:
        first = first.when(F.col(f"_s{code}") == F.col("_best"), code)
    return df.select(*kept, first.alias("fd"))


def downstream(cells: DataFrame, valid: str = "z") -> DataFrame:
    """(tile_id, j, i, dn_j, dn_i, steps): the cell each valid cell's D8 code leads to.

    NULL where the code is none of the eight or leads to a cell that is missing or not valid. steps:
    1 or the square root of 2."""
    ok = cells.where(F.col(valid).isNotNull())
    code = F.col("fd").cast("int")
    pick = lambda part: F.coalesce(*(F.when(code == c, F.lit(s[part])) for c, s in STEP.items()))
    out = ok.select(*CELL, (F.col("j") + pick(1)).alias("dn_j"), (F.col("i") + pick(0)).alias("dn_i"), F.when(code.isin(1, 4, 16, 64), 1.0).when(code.isin(2, 8, 32, 128), math.sqrt(2)).alias("steps"))
    there = ok.select("tile_id", F.col("j").alias("dn_j"), F.col("i").alias("dn_i"), F.lit(True).alias("there"))
    met = out.join(there, ["tile_id", "dn_j", "dn_i"], "left")
    return met.select(*CELL, *(F.when(F.col("there"), F.col(c)).alias(c) for c in ("dn_j", "dn_i", "steps")))


def upstream_counts(edges: DataFrame) -> DataFrame:
    """(tile_id, j, i, n_up): how many cells lead to each cell that any leads to."""
    return edges.where(F.col("dn_j").isNotNull()).groupBy("tile_id", F.col("dn_j").alias("j"), F.col("dn_i").alias("i")).agg(F.count("*").alias("n_up"))


def pointed(cells: DataFrame, valid: str = "z") -> DataFrame:
    """Append dn_j, dn_i and steps by each valid cell's D8 code (NULL for others), whether or not a cell is there, and ``ok``."""
    ok = F.col(valid).isNotNull()
    of = lambda value: looked_up({c: value(*s) for c, s in STEP.items()}, F.when(ok, F.col("fd").cast("int")))
    return cells.withColumns({"dn_j": F.col("j") + of(lambda di, dj: dj), "dn_i": F.col("i") + of(lambda di, dj: di), "steps": of(math.hypot), "ok": ok})


def looked_up(table: dict[int, float], key: Column) -> Column:
    """What a small fixed table holds for a key, else NULL."""
    return F.try_element_at(F.create_map(*(F.lit(x) for entry in table.items() for x in entry)), key)


def ringed(cells: DataFrame, block: int) -> DataFrame:
    """Cells dealt to their block, (bj, bi), and to those whose outermost cells they touch."""
    reach = lambda x: F.explode(F.sequence(F.greatest(F.floor((F.col(x) - 1) / block), F.lit(0)), F.floor((F.col(x) + 1) / block)).cast("array<int>"))
    return cells.withColumn("bj", reach("j")).withColumn("bi", reach("i"))


def places(rows: pd.DataFrame) -> tuple[np.ndarray, int, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]:
    """Where the cells of a frame's blocks (tile_id, bj, bi) lie in one flat array, each block with a cell around it: the number of each
    row's block, the array's size, and the place of cell j, i of a block; what lies beyond is put on that block's outermost cells."""
    j, i, bj, bi = (rows[c].to_numpy(dtype=np.int64) for c in ("j", "i", "bj", "bi"))
    key = (pd.factorize(rows["tile_id"])[0] * (bj.max() + 1) + bj) * (bi.max() + 1) + bi
    n = np.unique(key, return_inverse=True)[1]
    ends = []
    for x in (j, i):
        low, high = np.full(n.max() + 1, np.iinfo(np.int64).max), np.full(n.max() + 1, -1)
        np.minimum.at(low, n, x)
        np.maximum.at(high, n, x)
        ends.append((low - 1, high - low + 3))
    (low_j, ny), (low_i, nx) = ends
    start = np.concatenate([[0], np.cumsum(ny * nx)])
    return n, int(start[-1]), lambda n, j, i: start[n] + np.clip(j - low_j[n], 0, ny[n] - 1) * nx[n] + np.clip(i - low_i[n], 0, nx[n] - 1)


def owned(rows: pd.DataFrame, block: int) -> np.ndarray:
    """Which rows lie in the block that they are dealt to."""
    return ((rows["j"] // block == rows["bj"]) & (rows["i"] // block == rows["bi"])).to_numpy()


def links_of(rows: pd.DataFrame, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of some blocks (with the rings around them): which are their block's own, the row of the same block that each one's pointer
    leads to (itself: none), and whether that one lies in another block. Rows of the ring, and pointers to cells that are not there or not
    ok, lead nowhere."""
    n, size, at = places(rows)
    own = owned(rows, block)
    row_of = np.full(size, -1)
    row_of[at(n, rows["j"].to_numpy(), rows["i"].to_numpy())] = np.where(rows["ok"], np.arange(len(rows)), -1)
    has = own & rows["ok"].to_numpy() & rows["dn_j"].notna().to_numpy()
    to = np.arange(len(rows))
    found = row_of[at(n[has], *(rows[c].to_numpy(dtype=float, na_value=0)[has].astype(np.int64) for c in ("dn_j", "dn_i")))]
    to[has] = np.where(found >= 0, found, to[has])
    return own, to, ~own[to]


def gathered(to: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By pointer doubling inside a block: what comes together at each row of what all of them are given, the last row that each
    one's path reaches, and whether it never ends."""
    here = np.arange(len(to))
    ptr, total, alive = to.copy(), given.astype(float), to != here
    for _ in range(len(to).bit_length() + 1):
        if not alive.any():
            break
        total = total + np.bincount(ptr[alive], weights=total[alive], minlength=len(to))
        alive = alive & alive[ptr]
        ptr = ptr[ptr]
    return total, ptr, alive


def doubled(state: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(tile_id, node, ptr, area) -> the same with all area that comes down to a node, by pointer doubling. A tile of n nodes has no
    path of more than n, so what still points on after log2 n rounds is on a cycle or leads to one."""
    state = stage(state, "flow")
    largest = state.groupBy("tile_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(min(max_rounds, largest.bit_length() + 1)):
        if state.where(F.col("ptr").isNotNull()).isEmpty():
            break
        given = state.where(F.col("ptr").isNotNull()).groupBy("tile_id", F.col("ptr").alias("node")).agg(F.sum("area").alias("more"))
        ahead = state.select("tile_id", F.col("node").alias("ptr"), F.col("ptr").alias("next"))
        nxt = state.join(given.hint("merge"), ["tile_id", "node"], "left").join(ahead.hint("merge"), ["tile_id", "ptr"], "left")
        new = stage(nxt.select("tile_id", "node", F.col("next").alias("ptr"), (F.col("area") + F.coalesce("more", F.lit(0.0))).alias("area")), "flow")
        unstage(state)
        state = new
    return state


def accumulate(
    edges: DataFrame, cell_area: float, max_rounds: int = 40, refuse: bool = True, block: int = BLOCK, also: Callable[[pd.DataFrame], dict] | None = None, more: tuple[str, ...] = ()
) -> DataFrame:
    """(tile_id, j, i, area): drainage area over D8 edges (tile_id, j, i, dn_j, dn_i between neighbours).

    Columns after these are handed through; cells whose column ``ok``, if there is one, is false have none. Cells are counted inside
    blocks of a tile; what crosses is added up, by doubling, between the cells where it enters other blocks, and counted down from there.
    Edges on a cycle or leading to one are refused, or, with ``refuse`` off, all of their tile's areas are NULL and other tiles go on.
    ``also`` gives the rows of a block (with the ring around it) further columns, doubles named by ``more``, in the same pass."""
    use_package(edges.sparkSession)
    rows = edges if "ok" in edges.columns else edges.withColumn("ok", F.lit(True))
    kept = [c for c in rows.columns if c not in (*CELL, "dn_j", "dn_i", "steps", "ok")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    given = [*CELL, *kept, "dn_j", "dn_i", "ok"]
    kept += more
    shape = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in (*CELL, *kept, "dn_j", "dn_i", "ok")) + ", bj int, bi int, n double"

    def count(group: pd.DataFrame) -> pd.DataFrame:
        own, to, crosses = links_of(group, block)
        n, end, lost = gathered(to, group["ok"].to_numpy() & own)
        outs = {c: pd.arrays.IntegerArray(group[x].to_numpy()[end].astype("int64"), own[end]) for c, x in (("out_j", "j"), ("out_i", "i"))}
        return group.assign(n=n, lost=lost, leaves=crosses, **outs, **(also(group) if also else {}))[own]

    first = ringed(rows.select(*given), block)
    state = stage(in_packs(first, ["tile_id", "bj", "bi"], count, shape + ", lost boolean, leaves boolean, out_j int, out_i int"), "counted")
    crossing = state.where("leaves")
    bad = state.where("lost").select("tile_id")
    if not crossing.isEmpty():
        counted = crossing.groupBy("tile_id", F.struct(F.col("out_j").alias("j"), F.col("out_i").alias("i")).alias("node")).agg(F.sum("n").alias("area"))
        leads = state.select("tile_id", F.struct("j", "i").alias("node"), F.when(F.col("out_j").isNotNull(), F.struct(F.col("out_j").alias("j"), F.col("out_i").alias("i"))).alias("ptr"))
        entered = doubled(counted.join(leads.hint("merge"), ["tile_id", "node"]).select("tile_id", "node", "ptr", "area"), max_rounds)
        bad = bad.unionByName(entered.where("ptr IS NOT NULL").select("tile_id"))
        come = entered.select("tile_id", "node.j", "node.i", F.col("area").alias("more"), *(F.floor(F.col(f"node.{c}") / block).cast("int").alias(f"b{c}") for c in "ji"))

        def count_down(group: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
            if group.empty or more.empty:
                return group
            at = group[["j", "i"]].merge(more[["j", "i", "more"]], how="left", on=["j", "i"])["more"].fillna(0.0).to_numpy()
            return group.assign(n=group["n"] + gathered(links_of(group, block)[1], at)[0])

        of = ["tile_id", "bj", "bi"]
        columns = [*CELL, *kept, "dn_j", "dn_i", "ok", "bj", "bi", "n"]
        state = stage(state.select(*columns).groupBy(*of).cogroup(come.groupBy(*of)).applyInPandas(count_down, shape), "counted")
    bad = stage(bad.distinct(), "cycles")
    area = F.when(F.col("ok"), F.col("n") * float(cell_area))
    out = state.where("ok") if "ok" not in edges.columns else state
    if bad.isEmpty():
        return out.select(*CELL, *kept, area.alias("area"))
    if refuse:
        raise ValueError("flow directions form a cycle")
    return out.join(bad.withColumn("bad", F.lit(True)), "tile_id", "left").select(*CELL, *kept, F.when(F.col("bad").isNull(), area).alias("area"))


def given_flow(cells: DataFrame, dx: float) -> DataFrame:
    """Cells with directions from elsewhere (tile_id, j, i, z, fd), with area and ``status``: ok, or that the tile's
    directions form a cycle, in which case its areas are NULL. Codes that are none of the eight lead nowhere."""
    met = stage(accumulate(pointed(cells), dx * dx, refuse=False).select(*cells.columns, "area"), "given-flow")
    verdict = met.groupBy("tile_id").agg(F.when((F.count("z") > 0) & (F.count("area") == 0), "flow directions form a cycle").otherwise("ok").alias("status"))
    return met.join(verdict, "tile_id").select(*cells.columns, "area", "status")


def path_sums(nodes: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Sums along pointers: (tile_id, node, ptr, acc) -> root reached and the sum on the way.

    Roots point to themselves with acc 0. Cells on a cycle never reach a root that points to itself;
    their pointers stay on the cycle."""
    state = stage(nodes, "paths")
    for _ in range(max_rounds):
        ahead = state.select("tile_id", F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("acc").alias("more"))
        new = stage(state.join(ahead.hint("merge"), ["tile_id", "ptr"]).select("tile_id", "node", F.col("next").alias("ptr"), (F.col("acc") + F.col("more")).alias("acc"), (F.col("next") != F.col("ptr")).alias("moved")), "paths")
        unstage(state)
        going = not new.where("moved").isEmpty()
        path = new.ridgeline_path
        state = new.drop("moved")
        state.ridgeline_path = path
        if not going:
            break
    return state


def extents(cells: DataFrame) -> DataFrame:
    """(tile_id, nj, ni): the last row and column. Written, so joins know that it is a row a tile."""
    return stage(cells.groupBy("tile_id").agg(F.max("j").alias("nj"), F.max("i").alias("ni")), "extents")


def outlines(cells: DataFrame) -> DataFrame:
    """(tile_id, nj, ni, lost, out_j, out_i): extents, how many cells with an area have no elevation, and the outlet, from one look at
    the cells. Written, so joins know that it is a row a tile."""
    area = F.col("area").isNotNull()
    out = F.max_by(F.struct("j", "i"), F.when(area, F.struct(F.col("area"), -F.col("j"), -F.col("i"))))
    met = cells.groupBy("tile_id").agg(F.max("j").alias("nj"), F.max("i").alias("ni"), F.count_if(area & F.col("z").isNull()).alias("lost"), out.alias("o"))
    return stage(met.select("tile_id", "nj", "ni", "lost", F.col("o.j").alias("out_j"), F.col("o.i").alias("out_i")), "outlines")


def with_boundary(cells: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """Append ``is_boundary``: valid and in the first or last row or column of the tile (NoData edges
    don't count). Tile extents come from an aggregate, not from a window over a tile."""
    edge = (F.col("j") == 0) | (F.col("j") == F.col("nj")) | (F.col("i") == 0) | (F.col("i") == F.col("ni"))
    return cells.join(extents(cells) if box is None else box.select("tile_id", "nj", "ni"), "tile_id").withColumn("is_boundary", F.col("area").isNotNull() & edge).drop("nj", "ni")


def boundary_values(cells: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """Append ``z_bc`` to boundary cells: their elevation, else the first known one of the same row's
    left and right ends and the same column's top and bottom. Only boundary cells without an elevation are joined with ends, and
    only if there are any. ``box``: the outlines, if they are known."""
    box = outlines(cells) if box is None else box
    marked = with_boundary(cells, box)
    if box.where("lost > 0").isEmpty():
        return marked.withColumn("z_bc", F.when(F.col("is_boundary"), F.col("z"))).select(*cells.columns, "is_boundary", "z_bc")
    box = box.select("tile_id", "nj", "ni")
    ends = cells.select(*CELL, "z").join(box, "tile_id").where("i = 0 OR i = ni OR j = 0 OR j = nj")
    rows = ends.groupBy("tile_id", "j").agg(F.max(F.when(F.col("i") == 0, F.col("z"))).alias("left"), F.max(F.when(F.col("i") == F.col("ni"), F.col("z"))).alias("right"))
    columns = ends.groupBy("tile_id", "i").agg(F.max(F.when(F.col("j") == 0, F.col("z"))).alias("top"), F.max(F.when(F.col("j") == F.col("nj"), F.col("z"))).alias("bottom"))
    lost = F.col("is_boundary") & F.col("z").isNull()
    met = marked.where(lost).join(rows.hint("merge"), ["tile_id", "j"], "left").join(columns.hint("merge"), ["tile_id", "i"], "left")
    found = met.select(*marked.columns, F.coalesce("left", "right", "top", "bottom").alias("z_bc"))
    return marked.where(~lost).withColumn("z_bc", F.when(F.col("is_boundary"), F.col("z"))).unionByName(found).select(*cells.columns, "is_boundary", "z_bc")


def outlet(cells: DataFrame) -> DataFrame:
    """(tile_id, out_j, out_i, out_area): the largest area, the first in row order on a tie."""
    best = F.max_by(F.struct("j", "i", "area"), F.struct(F.col("area"), -F.col("j"), -F.col("i")))
    top = cells.where(F.col("area").isNotNull()).groupBy("tile_id").agg(best.alias("o"))
    return top.select("tile_id", F.col("o.j").alias("out_j"), F.col("o.i").alias("out_i"), F.col("o.area").alias("out_area"))


def perimeter_outlet(cells: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """(tile_id, out_j, out_i): the outlet, moved to the perimeter if it lies inside.

    Tried in order: its column's top and bottom, its row's left and right ends; NULL if none is valid. ``box``: the outlines, if
    they are known; cells meet their tile's, and only those to be tried are grouped."""
    box = outlines(cells) if box is None else box
    tiles = box.where("out_j IS NOT NULL").select("tile_id", "nj", "ni", "out_j", "out_i")
    inside = F.expr("out_j > 0 AND out_j < nj AND out_i > 0 AND out_i < ni")
    tries = F.when(~inside, F.when(F.expr("j = out_j AND i = out_i"), 0)).when(F.expr("i = out_i AND j = 0"), 1).when(F.expr("i = out_i AND j = nj"), 2)
    tries = tries.when(F.expr("j = out_j AND i = 0"), 3).when(F.expr("j = out_j AND i = ni"), 4)
    met = cells.where(F.col("area").isNotNull()).select(*CELL).join(tiles, "tile_id").select(*CELL, tries.alias("n")).where("n IS NOT NULL")
    first = met.groupBy("tile_id").agg(F.min_by(F.struct("j", "i"), "n").alias("o"))
    return tiles.select("tile_id").join(first, "tile_id", "left").select("tile_id", F.col("o.j").alias("out_j"), F.col("o.i").alias("out_i"))


def masks(cells: DataFrame, a_crit: float) -> DataFrame:
    """Append is_boundary, is_channel (area >= a_crit, or the outlet) and is_hillslope (neither)."""
    marked = with_boundary(cells).join(outlet(cells).select("tile_id", F.col("out_j").alias("j"), F.col("out_i").alias("i"), F.lit(True).alias("is_outlet")), CELL, "left")
    channel = F.col("area").isNotNull() & ((F.col("area") >= a_crit) | F.coalesce("is_outlet", F.lit(False)))
    return marked.withColumn("is_channel", F.coalesce(channel, F.lit(False))).withColumn("is_hillslope", F.col("area").isNotNull() & ~F.col("is_channel") & ~F.col("is_boundary")).drop("is_outlet")


def channel_paths(cells: DataFrame, dx: float, m: float, block: int = BLOCK) -> DataFrame:
    """(tile_id, j, i, path, path_unit): elevation of the boundary cell that a cell's D8 path leads to, and
    the sum of dL / A^m on the way. NULL where no path leads to the boundary or a slope is not finite.

    Paths are summed inside blocks of a tile, by doubling; those that cross are summed on between the cells where they enter
    other blocks, by doubling too."""
    use_package(cells.sparkSession)
    known = pointed(boundary_values(cells), "area").where("ok")
    own = F.when(F.col("area") > 0, F.col("steps") * dx / F.pow("area", F.lit(float(m))))
    stops = F.coalesce(F.col("z_bc").isNotNull(), F.lit(False)) | own.isNull()
    rows = known.select(*CELL, F.when(~stops, F.col("dn_j")).alias("dn_j"), F.when(~stops, F.col("dn_i")).alias("dn_i"), "ok", F.when(~stops, own).otherwise(0.0).alias("own"), "z_bc")

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        mine, to, _ = links_of(group, block)
        here = np.arange(len(to))
        ptr, acc = to.copy(), np.where(to != here, group["own"].to_numpy(), 0.0)
        for _ in range(len(to).bit_length() + 1):
            if (to[ptr] == ptr).all():
                break
            acc, ptr = acc + acc[ptr], ptr[ptr]
        ends = to[ptr] == ptr
        out = group[CELL].assign(acc=acc, base=np.where(ends & mine[ptr], group["z_bc"].to_numpy(dtype=float)[ptr], np.nan))
        for c, x in (("out_j", "j"), ("out_i", "i")):
            out[c] = pd.array(group[x].to_numpy()[ptr], dtype="Int64")
            out.loc[~ends | mine[ptr], c] = pd.NA
        return out[mine]

    kind = cells.schema["tile_id"].dataType.simpleString()
    found = in_packs(ringed(rows, block), ["tile_id", "bj", "bi"], walk, f"tile_id {kind}, j int, i int, acc double, base double, out_j int, out_i int")
    found = stage(found.withColumn("base", F.when(~F.isnan("base"), F.col("base"))), "walked")
    inside = found.where("out_j IS NULL").select(*CELL, F.col("base").alias("path"), F.when(F.col("base").isNotNull(), F.col("acc")).alias("path_unit"))
    crossing = found.where("out_j IS NOT NULL")
    if crossing.isEmpty():
        return inside
    node = F.struct("j", "i")
    out = F.struct(F.col("out_j").alias("j"), F.col("out_i").alias("i"))
    met = crossing.select("tile_id", out.alias("node")).distinct().join(found.hint("merge").withColumn("node", node), ["tile_id", "node"])
    # a path that ends in the block it enters is a root; its own sum is added once its root is known
    nodes = met.select("tile_id", "node", F.when(F.col("out_j").isNull(), F.col("node")).otherwise(out).alias("ptr"), F.when(F.col("out_j").isNull(), 0.0).otherwise(F.col("acc")).alias("acc"))
    roots = found.select("tile_id", node.alias("ptr"), "base", F.col("acc").alias("last")).where("base IS NOT NULL")
    entered = path_sums(nodes).join(roots.hint("merge"), ["tile_id", "ptr"]).select("tile_id", F.col("node.j").alias("out_j"), F.col("node.i").alias("out_i"), F.col("base").alias("path"), (F.col("acc") + F.col("last")).alias("ahead"))
    # cells whose paths cycle over blocks end at a cell that still leads out, and a root that leads out has no base
    over = crossing.join(entered.hint("merge"), ["tile_id", "out_j", "out_i"], "left").select(*CELL, "path", (F.col("acc") + F.col("ahead")).alias("path_unit"))
    return inside.unionByName(over)


def channel_elevation(cells: DataFrame, dx: float, u: float, k: float, m: float) -> DataFrame:
    """Append ``z_channel``: elevations integrated upstream from the boundary over D8 flow.

    z = z of the receiver + (U / K) dL / A^m. The sum along the path does not depend on U / K. NULL where no
    path leads to the boundary or a slope is not finite."""
    found = channel_paths(cells, dx, m).select(*CELL, (F.col("path") + u / k * F.col("path_unit")).alias("z_channel"))
    return cells.join(found.hint("merge"), CELL, "left").select(*cells.columns, "z_channel")


def dinf_channel_paths(cells: DataFrame, dx: float, m: float) -> DataFrame:
    """(tile_id, j, i, path, path_unit) over D-infinity flow: elevations upstream of the boundary are affine
    in U / K, path + U / K x path_unit. The order of the queue matters, so a tile is a task."""
    use_package(cells.sparkSession)

    def walk(tile: pd.DataFrame) -> pd.DataFrame:
        _, _, g = rasters(tile, ["z", "area_dinf", "facet", "r", "z_bc"])
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = 1.0 / g["area_dinf"] ** m
        facet = np.where(np.isfinite(g["facet"]), g["facet"], -1)
        flat, unit = dinf_channels(facet, g["r"], slope, g["z_bc"], dx)
        at = tile["j"], tile["i"]
        return tile[CELL].assign(path=flat[at], path_unit=(unit - flat)[at])

    known = boundary_values(cells).select(*CELL, "z", "area_dinf", "facet", "r", "z_bc")
    out = known.groupBy("tile_id").applyInPandas(walk, "tile_id string, j int, i int, path double, path_unit double")
    return out.select(*CELL, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("path", "path_unit")))


def dinf_direction(cells: DataFrame, dx: float) -> DataFrame:
    """Append facet (0-7), r (0..pi/4), angle_ref and angle of the steepest D-infinity fall.

    Of equal slopes the lowest facet wins; the slope must be above zero. Where it isn't, a column ``fd``
    (if there is one) gives the fallback. angle_ref is base + r, also for facets whose r runs from the
    far side; angle is measured the right way round. NULL without a direction."""
    return with_dinf(eight_neighbours(cells), cells.columns, dx)


def with_dinf(near: DataFrame, kept: list[str], dx: float) -> DataFrame:
    """Columns ``kept`` and what :func:`dinf_direction` appends, of cells with their neighbours' elevations.

    The fall along a facet is a cos r + b sin r; at the ends of r its sine and cosine are constants. Only the facet taken gets its angle.
    What is not known is NaN and falls by -1 here: without checks for NULL generated methods are shorter, and the JVM leaves those
    beyond 8,000 bytes uncompiled."""
    beside = lambda x, y: F.coalesce((F.col(x) - F.col(y)) / dx, F.lit(math.nan))
    df = near.select(*kept, *(beside("z", f"z_{SIDES[c]}").alias(f"_a{c}") for c in (1, 4, 16, 64)), *(beside(f"z_{SIDES[c]}", f"z_{SIDES[d]}").alias(f"_b{n}") for n, (c, d, _) in enumerate(FACETS)))
    sides = [(F.col(f"_a{c}"), F.col(f"_b{n}")) for n, (c, _, _) in enumerate(FACETS)]

    def fall(a: Column, b: Column) -> Column:
        r = F.atan2(b, a)  # between its ends
        end = a * F.cos(F.lit(QUARTER)) + b * F.sin(F.lit(QUARTER))
        return F.when(F.isnan(a + b), -1.0).when(b <= 0, a).when(b >= a, end).otherwise(a * F.cos(r) + b * F.sin(r))

    df = df.withColumns({f"_s{n}": fall(a, b) for n, (a, b) in enumerate(sides)})
    df = df.withColumn("_best", F.greatest(*(F.col(f"_s{n}") for n in range(8))))
    taken = F.when(F.col("_best") <= 0, None)
    for n in range(8):
        taken = taken.when(F.col(f"_s{n}") == F.col("_best"), n)
    df = df.withColumn("_n", taken)
    code = F.when(F.col("_n").isNull() & F.col("z").isNotNull(), F.col("fd").cast("int")) if "fd" in kept else F.lit(None).cast("int")
    a, b = (F.element_at(F.array(*column), F.col("_n") + 1) for column in zip(*sides, strict=True))
    df = df.select(*kept, "_n", F.when(F.col("_n").isNotNull(), F.least(F.greatest(F.atan2(b, a), F.lit(0.0)), F.lit(QUARTER))).alias("_r"), code.alias("_code"))
    facet, r, code = F.col("_n"), F.col("_r"), F.col("_code")
    if "fd" in kept:
        card = {1: 0, 64: 2, 16: 4, 4: 6}
        diag = {128: 0, 32: 2, 8: 4, 2: 6}
        facet = F.coalesce(facet, looked_up(card | diag, code))
        r = F.coalesce(r, looked_up(dict.fromkeys(card, 0.0) | dict.fromkeys(diag, QUARTER), code))
    base = looked_up({n: f[2] for n, f in enumerate(FACETS)}, F.col("facet"))
    df = df.withColumn("facet", facet.cast("int")).withColumn("r", r).withColumn("angle_ref", base * QUARTER + F.col("r"))
    odd = F.col("facet") % 2 == 1
    right = F.when(odd, (F.col("facet") + 1) * QUARTER - F.col("r")).otherwise(F.col("facet") * QUARTER + F.col("r"))
    return df.withColumn("angle", right).select(*kept, "facet", "r", "angle_ref", "angle")


def ahead(which: int, part: int) -> Column:
    """The step (0: of columns, 1: of rows) to the cardinal (0) or diagonal (1) receiver of a cell's facet."""
    return F.coalesce(*(F.when(F.col("facet") == n, F.lit(STEP[f[which]][part])) for n, f in enumerate(FACETS)))


def dinf_receivers(cells: DataFrame) -> DataFrame:
    """(tile_id, j, i, rcv_j, rcv_i, weight, kind) of cells with a facet: cardinal and diagonal receivers.

    Receivers beyond the tile are listed too; a join with the cells drops them."""
    both = F.array(*(F.struct((F.col("j") + ahead(w, 1)).alias("rcv_j"), (F.col("i") + ahead(w, 0)).alias("rcv_i"), share.alias("weight"), F.lit(kind).alias("kind")) for w, share, kind in ((0, (QUARTER - F.col("r")) / QUARTER, "cardinal"), (1, F.col("r") / QUARTER, "diagonal"))))
    return cells.where(F.col("facet").isNotNull()).select(*CELL, F.explode(both).alias("e")).select(*CELL, "e.rcv_j", "e.rcv_i", "e.weight", "e.kind")


def rasters(tile: pd.DataFrame, columns: list[str]) -> tuple[int, int, dict[str, np.ndarray]]:
    """A tile's columns as arrays [j, i]; missing cells are NaN."""
    ny, nx = int(tile["j"].max()) + 1, int(tile["i"].max()) + 1
    at = tile["j"].to_numpy(), tile["i"].to_numpy()
    out = {}
    for c in columns:
        out[c] = np.full((ny, nx), np.nan)
        out[c][at] = tile[c].to_numpy(dtype=float)
    return ny, nx, out


def handed(rows: pd.DataFrame, block: int, come: pd.DataFrame | None = None, cell_area: float = 0.0) -> tuple[np.ndarray, ...]:
    """The rows of some blocks (with the rings around them) hand on from high to low what has come to them (``come``: j, i, area, late, for
    one block), or ``cell_area`` from each cell: which rows are their block's own, what each holds then, and of those that give (which), their
    two receivers, what these get in other blocks, and whether they come late.

    late: a receiver comes before its giver in the order of falling elevation, then rows, so it keeps what it gets."""
    j, i, z, r = (rows[c].to_numpy() for c in ("j", "i", "z", "r"))
    n, size, at = places(rows)
    own = owned(rows, block)
    row_of = np.full(size, -1)
    row_of[at(n, j, i)] = np.arange(len(rows))
    passing, kept = np.zeros(len(rows)), np.zeros(len(rows))
    if come is None:
        passing[own] = cell_area
    else:
        late = come["late"].to_numpy(dtype=bool)
        to, area = row_of[at(np.zeros(len(come), int), come["j"].to_numpy(), come["i"].to_numpy())], come["area"].to_numpy()
        np.add.at(passing, to[~late], area[~late])
        np.add.at(kept, to[late], area[late])
    order = np.lexsort((i, j, -z))
    place = np.empty(len(rows), int)
    place[order] = np.arange(len(rows))
    givers = order[own[order]]
    facet = rows["facet"].to_numpy().astype(int)[givers]
    to, weight = np.empty((len(givers), 2), int), np.empty((len(givers), 2))
    for k, share in ((0, (QUARTER - r[givers]) / QUARTER), (1, r[givers] / QUARTER)):
        di, dj = np.array([STEP[f[k]] for f in FACETS])[facet].T
        to[:, k] = row_of[at(n[givers], j[givers] + dj, i[givers] + di)]
        weight[:, k] = np.where((share > 0) & (to[:, k] >= 0), share, 0.0)
    late = place[to] < place[givers][:, None]
    sent = np.zeros((len(givers), 2))
    amount, keeps, mine = passing.tolist(), kept.tolist(), own.tolist()
    for g, (u, ends, shares, lates) in enumerate(zip(givers.tolist(), to.tolist(), weight.tolist(), late.tolist(), strict=True)):
        if given := amount[u]:
            for k in (0, 1):
                if shares[k]:
                    v, more = ends[k], shares[k] * given
                    if not mine[v]:
                        sent[g, k] = more
                    elif lates[k]:
                        keeps[v] += more
                    else:
                        amount[v] += more
    return own, np.array(amount) + np.array(keeps), givers, to, sent, late


def hand_on(rows: pd.DataFrame, block: int, come: pd.DataFrame | None = None, cell_area: float = 0.0) -> pd.DataFrame:
    """What :func:`handed` says as rows: j, i, area, late, here. Rows that are not ``here`` go to cells of other blocks."""
    if rows.empty:
        return pd.DataFrame({c: pd.Series([], dtype=object if c == "tile_id" else float) for c in ("tile_id", "j", "i", "area", "late", "here")})
    tile, j, i = (rows[c].to_numpy() for c in CELL)
    own, area, _, to, sent, late = handed(rows, block, come, cell_area)
    held = pd.DataFrame({"tile_id": tile[own], "j": j[own], "i": i[own], "area": area[own], "late": False, "here": True})
    out = sent > 0
    left = pd.DataFrame({"tile_id": tile[to[out]], "j": j[to[out]], "i": i[to[out]], "area": sent[out], "late": late[out], "here": False})
    return pd.concat([held[held["area"] != 0], left]) if len(left) else held[held["area"] != 0]


def dinf_area(cells: DataFrame, dx: float, block: int = BLOCK) -> DataFrame:
    """Append ``area_dinf``: area handed on from high to low, split between two receivers.

    Cells need elevation and facet to take part; what leads to others is lost. Equal elevations go in row order: what a cell
    gets from one that comes after it stays there. Work goes by blocks of a tile with the cells around them, where a cell finds its
    receivers: a block hands its cells' area on, and what crosses into other blocks is what they start the next round with. Areas are
    sums, so rounds add up; every edge leads onwards in one order, so rounds end with the most blocks that a path enters. Only blocks
    that got something work in a round."""
    use_package(cells.sparkSession)
    cells = stage(cells, "directed")
    kind = cells.schema["tile_id"].dataType.simpleString()
    dealt = ringed(cells.where("z IS NOT NULL AND facet IS NOT NULL").select(*CELL, "z", "facet", "r"), block)
    first = in_packs(dealt, ["tile_id", "bj", "bi"], lambda rows: hand_on(rows, block, None, float(dx) * float(dx)), f"tile_id {kind}, j int, i int, area double, late boolean, here boolean")
    first = stage(first, "dinf-round")
    rounds = [first, *handed_over(dealt, first.where("NOT here"), block)]
    total = reduce(DataFrame.unionByName, rounds).where("here").select(*CELL, F.col("area").alias("area_dinf"))
    if len(rounds) > 1:
        total = total.groupBy(*CELL).agg(F.sum("area_dinf").alias("area_dinf"))
    return cells.join(total.hint("merge"), CELL, "left").select(*cells.columns, "area_dinf")


def handed_over(dealt: DataFrame, crossed: DataFrame, block: int) -> list[DataFrame]:
    """Rounds of :func:`hand_on` that start with what has crossed (tile_id, j, i, area, late), until nothing crosses."""
    kind = dealt.schema["tile_id"].dataType.simpleString()
    place = [F.floor(F.col(c) / block).cast("int").alias(f"b{c}") for c in "ji"]
    schema = f"tile_id {kind}, j int, i int, area double, late boolean, here boolean"
    keys, rounds = ["tile_id", "bj", "bi"], []
    while not crossed.isEmpty():
        come = crossed.groupBy(*CELL, "late").agg(F.sum("area").alias("area")).select(*CELL, "area", "late", *place)
        work = dealt.join(come.select(*keys).distinct(), keys, "left_semi")
        got = work.groupBy(*keys).cogroup(come.groupBy(*keys)).applyInPandas(lambda rows, new: hand_on(rows, block, new), schema)
        rounds.append(stage(got, "dinf-round"))
        crossed = rounds[-1].where("NOT here")
    return rounds


def both_flows(cells: DataFrame, dx: float, block: int = BLOCK) -> DataFrame:
    """Cells with elevation: columns fd, area, facet, r and area_dinf appended, as :func:`flow`, :func:`dinf_direction` and :func:`dinf_area`
    say, from one look at the neighbours and one pass over blocks. Only area that crosses between blocks is handed on after it and joined."""
    near = eight_neighbours(cells)
    named = [*cells.columns, "fd", "facet", "r"]
    directed = with_dinf(with_d8(near, near.columns, dx), [*cells.columns, "fd"], dx).select(*named)
    out = ("held", "sent_0", "sent_1", "late_0", "late_1")

    def spread(group: pd.DataFrame) -> dict[str, np.ndarray]:
        found = {c: np.full(len(group), np.nan if c == "held" else 0.0) for c in out}
        part = np.nonzero(group["z"].notna().to_numpy() & group["facet"].notna().to_numpy())[0]
        if len(part):
            own, area, givers, _, sent, late = handed(group.iloc[part], block, None, float(dx) * float(dx))
            found["held"][part[own]] = area[own]
            for k in (0, 1):
                found[f"sent_{k}"][part[givers]], found[f"late_{k}"][part[givers]] = sent[:, k], late[:, k]
        return found

    met = accumulate(pointed(directed), dx * dx, block=block, also=spread, more=out)
    met = met.withColumn("area_dinf", F.when(~F.isnan("held"), F.col("held")))
    to = (F.struct((F.col("j") + ahead(k, 1)).alias("j"), (F.col("i") + ahead(k, 0)).alias("i"), F.col(f"sent_{k}").alias("area"), (F.col(f"late_{k}") > 0).alias("late")) for k in (0, 1))
    crossed = stage(met.where("sent_0 > 0 OR sent_1 > 0").select("tile_id", F.inline(F.array(*to))).where("area > 0"), "crossed")
    dealt = ringed(met.where("z IS NOT NULL AND facet IS NOT NULL").select(*CELL, "z", "facet", "r"), block)
    if later := handed_over(dealt, crossed, block):
        come = reduce(DataFrame.unionByName, later).where("here").groupBy(*CELL).agg(F.sum("area").alias("come"))
        met = stage(met.join(come.hint("merge"), CELL, "left").withColumn("area_dinf", F.col("area_dinf") + F.coalesce("come", F.lit(0.0))), "both-flows")
    return met.select(*cells.columns, "fd", "area", "facet", "r", "area_dinf")


def dinf_channels(facet: np.ndarray, r: np.ndarray, slope: np.ndarray, start: np.ndarray, dx: float) -> tuple[np.ndarray, np.ndarray]:
    """Elevations upstream of known cells (``start``, NaN elsewhere) over D-infinity flow, in queue order: without any slope, and
    with ``slope``. Both are known in the same cells, so one queue sets them.

    A cell is set when the queue first reaches it through a receiver: from both receivers if both are
    known then, else from the one that is."""
    ny, nx = facet.shape
    wide, slope = nx + 2, np.pad(slope, 1, constant_values=np.nan).ravel()  # a rim of cells that are never known
    low, high = (np.pad(start, 1, constant_values=np.nan).ravel() for _ in (0, 1))
    given = np.nonzero(np.pad(facet, 1, constant_values=-1).ravel() >= 0)[0]
    of = np.pad(facet, 1, constant_values=-1).ravel()[given].astype(int)
    ends = np.stack([given + np.array([STEP[f[k]][1] * wide + STEP[f[k]][0] for f in FACETS])[of] for k in (0, 1)], axis=1)
    order = np.argsort(ends.ravel(), kind="stable")  # who leads to a cell, by rows
    first = np.searchsorted(ends.ravel()[order], np.arange(low.size + 1)).tolist()
    givers = given[order // 2].tolist()
    to = np.full((low.size, 2), -1)
    to[given] = ends
    to, r, dips = to.tolist(), np.pad(r, 1, constant_values=np.nan).ravel().tolist(), np.isfinite(slope).tolist()
    queue = deque(np.nonzero(np.isfinite(low))[0].tolist())
    known = np.isfinite(low).tolist()
    low, high, slope = low.tolist(), high.tolist(), slope.tolist()
    while queue:
        at = queue.popleft()
        for cell in givers[first[at] : first[at + 1]]:
            if known[cell] or not dips[cell]:
                continue
            a, b = to[cell]
            s, cos = slope[cell] * dx, math.cos(r[cell])
            if known[a] and known[b] and cos > 1e-12:
                sin = math.sin(r[cell])
                low[cell] = low[a] - (low[a] - low[b]) * sin / cos
                high[cell] = high[a] + (s - (high[a] - high[b]) * sin) / cos
            elif known[a]:
                low[cell], high[cell] = low[a], high[a] + s
            elif known[b]:
                low[cell], high[cell] = low[b], high[b] + s * math.sqrt(2)
            if math.isfinite(high[cell]) and math.isfinite(low[cell]):
                known[cell] = True
                queue.append(cell)
    return tuple(np.array(x).reshape(ny + 2, wide)[1:-1, 1:-1] for x in (low, high))


def fallen(rows: pd.DataFrame, walkers: pd.DataFrame, at: np.ndarray, interval: float, dx: float, block: int) -> pd.DataFrame:
    """Walkers (sj, si, z0, area, run, at some of the rows) through blocks (with the rings around them): follow pointers until the fall from z0
    reaches ``interval`` or the path ends. Each with z and run where it stands, ``going`` where it goes on in another block.

    Each level knows where 2^n steps lead, how long they are and the lowest cell on them; going down the levels, a walker jumps as
    long as nothing on the way is low enough, then takes one step more."""
    own, to, _ = links_of(rows, block)
    z = rows["z"].to_numpy(dtype=float)
    here = np.arange(len(to))
    levels = [(to, np.where(to != here, rows["steps"].to_numpy(dtype=float) * dx, 0.0), z[to])]
    while (levels[-1][0] != to[levels[-1][0]]).any():
        if len(levels) > len(to).bit_length() + 1:
            raise ValueError("flow directions form a cycle")
        ptr, length, low = levels[-1]
        levels.append((ptr[ptr], length + length[ptr], np.minimum(low, low[ptr])))
    j, i = rows["j"].to_numpy(), rows["i"].to_numpy()
    bottom = walkers["z0"].to_numpy() - interval
    run = walkers["run"].to_numpy(dtype=float).copy()
    for ptr, length, low in reversed(levels):
        jump = low[at] > bottom
        run, at = run + np.where(jump, length[at], 0.0), np.where(jump, ptr[at], at)
    ptr, length, _ = levels[0]
    run, at = run + length[at], ptr[at]
    out = walkers[["tile_id", "sj", "si", "z0", "area"]].assign(j=j[at], i=i[at], z=z[at], run=run, going=~own[at] & (z[at] > bottom))
    return out


def channel_slope_by_drop(cells: DataFrame, dx: float, interval: float, min_area: float, block: int = BLOCK) -> DataFrame:
    """(tile_id, j, i, area, slope) of cells with area >= min_area: follow D8 flow until the fall reaches
    ``interval`` (or the path ends) and divide fall by length.

    An approximation of a smoothed channel slope; it claims no equality with any other. All walk inside their blocks at once; those that
    leave theirs go on in the next, so rounds end with the most blocks that a walk enters. Cells without an area, such as those of a tile whose
    directions form a cycle, take no part."""
    use_package(cells.sparkSession)
    kind = cells.schema["tile_id"].dataType.simpleString()
    flowing = pointed(cells.where("area IS NOT NULL AND z IS NOT NULL"), "z").select(*CELL, "z", "area", "dn_j", "dn_i", "steps", "ok")
    dealt = ringed(flowing, block)
    schema = f"tile_id {kind}, sj int, si int, z0 double, area double, j int, i int, z double, run double, going boolean"
    keys = ["tile_id", "bj", "bi"]

    def start(rows: pd.DataFrame) -> pd.DataFrame:
        at = np.nonzero((rows["area"] >= min_area).to_numpy() & owned(rows, block))[0]
        mine = rows.iloc[at]
        return fallen(rows, mine.assign(sj=mine["j"], si=mine["i"], z0=mine["z"], run=0.0), at, interval, dx, block)

    def go_on(rows: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or come.empty:
            return pd.DataFrame({name: pd.Series([], dtype=object if name == "tile_id" else float) for name, _ in (c.split() for c in schema.split(", "))})
        n, size, place = places(rows)
        row_of = np.empty(size, int)
        row_of[place(n, rows["j"].to_numpy(), rows["i"].to_numpy())] = np.arange(len(rows))
        return fallen(rows, come, row_of[place(np.zeros(len(come), int), come["j"].to_numpy(), come["i"].to_numpy())], interval, dx, block)

    rounds = [stage(in_packs(dealt, keys, start, schema), "walks")]
    while not (going := rounds[-1].where("going")).isEmpty():
        come = going.select("tile_id", "sj", "si", "z0", "area", "j", "i", "run", *(F.floor(F.col(c) / block).cast("int").alias(f"b{c}") for c in "ji"))
        work = dealt.join(come.select(*keys).distinct(), keys, "left_semi")
        rounds.append(stage(work.groupBy(*keys).cogroup(come.groupBy(*keys)).applyInPandas(go_on, schema), "walks"))
    ended = reduce(DataFrame.unionByName, rounds).where("NOT going AND run > 0")
    return ended.select("tile_id", F.col("sj").alias("j"), F.col("si").alias("i"), "area", ((F.col("z0") - F.col("z")) / F.col("run")).alias("slope"))


def flow(cells: DataFrame, dx: float) -> DataFrame:
    """D8 direction and drainage area of cells with elevation: columns fd and area appended."""
    directed = d8_direction(cells, dx)
    return accumulate(pointed(directed), dx * dx).select(*directed.columns, "area")
