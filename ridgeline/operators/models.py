"""Steady-state landscape models: systems of equations as tables of cells, relaxed block by block.

Cells come prepared by the neighbourhood and routing operators: validity, direction, area, what the edge and the channels
are held to. A tile of one block is solved with all of its runs in one task, which puts the stencils together itself, so that rows
stay narrow and cells are not multiplied by runs before they are shuffled. For a larger tile the equations are written, a row for each
cell and run with its stencils, what it is held to, and how. A grouped map then solves blocks of a tile with a margin, whose outer ring is held to the elevations of the round
before; blocks exchange their rings by a shuffle until elevations settle. A tile of one block is done in
one round, a large tile uses as many tasks as it has blocks. Scenarios are rows of a small table. NoData
cells stay NULL. A neighbour that is missing or not valid acts as a zero (it still takes from the
diagonal), as in the model's definition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.solvers import factor_stencil, residual, search, search_line, solve_crosses, solve_stencil, solve_stencils
from ridgeline.operators import planform as plan
from ridgeline.operators import routing, stencil
from ridgeline.session import PACK, stage, unstage, use_package

OFFSETS = [(dj, di) for dj in (-1, 0, 1) for di in (-1, 0, 1)]
PREPARED = ["z", "drive", "valid", "is_boundary", "z_bc", "is_outlet", "edge_outlet", "path", "path_unit"]
BLOCK, MARGIN = 128, 16
"""Cells of a block's side, and of the margin that is solved with it."""
ROUNDS, SETTLED = 500, 1e-7
"""Rounds of exchange at most, and the change of elevation below which a run with a critical slope has settled."""
RESIDUAL = 1e-8
"""What a linear equation may leave over, as a share of the uplift."""
PICARD_ROUNDS, PICARD_TOL = 200, 1e-6
CELL = ["tile_id", "j", "i"]
SIDES = [(0, -1), (0, 1), (-1, 0), (1, 0)]
DIRECTION = {"d8": ["fd"], "dinf": ["facet", "r"]}
SCENARIO = ["model", "m", "u", "k", "d", "a_crit", "s_c"]
RUNS_A_TASK = 8
"""Runs of a tile of one block that a task solves at most."""
MAX_SCENARIOS = 10_000
"""Scenarios are runs, not data: a longer table is refused before it is broadcast."""


def nine(of: dict[tuple[int, int], Column]) -> Column:
    """A stencil as an array in the order of OFFSETS; what is not given is zero."""
    return F.array(*(of.get(o, F.lit(0.0)) for o in OFFSETS))


def coefficients(cells: DataFrame, dx: float, kind: str = "d8") -> DataFrame:
    """Append ``flow`` (slope towards receivers) and ``spread`` (five-point Laplacian) to prepared cells; only valid neighbours
    (area known) have entries."""
    near = stencil.eight_neighbours(cells.withColumn("there", F.when(F.col("valid"), 1.0)), "there", "a")
    there = {(dj, di): F.col(f"a_{routing.SIDES[code]}").isNotNull() for code, di, dj in routing.D8}
    unit = 1.0 / (dx * dx)
    spread = {o: F.when(there[o], unit).otherwise(0.0) for o in SIDES} | {(0, 0): F.lit(-4.0 * unit)}
    flow: dict[tuple[int, int], list[Column]] = {}
    if kind == "d8":
        for code, di, dj in routing.D8:
            flow[dj, di] = [F.when((F.col("fd") == code) & there[dj, di], 1.0 / (dx * math.hypot(di, dj)))]
    else:
        cos, sin = F.cos("r") / dx, F.sin("r") / dx
        for n, (a, b, _) in enumerate(routing.FACETS):
            to = [(routing.STEP[c][1], routing.STEP[c][0]) for c in (a, b)]
            at, (has_a, has_b) = F.col("facet") == n, (there[o] for o in to)
            flow.setdefault(to[0], []).append(F.when(at & has_a & has_b, cos - sin).when(at & has_a, cos))
            flow.setdefault(to[1], []).append(F.when(at & has_b, sin))
    ahead = {o: sum((F.coalesce(x, F.lit(0.0)) for x in parts[1:]), F.coalesce(parts[0], F.lit(0.0))) for o, parts in flow.items()}
    ahead[0, 0] = -sum(ahead.values())
    return near.select(*cells.columns, nine(spread).alias("spread"), nine(ahead).alias("flow"))


def prepared(cells: DataFrame, dx: float, m: float | None, kind: str = "d8") -> DataFrame:
    """What all scenarios of one exponent share: tile_id, j, i, z, valid, drive, fd or facet and r, is_boundary,
    z_bc, is_outlet, edge_outlet, and elevations along channels as path + U / K x path_unit (NULL without m)."""
    box = routing.outlines(cells)
    held = routing.boundary_values(cells, box).select(*cells.columns, "is_boundary", "z_bc")
    drive = F.col("area") if kind == "d8" else F.col("area_dinf")
    held = held.withColumn("valid", F.col("area").isNotNull()).withColumn("drive", drive)
    both = zip(("is_outlet", "edge_outlet"), (box, routing.perimeter_outlet(cells, box)), strict=True)
    outs = [where.select("tile_id", F.struct(F.col("out_j").alias("j"), F.col("out_i").alias("i")).alias(f"_{name}")) for name, where in both]
    held = held.join(stage(outs[0].join(outs[1], "tile_id", "full"), "outlets"), "tile_id", "left")  # a row a tile
    at_out = (F.coalesce(F.col(f"_{name}") == F.struct("j", "i"), F.lit(False)).alias(name) for name in ("is_outlet", "edge_outlet"))
    held = held.select(*CELL, "z", "valid", "drive", *DIRECTION[kind], "is_boundary", "z_bc", *at_out)
    if m is None:
        return held.withColumn("path", F.lit(None).cast("double")).withColumn("path_unit", F.lit(None).cast("double"))
    walked = routing.channel_paths(cells, dx, m) if kind == "d8" else routing.dinf_channel_paths(cells, dx, m)
    return held.join(walked.hint("merge"), CELL, "left")


def system(held: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Prepared cells with their stencils x scenarios -> the equations of each run: scenario, tile_id, j, i, flow, spread, u, d,
    s_c (NULL: linear), fixed, value, is_channel, z (to start from), valid."""
    if "tile_id" in scenarios.columns:  # as many as there are tiles to study, so data
        runs = held.join(scenarios, "tile_id")
    else:
        runs = held.crossJoin(F.broadcast(scenarios))  # a short list of runs, see MAX_SCENARIOS
    slow = F.col("model") == "ad"
    channel = F.when(slow, False).otherwise(F.col("valid") & (F.coalesce(F.col("drive") >= F.col("a_crit"), F.lit(False)) | F.col("is_outlet")))
    fixed = ~F.col("valid") | F.col("is_boundary") | F.when(slow, F.col("edge_outlet")).otherwise(channel)
    value = F.when(slow, F.col("z")).when(channel, F.col("path") + F.col("u") / F.col("k") * F.col("path_unit")).otherwise(F.col("z_bc"))
    power = F.when(slow & F.col("valid"), F.coalesce(F.col("k") * F.pow("drive", "m"), F.lit(0.0))).otherwise(0.0)
    return runs.select(
        "scenario", *CELL, F.transform("flow", lambda c: c * power).alias("flow"), "spread", "u", "d", F.when(F.col("model") == "nonlinear", F.col("s_c")).alias("s_c"),
        fixed.alias("fixed"), F.when(F.col("valid"), value).otherwise(0.0).alias("value"), channel.alias("is_channel"), "z", "valid",
    )


def arrays(rows: pd.DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """Columns of a rectangle of cells as arrays [j, i] (stencils: [3, 3, j, i]); cells without a row are fixed at 0."""
    j, i = (rows[c].to_numpy() - rows[c].min() for c in ("j", "i"))
    ny, nx = j.max() + 1, i.max() + 1
    out = {"at": (j, i)}
    for c in columns:
        if c in ("flow", "spread"):
            out[c] = np.zeros((3, 3, ny, nx))
            out[c][:, :, j, i] = np.stack(rows[c].to_numpy()).T.reshape(3, 3, -1)
        else:
            values = rows[c].to_numpy()
            out[c] = np.full((ny, nx), c == "fixed") if values.dtype == bool else np.zeros((ny, nx))
            out[c][j, i] = values
    return out


def no_rows(*names: str) -> pd.DataFrame:
    """A frame without rows whose columns Spark takes: lists of nothing have a type that it can't make text of."""
    return pd.DataFrame({c: pd.Series([], dtype=object if c in ("scenario", "tile_id", "status") else float) for c in names})


def side_slope(z: np.ndarray, there: np.ndarray, dx: float) -> np.ndarray:
    """Length of the gradient from available one-sided differences (as stencil.one_sided_slope)."""
    wide, ok = np.pad(z, 1), np.pad(there, 1)
    ny, nx = z.shape
    total = 0.0
    for pair in (SIDES[:2], SIDES[2:]):
        rise, count = np.zeros_like(z), np.zeros_like(z)
        for sign, (dj, di) in zip((-1, 1), pair, strict=True):
            at = slice(1 + dj, 1 + dj + ny), slice(1 + di, 1 + di + nx)
            rise += np.where(ok[at], sign * (wide[at] - z) / dx, 0.0)
            count += ok[at]
        total = total + (rise / np.maximum(count, 1)) ** 2
    return np.sqrt(total)


def stencils(g: dict[str, np.ndarray], dx: float, kind: str) -> dict[str, np.ndarray]:
    """``spread`` and ``flow`` [3, 3, j, i] of a rectangle of prepared cells, as :func:`coefficients` says."""
    ny, nx = g["valid"].shape
    wide = np.pad(g["valid"], 1)
    there = {(dj, di): wide[1 + dj : 1 + dj + ny, 1 + di : 1 + di + nx] for dj, di in OFFSETS}
    spread, flow = np.zeros((3, 3, ny, nx)), np.zeros((3, 3, ny, nx))
    unit = 1.0 / (dx * dx)
    for dj, di in SIDES:
        spread[1 + dj, 1 + di] = np.where(there[dj, di], unit, 0.0)
    spread[1, 1] = -4.0 * unit
    if kind == "d8":
        for code, di, dj in routing.D8:
            flow[1 + dj, 1 + di] = np.where((g["fd"] == code) & there[dj, di], 1.0 / (dx * math.hypot(di, dj)), 0.0)
    else:
        r = np.nan_to_num(g["r"])
        cos, sin = np.cos(r) / dx, np.sin(r) / dx
        for n, (a, b, _) in enumerate(routing.FACETS):
            (ai, aj), (bi, bj) = routing.STEP[a], routing.STEP[b]
            at = (g["facet"] == n) & np.isfinite(g["r"])
            flow[1 + aj, 1 + ai] += np.where(at & there[aj, ai], np.where(there[bj, bi], cos - sin, cos), 0.0)
            flow[1 + bj, 1 + bi] += np.where(at & there[bj, bi], sin, 0.0)
    flow[1, 1] = -flow.sum((0, 1))
    return {"spread": spread, "flow": flow}


def posed(g: dict[str, np.ndarray], p: dict) -> dict[str, np.ndarray]:
    """The equations of prepared cells (with their stencils) under parameters p, as :func:`system` says, and ``is_channel``."""
    valid, full = g["valid"], np.ones_like(g["z"])
    with np.errstate(invalid="ignore", divide="ignore"):
        if p["model"] == "ad":
            power = np.where(valid & np.isfinite(g["drive"]), p["k"] * g["drive"] ** p["m"], 0.0)
            channel, held, value, flow = np.zeros_like(valid), g["is_boundary"] | g["edge_outlet"], g["z"], power * g["flow"]
        else:
            channel = valid & ((g["drive"] >= p["a_crit"]) | g["is_outlet"])
            held, value, flow = channel | g["is_boundary"], np.where(channel, g["path"] + np.divide(p["u"], p["k"]) * g["path_unit"], g["z_bc"]), None
    return g | {"flow": flow, "fixed": held | ~valid, "value": np.where(valid, value, 0.0), "u": p["u"] * full, "d": p["d"] * full, "is_channel": channel}


def cut_down(c: np.ndarray, fixed: np.ndarray) -> tuple[tuple[slice, slice], np.ndarray]:
    """The rectangle that holds all free cells, and its system: fixed cells have identities. Rows and columns at the rim without a
    free cell take no part in the elimination."""
    (j0, j1), (i0, i1) = ((k[0], k[-1] + 1) for k in (np.nonzero((~fixed).any(axis))[0] for axis in (1, 0)))
    inside = slice(j0, j1), slice(i0, i1)
    own = c[:, :, *inside].copy()
    own[:, :, fixed[inside]] = 0.0
    own[1, 1][fixed[inside]] = 1.0
    return inside, own


def right_side(c: np.ndarray, fixed: np.ndarray, b: np.ndarray, inside: tuple[slice, slice]) -> tuple[np.ndarray, np.ndarray]:
    """Elevations known outside the rectangle (0 in it), and the right side of its system for right side b of all cells."""
    out = b.copy()
    out[inside] = 0.0
    return out, np.where(fixed, b, residual(c, b, out))[inside]


def factored(c: np.ndarray, fixed: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What solves the system c of the free cells for any right side, on which fixed cells have their values."""
    inside, own = cut_down(c, fixed)
    solve = factor_stencil(own)

    def solved(b: np.ndarray) -> np.ndarray:
        out, rest = right_side(c, fixed, b, inside)
        out[inside] = solve(rest)
        return out

    return solved


def alone(own: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray | float, str]:
    """The solution of one system, and its status."""
    try:
        return solve_stencil(own, rest), "ok"
    except np.linalg.LinAlgError as e:
        return np.nan, str(e)[:200]


def solve_linears(systems: list[dict[str, np.ndarray]]) -> list[tuple[np.ndarray, str]]:
    """Elevations and status of each of many linear systems; those of one shape are eliminated together."""
    done, shapes = [(np.empty(0), "")] * len(systems), {}
    for n, g in enumerate(systems):
        b = np.where(g["fixed"], g["value"], -g["u"])
        if g["fixed"].all():
            done[n] = b, "ok"
            continue
        c = g["d"] * g["spread"]
        c = c if g["flow"] is None else c + g["flow"]
        inside, own = cut_down(c, g["fixed"])
        shapes.setdefault(own.shape, []).append((n, inside, own, *right_side(c, g["fixed"], b, inside)))
    for (_, _, ny, nx), of in shapes.items():
        most = max(1, AT_ONCE // (ny * nx * min(ny, nx)))
        for first in range(0, len(of), most):
            some = of[first : first + most]
            try:
                found = [(z, "ok") for z in solve_stencils(np.stack([x[2] for x in some], axis=2), np.stack([x[4] for x in some]))]
            except np.linalg.LinAlgError:  # one of them can't be solved
                found = [alone(own, rest) for _, _, own, _, rest in some]
            for (n, inside, _, out, _), (z, status) in zip(some, found, strict=True):
                out[inside] = z
                done[n] = out if status == "ok" else np.full(out.shape, np.nan), status
    return done


def solve_linear(g: dict[str, np.ndarray], d: np.ndarray) -> np.ndarray:
    """Elevations under diffusivity d; fixed cells have identities as equations."""
    b = np.where(g["fixed"], g["value"], -g["u"])
    if g["fixed"].all():
        return b
    c = d * g["spread"]
    return factored(c if g["flow"] is None else c + g["flow"], g["fixed"])(b)


def solve_block(g: dict[str, np.ndarray], s_c: float | None, dx: float, start: np.ndarray | None = None, kept: dict | None = None) -> tuple[np.ndarray, bool]:
    """Elevations, and whether they have settled: with ``s_c`` diffusivity grows with slope, and the system is
    solved again until elevations move by less than PICARD_TOL. ``start``: elevations to begin with.

    Without flow (None, or nothing but zeros) an equation can be divided by its diffusivity, so the system is eliminated once for all
    rounds; ``kept`` keeps that for the next call with the same stencils, as long as the same cells are fixed."""
    free = ~g["fixed"]
    curved = s_c is not None and np.isfinite(s_c) and free.any()
    linear = solve_linear
    if (curved or kept is not None) and free.any() and (g["d"][free] > 0).all() and (g["flow"] is None or not g["flow"].any()):
        kept = {} if kept is None else kept
        if (key := g["fixed"].tobytes()) not in kept:
            kept.clear()
            kept[key] = factored(g["spread"], g["fixed"])
        linear = lambda g, d: kept[key](np.where(g["fixed"], g["value"], -g["u"] / d))
    z = start if curved and start is not None else linear(g, g["d"])
    for _ in range(PICARD_ROUNDS if curved else 0):
        ratio = np.clip(side_slope(z, g["valid"], dx) / s_c, -0.99, 0.99)
        new = linear(g, np.where(free, g["d"] / (1 - ratio**2), g["d"]))
        moved = np.abs(new - z)[free].max()
        z = new
        if not moved >= PICARD_TOL:
            return z, bool(np.isfinite(moved))
    return z, not curved


def hats(low: int, n: int, step: int, shift: int = 0) -> np.ndarray:
    """Weights of cells low + shift ... (n of them) on coarse nodes, which lie at every ``step``-th cell; the first
    column is node low // step - 1."""
    at = np.arange(low, low + n) + shift
    node, past = at // step - (low // step - 1), at % step / step
    out = np.zeros((n, (low + n) // step - low // step + 4))
    out[np.arange(n), node] = 1 - past
    out[np.arange(n), node + 1] += past
    return out


def slanted(a: np.ndarray, by: int) -> np.ndarray:
    """Columns moved so that column k holds what column k + by held."""
    out = np.zeros_like(a)
    m = a.shape[1]
    out[:, max(0, -by) : m - max(0, by)] = a[:, max(0, by) : m + min(0, by)]
    return out


def coarse_rows(rows: pd.DataFrame, step: int, dx: float, low: tuple[int, int], own: np.ndarray, smooth: bool) -> pd.DataFrame:
    """What a block (with the ring around it) adds to the coarse equations of its run: cj, ci, r (left over) and a (nine
    coefficients towards the nodes around); and, as node -1, -1, the most that any equation leaves over."""
    g = arrays(rows, ["flow", "spread", "u", "d", "fixed", "valid", "z"])
    at, shape = g["at"], g["z"].shape
    free = np.zeros(shape, bool)
    free[at] = ~g["fixed"][at]
    mine = np.zeros(shape, bool)
    mine[at] = own
    mine &= free
    d, s_c = g["d"], rows["s_c"].iloc[0]
    if s_c is not None and np.isfinite(s_c):
        d = d / (1 - np.clip(side_slope(g["z"], g["valid"], dx) / s_c, -0.99, 0.99) ** 2)
    c = g["flow"] + d * g["spread"]
    left = np.where(mine, residual(c, -g["u"], g["z"]), 0.0)
    worst = pd.DataFrame({"cj": [-1], "ci": [-1], "r": [np.abs(left).max()], "a": [[]]})
    if not smooth or not mine.any():
        return worst
    pj, pi = (hats(a, n, step) for a, n in zip(low, shape, strict=True))
    total = np.zeros((9, pj.shape[1], pi.shape[1]))
    wide = np.pad(free, 1)
    for dj, di in OFFSETS:
        part = c[dj + 1, di + 1] * mine * wide[1 + dj : 1 + dj + shape[0], 1 + di : 1 + di + shape[1]]
        qj, qi = hats(low[0], shape[0], step, dj), hats(low[1], shape[1], step, di)
        for k, (aj, ai) in enumerate(OFFSETS):
            total[k] += (pj * slanted(qj, aj)).T @ part @ (pi * slanted(qi, ai))
    r = pj.T @ left @ pi
    cj, ci = np.nonzero(np.abs(total[4]) > 0)
    nodes = pd.DataFrame({"cj": cj + low[0] // step - 1, "ci": ci + low[1] // step - 1, "r": r[cj, ci], "a": list(total[:, cj, ci].T)})
    return pd.concat([worst, nodes])


def solve_coarse(nodes: pd.DataFrame) -> pd.DataFrame:
    """cj, ci, e: corrections at the coarse nodes of a run."""
    j, i = (nodes[c].to_numpy() - nodes[c].min() for c in ("cj", "ci"))
    shape = j.max() + 1, i.max() + 1
    c, b = np.zeros((9, *shape)), np.zeros(shape)
    c[4] = 1.0
    c[:, j, i], b[j, i] = np.stack(nodes["a"].to_numpy()).T, nodes["r"]
    e = solve_stencil(c.reshape(3, 3, *shape), b)
    return nodes[["scenario", "tile_id", "cj", "ci"]].assign(e=np.nan_to_num(e[j, i]))


def corrections(nodes: pd.DataFrame, rows: pd.DataFrame, step: int) -> np.ndarray:
    """The coarse correction of each cell, by bilinear interpolation; fixed cells have none."""
    if nodes.empty:
        return np.zeros(len(rows))
    low = nodes["cj"].min(), nodes["ci"].min()
    e = np.zeros((nodes["cj"].max() - low[0] + 2, nodes["ci"].max() - low[1] + 2))
    e[nodes["cj"] - low[0], nodes["ci"] - low[1]] = nodes["e"]
    out = np.zeros(len(rows))
    for nj in (0, 1):
        for ni in (0, 1):
            k, weight = [], 1.0
            for x, n, first, size in (("j", nj, low[0], e.shape[0]), ("i", ni, low[1], e.shape[1])):
                past = rows[x].to_numpy() % step / step
                node = rows[x].to_numpy() // step + n - first
                weight = weight * np.where((node >= 0) & (node < size), past if n else 1 - past, 0.0)
                k.append(np.clip(node, 0, size - 1))
            out += weight * e[k[0], k[1]]
    return np.where(rows["fixed"].to_numpy(), 0.0, out)


def relax(equations: DataFrame, dx: float, block: int = BLOCK, margin: int = MARGIN, rounds: int = ROUNDS) -> DataFrame:
    """Equations (see :func:`system`; dx is the spacing for slopes) -> scenario, tile_id, j, i, z, is_channel, status.

    A tile of one block is solved at once. Others go in rounds: what the equations leave over is gathered on a coarse grid
    (every eighth of a block's side), solved there, a tile a task, and added; then all blocks are solved with their margins. With
    the coarse grid the number of rounds does not grow with the tile. It is left out where flow outweighs diffusion over a coarse
    cell: there values travel along the flow, and the correction would not be stable. A linear run has settled when no equation
    leaves over more than RESIDUAL of the uplift, any other when no elevation moves by SETTLED. What has not after ``rounds`` is "not
    converged"; a block that can't be solved gives its tile the reason as status. The driver sees whether any run is left."""
    spark = equations.sparkSession
    use_package(spark)
    run, reach, step = ["scenario", "tile_id"], margin + 1, max(2, block // 8)
    names = ["flow", "spread", "u", "d", "fixed", "value", "valid"]
    keys = [*run, "bj", "bi"]

    def near(x: str, out: int, size: int = block, cell: int = 1) -> Column:
        return F.explode(F.sequence(F.greatest(F.floor((F.col(x) * cell - out) / size), F.lit(0)).cast("int"), F.greatest(F.floor((F.col(x) * cell + out) / size), F.lit(0)).cast("int")))

    def one(rows: pd.DataFrame, nodes: pd.DataFrame | None = None) -> pd.DataFrame:
        if rows.empty:
            return no_rows("scenario", *CELL, "is_channel", "valid", "z", "moved", "status")
        first = rows.iloc[0]
        low_j, low_i = int(first["bj"]) * block, int(first["bi"]) * block
        own = rows["j"].between(low_j, low_j + block - 1) & rows["i"].between(low_i, low_i + block - 1)
        out = rows.loc[own, ["scenario", *CELL, "is_channel", "valid"]].copy()
        if out.empty:
            return out.assign(z=0.0, moved=0.0, status="ok")
        ring = (rows["j"] == low_j - reach) | (rows["j"] == low_j + block - 1 + reach) | (rows["i"] == low_i - reach) | (rows["i"] == low_i + block - 1 + reach)
        before = rows["z"].fillna(0.0)
        now = before if nodes is None else before + corrections(nodes, rows, step)
        rows = rows.assign(value=rows["value"].where(rows["fixed"] | ~ring, now), fixed=rows["fixed"] | ring)
        try:
            g = arrays(rows, names)
            z, settled = solve_block(g, first["s_c"], dx)
            z = z[g["at"]][own.to_numpy()]
            return out.assign(z=z, moved=np.abs(z - before[own].to_numpy()), status="ok" if settled else "not converged")
        except (ValueError, np.linalg.LinAlgError) as e:
            return out.assign(z=np.nan, moved=0.0, status=str(e)[:200])

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        own = ((rows["j"] // block == first["bj"]) & (rows["i"] // block == first["bi"])).to_numpy()
        out = coarse_rows(rows.assign(z=rows["z"].fillna(0.0)), step, dx, (rows["j"].min(), rows["i"].min()), own, bool(first["smooth"]))
        return out.assign(scenario=first["scenario"], tile_id=first["tile_id"])[["scenario", "tile_id", "cj", "ci", "r", "a"]]

    centre = lambda c: F.abs(F.get(c, F.lit(4)))
    sizes = stage(equations.groupBy(*run).agg(((F.max("j") >= block) | (F.max("i") >= block)).alias("several")), "sizes")
    solved_kind = "scenario string, tile_id string, j int, i int, is_channel boolean, valid boolean, z double, moved double, status string"
    ends = ["scenario", *CELL, "is_channel", "valid", "z", "status"]
    alone = equations.withColumn("bj", F.lit(0)).withColumn("bi", F.lit(0))
    large = sizes.where("several").select(*run)
    several = not large.isEmpty()
    if several:
        alone = alone.join(large, run, "left_anti")
    done = [stage(alone.groupBy(*keys).applyInPandas(lambda rows: one(rows), solved_kind).select(*ends), "done")]
    known = F.when(F.col("valid") & (F.col("status") == "ok") & ~F.isnan("z"), F.col("z"))
    if not several:
        return done[0].select("scenario", *CELL, known.alias("z"), "is_channel", "status")

    equations = stage(equations.join(large, run, "left_semi"), "equations")
    going = equations.groupBy(*run).agg(
        F.max(F.abs("u")).alias("u_max"), F.first("s_c").alias("bent"),
        (step * F.max(F.when(~F.col("fixed"), centre("flow"))) <= F.min(F.when(~F.col("fixed"), F.col("d") * centre("spread")))).alias("smooth"),
    )
    going = stage(going.withColumn("smooth", F.coalesce("smooth", F.lit(False))), "runs")
    if several:
        state = stage(equations.select("scenario", *CELL, "is_channel", "valid", "z", F.lit(math.inf).alias("moved"), F.lit("ok").alias("status")), "state")
        for n in range(rounds + 1):
            now = equations.drop("z").join(state.select("scenario", *CELL, "z").hint("merge"), ["scenario", *CELL]).join(going.select(*run, "smooth"), run)
            ringed = now.withColumn("bj", near("j", 1)).withColumn("bi", near("i", 1))
            found = stage(ringed.groupBy(*keys).applyInPandas(measure, "scenario string, tile_id string, cj int, ci int, r double, a array<double>"), "measured")
            worst = found.where("cj = -1 AND ci = -1").groupBy(*run).agg(F.max("r").alias("worst"), F.max(F.isnan("r")).alias("lost"))
            moved = state.groupBy(*run).agg(F.max("moved").alias("moved"), F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("bad"))
            straight = F.col("bent").isNull() & (F.col("u_max") > 0)
            still = F.when(straight, F.col("worst") <= RESIDUAL * F.col("u_max")).otherwise(F.col("moved") < SETTLED)
            over = F.coalesce(still, F.lit(False)) | F.coalesce("lost", F.lit(False)) | F.col("bad").isNotNull()
            judged = going.join(worst, run, "left").join(moved, run)
            judged = stage(judged.select(*going.columns, over.alias("over"), F.when(over, F.coalesce("bad", F.lit("ok"))).otherwise("not converged").alias("verdict")), "verdicts")
            left = judged.agg(F.count_if("over").alias("over"), F.count_if(~F.col("over")).alias("going")).first()
            if left["over"] or n == rounds:
                ended = judged if n == rounds else judged.where("over")
                done.append(stage(state.drop("status", "moved").join(ended.select(*run, F.col("verdict").alias("status")), run).select(*ends), "done"))
            if not left["going"] or n == rounds:
                break
            going = judged.where("NOT over").drop("over", "verdict")
            summed = found.where("cj >= 0 OR ci >= 0").groupBy(*run, "cj", "ci").agg(F.sum("r").alias("r"), F.array(*(F.sum(F.get("a", F.lit(k))) for k in range(9))).alias("a"))
            e = summed.groupBy(*run).applyInPandas(solve_coarse, "scenario string, tile_id string, cj int, ci int, e double")
            dealt = now.join(going.select(*run), run, "left_semi").withColumn("bj", near("j", reach)).withColumn("bi", near("i", reach))
            shared = e.join(going.select(*run), run, "left_semi").withColumn("bj", near("cj", reach + step, cell=step)).withColumn("bi", near("ci", reach + step, cell=step))
            new = stage(dealt.groupBy(*keys).cogroup(shared.groupBy(*keys)).applyInPandas(one, solved_kind), "state")
            for table in (state, found):
                unstage(table)
            state = new
        unstage(state)
    return reduce(DataFrame.unionByName, done).select("scenario", *CELL, known.alias("z"), "is_channel", "status")


def solve_models(cells: DataFrame, scenarios: DataFrame, dx: float, routing_kind: str = "d8", block: int = BLOCK) -> DataFrame:
    """Cells x scenarios -> scenario, tile_id, j, i, z, is_channel, status.

    scenarios: (scenario, model, m, u, k, d, a_crit, s_c), one row a run, for all tiles (at most MAX_SCENARIOS, which are
    broadcast), or with a column tile_id for that tile alone (any number, joined); model: ad, threshold or nonlinear. A run that fails or does not settle
    gives NULL elevations and the reason as its status, the others go on."""
    for_tiles = "tile_id" in scenarios.columns
    scenarios = stage(scenarios.select("scenario", *SCENARIO, *(["tile_id"] if for_tiles else [])), "scenarios")
    if not for_tiles and scenarios.count() > MAX_SCENARIOS:
        raise ValueError(f"more than {MAX_SCENARIOS} scenarios")
    exponent = F.when(F.col("model") == "ad", F.lit(None)).otherwise(F.col("m"))  # it matters to paths alone
    exponents = [r[0] for r in scenarios.select(exponent).distinct().limit(MAX_SCENARIOS + 1).collect()]
    if len(exponents) > MAX_SCENARIOS:
        raise ValueError(f"more than {MAX_SCENARIOS} exponents")
    whole, large = [], []
    for m in sorted(exponents, key=str):
        table = scenarios.where(exponent.eqNullSafe(F.lit(m)))
        some = cells.join(table.select("tile_id").distinct(), "tile_id", "left_semi") if for_tiles else cells
        held = stage(prepared(some, dx, m, routing_kind), "prepared")
        sizes = stage(held.groupBy("tile_id").agg(((F.max("j") >= block) | (F.max("i") >= block)).alias("several")), "sizes")
        several = sizes.where("several").select("tile_id")
        here = held
        if not several.isEmpty():
            here = held.join(several, "tile_id", "left_anti")
            large.append(system(coefficients(held.join(several, "tile_id", "left_semi"), dx, routing_kind), table))
        whole.append(solve_whole(here, runs_of(sizes.where("NOT several").select("tile_id"), table), dx, routing_kind))
    done = stage(reduce(DataFrame.unionByName, whole), "whole") if whole else None
    parts = ([] if done is None else [done]) + ([relax(reduce(DataFrame.unionByName, large), dx, block)] if large else [])
    if not parts:  # no scenario
        return cells.sparkSession.createDataFrame([], SOLVED)
    return reduce(DataFrame.unionByName, parts)


SOLVED = "scenario string, tile_id string, j int, i int, z double, is_channel boolean, status string"


def runs_of(tiles: DataFrame, scenarios: DataFrame) -> DataFrame:
    """tile_id, scenario, its parameters, and deal, which counts at most RUNS_A_TASK runs of a tile."""
    runs = tiles.join(scenarios, "tile_id") if "tile_id" in scenarios.columns else tiles.crossJoin(F.broadcast(scenarios))
    nth = F.row_number().over(Window.partitionBy("tile_id").orderBy("scenario"))
    return stage(runs.select("tile_id", F.floor((nth - 1) / RUNS_A_TASK).cast("int").alias("deal"), "scenario", *SCENARIO), "tile-runs")


def solve_whole(held: DataFrame, runs: DataFrame, dx: float, kind: str) -> DataFrame:
    """Prepared cells of tiles of one block and their runs (see :func:`runs_of`) -> scenario, tile_id, j, i, z, is_channel, status."""
    use_package(held.sparkSession)
    columns = [*PREPARED, *DIRECTION[kind]]
    keys = ["tile_id", "deal"]

    def some(rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or runs.empty:
            return no_rows("scenario", *CELL, "z", "is_channel", "status")
        of = {key: table.to_dict("records") for key, table in runs.groupby(keys)}
        asked, linear = [], []
        for key, tile in rows.groupby(keys):
            g = arrays(tile, columns)
            g |= stencils(g, dx, kind)
            at, kept = g["at"], {}
            for p in of.get(key, []):
                now = posed(g, p)
                what = key[0], p["scenario"], tile["j"].to_numpy(), tile["i"].to_numpy(), now["is_channel"][at], g["valid"][at], at
                if p["model"] == "ad":  # one linear system: those of many tiles are solved together
                    linear.append(now)
                    asked.append((*what, None, ""))
                    continue
                try:
                    z, settled = solve_block(now, p["s_c"] if p["model"] == "nonlinear" else None, dx, kept=kept)
                    z, status = z[at], "ok" if settled else "not converged"
                except (ValueError, np.linalg.LinAlgError) as e:
                    z, status = np.full(len(at[0]), np.nan), str(e)[:200]
                asked.append((*what, z, status))
        solved = iter(solve_linears(linear))
        out = {c: [] for c in ("scenario", *CELL, "z", "is_channel", "status")}
        for tile_id, scenario, j, i, channel, valid, at, z, status in asked:
            if z is None:
                z, status = next(solved)
                z = z[at]
            known = valid & np.isfinite(z) & (status == "ok")
            for c, v in zip(out, (scenario, tile_id, j, i, np.where(known, z, np.nan), channel, status), strict=True):
                out[c].append(v if isinstance(v, np.ndarray) else np.full(len(j), v, object))
        if not asked:
            return no_rows(*out)
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    deals = runs.select("tile_id", F.col("deal").alias("part")).distinct()
    dealt = held.join(deals, "tile_id").select(F.col("part").alias("deal"), *CELL, *columns)
    tiles = deals.agg(F.count_distinct("tile_id").alias("n"), F.count("*").alias("deals")).first()
    packs = math.ceil(held.count() * tiles["deals"] / max(tiles["n"], 1) / PACK) or 1  # tiles are solved many at a time
    pack = F.pmod(F.xxhash64(*keys), F.lit(packs)).alias("pack")
    solved = dealt.select(pack, "*").groupBy("pack").cogroup(runs.select(pack, "*").groupBy("pack")).applyInPandas(some, SOLVED)
    return solved.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def misfit(modelled: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mse, n: mean squared difference over cells known in both."""
    both = modelled.join(observed.select("tile_id", "j", "i", F.col("z").alias("z_obs")).hint("merge"), ["tile_id", "j", "i"])
    gap = F.col("z") - F.col("z_obs")
    return both.groupBy(*keys).agg(F.avg(gap * gap).alias("mse"), F.count(gap).alias("n"))


def search_ratio(g: dict[str, np.ndarray], base: dict, bounds: dict[str, tuple[float, float]], rounds: int) -> tuple[dict[str, float], float, float, bool]:
    """The advection-diffusion parameters that fit best, their misfit, that of the start, and whether the search has converged.

    Divided by D, the equations depend on K / D, and their solution is what the edge gives plus U / D times what an uplift of D gives. So
    the system is eliminated once a ratio, the best D within the bounds of D and K follows from least squares, and the search runs over the ratio (and
    parameters other than K and D) only."""
    others = [n for n in bounds if n not in ("k", "d")]
    (k_low, k_high), (d_low, d_high) = bounds["k"], bounds["d"]
    low, high = np.log10([k_low / d_high, *(bounds[n][0] for n in others)]), np.log10([k_high / d_low, *(bounds[n][1] for n in others)])
    k, d, *rest = (float(np.clip(base[n], *bounds[n])) for n in ("k", "d", *others))
    taken: dict[tuple, dict[str, float]] = {}

    def fit(x: np.ndarray, d: float | None = None) -> float:
        ratio, *more = (10.0**x).tolist()
        p = base | dict(zip(others, more, strict=True)) | {"model": "ad", "k": ratio, "d": 1.0}
        now = posed(g, p)
        given, lifted = np.where(now["fixed"], now["value"], 0.0), np.where(now["fixed"], 0.0, -1.0)
        if not now["fixed"].all():
            solve = factored(g["spread"] + now["flow"], now["fixed"])
            given, lifted = solve(given), solve(lifted)
        seen = g["valid"] & np.isfinite(g["z"]) & np.isfinite(given) & np.isfinite(lifted)
        if not seen.any():
            return math.inf
        gap, up = (g["z"] - given)[seen], lifted[seen]
        ends = np.clip([max(d_low, k_low / ratio), min(d_high, k_high / ratio)], d_low, d_high)
        if d is None and up @ up > 0 and p["u"] != 0:
            share = np.clip(up @ gap / (up @ up), *sorted(p["u"] / ends))
            d = float(np.clip(p["u"] / share, *sorted(ends)))
        elif d is None:  # any D fits as well
            d = float(np.clip(base["d"], *sorted(ends)))
        taken[tuple(x)] = dict(zip(others, more, strict=True)) | {"k": float(np.clip(ratio * d, k_low, k_high)), "d": d}
        return float(np.mean((gap - p["u"] / d * up) ** 2))

    start = np.clip(np.log10([k / d, *rest]), low, high)
    first = fit(start, d)
    best, value, converged = search(fit, start, low, high, rounds) if others else search_line(fit, start[0], low[0], high[0], rounds)
    return taken[tuple(best)], value, first, converged


def calibrate(cells: DataFrame, what: str, base: dict, bounds: dict[str, tuple[float, float]], dx: float, kind: str = "d8", rounds: int | None = None) -> DataFrame:
    """Per tile: the parameters within ``bounds`` whose model comes closest to the observed elevations.

    what: the model; base: its other parameters and the starting values. The search runs over log10 of
    the parameters until it converges; the status of a tile that has not after ``rounds`` (200 a parameter
    unless given) is "not converged". Returns tile_id, each parameter, mse, mse_start, status. The system
    is put together once a tile (elevations along channels are affine in U / K); a search solves it some
    hundred times one after another, so here a tile is a task. Where K and D of advection-diffusion are both sought, the search
    needs their ratio only (see :func:`search_ratio`)."""
    use_package(cells.sparkSession)
    names = list(bounds)
    by_ratio = what == "ad" and {"k", "d"} <= bounds.keys()
    columns = [*PREPARED, *DIRECTION[kind]]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        tile_id = rows["tile_id"].iloc[0]
        try:
            g = arrays(rows, columns)
            g |= stencils(g, dx, kind)
            if by_ratio:
                found, value, first, converged = search_ratio(g, base, bounds, rounds or 200 * len(names))
                return pd.DataFrame([{"tile_id": tile_id} | {n: found[n] for n in names} | {"mse": value, "mse_start": first, "status": "ok" if converged else "not converged"}])
            last, losses, kept = {}, {}, {}

            def loss(x: np.ndarray) -> float:
                p = base | {"model": what} | dict(zip(names, (10.0**x).tolist(), strict=True))
                now = posed(g, p)
                key = (p["k"], p["d"], p["u"], now["fixed"].tobytes())  # many threshold areas give the same channels
                if key not in losses:
                    losses[key] = gap(p, now)
                return losses[key]

            def gap(p: dict, now: dict[str, np.ndarray]) -> float:
                z, settled = solve_block(now, p["s_c"] if what == "nonlinear" else None, dx, last.get("z"), None if what == "ad" else kept)
                if not settled:
                    return math.inf
                last["z"] = z if np.isfinite(z).all() else None
                return float(np.nanmean(((z - g["z"]) ** 2)[g["valid"]]))

            low, high = (np.log10([bounds[n][e] for n in names]) for e in (0, 1))
            start = np.clip(np.log10([base[n] for n in names]), low, high)
            first = loss(start)
            best, value, converged = search(loss, start, low, high, rounds or 200 * len(names))
            row = dict(zip(names, (10.0**best).tolist(), strict=True)) | {"mse": value, "mse_start": first, "status": "ok" if converged else "not converged"}
        except (ValueError, np.linalg.LinAlgError) as e:
            row = dict.fromkeys([*names, "mse", "mse_start"], np.nan) | {"status": str(e)[:200]}
        return pd.DataFrame([{"tile_id": tile_id} | row])

    schema = "tile_id string, " + ", ".join(f"{n} double" for n in names) + ", mse double, mse_start double, status string"
    held = prepared(cells, dx, None if what == "ad" else base["m"], kind).select(*CELL, *columns)
    return held.groupBy("tile_id").applyInPandas(one, schema)


def planform_system(scenarios: DataFrame, no_flux: bool) -> DataFrame:
    """The equations of V-shaped planforms with z = 0 at the outlet; a scenario is a tile of its own.

    no_flux False: neighbours beyond an edge are mirrored. True: edge cells repeat the cell next to
    them, except at the top of the centre column, where (and along the bottom) the missing neighbour
    is a zero."""
    cells = plan.planform(scenarios)
    j, i, nx, ny = (F.col(c) for c in ("j", "i", "nx", "ny"))
    ci = ((nx - 1) / 2).cast("int")
    beyond = {(0, -1): i == 0, (0, 1): i == nx - 1, (-1, 0): j == 0, (1, 0): j == ny - 1}
    unit = {o: 1.0 / (F.col("dx") * F.col("dx")) if o[1] else 1.0 / (F.col("dy") * F.col("dy")) for o in SIDES}
    repeats = {(0, 1): (i == 0) & (j > 0), (0, -1): (i == nx - 1) & (j > 0), (1, 0): (j == 0) & (i != ci)}
    copies = F.coalesce(*(F.when(w, True) for w in repeats.values()), F.lit(False)) if no_flux else F.lit(False)
    spread = {o: F.when(copies | beyond[o], 0.0).otherwise(unit[o]) + (F.lit(0.0) if no_flux else F.when(beyond[-o[0], -o[1]], unit[o]).otherwise(0.0)) for o in SIDES}
    spread[0, 0] = F.when(copies, 0.0).otherwise(-sum(unit[o] for o in SIDES))
    power = F.col("k") * F.pow("area", "m")
    inward = {(0, 1): F.when(i < ci, power / F.col("dx")), (0, -1): F.when(i > ci, power / F.col("dx")), (1, 0): F.when((i == ci) & (j < ny - 1), power / F.col("dy"))}
    flow = {o: F.coalesce(x, F.lit(0.0)) for o, x in inward.items()}
    flow[0, 0] = -sum(flow.values())
    if no_flux:  # the row of a repeated cell: z - z of the cell next to it = 0; the first that fits
        same = [*repeats.items()][::-1]
        pick = {o: F.lit(0.0) for o in repeats}
        for o, w in same:
            pick = {p: F.when(w, -1.0 if p == o else 0.0).otherwise(x) for p, x in pick.items()}
        flow = {o: F.when(copies, pick[o]).otherwise(flow[o]) for o in repeats} | {(0, 0): F.when(copies, 1.0).otherwise(flow[0, 0])}
    return cells.select(
        "scenario", F.col("scenario").alias("tile_id"), "j", "i", nine(flow).alias("flow"), nine(spread).alias("spread"), F.when(copies, 0.0).otherwise(F.col("u")).alias("u"), "d",
        F.lit(None).cast("double").alias("s_c"), F.col("is_outlet").alias("fixed"), F.lit(0.0).alias("value"), F.lit(False).alias("is_channel"), F.lit(0.0).alias("z"), F.lit(True).alias("valid"), "area",
    )


PLANFORM = ["u", "k", "m", "d", "dx", "dy", "a_top"]
AT_ONCE = 1 << 21
"""Numbers in the eliminated blocks of the planforms that a task solves at once (of one, if it has more)."""


def crosses(rows: pd.DataFrame, ny: int, nx: int, no_flux: bool) -> tuple[np.ndarray, np.ndarray]:
    """The equations of planforms of one shape, as :func:`planform_system` says: coefficients of the cell above, to the left,
    itself, to the right and below [5, n, j, i], and right sides [n, j, i]."""
    u, k, m, d, dx, dy, top = (rows[c].to_numpy(float)[:, None, None] for c in PLANFORM)
    j, i = np.indices((ny, nx))
    ci = (nx - 1) // 2
    area = np.where(i < ci, (i + 1) * dx * dy, np.where(i > ci, (nx - i) * dx * dy, top + (j + 1) * 2 * ci * dx * dy))
    with np.errstate(invalid="ignore", divide="ignore"):
        power, x, y = k * area**m, 1.0 / (dx * dx), 1.0 / (dy * dy)
    rim = j == 0, i == 0, i == nx - 1, j == ny - 1
    unit = y, x, x, y
    at_none = np.zeros((ny, nx), bool)
    flow = (at_none, i > ci, i < ci, (i == ci) & (j < ny - 1))
    copied = (at_none, (i == nx - 1) & (j > 0), (i == 0) & (j > 0), (j == 0) & (i != ci)) if no_flux else (at_none,) * 4
    copies = np.any(copied, axis=0)
    outlet = (i == ci) & (j == ny - 1)
    c = np.zeros((5, *area.shape))
    for n, (at, step) in enumerate(zip((0, 1, 3, 4), (dy, dx, dx, dy), strict=True)):
        spread = np.where(rim[n], 0.0, unit[n]) + (0.0 if no_flux else np.where(rim[3 - n], unit[n], 0.0))
        moved = np.where(flow[n], power / step, 0.0)
        c[at] = np.where(copies, -1.0 * copied[n], d * spread + moved)
        c[2] -= d * unit[n] + moved
    c[2] = np.where(copies, 1.0, c[2])
    c[:, :, outlet] = 0.0
    c[2][:, outlet] = 1.0
    return c, np.where(copies | outlet, 0.0, -u)


def solved_planforms(rows: pd.DataFrame, no_flux: bool) -> tuple[np.ndarray, list[str]]:
    """Elevations [n, j, i] of scenarios of one shape, and a status for each."""
    ny, nx = (int(rows[c].iloc[0]) for c in ("ny", "nx"))
    c, b = crosses(rows, ny, nx, no_flux)
    try:
        return solve_crosses(c, b), ["ok"] * len(rows)
    except np.linalg.LinAlgError as e:
        if len(rows) == 1:
            return np.full(b.shape, np.nan), [str(e)[:200]]
    z, status = zip(*(solved_planforms(rows.iloc[[n]], no_flux) for n in range(len(rows))), strict=True)
    return np.concatenate(z), sum(status, [])


def solve_planforms(scenarios: DataFrame, columns: Callable[[pd.DataFrame], dict[str, list]], schema: str) -> DataFrame:
    """Scenarios with what ``columns`` makes of a few of them that have one shape (see schema). Scenarios are dealt over tasks, and a
    task builds and solves those of one shape together, so that they don't cost a group each."""
    use_package(scenarios.sparkSession)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (ny, nx), same in batch.groupby(["ny", "nx"], sort=False):
                most = max(1, AT_ONCE // int(ny * nx * min(ny, nx)))
                for first in range(0, len(same), most):
                    rows = same.iloc[first : first + most]
                    yield rows.assign(**columns(rows))

    tasks = int(scenarios.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = plan.checked(scenarios).select("scenario", *(F.col(c).cast("int").alias(c) for c in ("nx", "ny")), *(F.col(c).cast("double").alias(c) for c in PLANFORM))
    kinds = "scenario string, nx int, ny int, " + ", ".join(f"{c} double" for c in PLANFORM)
    return wanted.repartition(tasks, "scenario").mapInPandas(some, f"{kinds}, {schema}")


def by_size(scenarios: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Scenarios of one block, and the larger ones, if there are any."""
    several = (F.col("nx") > block) | (F.col("ny") > block)
    large = scenarios.where(several)
    return (scenarios, None) if large.isEmpty() else (scenarios.where(~several), large)


def planform_solutions(scenarios: DataFrame, no_flux: bool, block: int = BLOCK) -> DataFrame:
    """Scenarios (scenario, u, k, m, d, nx, ny, dx, dy, a_top) -> scenario, j, i, z, area, status."""

    def whole(rows: pd.DataFrame) -> dict[str, list]:
        z, status = solved_planforms(rows, no_flux)
        return {"zs": list(z.reshape(len(z), -1)), "status": status}

    small, large = by_size(scenarios, block)
    cells = solve_planforms(small, whole, "zs array<double>, status string").select("*", F.posexplode("zs").alias("_at", "z"))
    cells = cells.withColumn("j", F.floor(F.col("_at") / F.col("nx")).cast("int")).withColumn("i", F.col("_at") % F.col("nx"))
    solved = cells.select("scenario", "j", "i", F.when(~F.isnan("z"), F.col("z")).alias("z"), plan.area_at(F.col("j"), F.col("i")).alias("area"), "status")
    if large is None:
        return solved
    equations = planform_system(large, no_flux)
    z = relax(equations.drop("area"), 1.0, block)
    return solved.unionByName(z.join(equations.select("scenario", "j", "i", "area").hint("merge"), ["scenario", "j", "i"]).select("scenario", "j", "i", "z", "area", "status"))


PROFILES = ["west", "centre", "east", "line"]


def planform_profiles(scenarios: DataFrame, block: int = BLOCK) -> DataFrame:
    """Scenarios with elevations down the rows as arrays: centre, west and east (the middle column and those beside it) of the
    solution on the mirrored grid, and line (the middle column) of that on the no-flux grid. NaN or NULL where there is none."""

    def columns(rows: pd.DataFrame) -> dict[str, list]:
        (mirrored, _), (closed, _) = (solved_planforms(rows, no_flux) for no_flux in (False, True))
        ci = mirrored.shape[2] // 2
        return {n: list(z[:, :, ci + k]) for n, z, k in zip(PROFILES, (mirrored,) * 3 + (closed,), (-1, 0, 1, 0), strict=True)}

    small, large = by_size(scenarios, block)
    solved = solve_planforms(small, columns, ", ".join(f"{n} array<double>" for n in PROFILES))
    if large is None:
        return solved
    wide = large.select("scenario", "nx", "ny", *PLANFORM)
    for no_flux, sides in ((False, {"west": -1, "centre": 0, "east": 1}), (True, {"line": 0})):
        cells = planform_solutions(large, no_flux, block).join(large.select("scenario", "nx").hint("merge"), "scenario")
        off = F.col("i") - (F.col("nx") - 1) / 2
        down = lambda k: F.transform(F.array_sort(F.collect_list(F.when(off == k, F.struct("j", "z")))), lambda p: p["z"])  # noqa: B023, E731
        wide = wide.join(cells.where(F.abs(off) <= 1).groupBy("scenario").agg(*(down(k).alias(n) for n, k in sides.items())).hint("merge"), "scenario")
    return solved.unionByName(wide)
