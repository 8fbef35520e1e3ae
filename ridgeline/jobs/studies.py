"""Composite jobs: resolution studies, Peclet curves, model comparisons, exports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import drainage, models, planform, resample, routing, slope_area, stencil
from ridgeline.session import stage


def routed(cells: DataFrame, dx: float, dinf: bool = False, filled: bool = False) -> DataFrame:
    """Cells with fd and area, and for D-infinity facet, r and area_dinf. ``filled``: flats of the surface drain."""
    cells = cells.select("tile_id", "j", "i", "z")
    if dinf and not filled:
        return routing.both_flows(cells, dx)
    flowing = (drainage.filled_flow if filled else routing.flow)(cells, dx)
    if not dinf:
        return flowing
    return stage(routing.dinf_area(routing.dinf_direction(flowing, dx), dx), "routed-dinf")


SCENARIO = "scenario string, model string, m double, u double, k double, d double, a_crit double, s_c double"


def channel_points(cells: DataFrame, dx: float, min_area: float, interval: float) -> DataFrame:
    """(tile_id, j, i, a, s): area and slope of channel cells of routed cells with elevation z."""
    return routing.channel_slope_by_drop(cells, dx, interval, min_area).select("tile_id", "j", "i", F.col("area").alias("a"), F.col("slope").alias("s"))


def spacings(params: DataFrame, targets: list[float]) -> DataFrame:
    """A run for each row of ``params`` and each spacing: run (tile_id@dx_id), dx_id, dx and the columns of params."""
    runs = params.select("*", F.posexplode(F.array(*(F.lit(float(t)) for t in targets))).alias("dx_id", "dx"))
    return runs.withColumn("run", F.concat_ws("@", "tile_id", F.col("dx_id").cast("string")))


def coarse_surfaces(cells: DataFrame, runs: DataFrame, dx: float) -> DataFrame:
    """(tile_id, j, i, z), tile_id being a run: filled surfaces of all tiles at all of their spacings."""
    studied = cells.join(runs.select("tile_id").distinct(), "tile_id", "left_semi")
    wide = resample.resample_sweep(studied, dx, runs.select("tile_id", "dx_id", "dx"))
    coarse = stage(wide.select(F.concat_ws("@", "tile_id", F.col("dx_id").cast("string")).alias("tile_id"), "j", "i", "z"), "coarse")
    return stage(drainage.fill_pits(coarse).select("tile_id", "j", "i", F.col("filled").alias("z")), "filled")


def flow_of_runs(surfaces: DataFrame, runs: DataFrame, dinf: bool) -> DataFrame:
    """Routed surfaces with areas in their own spacing's units.

    Directions don't depend on the spacing, and areas are cells times its square, so all spacings are routed at once."""
    sides = runs.select(F.col("run").alias("tile_id"), (F.col("dx") * F.col("dx")).alias("cell"))
    flowing = routed(surfaces, 1.0, dinf, filled=True).join(sides, "tile_id")
    for c in ("area", "area_dinf") if dinf else ("area",):
        flowing = flowing.withColumn(c, F.col(c) * F.col("cell"))
    return stage(flowing.drop("cell"), "flowing")


def steepness_of_runs(surfaces: DataFrame, runs: DataFrame, min_area: float, interval: float) -> DataFrame:
    """run, part, ks, r2, n_good, a_max of routed surfaces (tile_id: a run, part, j, i, z, fd, area): all parts of all
    runs walk their channels together, in unit steps, which the spacing then measures."""
    whole = surfaces.withColumn("tile_id", F.concat_ws("|", "tile_id", "part"))
    of = runs.select(F.col("run").alias("_run"), F.col("dx").alias("_dx"), "theta")
    part = F.substring_index("tile_id", "|", -1)
    points = channel_points(whole, 1.0, min_area, interval).withColumn("_part", part)
    points = points.withColumn("_run", F.expr("left(tile_id, length(tile_id) - length(_part) - 1)"))
    points = points.join(of, "_run").withColumn("s", F.col("s") / F.col("_dx"))
    fits = slope_area.fit_fixed(points.select("_run", "_part", "a", "s", "theta"), ["_run", "_part", "theta"], F.col("theta"), min_points=1)
    return fits.select(F.col("_run").alias("run"), F.col("_part").alias("part"), "ks", "r2", "n_good", "a_max")


def resolution_study(cells: DataFrame, params: DataFrame, dx: float, targets: list[float], min_area: float = 1e5, interval: float = 10.0, routings: tuple[str, ...] = ("d8",)) -> DataFrame:
    """Steepness of observed and modelled relief at coarser spacings: location, tile, dx_id, dx, u, k, d, theta, then ks,
    r2, npts and amax of the observed relief (_obs) and of each routing's model (_d8, _dinf), ratio_* and status_*.

    params: (tile_id, location, tile, u, k, d, theta), a row for each tile to study. The spacing is a key: every
    surface of every tile is resampled, filled and routed in one plan, whose jobs don't grow with the number of spacings.
    The steady state is solved on unit cells, with D / dx^2 and K / dx in place of D and K, and its slopes are taken along the
    observed D8 flow, with the observed area. A run that fails has NULL values and a status, the others go on; a spacing
    at which a tile has no channel has NULL values."""
    runs = stage(spacings(params, targets), "runs")
    flowing = flow_of_runs(coarse_surfaces(cells, runs, dx), runs, "dinf" in routings)
    scenarios = runs.select(
        F.col("run").alias("scenario"), F.lit("ad").alias("model"), F.col("theta").alias("m"), "u", (F.col("k") / F.col("dx")).alias("k"), (F.col("d") / (F.col("dx") * F.col("dx"))).alias("d"),
        F.lit(0.0).alias("a_crit"), F.lit(1.0).alias("s_c"), F.col("run").alias("tile_id"),
    )
    solved = {kind: stage(models.solve_models(flowing, scenarios, 1.0, kind), f"solved-{kind}") for kind in routings}
    flow = flowing.select("tile_id", "j", "i", "fd", "area")
    parts = [flowing.select("tile_id", F.lit("obs").alias("part"), "j", "i", "z", "fd", "area")]
    parts += [s.where("z IS NOT NULL").select("tile_id", F.lit(kind).alias("part"), "j", "i", "z").join(flow.hint("merge"), ["tile_id", "j", "i"]) for kind, s in solved.items()]
    fits = stage(steepness_of_runs(stage(reduce(DataFrame.unionByName, parts), "surfaces"), runs, min_area, interval), "fits")
    row = runs.select("run", "location", "tile", "dx_id", "dx", "u", "k", "d", "theta")
    for part in ("obs", *routings):
        named = (F.col(a).alias(f"{b}_{part}") for a, b in (("ks", "ks"), ("r2", "r2"), ("n_good", "npts"), ("a_max", "amax")))
        row = row.join(fits.where(F.col("part") == part).select("run", *named), "run", "left")
    for kind, s in solved.items():
        row = row.join(s.groupBy(F.col("tile_id").alias("run")).agg(F.max("status").alias(f"status_{kind}")), "run", "left")
        row = row.withColumn(f"ratio_{kind}", slope_area.guarded_ratio(F.col(f"ks_{kind}"), F.col("ks_obs")))
    return row.drop("run")


def filled_results(results: DataFrame, spacings: list[float]) -> DataFrame:
    """Every (location, tile) at every spacing of the sweep; what has no result is NULL."""
    grid = results.select("location", "tile").distinct().withColumn("dx", F.explode(F.array(*map(F.lit, spacings))))
    return grid.join(results, ["location", "tile", "dx"], "left")


def compare_slopes(cells: DataFrame, modelled: DataFrame, dx: float, min_area: float, interval: float) -> DataFrame:
    """(tile_id, j, i, a, s_obs, s_mod): slopes of observed and modelled elevations along the observed flow,
    where both are finite and positive. cells are routed; modelled has tile_id, j, i, z."""
    observed = channel_points(cells, dx, min_area, interval)
    on_flow = cells.drop("z").join(modelled.select("tile_id", "j", "i", "z").hint("merge"), ["tile_id", "j", "i"])
    other = channel_points(on_flow, dx, min_area, interval).select("tile_id", "j", "i", F.col("s").alias("s_mod"))
    both = observed.withColumnRenamed("s", "s_obs").join(other.hint("merge"), ["tile_id", "j", "i"])
    return both.where("s_obs > 0 AND s_mod > 0 AND a > 0")


def fit_curves(slopes: DataFrame, points: int = 200) -> DataFrame:
    """tile_id, n, step, a, s_obs, s_mod: both power laws of each tile, fitted over all of its points, at
    log-spaced areas between its extremes."""
    x = F.log10("a")
    fits = slopes.groupBy("tile_id").agg(
        F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"),
        *(f(F.log10(c), x).alias(f"{n}_{c}") for c in ("s_obs", "s_mod") for n, f in (("slope", F.regr_slope), ("icept", F.regr_intercept))),
    )
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("low") + k * (F.col("high") - F.col("low")) / (points - 1))
    wide = fits.select("*", F.posexplode(at).alias("step", "x"))
    ten = F.lit(10.0)
    return wide.select("tile_id", "n", "step", F.pow(ten, "x").alias("a"), *(F.pow(ten, F.col(f"icept_{c}") + F.col(f"slope_{c}") * F.col("x")).alias(c) for c in ("s_obs", "s_mod")))


def variant_fits(cells: DataFrame, variants: DataFrame, dx: float, min_area: float, interval: float) -> DataFrame:
    """tile_id, variant, ks, theta, r2, n_bins, n_points: the binned fit of each variant of each tile, with the
    observed area and flow. variants: (tile_id, variant, j, i, z), the observed elevations being one."""
    key = F.concat_ws("|", "tile_id", "variant")
    on_flow = variants.select("tile_id", "j", "i", "variant", "z").join(cells.select("tile_id", "j", "i", "area", "fd").hint("merge"), ["tile_id", "j", "i"])
    points = stage(channel_points(on_flow.withColumn("tile_id", key), dx, min_area, interval), "variant-points")
    fits = slope_area.fit_bins(slope_area.binned(points, ["tile_id"], min_area), ["tile_id"])
    return fits.select(F.substring_index("tile_id", "|", 1).alias("tile_id"), F.substring_index("tile_id", "|", -1).alias("variant"), "ks", "theta", "r2", "n_bins", "n_points")


def peclet_sweep(bases: DataFrame, first: float, last: float, count: int) -> DataFrame:
    """Scenarios (scenario, base, u, k, m, d, nx, ny, dx, dy, a_top) at log-spaced spacings with the inlet's area
    held. bases: (scenario, u, k, m, pe, inlet_area, length, width, height): diffusivity from the Peclet
    number, grids that cover width x height."""
    tasks = int(bases.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small table of bases may lie in one file
    b = bases.repartition(tasks, "scenario").select("*", F.posexplode(planform.log_steps(first, last, count)).alias("_step", "_dx"))
    b = b.withColumn("nx", planform.grid_size(F.col("width"), F.col("_dx"), odd=True)).withColumn("ny", planform.grid_size(F.col("height"), F.col("_dx")))
    b = b.where("nx >= 5 AND ny >= 5").withColumn("dx", F.col("width") / (F.col("nx") - 1)).withColumn("dy", F.col("height") / (F.col("ny") - 1))
    d = planform.d_from_pe(F.col("pe"), F.col("k"), F.col("length"), F.col("inlet_area"), F.col("m"))
    top = planform.a_top_for_inlet(F.col("inlet_area"), (F.col("nx") - 1) / 2, F.col("dx"), F.col("dy"))
    return b.select(F.concat_ws("@", "scenario", F.col("_step").cast("string")).alias("scenario"), F.col("scenario").alias("base"), "u", "k", "m", d.alias("d"), "nx", "ny", "dx", "dy", top.alias("a_top"))


def peclet_curves(scenarios: DataFrame, cut: float = 0.2, min_points: int = 3, profiles: Callable[[DataFrame], DataFrame] = models.planform_profiles) -> DataFrame:
    """scenario, dx, ks_curvature, ks_fit, r2_fit, n_fit, ks_local, ks_q25, ks_q75: three estimates of steepness
    along the centre line, each over U / K.

    Curvature: median of U/K + (D/K) lap on the mirrored grid. Fit (exponent fixed to m) and local: slope
    against area, and S A^m, on the no-flux grid; NULL below ``min_points``. The first and last ``cut`` of the
    line is left out. ``profiles``: what appends to scenarios the elevations that the estimates are taken from, the middle columns
    down the rows as arrays (see :func:`models.planform_profiles`). A scenario stays one row, which holds no more than the
    length of its line, so nothing is shuffled by scenario."""
    u, k, d, m, dx, dy = (F.col(c) for c in ("u", "k", "d", "m", "dx", "dy"))
    first, last = F.greatest(F.floor(cut * F.col("ny")), F.lit(0)).cast("int"), F.least(F.ceil((1 - cut) * F.col("ny")), F.col("ny")).cast("int") - 1
    rows = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    at = lambda name, j: F.get(F.col(name), j)
    over = u / k

    def curvature(j: Column) -> Column:
        z = at("centre", j)
        lap = (at("east", j) - 2 * z + at("west", j)) / (dx * dx) + (at("centre", j + 1) - 2 * z + at("centre", j - 1)) / (dy * dy)
        return (over + d / k * lap) / over

    point = lambda j: F.struct(planform.area_at(j, ((F.col("nx") - 1) / 2).cast("int")).alias("a"), ((at("line", j) - at("line", j + 1)) / dy).alias("s"))
    lines = profiles(scenarios).select("scenario", "dx", "m", over.alias("over"), F.transform(rows, curvature).alias("curved"), F.transform(rows, point).alias("points"))
    lines = slope_area.fit_in_row(lines, "points", F.col("m"), min_points)
    return lines.select(
        "scenario", "dx", slope_area.quantiles_in_row(F.col("curved"), (0.5,))[0].alias("ks_curvature"), (F.col("ks") / F.col("over")).alias("ks_fit"), F.col("r2").alias("r2_fit"), F.col("n_good").alias("n_fit"),
        *((F.col(a) / F.col("over")).alias(b) for a, b in (("ks_median", "ks_local"), ("ks_q25", "ks_q25"), ("ks_q75", "ks_q75"))),
    )


def compare_routings(cells: DataFrame, scenarios: DataFrame, dx: float) -> DataFrame:
    """tile_id, scenario, routing, mse, n for each model under D8 and D-infinity flow."""
    both = routed(cells, dx, dinf=True)
    runs = [models.misfit(models.solve_models(both, scenarios, dx, kind), both, ["tile_id", "scenario"]).withColumn("routing", F.lit(kind)) for kind in ("d8", "dinf")]
    return reduce(DataFrame.unionByName, runs).select("tile_id", "scenario", "routing", "mse", "n")


def model_outputs(solved: DataFrame, dx: float) -> DataFrame:
    """The layers of a modelled tile as one wide table: elevation, filled, flow_direction, area, logarea,
    hillshade. Write it with ``write_cells``."""
    filled = stage(drainage.fill_pits(solved.select("tile_id", "j", "i", "z")), "filled")
    flowing = drainage.filled_flow(filled.select("tile_id", "j", "i", F.col("filled").alias("z")), dx).select("tile_id", "j", "i", F.col("fd").alias("flow_direction"), "area")
    shaded = stencil.hillshade(filled, dx)
    return shaded.join(flowing.hint("merge"), ["tile_id", "j", "i"]).select("tile_id", "j", "i", F.col("z").alias("elevation"), "filled", "flow_direction", "area", F.log10("area").alias("logarea"), F.col("shade").alias("hillshade"))


def export_runs(results: DataFrame, path: str) -> None:
    """Results of runs as CSV with a header, in range-partitioned order of location, tile and dx."""
    results.repartitionByRange("location", "tile", "dx").sortWithinPartitions("location", "tile", "dx").write.mode("overwrite").csv(path, header=True)


def pe_table(parts: DataFrame) -> DataFrame:
    """Peclet relations over rows (id, pe, k, length, area, m)."""
    pe, k, length, area, m = (F.col(c) for c in ("pe", "k", "length", "area", "m"))
    d = planform.d_from_pe(pe, k, length, area, m)
    return parts.select("id", d.alias("d"), planform.pe_from_d(d, k, length, area, m).alias("pe_back"), planform.inlet_area_from_pe(pe, d, k, length, m).alias("area_back"))
