"""Registered queries over the tables, and the same queries as DuckDB SQL."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.jobs import studies
from ridgeline.operators import drainage, models, planform, resample, routing, slope_area, stencil
from ridgeline.session import stage, staging_path
from ridgeline.sources import grids

DX = grids.SPACING
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CELLS = f"""cells AS MATERIALIZED (SELECT 't' || CAST(vec_id // {grids.TILE_ROWS} AS VARCHAR) AS tile_id, CAST(vec_id % {grids.TILE_ROWS} AS INTEGER) AS j,
  CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS z FROM embeddings)"""
NEAR = """near4 AS (SELECT *, lag(z) OVER r AS z_w, lead(z) OVER r AS z_e, lag(z) OVER c AS z_n, lead(z) OVER c AS z_s FROM cells
  WINDOW r AS (PARTITION BY tile_id, j ORDER BY i), c AS (PARTITION BY tile_id, i ORDER BY j)),
box AS (SELECT tile_id, max(j) AS nj, max(i) AS ni FROM cells GROUP BY tile_id)"""
NEAR8 = """near8 AS MATERIALIZED (SELECT *, lag(z_n) OVER r AS z_nw, lead(z_n) OVER r AS z_ne, lag(z_s) OVER r AS z_sw, lead(z_s) OVER r AS z_se FROM near4
  WINDOW r AS (PARTITION BY tile_id, j ORDER BY i))"""
FLOW = """falls AS (SELECT *, (z - z_e) / 10.0 AS e, (z - z_se) / (10.0 * sqrt(2)) AS se, (z - z_s) / 10.0 AS s, (z - z_sw) / (10.0 * sqrt(2)) AS sw,
  (z - z_w) / 10.0 AS w, (z - z_nw) / (10.0 * sqrt(2)) AS nw, (z - z_n) / 10.0 AS n, (z - z_ne) / (10.0 * sqrt(2)) AS ne FROM near8),
d8 AS MATERIALIZED (SELECT tile_id, j, i, z, CASE WHEN best > 0 THEN CASE best WHEN e THEN 1 WHEN se THEN 2 WHEN s THEN 4 WHEN sw THEN 8 WHEN w THEN 16 WHEN nw THEN 32 WHEN n THEN 64 ELSE 128 END END AS fd
  FROM (SELECT *, greatest(e, se, s, sw, w, nw, n, ne) AS best FROM falls)),
step(fd, di, dj) AS (VALUES (1, 1, 0), (2, 1, 1), (4, 0, 1), (8, -1, 1), (16, -1, 0), (32, -1, -1), (64, 0, -1), (128, 1, -1)),
links AS MATERIALIZED (SELECT tile_id, j, i, j + dj AS dn_j, i + di AS dn_i, CASE WHEN di <> 0 AND dj <> 0 THEN sqrt(2) ELSE 1.0 END AS steps FROM d8 JOIN step USING (fd)),
walk AS (SELECT tile_id, j AS sj, i AS si, j, i FROM d8 UNION ALL SELECT w.tile_id, w.sj, w.si, l.dn_j, l.dn_i FROM walk w JOIN links l ON w.tile_id = l.tile_id AND w.j = l.j AND w.i = l.i),
area AS MATERIALIZED (SELECT tile_id, j, i, CAST(100 * count(*) AS DOUBLE) AS area FROM walk GROUP BY tile_id, j, i),
flow AS MATERIALIZED (SELECT d8.*, area.area, nj, ni FROM d8 JOIN area USING (tile_id, j, i) JOIN box USING (tile_id))"""
POINTS = "points AS (SELECT l_returnflag AS grp, l_extendedprice AS a, l_discount * pow(l_extendedprice, -0.45) AS s FROM lineitem), logs AS (SELECT grp, log10(a) AS x, log10(s) AS y, a, s FROM points WHERE a > 0 AND s > 0)"
BINS = """ends AS (SELECT grp, min(x) AS lo, max(x) AS hi FROM logs GROUP BY grp HAVING count(*) >= 30 AND max(x) > min(x)),
raw_bins AS (SELECT grp, CAST(least(floor((x - lo) / ((hi - lo) / 24)), 23) AS INTEGER) AS bin, median(x) AS log_a, median(y) AS log_s, count(*) AS n FROM logs JOIN ends USING (grp) GROUP BY ALL),
used AS (SELECT grp, CASE WHEN count(*) FILTER (n >= 10) >= 3 THEN 10 WHEN count(*) FILTER (n >= 5) >= 3 THEN 5 WHEN count(*) FILTER (n >= 3) >= 3 THEN 3 END AS least_n FROM raw_bins GROUP BY grp),
bins AS (SELECT raw_bins.* FROM raw_bins JOIN used USING (grp) WHERE n >= least_n)"""
RUNS = "runs AS (SELECT l_returnflag AS location, CAST(l_suppkey % 5 AS INTEGER) AS tile, CAST(l_linenumber AS DOUBLE) AS dx, l_extendedprice AS ks_mod, CASE WHEN l_quantity > 5 THEN l_quantity END AS ks_obs FROM lineitem)"


def unsigned_zero(sql: str) -> str:
    """Add 0.0 to every rounded value: DuckDB's round keeps the sign of a zero, Spark's does not."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(sql[at:m.start()] + "(" + sql[m.start():end] + " + 0.0)")
        at = end
    return "".join(out) + sql[at:]


def query(sql: str | None = None) -> Callable:
    """Register a query, with its SQL if SQL can say it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = unsigned_zero(sql)
        return f

    return add


def to(places: int, **columns: Column | str) -> list[Column]:
    """Rounded columns, named."""
    return [F.round(c, places).alias(n) for n, c in columns.items()]


def rounded(places: int, *names: str) -> list[Column]:
    return [F.round(n, places).alias(n) for n in names]


def sql_round(places: int, *names: str) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


# ---- slope-area analytics


@query(f"""WITH {POINTS}, {BINS},
centre AS (SELECT grp, sum(n * log_a) / sum(n) AS mx, sum(n * log_s) / sum(n) AS my FROM bins GROUP BY grp),
sums AS (SELECT grp, any_value(mx) AS mx, any_value(my) AS my, sum(n * (log_a - mx) ** 2) AS sxx, sum(n * (log_a - mx) * (log_s - my)) AS sxy, sum(n * (log_s - my) ** 2) AS syy, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS n_points
  FROM bins JOIN centre USING (grp) GROUP BY grp)
SELECT grp, round(pow(10.0, my - sxy / sxx * mx), 6) AS ks, round(-sxy / sxx, 6) AS theta, round(sxy * sxy / (sxx * syy), 6) AS r2, n_bins, n_points FROM sums""")
def sa_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = slope_area.binned(grids.slope_area_points(spark, sf_dir), ["grp"])
    return slope_area.fit_bins(bins, ["grp"]).select("grp", *rounded(6, "ks", "theta", "r2"), "n_bins", "n_points")


@query(f"WITH {POINTS}, {BINS} SELECT grp, bin, {sql_round(6, 'log_a', 'log_s')}, round(pow(10.0, log_a), 2) AS a, round(pow(10.0, log_s), 8) AS s, n FROM bins")
def sa_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = slope_area.binned(grids.slope_area_points(spark, sf_dir), ["grp"])
    ten = F.lit(10.0)
    return bins.select("grp", "bin", *rounded(6, "log_a", "log_s"), *to(2, a=F.pow(ten, "log_a")), *to(8, s=F.pow(ten, "log_s")), "n")


@query(f"""WITH {POINTS}, {BINS},
edges AS (SELECT grp, bin, coalesce((p + log_a) / 2, log_a - (q - log_a) / 2) AS e0, coalesce((q + log_a) / 2, log_a + (log_a - p) / 2) AS e1
  FROM (SELECT *, lag(log_a) OVER o AS p, lead(log_a) OVER o AS q FROM bins WINDOW o AS (PARTITION BY grp ORDER BY log_a))),
q AS (SELECT grp, bin, quantile_cont(s, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM logs JOIN edges USING (grp) WHERE x >= e0 AND x < e1 GROUP BY grp, bin)
SELECT grp, bin, round(CASE WHEN n >= 3 THEN q[2] - q[1] ELSE 0 END, 8) AS lower, round(CASE WHEN n >= 3 THEN q[3] - q[2] ELSE 0 END, 8) AS upper FROM edges LEFT JOIN q USING (grp, bin)""")
def sa_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = grids.slope_area_points(spark, sf_dir)
    return slope_area.iqr_errors(points, slope_area.binned(points, ["grp"]), ["grp"]).select("grp", "bin", *rounded(8, "lower", "upper"))


@query(f"""WITH {POINTS}, fitted AS (SELECT grp, y, -0.45 * x - 1.3 AS f, a AS w FROM logs), m AS (SELECT grp, sum(w * y) / sum(w) AS my FROM fitted GROUP BY grp)
SELECT grp, round(1 - sum(w * (y - f) ** 2) / sum(w * (y - my) ** 2), 6) AS r2 FROM fitted JOIN m USING (grp) GROUP BY grp""")
def sa_weighted_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = slope_area.log_points(grids.slope_area_points(spark, sf_dir), ["grp"]).withColumn("f", -0.45 * F.col("log_a") - 1.3).withColumn("w", F.pow(F.lit(10.0), "log_a"))
    return slope_area.weighted_r2(logs, ["grp"], "log_s", "f", "w").select("grp", *rounded(6, "r2"))


@query(f"WITH {POINTS} SELECT grp, round(pow(10.0, regr_intercept(y, x)), 6) AS ks, round(-regr_slope(y, x), 6) AS theta, round(regr_r2(y, x), 6) AS r2, count(*) AS n_good FROM logs GROUP BY grp")
def sa_fit_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slope_area.fit_free(grids.slope_area_points(spark, sf_dir), ["grp"]).select("grp", *rounded(6, "ks", "theta", "r2"), "n_good")


@query(f"""WITH {POINTS}, c AS (SELECT grp, avg(y + 0.45 * x) AS c, avg(y) AS my FROM logs GROUP BY grp)
SELECT grp, round(pow(10.0, any_value(c)), 6) AS ks, round(1 - sum((y - (c - 0.45 * x)) ** 2) / sum((y - my) ** 2), 6) AS r2, count(*) AS n_good, round(max(a), 2) AS a_max FROM logs JOIN c USING (grp) GROUP BY grp""")
def sa_fit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slope_area.fit_fixed(grids.slope_area_points(spark, sf_dir), ["grp"], 0.45).select("grp", *rounded(6, "ks", "r2"), "n_good", *rounded(2, "a_max"))


@query(f"WITH {POINTS}, k AS (SELECT grp, quantile_cont(s * pow(a, 0.4), [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM logs GROUP BY grp) SELECT grp, round(q[2], 6) AS ks_median, round(q[1], 6) AS ks_q25, round(q[3], 6) AS ks_q75, n FROM k")
def ks_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slope_area.local_ks(grids.slope_area_points(spark, sf_dir), ["grp"], 0.4).select("grp", *rounded(6, "ks_median", "ks_q25", "ks_q75"), "n")


@query(f"WITH {POINTS} SELECT grp, round(min(a) * 0.9, 6) AS a_low, round(max(a) * 1.1, 6) AS a_high, round(min(s) * 0.9, 8) AS s_low, round(max(s) * 1.1, 8) AS s_high FROM logs GROUP BY grp")
def axis_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slope_area.axis_limits(grids.slope_area_points(spark, sf_dir), ["grp"]).select("grp", *rounded(6, "a_low", "a_high"), *rounded(8, "s_low", "s_high"))


@query(f"""WITH {RUNS}, r AS (SELECT location, dx, CASE WHEN ks_obs > 0 AND ks_mod > 0 THEN ks_mod / ks_obs END AS v FROM runs)
SELECT location, dx, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.75), 4) AS q75, count(v) AS n FROM r GROUP BY location, dx""")
def group_median_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = grids.run_results(spark, sf_dir).withColumn("ratio", slope_area.guarded_ratio(F.col("ks_mod"), F.col("ks_obs")))
    return slope_area.median_iqr(runs, ["location", "dx"], "ratio").select("location", "dx", *rounded(4, "median", "q25", "q75"), "n")


@query(f"WITH {RUNS} SELECT location, tile, dx, count(*) AS n, max(ks_mod) AS ks_mod, max(ks_obs) AS ks_obs FROM runs GROUP BY ALL")
def exported_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steepest result of each location, tile and spacing, exported as sorted CSV and read back."""
    top = grids.run_results(spark, sf_dir).groupBy("location", "tile", "dx").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("ks_mod", "ks_obs")))
    path = staging_path(spark, "export")
    studies.export_runs(top, path)
    return spark.read.schema(top.schema).csv(path, header=True)


@query(f"WITH {RUNS} SELECT dx, count(DISTINCT location || tile) AS n_tiles FROM runs GROUP BY dx")
def distinct_spacings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spacings that occur, in order, with how many tiles have each."""
    tiles = grids.run_results(spark, sf_dir).select("dx", "location", "tile").distinct()
    return tiles.groupBy("dx").agg(F.count("*").alias("n_tiles")).orderBy("dx")


@query(f"""WITH {RUNS}, per AS (SELECT location, tile, dx, round(avg(ks_mod), 4) AS v FROM runs GROUP BY ALL)
SELECT location, tile, array_to_string(list(CAST(CAST(dx AS INTEGER) AS VARCHAR) ORDER BY dx), ',') AS dx_series, count(*) AS n_dx, round(max(v), 4) AS top FROM per GROUP BY location, tile""")
def plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = grids.run_results(spark, sf_dir).groupBy("location", "tile", "dx").agg(F.round(F.avg("ks_mod"), 4).alias("v"))
    rows = per.groupBy("location", "tile").agg(F.sort_array(F.collect_list(F.struct("dx", "v"))).alias("series"))
    return rows.select("location", "tile", F.array_join(F.transform("series", lambda p: p["dx"].cast("int").cast("string")), ",").alias("dx_series"), F.size("series").cast("long").alias("n_dx"), F.round(F.array_max(F.transform("series", lambda p: p["v"])), 4).alias("top"))


@query(f"""WITH {RUNS}, m AS (SELECT location, dx, median(ks_mod) AS v FROM runs GROUP BY ALL), f AS (SELECT location, arg_min(dx, dx) AS x0, arg_min(v, dx) AS y0 FROM m WHERE v > 0 GROUP BY location HAVING count(*) >= 2)
SELECT location, dx, round(v, 4) AS v, round(y0 * x0 / dx, 4) AS guide FROM m LEFT JOIN f USING (location)""")
def slope_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = slope_area.quantiles(grids.run_results(spark, sf_dir), ["location", "dx"], "ks_mod", (0.5,)).select("location", "dx", F.col("q")[0].alias("v"))
    return slope_area.guide_line(m, ["location"], "dx", "v").select("location", "dx", *rounded(4, "v", "guide"))


# ---- stencils on the rough surface


@query(f"""WITH {CELLS}, {NEAR}, g AS (SELECT tile_id, j, i, CASE WHEN i = 0 THEN z_e - z WHEN i = ni THEN z - z_w ELSE (z_e - z_w) / 2 END AS gx, CASE WHEN j = 0 THEN z_s - z WHEN j = nj THEN z - z_n ELSE (z_s - z_n) / 2 END AS gy FROM near4 JOIN box USING (tile_id))
SELECT tile_id, j, i, round(sqrt(gx * gx + gy * gy), 6) AS slope FROM g""")
def slope_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.slope_magnitude(grids.matrix_cells(spark, sf_dir)).select("tile_id", "j", "i", *rounded(6, "slope"))


@query(f"WITH {CELLS}, {NEAR} SELECT tile_id, j, i, round((z_e - 2 * z + z_w) / 100 + (z_s - 2 * z + z_n) / 100, 6) AS lap FROM near4")
def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.laplacian(grids.matrix_cells(spark, sf_dir), DX).select("tile_id", "j", "i", *rounded(6, "lap"))


PICARD = """picard AS (SELECT tile_id, j, i, z, CASE WHEN i = 0 THEN (z_e - z) / 10 WHEN i = ni THEN (z - z_w) / 10 ELSE ((z - z_w) / 10 + (z_e - z) / 10) / 2 END AS x, CASE WHEN j = 0 THEN (z_s - z) / 10 WHEN j = nj THEN (z - z_n) / 10 ELSE ((z - z_n) / 10 + (z_s - z) / 10) / 2 END AS y FROM near4 JOIN box USING (tile_id)),
sloped AS (SELECT tile_id, j, i, sqrt(x * x + y * y) AS slope FROM picard)"""


def _sloped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.one_sided_slope(grids.matrix_cells(spark, sf_dir).withColumn("area", F.lit(1.0)), DX)


@query(f"WITH {CELLS}, {NEAR}, {PICARD} SELECT tile_id, j, i, round(slope, 6) AS slope, round(0.01 / (1 - greatest(-0.99, least(0.99, slope / 0.05)) ** 2), 6) AS d_eff, round(0.01 * slope / (1 - (slope / 1.27) ** 2), 8) AS flux FROM sloped")
def picard_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = F.col("slope"), F.lit(0.01)
    return _sloped(spark, sf_dir).select("tile_id", "j", "i", *to(6, slope=s, d_eff=stencil.effective_diffusivity(d, s, 0.05)), *to(8, flux=stencil.nonlinear_flux(d, s, 1.27)))


@query(f"WITH {CELLS}, {NEAR}, {PICARD} SELECT tile_id, j, i, round(0.01 * slope, 8) AS linear, round(0.01 * slope / (1 - (slope / 1.27) ** 2) - 0.01 * slope, 8) AS excess FROM sloped")
def hillslope_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear flux, and what a critical slope adds to it."""
    s, d = F.col("slope"), F.lit(0.01)
    linear = stencil.linear_flux(d, s)
    return _sloped(spark, sf_dir).select("tile_id", "j", "i", *to(8, linear=linear, excess=stencil.nonlinear_flux(d, s, 1.27) - linear))


@query(f"WITH {CELLS} SELECT tile_id, j, i, round(1000.0 - 5.0 * j + 0.1 * z, 6) AS z FROM cells")
def stored_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of all tiles written by blocks; one is read back, the other's files are pruned."""
    path = staging_path(spark, "cells")
    both = [cells(spark, sf_dir).withColumn("variant", F.lit(name)) for name, cells in (("raw", grids.matrix_cells), ("tilted", grids.tilted_cells))]
    grids.write_cells(reduce(DataFrame.unionByName, both), path)
    return grids.read_cells(spark, path, variant="tilted").select("tile_id", "j", "i", *rounded(6, "z"))


@query(f"WITH {CELLS}, {NEAR}, {PICARD} SELECT tile_id, CAST(least(floor(slope / 0.01), 24) AS INTEGER) AS bin, count(*) AS n FROM sloped WHERE slope BETWEEN 0 AND 0.25 GROUP BY ALL")
def slope_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slope_area.histogram(_sloped(spark, sf_dir), ["tile_id"], "slope", 0.0, 0.25, 25)


@query(f"WITH {CELLS}, {NEAR}, s AS (SELECT tile_id, j, i, (z_e - z_w) / 20 AS gx, (z_n - z_s) / 20 AS gy FROM near4) SELECT tile_id, j, i, round(greatest(0, (sin(radians(20)) - cos(radians(20)) * (gx * sin(radians(315)) + gy * cos(radians(315)))) / sqrt(1 + gx * gx + gy * gy)), 6) AS shade FROM s WHERE gx IS NOT NULL AND gy IS NOT NULL")
def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.hillshade(grids.matrix_cells(spark, sf_dir), DX).where("shade IS NOT NULL").where((F.col("j") > 0) & (F.col("i") > 0)).join(
        grids.matrix_cells(spark, sf_dir).groupBy("tile_id").agg(F.max("j").alias("nj"), F.max("i").alias("ni")), "tile_id").where("j < nj AND i < ni").select("tile_id", "j", "i", *rounded(6, "shade"))


@query(f"WITH {CELLS} SELECT tile_id, j - 10 AS j, i - 8 AS i, round(z, 6) AS z FROM cells WHERE j >= 10 AND j < 40 AND i >= 8 AND i < 56")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.crop(grids.matrix_cells(spark, sf_dir), 10, 40, 8, 56).select("tile_id", "j", "i", *rounded(6, "z"))


@query(f"WITH {CELLS} SELECT tile_id, j, count(*) AS n, round(sum(z), 5) AS z FROM cells WHERE j >= 10 AND j < 40 GROUP BY ALL")
def interior_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.trim(grids.matrix_cells(spark, sf_dir), 0.2, grids.TILE_ROWS).groupBy("tile_id", "j").agg(F.count("*").alias("n"), F.round(F.sum("z"), 5).alias("z"))


@query(f"WITH {CELLS} SELECT tile_id, j, round((z - lead(z) OVER (PARTITION BY tile_id ORDER BY j)) / 10, 6) AS slope FROM cells WHERE i = 31")
def centreline_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.centreline_slope(grids.matrix_cells(spark, sf_dir), DX).select("tile_id", "j", *rounded(6, "slope"))


@query(f"""WITH {CELLS}, {NEAR}, line AS (SELECT tile_id, (z_e - 2 * z + z_w) / 100 + (z_s - 2 * z + z_n) / 100 AS lap FROM near4 JOIN box USING (tile_id) WHERE i = 31 AND j >= floor(0.2 * (nj + 1)) AND j < ceil(0.8 * (nj + 1)))
SELECT tile_id, round(median((10.0 + 1000.0 * lap) / 10.0), 6) AS ks_norm, count(lap) AS n FROM line GROUP BY tile_id""")
def centreline_steepness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.local_steepness(grids.matrix_cells(spark, sf_dir), 1e-4, 1e-5, 1e-2, DX, 0.2).select("tile_id", *rounded(6, "ks_norm"), "n")


@query(f"""WITH {CELLS}, v AS (SELECT tile_id, j, i FROM cells WHERE z > -1), side(dj, di) AS (VALUES (0, -1), (0, 1), (-1, 0), (1, 0))
SELECT v.tile_id, v.j, v.i, w.j AS nj, w.i AS ni, CAST(0.01 AS DOUBLE) AS coefficient FROM v, side JOIN v w ON w.tile_id = v.tile_id AND w.j = v.j + dj AND w.i = v.i + di
UNION ALL SELECT tile_id, j, i, j, i, CAST(-0.04 AS DOUBLE) FROM v""")
def diffusion_stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grids.matrix_cells(spark, sf_dir).withColumn("area", F.when(F.col("z") > -1, 1.0))
    return stencil.diffusion_stencil(cells, DX).select("tile_id", "j", "i", "nj", "ni", *rounded(6, "coefficient"))


@query(f"WITH {CELLS}, {NEAR} SELECT tile_id, j, i, CASE WHEN i = 0 THEN 1 ELSE i - 1 END AS west, CASE WHEN i = ni THEN ni - 1 ELSE i + 1 END AS east, CASE WHEN j = 0 THEN 1 ELSE j - 1 END AS north, CASE WHEN j = nj THEN nj - 1 ELSE j + 1 END AS south FROM cells JOIN box USING (tile_id)")
def reflecting_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grids.matrix_cells(spark, sf_dir)
    box = cells.groupBy("tile_id").agg((F.max("j") + 1).alias("ny"), (F.max("i") + 1).alias("nx"))
    at = lambda axis, step, n: stencil.reflect(F.col(axis) + step, F.col(n))
    return cells.join(box, "tile_id").select("tile_id", "j", "i", at("i", -1, "nx").alias("west"), at("i", 1, "nx").alias("east"), at("j", -1, "ny").alias("north"), at("j", 1, "ny").alias("south"))


@query(f"WITH {CELLS} SELECT tile_id, round(avg((z - (1000 - 5.0 * j + 0.1 * z)) ** 2), 4) AS mse, count(*) AS n, round(max(abs(z - (1000 - 5.0 * j + 0.1 * z))), 6) AS moved FROM cells GROUP BY tile_id")
def model_misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough, tilted = grids.matrix_cells(spark, sf_dir), grids.tilted_cells(spark, sf_dir)
    moved = tilted.join(rough.withColumnRenamed("z", "z0"), ["tile_id", "j", "i"]).groupBy("tile_id").agg(F.max(F.abs(F.col("z") - F.col("z0"))).alias("moved"))
    return models.misfit(tilted, rough, ["tile_id"]).join(moved, "tile_id").select("tile_id", *rounded(4, "mse"), "n", *rounded(6, "moved"))


HOLED = "holed AS (SELECT tile_id, j, i, CASE WHEN abs(z) < 1.5 THEN z END AS z FROM cells)"


@query(f"""WITH {CELLS}, {HOLED}, {NEAR}, size AS (SELECT tile_id, nj + 1 AS ny, ni + 1 AS nx, greatest(CAST(round_even((nj + 1) * 0.5, 0) AS INTEGER), 1) AS my, greatest(CAST(round_even((ni + 1) * 0.5, 0) AS INTEGER), 1) AS mx FROM box),
place AS (SELECT tile_id, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, ny, nx, CASE WHEN my > 1 THEN CAST(j AS DOUBLE) * (ny - 1) / (my - 1) ELSE 0 END AS y, CASE WHEN mx > 1 THEN CAST(i AS DOUBLE) * (nx - 1) / (mx - 1) ELSE 0 END AS x
  FROM (SELECT *, unnest(range(0, mx)) AS i FROM (SELECT *, unnest(range(0, my)) AS j FROM size))),
corner AS (SELECT *, CAST(least(floor(y), greatest(ny - 2, 0)) AS INTEGER) AS y0, CAST(least(floor(x), greatest(nx - 2, 0)) AS INTEGER) AS x0 FROM place),
wide AS (SELECT tile_id, j, i, y0 + a AS cj, x0 + b AS ci, (CASE WHEN a = 1 THEN y - y0 ELSE 1 - (y - y0) END) * (CASE WHEN b = 1 THEN x - x0 ELSE 1 - (x - x0) END) AS w FROM corner, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b)),
summed AS (SELECT wide.tile_id, wide.j, wide.i, coalesce(sum(w) FILTER (z IS NOT NULL), 0) AS weight, sum(w * z) AS total FROM wide JOIN holed h ON h.tile_id = wide.tile_id AND h.j = cj AND h.i = ci GROUP BY ALL)
SELECT tile_id, j, i, CASE WHEN weight >= 0.5 THEN round(total / weight, 6) END AS z FROM summed""")
def zoom_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = grids.matrix_cells(spark, sf_dir).withColumn("z", F.when(F.abs("z") < 1.5, F.col("z")))
    return resample.resample(holed, DX, 2 * DX).select("tile_id", "j", "i", *rounded(6, "z"))


@query("""WITH g AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN [0.0, CAST(s_suppkey AS DOUBLE), 0.0, 100.0, 0.0, -CAST(s_suppkey AS DOUBLE)] END AS gt, CASE WHEN s_suppkey % 3 < 2 THEN CAST(s_nationkey AS DOUBLE) END AS dx FROM supplier)
SELECT id, x AS dx, coalesce(CASE WHEN abs(gt[6]) > 0 THEN abs(gt[6]) END, x) AS dy FROM (SELECT *, coalesce(CASE WHEN gt[2] > 0 THEN gt[2] END, CASE WHEN dx > 0 THEN dx END) AS x FROM g)""")
def georeference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_nationkey").cast("double").alias("n"))
    kind = F.col("id") % 3
    gt = F.when(kind == 0, F.array(F.lit(0.0), F.col("x"), F.lit(0.0), F.lit(100.0), F.lit(0.0), -F.col("x")))
    x, y = grids.spacing(gt, F.when(kind < 2, F.col("n")))
    return s.select("id", x.alias("dx"), y.alias("dy"))


# ---- planforms and Peclet numbers, scenarios from supplier and part


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planform scenario for each supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(
        F.concat(F.lit("s"), key.cast("string")).alias("scenario"),
        F.lit(1e-4).alias("u"), (F.lit(1e-5) * (1.0 + nation / 25.0)).alias("k"), F.lit(0.4).alias("m"), F.lit(1e-2).alias("d"),
        (F.lit(11) + 2 * (key % 3)).cast("int").alias("nx"), (F.lit(15) + key % 5).cast("int").alias("ny"),
        F.lit(10.0).alias("dx"), F.lit(10.0).alias("dy"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("a_top"),
    )


@query("""WITH s AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS scenario, 11 + 2 * (s_suppkey % 3) AS nx, 15 + s_suppkey % 5 AS ny, greatest(s_acctbal, 0) AS a_top FROM supplier),
g AS (SELECT *, (nx - 1) // 2 AS ci FROM (SELECT *, unnest(range(0, ny)) AS j FROM s)), c AS (SELECT *, unnest(range(0, nx)) AS i FROM g)
SELECT scenario, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, round(CASE WHEN i < ci THEN (i + 1) * 100.0 WHEN i > ci THEN (nx - i) * 100.0 ELSE a_top + (j + 1) * 2 * ci * 100.0 END, 4) AS area,
  i = ci AND j = ny - 1 AS is_outlet, CAST(CASE WHEN i = ci AND j < ny - 1 THEN j + 1 ELSE j END AS INTEGER) AS dn_j, CAST(CASE WHEN i < ci THEN i + 1 WHEN i > ci THEN i - 1 ELSE i END AS INTEGER) AS dn_i FROM c""")
def planform_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planform.planform(scenarios(spark, sf_dir)).select("scenario", "j", "i", *rounded(4, "area"), "is_outlet", "dn_j", "dn_i")


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS pe, 1e-5 AS k, p_retailprice AS length, 5000.0 + p_size AS area, 0.4 AS m FROM part), d AS (SELECT *, k * length * pow(area, m) / pe AS d FROM p)
SELECT id, round(d, 8) AS d, round(k * length * pow(area, m) / d, 6) AS pe_back, round(pow(pe * d / (k * length), 1 / m), 4) AS area_back, CAST(round(greatest(area - 2.0 * pe * 10.0 * 10.0, 0), 6) AS DOUBLE) AS a_top FROM d""")
def peclet(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("pe"), F.lit(1e-5).alias("k"), F.col("p_retailprice").alias("length"), (5000.0 + F.col("p_size")).alias("area"), F.lit(0.4).alias("m"))
    top = p.select("id", planform.a_top_for_inlet(F.col("area"), F.col("pe"), F.lit(10.0), F.lit(10.0)).alias("a_top"))
    return studies.pe_table(p).join(top, "id").select("id", *rounded(8, "d"), *rounded(6, "pe_back"), *rounded(4, "area_back"), *rounded(6, "a_top"))


@query("""WITH s AS (SELECT p_partkey AS id, p_retailprice AS length FROM part), t AS (SELECT *, pow(10, log10(5.0) + k * (log10(100.0) - log10(5.0)) / 24) AS dx FROM s, range(0, 25) r(k))
SELECT id, CAST(k AS INTEGER) AS dx_id, round(dx, 6) AS dx, CAST(round_even(length / dx, 0) AS INTEGER) + 1 AS ny, CAST(round_even(length / dx, 0) AS INTEGER) + 1 + CASE WHEN CAST(round_even(length / dx, 0) AS INTEGER) % 2 = 1 THEN 1 ELSE 0 END AS nx FROM t""")
def grid_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("length"))
    steps = p.select("id", "length", F.posexplode(planform.log_steps(5.0, 100.0, 25)).alias("dx_id", "dx"))
    return steps.select("id", "dx_id", *rounded(6, "dx"), planform.grid_size(F.col("length"), F.col("dx")).alias("ny"), planform.grid_size(F.col("length"), F.col("dx"), odd=True).alias("nx"))


# ---- routing on the rough surface


def rough_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.flow(grids.matrix_cells(spark, sf_dir), DX)


FLOWING = f"WITH RECURSIVE {CELLS}, {NEAR}, {NEAR8}, {FLOW}"


@query(f"WITH {CELLS}, {NEAR}, {NEAR8}, {FLOW.split('step(fd')[0].rstrip().rstrip(',')} SELECT tile_id, j, i, fd FROM d8")
def d8_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.d8_direction(grids.matrix_cells(spark, sf_dir), DX).select("tile_id", "j", "i", "fd")


@query(f"WITH {CELLS}, {NEAR}, {NEAR8}, {FLOW.split('walk AS')[0].rstrip().rstrip(',')} SELECT d8.tile_id, d8.j, d8.i, dn_j, dn_i, round(steps, 6) AS steps, coalesce(n_up, 0) AS n_up FROM d8 LEFT JOIN links l ON l.tile_id = d8.tile_id AND l.j = d8.j AND l.i = d8.i LEFT JOIN (SELECT tile_id, dn_j AS j, dn_i AS i, count(*) AS n_up FROM links GROUP BY ALL) u ON u.tile_id = d8.tile_id AND u.j = d8.j AND u.i = d8.i")
def d8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = routing.downstream(routing.d8_direction(grids.matrix_cells(spark, sf_dir), DX))
    return edges.join(routing.upstream_counts(edges), ["tile_id", "j", "i"], "left").select("tile_id", "j", "i", "dn_j", "dn_i", *rounded(6, "steps"), F.coalesce("n_up", F.lit(0)).alias("n_up"))


@query(f"{FLOWING} SELECT tile_id, j, i, area, round(log10(area), 6) AS logarea FROM area")
def d8_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rough_flow(spark, sf_dir).select("tile_id", "j", "i", "area", F.round(F.log10("area"), 6).alias("logarea"))


@query(f"""{FLOWING}, o AS (SELECT tile_id, arg_max(j, (area, -j, -i)) AS out_j, arg_max(i, (area, -j, -i)) AS out_i, max(area) AS out_area FROM flow GROUP BY tile_id)
SELECT tile_id, out_j, out_i, out_area, CASE WHEN out_j IN (0, nj) OR out_i IN (0, ni) THEN out_j ELSE 0 END AS edge_j, out_i AS edge_i FROM o JOIN box USING (tile_id)""")
def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stage(rough_flow(spark, sf_dir), "rough")
    edge = routing.perimeter_outlet(cells).select("tile_id", F.col("out_j").alias("edge_j"), F.col("out_i").alias("edge_i"))
    return routing.outlet(cells).join(edge, "tile_id")


@query(f"""{FLOWING}, o AS (SELECT tile_id, arg_max(j, (area, -j, -i)) AS oj, arg_max(i, (area, -j, -i)) AS oi FROM flow GROUP BY tile_id),
m AS (SELECT flow.*, j IN (0, nj) OR i IN (0, ni) AS is_boundary, area >= 500 OR (j = oj AND i = oi) AS is_channel FROM flow JOIN o USING (tile_id))
SELECT tile_id, j, i, is_boundary, is_channel, NOT is_boundary AND NOT is_channel AS is_hillslope, round(1e-4 / 1e-5 / pow(area, 0.5), 6) AS s0 FROM m""")
def channel_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = routing.masks(stage(rough_flow(spark, sf_dir), "rough"), 500.0)
    return marked.select("tile_id", "j", "i", "is_boundary", "is_channel", "is_hillslope", *to(6, s0=stencil.steady_slope(1e-4, 1e-5, F.col("area"), 0.5)))


@query(f"""WITH {CELLS}, {NEAR}, h AS (SELECT cells.tile_id, j, i, nj, ni, CASE WHEN abs(z) < 1.5 THEN z END AS z FROM cells JOIN box USING (tile_id)),
e AS (SELECT tile_id, j, i, z, max(z) FILTER (i = 0) OVER r AS l, max(z) FILTER (i = ni) OVER r AS g, max(z) FILTER (j = 0) OVER c AS t, max(z) FILTER (j = nj) OVER c AS b, j IN (0, nj) OR i IN (0, ni) AS edge FROM h
  WINDOW r AS (PARTITION BY tile_id, j), c AS (PARTITION BY tile_id, i))
SELECT tile_id, j, i, round(coalesce(z, l, g, t, b), 6) AS z_bc FROM e WHERE edge""")
def boundary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grids.matrix_cells(spark, sf_dir).withColumn("area", F.lit(1.0)).withColumn("z", F.when(F.abs("z") < 1.5, F.col("z")))
    return routing.boundary_values(cells).where("is_boundary").select("tile_id", "j", "i", *rounded(6, "z_bc"))


@query(f"""{FLOWING}, path AS (SELECT tile_id, j AS sj, i AS si, j, i, CAST(0 AS DOUBLE) AS acc FROM flow UNION ALL
  SELECT p.tile_id, p.sj, p.si, l.dn_j, l.dn_i, p.acc + l.steps * 10.0 / pow(f.area, 0.5) FROM path p JOIN flow f ON f.tile_id = p.tile_id AND f.j = p.j AND f.i = p.i JOIN links l ON l.tile_id = p.tile_id AND l.j = p.j AND l.i = p.i
  WHERE NOT (p.j IN (0, nj) OR p.i IN (0, ni))),
ends AS (SELECT p.tile_id, sj AS j, si AS i, f.z + 10.0 * acc AS z FROM path p JOIN flow f ON f.tile_id = p.tile_id AND f.j = p.j AND f.i = p.i WHERE p.j IN (0, nj) OR p.i IN (0, ni))
SELECT flow.tile_id, flow.j, flow.i, round(ends.z, 6) AS z_channel FROM flow LEFT JOIN ends ON ends.tile_id = flow.tile_id AND ends.j = flow.j AND ends.i = flow.i""")
def channel_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.channel_elevation(stage(rough_flow(spark, sf_dir), "rough"), DX, 1e-4, 1e-5, 0.5).select("tile_id", "j", "i", *rounded(6, "z_channel"))


def _facet_sql() -> str:
    names = routing.SIDES
    parts = []
    for n, (a, b, base) in enumerate(routing.FACETS):
        r = f"least(greatest(atan2((z_{names[a]} - z_{names[b]}) / 10.0, (z - z_{names[a]}) / 10.0), 0.0), pi() / 4)"
        parts.append(f"SELECT tile_id, j, i, {n} AS facet, {base} AS base, {r} AS r, (z - z_{names[a]}) / 10.0 * cos({r}) + (z_{names[a]} - z_{names[b]}) / 10.0 * sin({r}) AS slope FROM near8 WHERE z_{names[a]} IS NOT NULL AND z_{names[b]} IS NOT NULL")
    return "facets AS (" + " UNION ALL ".join(parts) + "), dinf AS MATERIALIZED (SELECT tile_id, j, i, arg_max(facet, (slope, -facet)) AS facet, arg_max(r, (slope, -facet)) AS r, arg_max(base, (slope, -facet)) AS base FROM facets WHERE slope > 0 GROUP BY tile_id, j, i)"


@query(f"WITH {CELLS}, {NEAR}, {NEAR8}, {_facet_sql()} SELECT cells.tile_id, cells.j, cells.i, facet, round(r, 6) AS r, round(base * pi() / 4 + r, 6) AS angle_ref, round(CASE WHEN facet % 2 = 1 THEN (facet + 1) * pi() / 4 - r ELSE facet * pi() / 4 + r END, 6) AS angle FROM cells LEFT JOIN dinf ON dinf.tile_id = cells.tile_id AND dinf.j = cells.j AND dinf.i = cells.i")
def dinf_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.dinf_direction(grids.matrix_cells(spark, sf_dir), DX).select("tile_id", "j", "i", "facet", *rounded(6, "r", "angle_ref", "angle"))


def _receiver_sql() -> str:
    rows = ", ".join(f"({n}, {routing.STEP[f[w]][1]}, {routing.STEP[f[w]][0]}, {w})" for n, f in enumerate(routing.FACETS) for w in (0, 1))
    return f"hand(facet, dj, di, w) AS (VALUES {rows})"


@query(f"WITH {CELLS}, {NEAR}, {NEAR8}, {_facet_sql()}, {_receiver_sql()} SELECT tile_id, j, i, j + dj AS rcv_j, i + di AS rcv_i, round(CASE WHEN w = 0 THEN (pi() / 4 - r) / (pi() / 4) ELSE r / (pi() / 4) END, 6) AS weight, CASE WHEN w = 0 THEN 'cardinal' ELSE 'diagonal' END AS kind FROM dinf JOIN hand USING (facet)")
def dinf_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.dinf_receivers(routing.dinf_direction(grids.matrix_cells(spark, sf_dir), DX)).select("tile_id", "j", "i", "rcv_j", "rcv_i", *rounded(6, "weight"), "kind")


@query(f"""WITH RECURSIVE {CELLS}, {NEAR}, {NEAR8}, {_facet_sql()}, {_receiver_sql()},
edge AS MATERIALIZED (SELECT d.tile_id, d.j, d.i, d.j + dj AS rj, d.i + di AS ri, CASE WHEN w = 0 THEN (pi() / 4 - d.r) / (pi() / 4) ELSE d.r / (pi() / 4) END AS share FROM dinf d JOIN hand USING (facet) JOIN dinf t ON t.tile_id = d.tile_id AND t.j = d.j + dj AND t.i = d.i + di),
spread AS (SELECT tile_id, j, i, CAST(100 AS DOUBLE) AS a FROM dinf UNION ALL SELECT s.tile_id, e.rj, e.ri, sum(s.a * e.share) FROM spread s JOIN edge e ON e.tile_id = s.tile_id AND e.j = s.j AND e.i = s.i WHERE e.share > 0 GROUP BY s.tile_id, e.rj, e.ri)
SELECT tile_id, j, i, round(sum(a), 4) AS area_dinf FROM spread GROUP BY tile_id, j, i""")
def dinf_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = routing.dinf_area(routing.dinf_direction(grids.matrix_cells(spark, sf_dir), DX), DX)
    return spread.where("area_dinf IS NOT NULL").select("tile_id", "j", "i", *rounded(4, "area_dinf"))


# ---- models: what is checked is stated as counts (check, n, n_bad)


def checks(df: DataFrame, **conditions: tuple[Column, Column]) -> DataFrame:
    """(check, n, n_bad): how many rows a check looks at, and how many fail it (NULL fails)."""
    row = df.agg(*(x for name, (where, good) in conditions.items() for x in (F.count_if(where).alias(f"{name}_n"), F.count_if(where & ~F.coalesce(good, F.lit(False))).alias(f"{name}_bad"))))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_bad").alias("n_bad")) for n in conditions))))


TILE_SIZES = f"sizes AS (SELECT vec_id // {grids.TILE_ROWS} AS t, count(*) AS ny, max(len(embedding)) AS nx FROM embeddings GROUP BY 1), total AS (SELECT CAST(sum(ny * nx) AS BIGINT) AS cells, CAST(sum(2 * nx + 2 * ny - 4) AS BIGINT) AS edge, count(*) AS tiles FROM sizes)"


def model_sql(runs: int) -> str:
    return f"WITH {TILE_SIZES} SELECT 'solved' AS \"check\", {runs} * (cells - edge) AS n, CAST(0 AS BIGINT) AS n_bad FROM total UNION ALL SELECT 'boundary', {runs} * edge, 0 FROM total"


def run_scenarios(spark: SparkSession, model: str) -> DataFrame:
    rows = [(f"{model}{n}", model, 0.45, 1e-4, k, d, 2000.0, 1.27) for n, (k, d) in enumerate(((1e-5, 1e-2), (5e-6, 2e-2)))]
    return spark.createDataFrame(rows, studies.SCENARIO)


def left_over(solved: DataFrame, cells: DataFrame, scenarios: DataFrame, kind: str) -> DataFrame:
    """What the equation of each cell leaves, from the neighbourhood and routing operators, not from the
    system that was solved: solved cells with ``rest`` (U + D lap z - K A^m S of free cells, the distance from
    its path's elevation of a channel cell) and is_boundary, as_observed, ok."""
    runs = scenarios.select("scenario", "model", "m", "u", "k", "d", "s_c")
    way = models.DIRECTION[kind]
    drive = F.col("area") if kind == "d8" else F.col("area_dinf")
    shape = routing.with_boundary(cells).withColumns({c: F.lit(None).cast("double") for c in ("path", "path_unit")})
    if not runs.where("model <> 'ad'").isEmpty():  # only these have channels, whose elevations follow paths; a channel without one fails
        walked = (routing.channel_paths if kind == "d8" else routing.dinf_channel_paths)(cells, DX, 0.45)
        shape = shape.drop("path", "path_unit").join(walked.hint("merge"), ["tile_id", "j", "i"], "left")
    shape = shape.select("tile_id", "j", "i", F.col("z").alias("z_obs"), F.col("area").isNotNull().alias("valid"), drive.alias("drive"), *way, "is_boundary", "path", "path_unit")
    own = solved.join(shape.hint("merge"), ["tile_id", "j", "i"]).join(F.broadcast(runs), "scenario")
    # rows are narrow before windows sort them: what is judged of a cell alone is judged first
    z, slow = F.col("z"), F.col("model") == "ad"
    power = F.when(slow, F.col("k") * F.pow("drive", F.col("m")))
    path = F.when(F.col("is_channel"), z - F.col("path") - F.col("u") / F.col("k") * F.col("path_unit"))
    own = own.select(
        "scenario", F.concat_ws("|", "scenario", "tile_id").alias("tile_id"), "j", "i", F.when(F.col("valid"), F.coalesce(z, F.lit(math.nan))).alias("c"), *way, power.alias("power"),
        "is_boundary", "is_channel", path.alias("rest_path"), (F.abs(z - F.col("z_obs")) < 1e-9).alias("as_observed"), (F.col("status") == "ok").alias("ok"),
    )
    near = stencil.eight_neighbours(own, "c", "c").join(F.broadcast(runs), "scenario")
    z, at = F.col("c"), {code: F.col(f"c_{name}") for code, name in routing.SIDES.items()}
    near = near.withColumns({f"{p}_{n}": F.col(f"c_{n}") for n in "wens" for p in "za"}).withColumn("z", z)
    lap = (F.col("z_e") - 2.0 * z + F.col("z_w")) / (DX * DX) + (F.col("z_s") - 2.0 * z + F.col("z_n")) / (DX * DX)
    if kind == "d8":
        falls = [F.when((F.col("fd") == code) & c.isNotNull(), (z - c) / (DX * math.hypot(*routing.STEP[code]))) for code, c in at.items()]
    else:
        near = near.withColumns({"cos": F.cos("r") / DX, "sin": F.sin("r") / DX})
        cos, sin = F.col("cos"), F.col("sin")
        falls = [F.when((F.col("facet") == n) & c.isNotNull(), w * (z - c)) for n, (a, b, _) in enumerate(routing.FACETS) for c, w in ((at[a], cos - sin), (at[b], sin))]
    every = near.withColumns({"lap": lap, "side_slope": stencil.one_sided(DX), "fall": reduce(lambda x, y: x + y, (F.coalesce(f, F.lit(0.0)) for f in falls))})
    incision = F.when(F.col("model") == "ad", F.col("power") * F.col("fall")).otherwise(0.0)
    d = F.when(F.col("model") == "nonlinear", stencil.effective_diffusivity(F.col("d"), F.col("side_slope"), 1.27)).otherwise(F.col("d"))
    free = F.col("u") + d * F.col("lap") - F.coalesce(incision, F.lit(0.0))
    return every.withColumn("rest", F.when(F.col("is_channel"), F.col("rest_path")).otherwise(free))


def solved_checks(spark: SparkSession, sf_dir: str, model: str, kind: str) -> DataFrame:
    cells = studies.routed(grids.tilted_cells(spark, sf_dir), DX, kind == "dinf")
    runs = run_scenarios(spark, model)
    both = left_over(models.solve_models(cells, runs, DX, kind), cells, runs, kind)
    inner = ~F.col("is_boundary")
    held = F.col("as_observed") | F.col("is_channel") & (F.abs("rest") < 1e-9)
    return checks(both, solved=(inner, (F.abs("rest") < 1e-8) & F.col("ok")), boundary=(F.col("is_boundary"), held))


def _model_query(name: str, model: str, kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return solved_checks(spark, sf_dir, model, kind)

    run.__name__ = name
    query(model_sql(2))(run)


for _name, _model, _kind in (("ad_solve", "ad", "d8"), ("ad_solve_dinf", "ad", "dinf"), ("threshold_solve", "threshold", "d8"), ("threshold_solve_dinf", "threshold", "dinf"), ("nonlinear_solve", "nonlinear", "d8"), ("nonlinear_solve_dinf", "nonlinear", "dinf")):
    _model_query(_name, _model, _kind)


# Surfaces whose steady state is known: the edge of each tile holds it, its inside holds the rough surface.
SHAPES = f"shape AS (SELECT *, CAST(substr(tile_id, 2) AS INTEGER) AS t, max(j) OVER (PARTITION BY tile_id) AS nj, max(i) OVER (PARTITION BY tile_id) AS ni FROM cells)"


def edged(spark: SparkSession, sf_dir: str, known: Callable[[Column, Column, Column, Column, Column], Column]) -> DataFrame:
    """Rough tiles whose edge is known(t, j, i, nj, ni)."""
    cells = grids.matrix_cells(spark, sf_dir)
    box = cells.groupBy("tile_id").agg(F.max("j").alias("nj"), F.max("i").alias("ni"))
    t = F.substr("tile_id", F.lit(2)).cast("int")
    edge = (F.col("j") == 0) | (F.col("j") == F.col("nj")) | (F.col("i") == 0) | (F.col("i") == F.col("ni"))
    z = F.when(edge, known(t, F.col("j"), F.col("i"), F.col("nj"), F.col("ni"))).otherwise(F.col("z"))
    return cells.join(box, "tile_id").withColumn("z", z)


def one_run(spark: SparkSession, model: str, m: float, u: float, k: float, d: float, a_crit: float = 0.0) -> DataFrame:
    return spark.createDataFrame([("known", model, m, u, k, d, a_crit, 1.27)], studies.SCENARIO)


@query(f"WITH {CELLS}, {SHAPES} SELECT tile_id, j, i, round(1000 - (0.02 + 0.001 * (t % 5)) * 10 * j + (1e-4 * (0.02 + 0.001 * (t % 5)) - 1e-6) / 0.02 * (10 * i) ** 2, 5) AS z, 'ok' AS status FROM shape")
def ad_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U + D lap z = K S is met by a plane to the south bent along its rows."""
    s = lambda t: 0.02 + 0.001 * (t % 5)
    cells = edged(spark, sf_dir, lambda t, j, i, nj, ni: 1000.0 - s(t) * 10.0 * j + (1e-4 * s(t) - 1e-6) / 0.02 * F.pow(10.0 * i, F.lit(2.0)))
    flowing = cells.withColumn("area", F.lit(1.0)).withColumn("fd", F.lit(4)).drop("nj", "ni")
    return models.solve_models(flowing, one_run(spark, "ad", 0.0, 1e-6, 1e-4, 1e-2), DX).select("tile_id", "j", "i", *rounded(5, "z"), "status")


@query(f"WITH {CELLS}, {SHAPES} SELECT tile_id, j, i, round(1000 - (0.01 + 0.001 * (t % 5)) * 10 * j - (0.02 - cos(0.3) * (0.01 + 0.001 * (t % 5))) / sin(0.3) * 10 * i, 5) AS z, 'ok' AS status FROM shape")
def ad_closed_form_dinf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane whose fall along an angle of 0.3 from south to east is U / K."""
    s = lambda t: 0.01 + 0.001 * (t % 5)
    cells = edged(spark, sf_dir, lambda t, j, i, nj, ni: 1000.0 - s(t) * 10.0 * j - (0.02 - F.cos(F.lit(0.3)) * s(t)) / F.sin(F.lit(0.3)) * 10.0 * i)
    flowing = cells.withColumn("area", F.lit(1.0)).withColumn("area_dinf", F.lit(1.0)).withColumn("facet", F.lit(6)).withColumn("r", F.lit(0.3)).drop("nj", "ni")
    return models.solve_models(flowing, one_run(spark, "ad", 0.0, 2e-6, 1e-4, 1e-2), DX, "dinf").select("tile_id", "j", "i", *rounded(5, "z"), "status")


@query(f"WITH {CELLS}, {SHAPES} SELECT tile_id, j, i, round(1000 + t + 10.0 / sqrt(5000.0) * 10 * (nj - j) - 0.005 * (10 * (i - ni // 2)) ** 2, 5) AS z, i = ni // 2 AND j BETWEEN 0 AND nj AS is_channel, 'ok' AS status FROM shape")
def threshold_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel down the middle column between slopes that bend by U / D."""
    middle = lambda ni: F.floor(ni / 2)
    cells = edged(spark, sf_dir, lambda t, j, i, nj, ni: 1000.0 + t + 10.0 / math.sqrt(5000.0) * 10.0 * (nj - j) - 0.005 * F.pow(10.0 * (i - middle(ni)), F.lit(2.0)))
    flowing = cells.withColumn("area", F.when(F.col("i") == middle(F.col("ni")), 5000.0).otherwise(1.0)).withColumn("fd", F.lit(4)).drop("nj", "ni")
    return models.solve_models(flowing, one_run(spark, "threshold", 0.5, 1e-4, 1e-5, 1e-2, 2000.0), DX).select("tile_id", "j", "i", *rounded(5, "z"), "is_channel", "status")


PLANFORM_SQL = "WITH s AS (SELECT 11 + 2 * (s_suppkey % 3) AS nx, 15 + s_suppkey % 5 AS ny FROM supplier) SELECT 'solved' AS \"check\", CAST(sum(nx * ny - 1) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_bad FROM s UNION ALL SELECT 'outlet', count(*), 0 FROM s"


def planform_checks(spark: SparkSession, sf_dir: str, no_flux: bool) -> DataFrame:
    """Each cell's equation anew, with neighbours found by windows: mirrored beyond an edge, or zero there and
    edge cells repeating the cell next to them."""
    s = scenarios(spark, sf_dir)
    solved = stage(models.planform_solutions(s, no_flux).select("scenario", "j", "i", "z", "status"), "planform")
    # an exploded table's size is not known to the planner: without the hint it would broadcast all cells
    cells = planform.planform(s).join(solved.hint("merge"), ["scenario", "j", "i"])
    cells = stencil.four_neighbours(cells.withColumn("tile_id", F.col("scenario")))
    down = F.when(F.col("dn_i") > F.col("i"), F.col("z_e")).when(F.col("dn_i") < F.col("i"), F.col("z_w")).when(F.col("dn_j") > F.col("j"), F.col("z_s")).otherwise(F.col("z"))
    cells = cells.withColumn("z_down", down)
    beyond = {"w": ("e", F.col("i") == 0), "e": ("w", F.col("i") == F.col("nx") - 1), "n": ("s", F.col("j") == 0), "s": ("n", F.col("j") == F.col("ny") - 1)}
    sides = {f"z_{name}": F.when(edge, F.lit(0.0) if no_flux else F.col(f"z_{other}")).otherwise(F.col(f"z_{name}")) for name, (other, edge) in beyond.items()}
    cells = cells.withColumns(sides)
    z, ci = F.col("z"), (F.col("nx") - 1) / 2
    lap = (F.col("z_e") - 2 * z + F.col("z_w")) / F.pow("dx", F.lit(2.0)) + (F.col("z_s") - 2 * z + F.col("z_n")) / F.pow("dy", F.lit(2.0))
    length = F.when(F.col("dn_j") != F.col("j"), F.col("dy")).otherwise(F.col("dx"))
    rest = F.col("u") + F.col("d") * lap - F.col("k") * F.pow("area", "m") * (z - F.col("z_down")) / length
    if no_flux:
        copied = F.when((F.col("i") == 0) & (F.col("j") > 0), z - F.col("z_e")).when((F.col("i") == F.col("nx") - 1) & (F.col("j") > 0), z - F.col("z_w")).when((F.col("j") == 0) & (F.col("i") != ci), z - F.col("z_s"))
        rest = F.coalesce(copied, rest)
    outlet = F.col("is_outlet")
    return checks(cells, solved=(~outlet, (F.abs(rest) < 1e-9) & (z > -1e-9) & (F.col("status") == "ok")), outlet=(outlet, F.abs(z) < 1e-9))


@query(PLANFORM_SQL)
def planform_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planform_checks(spark, sf_dir, False)


@query(PLANFORM_SQL)
def planform_solve_noflux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planform_checks(spark, sf_dir, True)


DRAINED = "'edge' AS \"check\", edge AS n, CAST(0 AS BIGINT) AS n_bad FROM total UNION ALL SELECT 'inside', cells - edge, 0 FROM total UNION ALL SELECT 'directed', cells - edge, 0 FROM total"


def drained(spark: SparkSession, sf_dir: str, block: int) -> DataFrame:
    """Cells of the rough surface, filled over blocks of ``block`` cells, with direction and area."""
    filled = stage(drainage.fill_pits(grids.matrix_cells(spark, sf_dir), block), "filled")
    flowing = drainage.filled_flow(filled.select("tile_id", "j", "i", F.col("filled").alias("z")), DX, block)
    return filled.join(flowing.select("tile_id", "j", "i", "fd", "area").hint("merge"), ["tile_id", "j", "i"])


@query(f"WITH {TILE_SIZES} SELECT {DRAINED}")
def fill_pits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges stay; inside, each cell is as high as itself or its lowest neighbour, and is led on. With no cycles and
    all area led out (see filled_drainage) only the lowest surface that drains fits."""
    near = stencil.eight_neighbours(stage(drained(spark, sf_dir, stencil.BLOCK), "drained"), "filled", "f")
    lowest = F.least(*(F.col(f"f_{s}") for s in routing.SIDES.values()))
    inner = F.col("f_n").isNotNull() & F.col("f_s").isNotNull() & F.col("f_w").isNotNull() & F.col("f_e").isNotNull()
    return checks(near, edge=(~inner, F.col("filled") == F.col("z")), inside=(inner, F.col("filled") == F.greatest(F.col("z"), lowest)), directed=(inner, F.col("fd").isNotNull()))


@query(f"WITH {CELLS}, box AS (SELECT tile_id, max(j) AS nj, max(i) AS ni FROM cells GROUP BY tile_id) SELECT tile_id, CAST(100 * (nj + 1) * (ni + 1) AS DOUBLE) AS left_by, CAST((nj - 1) * (ni - 1) AS BIGINT) AS n_inside, CAST(0 AS BIGINT) AS n_stuck FROM box")
def filled_drainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a tile's area leaves it over cells of its edge, and every cell inside has a direction."""
    cells = stage(drained(spark, sf_dir, 32), "drained")
    box = cells.groupBy("tile_id").agg(F.max("j").alias("nj"), F.max("i").alias("ni"))
    stuck, inside = F.col("fd").isNull(), (F.col("j") > 0) & (F.col("j") < F.col("nj")) & (F.col("i") > 0) & (F.col("i") < F.col("ni"))
    return cells.join(box, "tile_id").groupBy("tile_id").agg(F.round(F.sum(F.when(stuck, F.col("area"))), 4).alias("left_by"), F.count_if(inside).alias("n_inside"), F.count_if(inside & stuck).alias("n_stuck"))


@query()
def dinf_channel_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = studies.routed(grids.tilted_cells(spark, sf_dir), DX, True)
    paths = routing.dinf_channel_paths(cells, DX, 0.45)
    return paths.select("tile_id", "j", "i", *to(6, z_channel=F.col("path") + 10.0 * F.col("path_unit")))


TILTED = CELLS.replace("CAST(unnest(embedding) AS DOUBLE) AS z FROM embeddings)", "unnest(embedding) AS v FROM embeddings)").replace("cells AS", "raw AS") + ",\ncells AS MATERIALIZED (SELECT tile_id, j, i, 1000.0 - 5.0 * j + 0.1 * CAST(v AS DOUBLE) AS z FROM raw)"
TILTED_FLOW = f"WITH RECURSIVE {TILTED}, {NEAR}, {NEAR8}, {FLOW}"


def drop_sql(name: str, surface: str, interval: float, least: float) -> str:
    """(tile_id, j, i, a, s): the slope of each channel cell of ``surface`` (tile_id, j, i, z) along links, until the fall reaches the interval."""
    return f"""{name}_walk AS (SELECT f.tile_id, f.j AS sj, f.i AS si, v.z AS z0, f.j, f.i, v.z AS z, CAST(0 AS DOUBLE) AS run FROM flow f JOIN {surface} v USING (tile_id, j, i) WHERE f.area >= {least}
  UNION ALL SELECT w.tile_id, w.sj, w.si, w.z0, l.dn_j, l.dn_i, v.z, w.run + 10.0 * l.steps FROM {name}_walk w JOIN links l ON l.tile_id = w.tile_id AND l.j = w.j AND l.i = w.i JOIN {surface} v ON v.tile_id = w.tile_id AND v.j = l.dn_j AND v.i = l.dn_i WHERE w.z0 - w.z < {interval}),
{name} AS MATERIALIZED (SELECT w.tile_id, sj AS j, si AS i, arg_max(w.z0 - w.z, run) / max(run) AS s, any_value(f.area) AS a FROM {name}_walk w JOIN flow f ON f.tile_id = w.tile_id AND f.j = sj AND f.i = si WHERE run > 0 GROUP BY w.tile_id, sj, si)"""


@query(f"{TILTED_FLOW}, {drop_sql('falls_of', 'cells', 10.0, 500.0)} SELECT tile_id, j, i, a AS area, round(s, 8) AS slope FROM falls_of")
def channel_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = studies.routed(grids.tilted_cells(spark, sf_dir), DX)
    return routing.channel_slope_by_drop(cells, DX, 10.0, 500.0).select("tile_id", "j", "i", "area", *rounded(8, "slope"))


BASE = {"m": 0.45, "u": 1e-4, "k": 1e-5, "d": 1e-2, "a_crit": 2000.0, "s_c": 1.27}
KNOWN = {"k": 10**-4.7, "d": 10**-1.5, "a_crit": 2000.0}
"""What the surfaces to fit are made of. Some 18,600 cells inside the tiles drain 2,000 or more; none drains 5,000."""


def recovered_sql(*names: str) -> str:
    logs = {"k": "CAST(-4.7 AS DOUBLE) AS log_k", "d": "CAST(-1.5 AS DOUBLE) AS log_d"}
    return f"WITH {TILE_SIZES} SELECT 't' || CAST(t AS VARCHAR) AS tile_id, 'ok' AS status, true AS found" + "".join(f", {logs[n]}" for n in names) + " FROM sizes"


def recovered(spark: SparkSession, sf_dir: str, what: str, bounds: dict) -> DataFrame:
    """Fits what the model makes of known parameters: a row a tile, with the parameters that a surface pins
    down (the threshold area is one of many that give the same channels)."""
    cells = studies.routed(grids.tilted_cells(spark, sf_dir), DX)
    p = BASE | {n: KNOWN[n] for n in bounds}
    run = one_run(spark, what, p["m"], p["u"], p["k"], p["d"], p["a_crit"])
    made = models.solve_models(cells, run, DX).select("tile_id", "j", "i", "z")
    fitted = models.calibrate(made.join(cells.drop("z").hint("merge"), ["tile_id", "j", "i"]), what, BASE, bounds, DX)
    found = (F.col("mse") <= 1e-6 * F.col("mse_start")).alias("found")
    if "a_crit" in bounds:  # the channels themselves: there are some inside, and they are the planted ones
        fitted = stage(fitted, "fitted")
        over = [F.coalesce(F.col("area") >= c, F.lit(False)) for c in (F.col("a_crit"), F.lit(p["a_crit"]))]
        inside = routing.with_boundary(cells).where("NOT is_boundary").join(fitted.select("tile_id", "a_crit"), "tile_id")
        masks = inside.groupBy("tile_id").agg(F.count_if(over[1]).alias("n"), F.count_if(over[0] != over[1]).alias("n_wrong"))
        fitted, found = fitted.join(masks, "tile_id"), (found & (F.col("n") > 0) & (F.col("n_wrong") == 0)).alias("found")
    return fitted.select("tile_id", "status", found, *(F.round(F.log10(n), 2).alias(f"log_{n}") for n in bounds if n != "a_crit"))


@query(recovered_sql("k", "d"))
def calibrate_ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovered(spark, sf_dir, "ad", {"k": (1e-7, 1e-3), "d": (1e-4, 1e1)})


@query(recovered_sql())
def calibrate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovered(spark, sf_dir, "threshold", {"a_crit": (1e2, 1e5)})


@query(recovered_sql())
def calibrate_nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovered(spark, sf_dir, "nonlinear", {"a_crit": (1e2, 1e5)})


@query(recovered_sql("d", "k"))
def calibrate_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovered(spark, sf_dir, "threshold", {"a_crit": (1e2, 1e5), "d": (1e-4, 1e1), "k": (1e-7, 1e-3)})


# ---- studies


def tile_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile under the parameters of one of the study's tiles, in turn."""
    tiles = grids.matrix_cells(spark, sf_dir).select("tile_id").distinct().withColumn("n", F.substr("tile_id", F.lit(2)).cast("int") % len(grids.PARAMS))
    table = spark.createDataFrame([(n, p[0], p[1], p[2], p[6], p[7], p[3]) for n, p in enumerate(grids.PARAMS)], "n int, location string, tile int, u double, k double, d double, theta double")
    return tiles.join(table, "n").drop("n")


SPACINGS = [DX * 1.5 * (16 / 3) ** (k / 24) for k in range(25)]
"""25 spacings between 1.5 and 8 cells, log-spaced."""
LEAST_AREA = 4 * 900.0


@query()
def resolution_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile at every spacing, observed and modelled under both routings."""
    return studies.resolution_study(grids.tilted_cells(spark, sf_dir), stage(tile_params(spark, sf_dir), "params"), DX, SPACINGS, min_area=LEAST_AREA, routings=("d8", "dinf"))


COARSE = f"""WITH RECURSIVE {TILTED.replace(chr(10) + 'cells AS', chr(10) + 'fine AS')},
runs AS (SELECT tile_id AS base, tile_id || '@' || k AS tile_id, k AS dx_id, dx, ny, nx, CAST(round_even(ny * (10.0 / dx), 0) AS INTEGER) AS my, CAST(round_even(nx * (10.0 / dx), 0) AS INTEGER) AS mx,
  list_extract({[p[3] for p in grids.PARAMS]}, CAST(substr(tile_id, 2) AS INTEGER) % {len(grids.PARAMS)} + 1) AS theta
  FROM (SELECT tile_id, max(j) + 1 AS ny, max(i) + 1 AS nx FROM fine GROUP BY tile_id), (SELECT CAST(unnest(range(0, {len(SPACINGS)})) AS INTEGER) AS k, CAST(unnest({SPACINGS}) AS DOUBLE) AS dx)),
place AS (SELECT base, tile_id, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, ny, nx, j * (ny - 1) / (my - 1) AS y, i * (nx - 1) / (mx - 1) AS x FROM (SELECT *, unnest(range(0, mx)) AS i FROM (SELECT *, unnest(range(0, my)) AS j FROM runs))),
corner AS (SELECT *, CAST(least(floor(y), ny - 2) AS INTEGER) AS y0, CAST(least(floor(x), nx - 2) AS INTEGER) AS x0 FROM place),
wide AS (SELECT base, tile_id, j, i, y0 + a AS cj, x0 + b AS ci, (CASE WHEN a = 1 THEN y - y0 ELSE 1 - (y - y0) END) * (CASE WHEN b = 1 THEN x - x0 ELSE 1 - (x - x0) END) AS w FROM corner, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, b)),
cells AS MATERIALIZED (SELECT wide.tile_id, wide.j, wide.i, sum(w * z) AS z FROM wide JOIN fine f ON f.tile_id = base AND f.j = cj AND f.i = ci GROUP BY ALL)"""
COARSE_FLOW = FLOW.replace("CAST(100 * count(*) AS DOUBLE) AS area FROM walk GROUP", "count(*) * any_value(dx * dx) AS area FROM walk JOIN runs USING (tile_id) GROUP")


@query(f"""{COARSE}, {NEAR}, {NEAR8}, {COARSE_FLOW}, {drop_sql('falls_of', 'cells', 10.0, LEAST_AREA)}
SELECT base AS tile_id, dx_id, round(dx, 6) AS dx, round(pow(10.0, avg(log10(s * 10.0 / dx) + theta * log10(a))), 6) AS ks, count(*) AS n_good, round(max(a), 3) AS a_max FROM falls_of JOIN runs USING (tile_id) WHERE s > 0 GROUP BY base, dx_id, dx""")
def resolution_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed part of the study: resampled, filled, routed and fitted at every spacing in one plan."""
    runs = stage(studies.spacings(tile_params(spark, sf_dir), SPACINGS), "runs")
    flowing = studies.flow_of_runs(studies.coarse_surfaces(grids.tilted_cells(spark, sf_dir), runs, DX), runs, False)
    fits = studies.steepness_of_runs(flowing.withColumn("part", F.lit("obs")), runs, LEAST_AREA, 10.0)
    return fits.join(runs, "run").select("tile_id", "dx_id", *rounded(6, "dx", "ks"), "n_good", *rounded(3, "a_max"))


@query(f"""WITH {RUNS}, per AS (SELECT location, tile, dx, max(ks_mod) AS top FROM runs WHERE dx < 6 OR tile > 2 GROUP BY ALL), pairs AS (SELECT DISTINCT location, tile FROM per)
SELECT location, tile, dx, top FROM (SELECT location, tile, CAST(unnest(range(1, 8)) AS DOUBLE) AS dx FROM pairs) LEFT JOIN per USING (location, tile, dx)""")
def result_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = grids.run_results(spark, sf_dir).where("dx < 6 OR tile > 2").groupBy("location", "tile", "dx").agg(F.max("ks_mod").alias("top"))
    return studies.filled_results(runs, [float(k) for k in range(1, 8)])


@query("SELECT s_suppkey AS id, CAST(25 AS DOUBLE) AS dx, s_suppkey % 7 + 3 AS nx, s_suppkey % 5 + 3 AS ny, CASE s_suppkey % 3 WHEN 0 THEN '7.0,25.0,0.0,100.0,0.0,-25.0' WHEN 1 THEN '1.0,2.0' END AS gt FROM supplier")
def resampled_georeference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"))
    arrays = lambda *x: F.array(*map(F.lit, x))
    gt = F.when(F.col("id") % 3 == 0, arrays(7.0, 10.0, 0.0, 100.0, 0.0, -10.0)).when(F.col("id") % 3 == 1, arrays(1.0, 2.0))
    new = grids.resampled_georeference(gt, 25.0, F.col("id") % 5 + 3, F.col("id") % 7 + 3)
    return s.select("id", new.alias("g")).select("id", "g.dx", "g.nx", "g.ny", F.array_join(F.transform("g.geotransform", lambda x: x.cast("string")), ",").alias("gt"))


MODELLED = "1000.0 - 4.5 * j + 0.05 * CAST(v AS DOUBLE)"


def modelled_cells(spark: SparkSession, sf_dir: str, fall: float = 4.5, rough: float = 0.05) -> DataFrame:
    """A smoother surface than the tilted one, in the place of a model's."""
    return grids.matrix_cells(spark, sf_dir).withColumn("z", 1000.0 - fall * F.col("j") + rough * F.col("z"))


@query(f"""{TILTED_FLOW}, other AS MATERIALIZED (SELECT tile_id, j, i, {MODELLED} AS z FROM raw), {drop_sql('obs', 'cells', 10.0, 300.0)}, {drop_sql('mod', 'other', 10.0, 300.0)},
both_s AS (SELECT o.tile_id, log10(o.a) AS x, log10(o.s) AS y1, log10(m.s) AS y2 FROM obs o JOIN mod m USING (tile_id, j, i) WHERE o.s > 0 AND m.s > 0),
fits AS (SELECT tile_id, count(*) AS n, min(x) AS low, max(x) AS high, regr_slope(y1, x) AS b1, regr_intercept(y1, x) AS c1, regr_slope(y2, x) AS b2, regr_intercept(y2, x) AS c2 FROM both_s GROUP BY tile_id),
steps AS (SELECT *, CAST(unnest(range(0, 200)) AS INTEGER) AS step FROM fits)
SELECT tile_id, n, step, round(pow(10, low + step * (high - low) / 199), 3) AS a, round(pow(10, c1 + b1 * (low + step * (high - low) / 199)), 6) AS s_obs, round(pow(10, c2 + b2 * (low + step * (high - low) / 199)), 6) AS s_mod FROM steps""")
def observed_and_modelled_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = studies.routed(grids.tilted_cells(spark, sf_dir), DX)
    slopes = stage(studies.compare_slopes(cells, modelled_cells(spark, sf_dir), DX, 300.0, 10.0), "slopes")
    return studies.fit_curves(slopes).select("tile_id", "n", "step", *rounded(3, "a"), *rounded(6, "s_obs", "s_mod"))


VARIANTS = {"original": (5.0, 0.1), "AD_no_opt": (4.5, 0.05), "AD_opt": (4.8, 0.08), "partitioned": (4.9, 0.02)}


@query(f"""{TILTED_FLOW}, """ + ", ".join(f"v{n} AS MATERIALIZED (SELECT tile_id, j, i, 1000.0 - {a} * j + {b} * CAST(v AS DOUBLE) AS z FROM raw), {drop_sql(f'd{n}', f'v{n}', 10.0, 200.0)}" for n, (a, b) in enumerate(VARIANTS.values()))
    + ", every_v AS (" + " UNION ALL ".join(f"SELECT tile_id || '|{name}' AS grp, a, s FROM d{n}" for n, name in enumerate(VARIANTS)) + f"""),
logs AS (SELECT grp, log10(a) AS x, log10(s) AS y, a, s FROM every_v WHERE a >= 200 AND s > 0), {BINS},
centre AS (SELECT grp, sum(n * log_a) / sum(n) AS mx, sum(n * log_s) / sum(n) AS my FROM bins GROUP BY grp),
sums AS (SELECT grp, any_value(mx) AS mx, any_value(my) AS my, sum(n * (log_a - mx) ** 2) AS sxx, sum(n * (log_a - mx) * (log_s - my)) AS sxy, sum(n * (log_s - my) ** 2) AS syy, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS n_points FROM bins JOIN centre USING (grp) GROUP BY grp)
SELECT split_part(grp, '|', 1) AS tile_id, split_part(grp, '|', 2) AS variant, round(pow(10.0, my - sxy / sxx * mx), 6) AS ks, round(-sxy / sxx, 6) AS theta, round(sxy * sxy / (sxx * syy), 6) AS r2, n_bins, n_points FROM sums""")
def slope_area_of_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = studies.routed(grids.tilted_cells(spark, sf_dir), DX)
    surfaces = reduce(DataFrame.unionByName, (modelled_cells(spark, sf_dir, a, b).withColumn("variant", F.lit(name)) for name, (a, b) in VARIANTS.items()))
    fits = studies.variant_fits(cells, surfaces, DX, 200.0, 10.0)
    return fits.select("tile_id", "variant", *rounded(6, "ks", "theta", "r2"), "n_bins", "n_points")


def peclet_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planform with a Peclet number for each supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"))
    return s.select(F.concat(F.lit("s"), F.col("key").cast("string")).alias("scenario"), F.lit(1.47e-4).alias("u"), F.lit(1e-4).alias("k"), F.lit(0.35).alias("m"),
                    (10.0 + 10.0 * (F.col("key") % 9)).alias("pe"), F.lit(2.59e6).alias("inlet_area"), F.lit(50.0).alias("length"), F.lit(200.0).alias("width"), F.lit(150.0).alias("height"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(studies.peclet_sweep(peclet_bases(spark, sf_dir), 12.0, 40.0, 25), "sweep")


@query()
def peclet_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.peclet_curves(sweep(spark, sf_dir))


SWEEP_SQL = """base AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS base, 10.0 + 10 * (s_suppkey % 9) AS pe, unnest(range(0, 25)) AS step FROM supplier),
sized AS (SELECT *, CAST(round_even(150 / t, 0) AS INTEGER) + 1 AS ny, CAST(round_even(200 / t, 0) AS INTEGER) + 1 + CASE WHEN CAST(round_even(200 / t, 0) AS INTEGER) % 2 = 1 THEN 1 ELSE 0 END AS nx
  FROM (SELECT *, pow(10, log10(12.0) + step * (log10(40.0) - log10(12.0)) / 24) AS t FROM base)),
sweep AS (SELECT base || '@' || CAST(step AS VARCHAR) AS scenario, nx, ny, 200.0 / (nx - 1) AS dx, 150.0 / (ny - 1) AS dy, 1e-4 * 50 * pow(2.59e6, 0.35) / pe AS d,
  greatest(2.59e6 - (nx - 1) * (200.0 / (nx - 1)) * (150.0 / (ny - 1)), 0) AS a_top FROM sized)"""


@query(f"WITH {SWEEP_SQL} SELECT scenario, nx, ny, round(dx, 8) AS dx, round(dy, 8) AS dy, round(d, 10) AS d, round(a_top, 4) AS a_top FROM sweep")
def peclet_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spark, sf_dir).select("scenario", "nx", "ny", *rounded(8, "dx", "dy"), *rounded(10, "d"), *rounded(4, "a_top"))


@query(f"""WITH {SWEEP_SQL}, g AS (SELECT *, (nx - 1) // 2 AS ci, unnest(range(0, ny)) AS j FROM sweep),
line AS (SELECT *, 500 - 2.0 * j * dy + 0.001 * (j * dy) ** 2 AS z, lead(500 - 2.0 * j * dy + 0.001 * (j * dy) ** 2) OVER (PARTITION BY scenario ORDER BY j) AS z_s, a_top + (j + 1) * 2 * ci * dx * dy AS area FROM g),
cut AS (SELECT *, (z - z_s) / dy AS s FROM line WHERE j >= floor(0.2 * ny) AND j < ceil(0.8 * ny)),
c AS (SELECT scenario, avg(log10(s) + 0.35 * log10(area)) AS c, avg(log10(s)) AS my, count(*) AS n FROM cut WHERE s > 0 GROUP BY scenario),
fit AS (SELECT scenario, any_value(n) AS n_fit, pow(10, any_value(c)) / 1.47 AS ks_fit, 1 - sum((log10(s) - (c - 0.35 * log10(area))) ** 2) / sum((log10(s) - my) ** 2) AS r2_fit, quantile_cont(s * pow(area, 0.35), [0.25, 0.5, 0.75]) AS q FROM cut JOIN c USING (scenario) WHERE s > 0 GROUP BY scenario),
curve AS (SELECT scenario, median((1.47 + d / 1e-4 * (0.002 + 0.0004)) / 1.47) AS ks_curvature FROM sweep GROUP BY scenario)
SELECT sweep.scenario, round(dx, 8) AS dx, round(ks_curvature, 5) AS ks_curvature, CASE WHEN n_fit >= 3 THEN round(ks_fit, 4) END AS ks_fit, CASE WHEN n_fit >= 3 THEN round(r2_fit, 5) END AS r2_fit, n_fit,
  CASE WHEN n_fit >= 3 THEN round(q[2] / 1.47, 4) END AS ks_local, CASE WHEN n_fit >= 3 THEN round(q[1] / 1.47, 4) END AS ks_q25, CASE WHEN n_fit >= 3 THEN round(q[3] / 1.47, 4) END AS ks_q75
FROM sweep JOIN curve USING (scenario) LEFT JOIN fit USING (scenario)""")
def peclet_curves_given_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimates of peclet_curves from a relief in closed form in the place of the solutions."""

    def relief(scenarios: DataFrame) -> DataFrame:
        def down(x: Column | float) -> Column:
            y = lambda j: j * F.col("dy")
            return F.transform(F.sequence(F.lit(0), F.col("ny") - 1), lambda j: 500.0 - 2.0 * y(j) + 0.001 * y(j) * y(j) + x)

        side = down(0.0002 * F.col("dx") * F.col("dx"))
        return planform.checked(scenarios).withColumns({"west": side, "centre": down(0.0), "east": side, "line": down(0.0)})

    got = studies.peclet_curves(sweep(spark, sf_dir), profiles=relief)
    return got.select("scenario", *rounded(8, "dx"), *rounded(5, "ks_curvature"), *rounded(4, "ks_fit"), *rounded(5, "r2_fit"), "n_fit", *rounded(4, "ks_local", "ks_q25", "ks_q75"))


@query()
def routing_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = run_scenarios(spark, "ad").unionByName(run_scenarios(spark, "threshold"))
    return studies.compare_routings(grids.tilted_cells(spark, sf_dir), both, DX)


@query(f"""{TILTED_FLOW}, {_facet_sql()}, {_receiver_sql()},
edge AS MATERIALIZED (SELECT d.tile_id, d.j, d.i, d.j + dj AS rj, d.i + di AS ri, CASE WHEN w = 0 THEN (pi() / 4 - d.r) / (pi() / 4) ELSE d.r / (pi() / 4) END AS share FROM dinf d JOIN hand USING (facet) JOIN dinf t ON t.tile_id = d.tile_id AND t.j = d.j + dj AND t.i = d.i + di),
spread AS (SELECT tile_id, j, i, CAST(100 AS DOUBLE) AS a FROM dinf UNION ALL SELECT s.tile_id, e.rj, e.ri, sum(s.a * e.share) FROM spread s JOIN edge e ON e.tile_id = s.tile_id AND e.j = s.j AND e.i = s.i WHERE e.share > 0 GROUP BY s.tile_id, e.rj, e.ri),
other AS (SELECT tile_id, j, i, sum(a) AS area_dinf FROM spread GROUP BY ALL)
SELECT tile_id, count(*) AS n, round(min(log10(area)), 6) AS low_area, round(max(log10(area)), 6) AS high_area, round(min(log10(area_dinf)), 6) AS low_area_dinf, round(max(log10(area_dinf)), 6) AS high_area_dinf, round(avg(log10(area) - log10(area_dinf)), 6) AS mean_gap
FROM area JOIN other USING (tile_id, j, i) WHERE area > 0 AND area_dinf > 0 GROUP BY tile_id""")
def area_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = studies.routed(grids.tilted_cells(spark, sf_dir), DX, True)
    got = cells.where("area > 0 AND area_dinf > 0").groupBy("tile_id").agg(F.count("*").alias("n"), *(f(F.log10(c)).alias(f"{n}_{c}") for c in ("area", "area_dinf") for n, f in (("low", F.min), ("high", F.max))), F.avg(F.log10("area") - F.log10("area_dinf")).alias("mean_gap"))
    return got.select("tile_id", "n", *rounded(6, "low_area", "high_area", "low_area_dinf", "high_area_dinf", "mean_gap"))


@query(f"""{TILTED_FLOW}, sun AS (SELECT tile_id, j, i, (z_e - z_w) / 20 AS gx, (z_n - z_s) / 20 AS gy FROM near4)
SELECT tile_id, j, i, round(flow.z, 6) AS elevation, round(flow.z, 6) AS filled, fd AS flow_direction, area, round(log10(area), 6) AS logarea,
  CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN round(greatest(0, (sin(radians(20)) - cos(radians(20)) * (gx * sin(radians(315)) + gy * cos(radians(315)))) / sqrt(1 + gx * gx + gy * gy)), 6) ELSE round(CAST(0 AS DOUBLE), 6) END AS hillshade
FROM flow JOIN sun USING (tile_id, j, i)""")
def model_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = studies.model_outputs(grids.tilted_cells(spark, sf_dir), DX)
    return layers.select("tile_id", "j", "i", *rounded(6, "elevation", "filled"), "flow_direction", "area", *rounded(6, "logarea", "hillshade"))
