"""Slope-area analytics: binned and plain power-law fits, spreads, steepness indices.

Points are rows of (keys..., a, s). Every operator takes any number of key columns and gives a row (or
a row for each bin) per key; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import stage

MIN_POINTS = 30
MIN_BINS = 3
ACCURACY = 10_000
QUARTILES = (0.25, 0.5, 0.75)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: tuple[float, ...]) -> DataFrame:
    """keys, q (array of exact quantiles, linear between ranks), n over the values that are not NULL.

    A sketch a key gives cuts close to the wanted ranks, values are counted between cuts, and only the few
    cells that hold a wanted rank are sorted, after equal values are counted together. No task holds a
    group: memory does not grow with it, whatever its size. Cuts decide which cells are sorted, never
    the result. Keys without a value have no row; NULL keys are a key.

    The input is read once: keys and values are written, and the passes read those. Cuts and chosen cells are written too,
    so Spark knows their size: it broadcasts them below its threshold and shuffles by key above it."""
    rows = stage(rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), "values")
    near = sorted({min(1.0, max(0.0, p + d / ACCURACY)) for p in probs for d in (-10, -2, 2, 10)})
    sketch = stage(rows.groupBy(*keys).agg(F.percentile_approx("_v", near, ACCURACY).alias("_cuts")), "cuts")
    cell = F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))
    placed = join_keys(rows, sketch, keys).select(*keys, cell.alias("_cell"), "_v")

    per_key = Window.partitionBy(*keys)  # a row for each cell: at most len(near) + 1
    cells = placed.groupBy(*keys, "_cell").agg(F.count("*").alias("_held"))
    cells = cells.withColumn("_n", F.sum("_held").over(per_key)).withColumn("_upto", F.sum("_held").over(per_key.orderBy("_cell")))
    place = [p * (F.col("_n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*(f(x) for x in place for f in (F.floor, F.ceil))))
    inside = F.filter(ranks, lambda r: (r >= F.col("_upto") - F.col("_held")) & (r < F.col("_upto")))
    chosen = stage(cells.select(*keys, "_cell", "_n", (F.col("_upto") - F.col("_held")).alias("_before"), inside.alias("_ranks")).where(F.size("_ranks") > 0), "ranked")

    values = join_keys(placed, chosen, [*keys, "_cell"]).groupBy(*keys, "_cell", "_v").agg(F.count("*").alias("_m"), *(F.any_value(c).alias(c) for c in ("_n", "_before", "_ranks")))
    last = F.sum("_m").over(Window.partitionBy(*keys, "_cell").orderBy("_v")) + F.col("_before")
    met = values.withColumn("_last", last).select(*keys, "_n", "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_last") - F.col("_m")) & (r < F.col("_last")))).alias("_rank"))
    at = met.groupBy(*keys).agg(F.any_value("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two ranks a quantile
    out = []
    for p in probs:
        x = p * (F.col("n") - 1)
        low, high = F.try_element_at("_at", F.floor(x)), F.try_element_at("_at", F.ceil(x))
        out.append(low + (x - F.floor(x)) * (high - low))
    return stage(at.select(*keys, F.array(*out).alias("q"), "n"), "quantiles")  # a row a key; callers read it more than once


def join_keys(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Append to rows the columns of ``table`` (a row for each key); NULL keys meet."""
    named = table.select(*(F.col(c).alias(f"_of_{c}" if c in keys else c) for c in table.columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(named, same, how).drop(*(f"_of_{k}" for k in keys))


def usable(points: DataFrame, min_area: float = 0.0) -> DataFrame:
    """Points with finite, positive slope and an area above zero and at least ``min_area``."""
    a, s = F.col("a"), F.col("s")
    return points.where(finite(a) & finite(s) & (a > 0) & (a >= min_area) & (s > 0))


def log_points(points: DataFrame, keys: list[str], min_area: float = 0.0) -> DataFrame:
    return usable(points, min_area).select(*keys, F.log10("a").alias("log_a"), F.log10("s").alias("log_s"), "s")


def binned(points: DataFrame, keys: list[str], min_area: float = 0.0, nbins: int = 24, min_per_bin: int = 10, agg: str = "median", relax: bool = True) -> DataFrame:
    """Bins that take part in a fit: keys, bin, log_a, log_s, n, used_min.

    Equal bins of log10 area between its extremes, the last one closed; medians (or means) of logs.
    Bins with fewer than ``min_per_bin`` points go; where fewer than three bins are left the bound
    falls to max(3, min_per_bin // 2), then to 3. Keys with fewer than 30 points, one single area or
    fewer than three bins at the last bound have no row.
    """
    if agg not in ("median", "mean"):
        raise ValueError("agg is median or mean")
    pts = log_points(points, keys, min_area)
    ends = pts.groupBy(*keys).agg(F.min("log_a").alias("lo"), F.max("log_a").alias("hi"), F.count("*").alias("total")).where((F.col("total") >= MIN_POINTS) & (F.col("hi") > F.col("lo")))
    ends = stage(ends, "ends")  # small, and known to be: points are not shuffled by key for it
    width = (F.col("hi") - F.col("lo")) / nbins
    placed = pts.join(ends, keys).withColumn("bin", F.least(F.floor((F.col("log_a") - F.col("lo")) / width), F.lit(nbins - 1)).cast("int"))
    if agg == "mean":
        bins = placed.groupBy(*keys, "bin").agg(F.avg("log_a").alias("log_a"), F.avg("log_s").alias("log_s"), F.count("*").alias("n"))
    else:
        both = placed.select(*keys, "bin", F.explode(F.create_map(F.lit("log_a"), "log_a", F.lit("log_s"), "log_s")).alias("_of", "_x"))
        middle = lambda c: F.max(F.when(F.col("_of") == c, F.col("q")[0])).alias(c)
        bins = quantiles(both, [*keys, "bin", "_of"], "_x", (0.5,)).groupBy(*keys, "bin").agg(middle("log_a"), middle("log_s"), F.max("n").alias("n"))
    bounds = [min_per_bin, max(3, min_per_bin // 2), 3] if relax else [min_per_bin]
    per_key = Window.partitionBy(*keys)  # at most nbins rows a key
    counts = {b: F.sum((F.col("n") >= b).cast("int")).over(per_key) for b in dict.fromkeys(bounds)}
    used = F.coalesce(*(F.when(counts[b] >= MIN_BINS, F.lit(b)) for b in bounds))
    return bins.withColumn("used_min", used).where(F.col("n") >= F.col("used_min"))


def fit_bins(bins: DataFrame, keys: list[str], weighted: bool = True) -> DataFrame:
    """keys, ks, theta, r2, n_bins, n_points of the count-weighted line through binned logs."""
    w = F.col("n").cast("double") if weighted else F.lit(1.0)
    x, y = F.col("log_a"), F.col("log_s")
    centre = bins.groupBy(*keys).agg((F.sum(w * x) / F.sum(w)).alias("mx"), (F.sum(w * y) / F.sum(w)).alias("my"))
    dx, dy = x - F.col("mx"), y - F.col("my")
    sums = bins.join(centre, keys).groupBy(*keys, "mx", "my").agg(
        F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dy * dy).alias("syy"), F.count("*").alias("n_bins"), F.sum("n").alias("n_points")
    )
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    return sums.select(
        *keys,
        F.pow(F.lit(10.0), F.col("my") - slope * F.col("mx")).alias("ks"),
        (-slope).alias("theta"),
        F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")).alias("r2"),
        "n_bins",
        "n_points",
    )


def weighted_r2(rows: DataFrame, keys: list[str], y: str, fitted: str, w: str) -> DataFrame:
    """keys, r2 = 1 - sum w (y - fitted)^2 / sum w (y - weighted mean)^2; NULL without spread."""
    mean = stage(rows.groupBy(*keys).agg((F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("my")), "means")  # else rows would meet it shuffled, a group a task
    parts = rows.join(mean, keys).groupBy(*keys).agg(F.sum(F.col(w) * F.pow(F.col(y) - F.col(fitted), F.lit(2.0))).alias("res"), F.sum(F.col(w) * F.pow(F.col(y) - F.col("my"), F.lit(2.0))).alias("tot"))
    return parts.select(*keys, F.when(F.col("tot") > 0, 1.0 - F.col("res") / F.col("tot")).alias("r2"))


def iqr_errors(points: DataFrame, bins: DataFrame, keys: list[str], min_area: float = 0.0) -> DataFrame:
    """keys, bin, lower, upper: distance of the quartiles of linear slope from its median.

    Edges are midpoints between bin centres, the outer ones mirrored; all bins are half-open, the last
    too. Bins with fewer than three points get zeros."""
    order = Window.partitionBy(*keys).orderBy("log_a")
    before, after = F.lag("log_a").over(order), F.lead("log_a").over(order)
    c = F.col("log_a")
    low = F.coalesce((before + c) / 2, c - (after - c) / 2)
    high = F.coalesce((after + c) / 2, c + (c - before) / 2)
    edges = bins.select(*keys, "bin", low.alias("e0"), high.alias("e1"))
    edges = stage(edges, "edges")
    table = stage(edges.groupBy(*keys).agg(F.collect_list(F.struct("bin", "e0", "e1")).alias("edges")), "edge-lists")  # at most nbins each
    at = F.filter("edges", lambda e: (F.col("log_a") >= e["e0"]) & (F.col("log_a") < e["e1"]))
    inside = log_points(points, keys, min_area).join(table, keys).withColumn("bin", F.get(at, F.lit(0))["bin"]).where(F.col("bin").isNotNull())
    q = quantiles(inside, [*keys, "bin"], "s", QUARTILES)
    some = F.col("n") >= 3
    got = edges.select(*keys, "bin").join(q, [*keys, "bin"], "left")
    return got.select(*keys, "bin", F.when(some, F.col("q")[1] - F.col("q")[0]).otherwise(0.0).alias("lower"), F.when(some, F.col("q")[2] - F.col("q")[1]).otherwise(0.0).alias("upper"))


def fit_free(points: DataFrame, keys: list[str], min_points: int = 5) -> DataFrame:
    """keys, ks, theta, r2, n_good, intercept, slope of log10 S = intercept + slope log10 A (least squares)."""
    fit = log_points(points, keys).groupBy(*keys).agg(
        F.regr_slope("log_s", "log_a").alias("slope"), F.regr_intercept("log_s", "log_a").alias("intercept"), F.regr_r2("log_s", "log_a").alias("r2"), F.count("*").alias("n_good")
    )
    enough = F.col("n_good") >= min_points
    return fit.select(*keys, F.when(enough, F.pow(F.lit(10.0), "intercept")).alias("ks"), F.when(enough, -F.col("slope")).alias("theta"), *(F.when(enough, F.col(c)).alias(c) for c in ("r2", "intercept", "slope")), "n_good")


def fit_fixed(points: DataFrame, keys: list[str], theta: float | Column, min_points: int = 5) -> DataFrame:
    """keys, ks, r2, n_good, a_max with the exponent given (a number, or a column among the keys): the
    intercept is the mean of log S + theta log A."""
    pts = log_points(points, keys)
    c = F.avg(F.col("log_s") + theta * F.col("log_a"))
    spread = F.var_pop(F.col("log_s") + theta * F.col("log_a"))  # around c, which is its mean
    fit = pts.groupBy(*keys).agg(c.alias("c"), F.count("*").alias("n_good"), F.max("log_a").alias("top"), spread.alias("res"), F.var_pop("log_s").alias("tot"))
    enough = F.col("n_good") >= min_points
    return fit.select(*keys, F.when(enough, F.pow(F.lit(10.0), "c")).alias("ks"), F.when(enough & (F.col("tot") > 0), 1.0 - F.col("res") / F.col("tot")).alias("r2"), "n_good", F.pow(F.lit(10.0), "top").alias("a_max"))


def local_ks(points: DataFrame, keys: list[str], m: float | Column, min_points: int = 5) -> DataFrame:
    """keys, ks_median, ks_q25, ks_q75, n of S A^m (m a number, or a column among the keys); NULL statistics
    below ``min_points``."""
    pts = usable(points).select(*keys, (F.col("s") * F.pow("a", m if isinstance(m, Column) else F.lit(m))).alias("ks")).where(F.col("ks") > 0)
    q = quantiles(pts, keys, "ks", QUARTILES)
    enough = F.col("n") >= min_points
    return q.select(*keys, *(F.when(enough, F.col("q")[k]).alias(f"ks_{name}") for k, name in ((1, "median"), (0, "q25"), (2, "q75"))), "n")


def quantiles_in_row(values: Column, probs: tuple[float, ...]) -> list[Column]:
    """Exact quantiles, linear between ranks, of the known values of an array; NULL without any."""
    known = F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))
    out = []
    for p in probs:
        x = p * (F.size(known) - 1)
        low, high = F.get(known, F.floor(x).cast("int")), F.get(known, F.ceil(x).cast("int"))
        out.append(low + (x - F.floor(x)) * (high - low))
    return out


def fit_in_row(rows: DataFrame, points: str, m: Column, min_points: int = 5) -> DataFrame:
    """Append ks, r2, n_good of :func:`fit_fixed` and ks_median, ks_q25, ks_q75 of :func:`local_ks` for an array of points (a, s) in each
    row: a few points each for many keys, which need no grouping. n_good is NULL without a usable point."""
    good = F.filter(points, lambda p: finite(p["a"]) & finite(p["s"]) & (p["a"] > 0) & (p["s"] > 0))
    mean = lambda c, f: F.try_divide(F.aggregate(c, F.lit(0.0), lambda t, x: t + f(x)), F.size(c))
    spread = lambda c: mean(F.col(c), lambda x: (x - F.col(f"{c}_mean")) * (x - F.col(f"{c}_mean")))
    df = rows.withColumn("_good", good).withColumns({
        "_y": F.transform("_good", lambda p: F.log10(p["s"])), "_c": F.transform("_good", lambda p: F.log10(p["s"]) + m * F.log10(p["a"])),
        "_ks": F.array_sort(F.filter(F.transform("_good", lambda p: p["s"] * F.pow(p["a"], m)), lambda v: v > 0)), "_n": F.size("_good"),
    })
    df = df.withColumns({f"{c}_mean": mean(F.col(c), lambda x: x) for c in ("_y", "_c")})
    df = df.withColumns({"_tot": spread("_y"), "_res": spread("_c")})
    enough, some = F.col("_n") >= min_points, F.size("_ks") >= min_points
    local = zip(("ks_q25", "ks_median", "ks_q75"), quantiles_in_row(F.col("_ks"), QUARTILES), strict=True)
    return df.select(
        *rows.columns, F.when(enough, F.pow(F.lit(10.0), "_c_mean")).alias("ks"), F.when(enough & (F.col("_tot") > 0), 1.0 - F.col("_res") / F.col("_tot")).alias("r2"),
        F.when(F.col("_n") > 0, F.col("_n").cast("long")).alias("n_good"), *(F.when(some, q).alias(n) for n, q in local),
    )


def guarded_ratio(over: Column, under: Column) -> Column:
    """over / under where both are finite and positive, else NULL."""
    return F.when(finite(over) & finite(under) & (over > 0) & (under > 0), over / under)


def median_iqr(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median, q25, q75, n over finite positive values; keys without any keep NULLs."""
    v = F.col(value)
    good = F.when(finite(v) & (v > 0), v)
    q = join_keys(rows.select(*keys).distinct(), quantiles(rows.withColumn("_good", good), keys, "_good", QUARTILES), keys, "left")
    return q.select(*keys, F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram(values: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """keys, bin, n of equal bins over [low, high], the last one closed; values outside don't count."""
    v = F.col(value)
    inside = values.where((v >= low) & (v <= high))
    at = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def axis_limits(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys and padded limits (minimum 0.9, maximum 1.1) of areas and slopes that can stand on log axes."""
    return usable(points).groupBy(*keys).agg(*((f(c) * pad).alias(f"{c}_{name}") for c in ("a", "s") for f, pad, name in ((F.min, 0.9, "low"), (F.max, 1.1, "high"))))


def guide_line(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Append ``guide``: value0 (x / x0)^-1 through the first valid point in order of ``order``.

    Keys with fewer than two valid points get no guide."""
    v, x = F.col(value), F.col(order)
    good = finite(v) & (v > 0)
    first = points.where(good).groupBy(*keys).agg(F.min_by(F.struct(x.alias("x0"), v.alias("y0")), F.struct(x, v)).alias("p"), F.count("*").alias("_n")).where("_n >= 2")
    return points.join(first, keys, "left").withColumn("guide", F.col("p.y0") * F.col("p.x0") / x).drop("p", "_n")
