"""Bilinear resampling that passes over NoData."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zoom(cells: DataFrame, factor_y: float, factor_x: float) -> DataFrame:
    """Cells (tile_id, j, i, z) of each tile resampled by the given factors."""
    return sampled(cells, extents(cells).withColumn("fy", F.lit(float(factor_y))).withColumn("fx", F.lit(float(factor_x))), ["tile_id"])


def extents(cells: DataFrame) -> DataFrame:
    """(tile_id, ny, nx)."""
    return cells.groupBy("tile_id").agg((F.max("j") + 1).alias("ny"), (F.max("i") + 1).alias("nx"))


def sampled(cells: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """keys, j, i, z of every grid (keys, ny, nx, fy, fx) over cells of its tile; a tile may have many grids.

    Output size is round(n * factor) (half to even); sample k stands at k (n - 1) / (size - 1). Corner
    values are weighted bilinearly, NoData with weight zero; a cell whose valid weight is below one half
    is NULL. Each output cell joins the square of cells that it lies in, rows of a grid are dealt over tasks; a tile needs no other."""
    size = lambda n, f: F.greatest(F.bround(F.col(n) * F.col(f)), F.lit(1)).cast("int")
    box = grids.withColumn("my", size("ny", "fy")).withColumn("mx", size("nx", "fx")).drop("fy", "fx")
    rows = box.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("my") - 1))).repartition(*keys, "j")
    out = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mx") - 1)))
    place = lambda k, n, m: F.when(F.col(m) > 1, F.col(k) * (F.col(n) - 1) / (F.col(m) - 1)).otherwise(0.0)
    out = out.withColumn("y", place("j", "ny", "my")).withColumn("x", place("i", "nx", "mx"))
    y0, x0 = F.least(F.floor("y"), F.greatest(F.col("ny") - 2, F.lit(0))), F.least(F.floor("x"), F.greatest(F.col("nx") - 2, F.lit(0)))
    out = out.withColumn("y0", y0.cast("int")).withColumn("x0", x0.cast("int")).withColumn("fy", F.col("y") - F.col("y0")).withColumn("fx", F.col("x") - F.col("x0"))
    # a cell is a corner of four squares of neighbouring cells: squares are as many as cells, however many grids are sampled from them
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    parts = cells.where("z IS NOT NULL").select("tile_id", "j", "i", "z", corner.alias("c")).select("tile_id", (F.col("j") - F.col("c.a")).alias("y0"), (F.col("i") - F.col("c.b")).alias("x0"), "c", "z")
    squares = parts.groupBy("tile_id", "y0", "x0").agg(*(F.max(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col("z"))).alias(f"z{a}{b}") for a in (0, 1) for b in (0, 1)))
    # what an exploded table holds is not known to the planner: without the hint it would broadcast all cells
    met = out.join(squares.hint("merge"), ["tile_id", "y0", "x0"], "left")
    share = lambda c, k: F.col(c) if k else 1.0 - F.col(c)
    weights = [(F.col(f"z{a}{b}"), share("fy", a) * share("fx", b)) for a in (0, 1) for b in (0, 1)]
    weight = sum((F.when(z.isNotNull(), w).otherwise(0.0) for z, w in weights), F.lit(0.0))
    total = sum((F.coalesce(w * z, F.lit(0.0)) for z, w in weights), F.lit(0.0))
    summed = met.select(*keys, "j", "i", weight.alias("weight"), total.alias("total"))
    return summed.select(*keys, "j", "i", F.when(F.col("weight") >= 0.5, F.col("total") / F.col("weight")).alias("z"))


def resample(cells: DataFrame, dx: float, dx_target: float) -> DataFrame:
    """Square cells of side ``dx`` resampled to ``dx_target``."""
    if dx_target <= 0:
        raise ValueError("the target spacing must be positive")
    return zoom(cells, dx / dx_target, dx / dx_target)


def resample_sweep(cells: DataFrame, dx: float, targets: DataFrame) -> DataFrame:
    """(tile_id, dx_id, j, i, z): square cells of side ``dx`` resampled to every spacing of their tile's in
    ``targets`` (tile_id, dx_id, dx), one plan for all. Spacings that are not above zero give no cells."""
    wanted = targets.where("dx > 0").select("tile_id", "dx_id", (F.lit(float(dx)) / F.col("dx")).alias("fy"))
    return sampled(cells, extents(cells).join(wanted.withColumn("fx", F.col("fy")), "tile_id"), ["tile_id", "dx_id"])
