"""Neighbourhood operators on cell tables.

Cells are dealt by blocks of a tile, each with the one cell around it that its neighbourhoods reach; the
windows along a block's rows and columns then need sorts only, and a large tile keeps many tasks busy. A
neighbour counts only if it is the very next cell: a cell without a row is as good as NoData.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BLOCK = 256
"""Cells of a block's side."""
DEALT = ["tile_id", "_bj", "_bi"]


def along_row() -> WindowSpec:
    return Window.partitionBy(*DEALT, "j").orderBy("i")


def along_column() -> WindowSpec:
    return Window.partitionBy(*DEALT, "i").orderBy("j")


def by_block(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Deal cells to the blocks whose cells have them as neighbours."""
    reach = lambda x: F.explode(F.sequence(F.greatest(F.floor((F.col(x) - 1) / block), F.lit(0)), F.floor((F.col(x) + 1) / block)))
    return cells.withColumn("_bj", reach("j")).withColumn("_bi", reach("i")).repartition(*DEALT)


def own(dealt: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each cell once, from the block it lies in."""
    return dealt.where((F.floor(F.col("j") / block) == F.col("_bj")) & (F.floor(F.col("i") / block) == F.col("_bi"))).drop("_bj", "_bi")


def beside(value: str, along: WindowSpec, axis: str, step: int) -> Column:
    """The value of the next cell before (-1) or behind (1) on an axis; NULL if that cell has no row."""
    look = F.lag if step < 0 else F.lead
    return F.when(look(axis).over(along) == F.col(axis) + step, look(value).over(along))


def four_neighbours(cells: DataFrame, value: str = "z", prefix: str = "z", block: int = BLOCK) -> DataFrame:
    """Append the values to the west, east, north and south (NULL beyond the tile)."""
    df = by_block(cells, block)
    for name, along, axis, step in (("w", along_row(), "i", -1), ("e", along_row(), "i", 1), ("n", along_column(), "j", -1), ("s", along_column(), "j", 1)):
        df = df.withColumn(f"{prefix}_{name}", beside(value, along, axis, step))
    return own(df, block)


def eight_neighbours(cells: DataFrame, value: str = "z", prefix: str = "z", block: int = BLOCK) -> DataFrame:
    """Append all eight neighbours' values: first along rows, then rows' triples along columns.

    A cell without a row hides the two beside it from the rows next to it; ``grids.dense`` adds such rows."""
    df = by_block(cells, block)
    for name, step in (("w", -1), ("e", 1)):
        df = df.withColumn(f"{prefix}_{name}", beside(value, along_row(), "i", step))
    triple = F.struct(F.col(value).alias("c"), F.col(f"{prefix}_w").alias("w"), F.col(f"{prefix}_e").alias("e"))
    df = df.withColumn("_triple", triple).withColumn("_up", beside("_triple", along_column(), "j", -1)).withColumn("_down", beside("_triple", along_column(), "j", 1))
    for row, letter in (("_up", "n"), ("_down", "s")):
        for part, end in (("c", ""), ("w", "w"), ("e", "e")):
            df = df.withColumn(f"{prefix}_{letter}{end}", F.col(f"{row}.{part}"))
    return own(df.drop("_triple", "_up", "_down"), block)


def _gradient(before: Column, here: Column, after: Column, at: Column, last: Column) -> Column:
    """Central difference inside, one-sided at the first and last index, spacing 1."""
    return F.when(at == 0, after - here).when(at == last, here - before).otherwise((after - before) / 2.0)


def slope_magnitude(cells: DataFrame, mask: Column | None = None, dx: float = 1.0) -> DataFrame:
    """Append ``slope``: the gradient's length over index spacing (or ``dx``); NULL outside the mask."""
    box = cells.groupBy("tile_id").agg(F.max("i").alias("_ni"), F.max("j").alias("_nj"))
    df = four_neighbours(cells).join(box, "tile_id")
    gx = _gradient(F.col("z_w"), F.col("z"), F.col("z_e"), F.col("i"), F.col("_ni"))
    gy = _gradient(F.col("z_n"), F.col("z"), F.col("z_s"), F.col("j"), F.col("_nj"))
    slope = F.sqrt(gx * gx + gy * gy) / dx
    return df.withColumn("slope", slope if mask is None else F.when(mask, slope)).select(*cells.columns, "slope")


def laplacian(cells: DataFrame, dx: float, dy: float | None = None) -> DataFrame:
    """Append ``lap``: the five-point Laplacian, NULL on the border and next to NoData."""
    dy = dx if dy is None else dy
    z = F.col("z")
    lap = (F.col("z_e") - 2.0 * z + F.col("z_w")) / (dx * dx) + (F.col("z_s") - 2.0 * z + F.col("z_n")) / (dy * dy)
    return four_neighbours(cells).withColumn("lap", lap).drop("z_w", "z_e", "z_n", "z_s")


def one_sided_slope(cells: DataFrame, dx: float, dy: float | None = None) -> DataFrame:
    """Append ``slope`` from the available one-sided differences: their mean in x and in y.

    A neighbour counts if its cell is valid (``area`` known). Central where both exist, one-sided where
    one does, zero where none does."""
    df = four_neighbours(four_neighbours(cells), "area", "a")
    return df.withColumn("slope", F.when(F.col("area").isNotNull(), one_sided(dx, dy))).select(*cells.columns, "slope")


def one_sided(dx: float, dy: float | None = None) -> Column:
    """The length of the one-sided gradient from columns z, z_w ... and a_w ... (see :func:`one_sided_slope`)."""
    dy = dx if dy is None else dy

    def side(low: str, high: str, step: float) -> Column:
        back = F.when(F.col(f"a_{low}").isNotNull(), (F.col("z") - F.col(f"z_{low}")) / step)
        ahead = F.when(F.col(f"a_{high}").isNotNull(), (F.col(f"z_{high}") - F.col("z")) / step)
        count = F.col(f"a_{low}").isNotNull().cast("int") + F.col(f"a_{high}").isNotNull().cast("int")
        total = F.when(F.col(f"a_{low}").isNotNull(), back).otherwise(0.0) + F.when(F.col(f"a_{high}").isNotNull(), ahead).otherwise(0.0)
        return F.when(count > 0, total / count).otherwise(0.0)

    x, y = side("w", "e", dx), side("n", "s", dy)
    return F.sqrt(x * x + y * y)


def effective_diffusivity(d: Column, slope: Column, critical: float) -> Column:
    """d / (1 - r^2) with r = slope / critical, held to at most 0.99 either way."""
    r = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), slope / critical))
    return d / (1.0 - r * r)


def linear_flux(d: Column, slope: Column) -> Column:
    """d s."""
    return d * slope


def nonlinear_flux(d: Column, slope: Column, critical: float) -> Column:
    """d s / (1 - (s / critical)^2); NULL at the critical slope."""
    return F.try_divide(d * slope, 1.0 - F.pow(slope / critical, F.lit(2.0)))


def steady_slope(u: Column | float, k: Column | float, area: Column, m: Column | float) -> Column:
    """(U / K) / A^m, NULL without area."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.try_divide(as_col(u) / as_col(k), F.pow(area, as_col(m)))


def hillshade(cells: DataFrame, dx: float, inclination: float = 20.0, azimuth: float = 315.0) -> DataFrame:
    """Append ``shade`` in 0..1: Lambert's law under a sun at the given height and compass direction."""
    df = four_neighbours(cells)
    gx, gy = (F.col("z_e") - F.col("z_w")) / (2.0 * dx), (F.col("z_n") - F.col("z_s")) / (2.0 * dx)
    up, side = F.radians(F.lit(inclination)), F.radians(F.lit(azimuth))
    facing = F.sin(up) - F.cos(up) * (gx * F.sin(side) + gy * F.cos(side))
    return df.withColumn("shade", F.greatest(F.lit(0.0), facing / F.sqrt(1.0 + gx * gx + gy * gy))).select(*cells.columns, "shade")


def diffusion_stencil(cells: DataFrame, dx: float) -> DataFrame:
    """The five-point Laplacian of valid cells as (tile_id, j, i, nj, ni, coefficient).

    A neighbour that is missing or not valid still takes from the diagonal: it acts as a zero."""
    valid = cells.where(F.col("area").isNotNull()).select("tile_id", "j", "i")
    c = 1.0 / (dx * dx)
    sides = F.explode(F.array(*(F.struct(F.lit(a).alias("dj"), F.lit(b).alias("di")) for a, b in ((0, -1), (0, 1), (-1, 0), (1, 0)))))
    reach = valid.withColumn("d", sides).select("tile_id", "j", "i", (F.col("j") + F.col("d.dj")).alias("nj"), (F.col("i") + F.col("d.di")).alias("ni"))
    there = reach.join(valid.select("tile_id", F.col("j").alias("nj"), F.col("i").alias("ni")), ["tile_id", "nj", "ni"]).select("tile_id", "j", "i", "nj", "ni", F.lit(c).alias("coefficient"))
    return there.unionByName(valid.select("tile_id", "j", "i", F.col("j").alias("nj"), F.col("i").alias("ni"), F.lit(-4.0 * c).alias("coefficient")))


def reflect(index: Column, size: Column | int) -> Column:
    """An index mirrored at the grid's edges: -1 becomes 1, n becomes n - 2."""
    n = size if isinstance(size, Column) else F.lit(size)
    return F.when(index < 0, 1).when(index >= n, n - 2).otherwise(index)


def trim(cells: DataFrame, fraction: float, rows: int) -> DataFrame:
    """Rows floor(f n) <= j < ceil((1 - f) n); refuses to leave none."""
    import math

    low, high = math.floor(fraction * rows), math.ceil((1 - fraction) * rows)
    if low >= high:
        raise ValueError("trimming leaves no row")
    return cells.where((F.col("j") >= low) & (F.col("j") < high))


def centreline_slope(cells: DataFrame, dy: float) -> DataFrame:
    """Along the middle column of each tile: (z - z of the next row) / dy; the last is NULL."""
    box = cells.groupBy("tile_id").agg(F.floor(F.max("i") / 2).alias("_ci"))
    line = cells.join(box.hint("merge"), "tile_id").where(F.col("i") == F.col("_ci")).drop("_ci")  # a column a tile
    down = beside("z", Window.partitionBy("tile_id").orderBy("j"), "j", 1)
    return line.withColumn("slope", (F.col("z") - down) / dy)


def local_steepness(cells: DataFrame, u: float, k: float, d: float, dx: float, cut: float) -> DataFrame:
    """Per tile: median over trimmed centre-line rows of (U / K + (D / K) lap) / (U / K)."""
    box = cells.groupBy("tile_id").agg((F.max("j") + 1).alias("_n"), F.floor(F.max("i") / 2).alias("_ci"))
    df = laplacian(cells, dx).join(box, "tile_id")
    df = df.where((F.col("i") == F.col("_ci")) & (F.col("j") >= F.floor(cut * F.col("_n"))) & (F.col("j") < F.ceil((1 - cut) * F.col("_n"))))
    return df.groupBy("tile_id").agg(F.median((u / k + d / k * F.col("lap")) / (u / k)).alias("ks_norm"), F.count("lap").alias("n"))
