"""Grids as tables of cells, and the readers that make them.

A cell table has a row for every cell of a tile's rectangle: ``tile_id``, row ``j`` (south is up),
column ``i``, elevation ``z`` and, where known, drainage ``area`` and D8 code ``fd``. NoData is NULL;
NaN is turned into NULL on the way in, since NaN compares as the largest number here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_ROWS = 50
SPACING = 10.0
FILE_BLOCK = 1024
"""Cells along a side of the blocks in which tiles are written."""


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns))


def read_cells(spark: SparkSession, path: str, tiles: list[str] | None = None, variant: str | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Cells from Parquet partitioned by ``tile_id`` (and ``variant``); only the named ones are read.

    ``window``: (j0, j1, i0, i1), half open, in the tile's own rows and columns. The scan skips row groups
    by their least and greatest j and i, which :func:`write_cells` keeps close. Use :func:`crop` to count anew."""
    df = spark.read.parquet(path)
    if tiles is not None:
        df = df.where(F.col("tile_id").isin(tiles))
    if variant is not None:
        df = df.where(F.col("variant") == variant)
    if window is not None:
        j0, j1, i0, i1 = window
        df = df.where((F.col("j") >= j0) & (F.col("j") < j1) & (F.col("i") >= i0) & (F.col("i") < i1))
    return no_nan(df)


def write_cells(cells: DataFrame, path: str, block: int = FILE_BLOCK) -> None:
    """Cells to Parquet, partitioned by tile and, if there is one, variant. Tasks get blocks of a tile, so one
    large tile is written by many, and a file holds neighbouring cells in order."""
    keys = [c for c in ("variant", "tile_id") if c in cells.columns]
    place = [*keys, *(F.floor(F.col(c) / block) for c in "ji")]
    cells.repartition(*place).sortWithinPartitions(*place, "j", "i").write.mode("overwrite").partitionBy(*keys).parquet(path)


def matrix_cells(spark: SparkSession, sf_dir: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The ``embeddings`` matrix as tiles of ``tile_rows`` rows: a rough surface."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return no_nan(e.select(
        F.concat(F.lit("t"), F.floor(F.col("vec_id") / tile_rows).cast("string")).alias("tile_id"),
        (F.col("vec_id") % tile_rows).cast("int").alias("j"),
        F.col("i").cast("int").alias("i"),
        F.col("v").cast("double").alias("z"),
    ))


def tilted_cells(spark: SparkSession, sf_dir: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """A plane that falls to the south under a tenth of the rough surface."""
    return matrix_cells(spark, sf_dir, tile_rows).withColumn("z", 1000.0 - 5.0 * F.col("j") + 0.1 * F.col("z"))


def slope_area_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, a, s): areas and slopes with a known exponent of 0.45, from ``lineitem``."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice", "l_discount")
    return rows.select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("a"), (F.col("l_discount") * F.pow("l_extendedprice", F.lit(-0.45))).alias("s"))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, tile, dx, value): rows shaped like results of runs, from ``lineitem``."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rows.select(
        F.col("l_returnflag").alias("location"),
        (F.col("l_suppkey") % 5).cast("int").alias("tile"),
        F.col("l_linenumber").cast("double").alias("dx"),
        F.col("l_extendedprice").alias("ks_mod"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("ks_obs"),
    )


def dense(cells: DataFrame) -> DataFrame:
    """Add the missing cells of each tile's rectangle as NULL rows (window stencils need them)."""
    box = cells.groupBy("tile_id").agg(F.max("j").alias("nj"), F.max("i").alias("ni"))
    frame = box.select("tile_id", F.explode(F.sequence(F.lit(0), "nj")).alias("j"), "ni").select("tile_id", "j", F.explode(F.sequence(F.lit(0), "ni")).alias("i"))
    return frame.join(cells, ["tile_id", "j", "i"], "left")


def crop(cells: DataFrame, j0: int, j1: int, i0: int, i1: int) -> DataFrame:
    """The half-open window [j0, j1) x [i0, i1), counted from its corner."""
    inside = cells.where((F.col("j") >= j0) & (F.col("j") < j1) & (F.col("i") >= i0) & (F.col("i") < i1))
    return inside.withColumn("j", F.col("j") - j0).withColumn("i", F.col("i") - i0)


def spacing(geotransform: Column, dx: Column) -> tuple[Column, Column]:
    """(dx, dy) of a georeference: from its transform, else from a positive dx; dy defaults to dx."""
    usable = lambda x: F.when((x > 0) & (x < float("inf")), x)
    x = F.coalesce(usable(F.try_element_at(geotransform, F.lit(2))), usable(dx))
    y = F.coalesce(usable(F.abs(F.try_element_at(geotransform, F.lit(6)))), x)
    return x, y


def resampled_georeference(geotransform: Column, dx_target: float, ny: Column, nx: Column) -> Column:
    """A georeference after resampling: struct(dx, nx, ny, geotransform). The transform keeps its origin and
    rotation and has the new steps, the one to the south below zero; NULL or shorter than six, it stays."""
    steps = F.transform(geotransform, lambda x, k: F.when(k == 1, float(dx_target)).when(k == 5, -float(dx_target)).otherwise(x))
    return F.struct(F.lit(float(dx_target)).alias("dx"), nx.alias("nx"), ny.alias("ny"), F.when(F.size(geotransform) >= 6, steps).otherwise(geotransform).alias("geotransform"))


PARAMS = [
    # Region, tile, uplift, concavity, hilltop curvature, steepness, K, D.
    ("AP", 1, 5.5e-5, 0.562, 1.99e-2, 138.555, 4.0e-7, 2.8e-3),
    ("AP", 2, 5.5e-5, 0.592, 1.944e-2, 190.918, 2.9e-7, 2.8e-3),
    ("AP", 3, 5.5e-5, 0.542, 2.06e-2, 111.454, 4.9e-7, 2.7e-3),
    ("AP", 4, 5.5e-5, 0.438, 2.194e-2, 27.907, 2.0e-6, 2.5e-3),
    ("AP", 5, 5.5e-5, 0.400, 2.199e-2, 15.468, 3.6e-6, 2.5e-3),
    ("GM", 1, 1.47e-4, 0.379, 1.442e-2, 6.539, 2.2e-5, 1.0e-2),
    ("GM", 2, 1.47e-4, 0.308, 1.45e-2, 2.414, 6.1e-5, 1.0e-2),
    ("GM", 3, 1.47e-4, 0.417, 7.11e-3, 7.720, 1.9e-5, 2.1e-2),
    ("GM", 4, 1.47e-4, 0.313, 1.496e-2, 4.153, 3.5e-5, 9.8e-3),
    ("GM", 5, 1.47e-4, 0.300, 1.635e-2, 2.507, 5.9e-5, 9.0e-3),
]


def params(spark: SparkSession) -> DataFrame:
    """Parameters of the study tiles, with the initial guesses K0 = U / steepness and D0 = U / curvature."""
    table = spark.createDataFrame(PARAMS, "region string, tile int, u double, theta double, hilltop_curvature double, steepness double, k double, d double")
    return table.withColumn("k0", F.col("u") / F.col("steepness")).withColumn("d0", F.col("u") / F.col("hilltop_curvature"))
