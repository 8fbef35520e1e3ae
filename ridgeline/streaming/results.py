"""Running summaries of results that arrive as files, with event time and late data.

The batch operators need whole groups; a stream keeps what adds up: counts, sums and sums of squares of
log ratios for each location, spacing and window of event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.slope_area import guarded_ratio


def read_results(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of result rows (ts, location, dx, ks_obs, ks_mod) from Parquet files as they arrive."""
    schema = "ts timestamp, location string, dx double, ks_obs double, ks_mod double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_ratios(results: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, location, dx, n, mean_log_ratio, sd_log_ratio of valid ratios; rows later than ``late``
    behind the newest are left out."""
    ratio = F.log10(guarded_ratio(F.col("ks_mod"), F.col("ks_obs")))
    kept = results.withWatermark("ts", late).withColumn("r", ratio).where(F.col("r").isNotNull())
    sums = kept.groupBy(F.window("ts", window).alias("window"), "location", "dx").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(F.col("window.start").alias("start"), "location", "dx", "n", mean.alias("mean_log_ratio"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd_log_ratio"))
