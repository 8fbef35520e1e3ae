"""A stream gives the sums of a batch."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ridgeline.streaming.results import read_results, running_ratios


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(60).select(
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 300).alias("ts"), F.lit("A").alias("location"), (F.col("id") % 2).cast("double").alias("dx"),
        F.lit(1.0).alias("ks_obs"), F.when(F.col("id") % 7 > 0, F.pow(F.lit(10.0), F.col("id") % 3)).alias("ks_mod"),
    )
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = running_ratios(read_results(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("ratios").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["dx"]): (r["n"], r["mean_log_ratio"]) for r in spark.table("ratios").collect()}
    want = running_ratios(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert len(want) == len(got) and all(math.isclose(got[r["start"], r["dx"]][1], r["mean_log_ratio"], abs_tol=1e-12) and got[r["start"], r["dx"]][0] == r["n"] for r in want)
