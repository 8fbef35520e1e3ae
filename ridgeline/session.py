"""Where intermediate tables live, and how a job cuts its lineage.

Executors share only the folder named by ``spark.checkpoint.dir``. Everything a job wants to keep
between two of its steps is written there as Parquet, so a lost executor costs a re-read, not a
recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_CLEANED: set[str] = set()


def use_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed or sent with ``--py-files``; this path then finds nothing."""
    here = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder
    of its own; a cluster session is refused, since a machine-local folder would be invisible to others.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="ridgeline-"))
    path = f"{base.rstrip('/')}/ridgeline-{app}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended: whoever owns the folder clears it
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it (lineage cut)."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.ridgeline_path = path  # for unstage()
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table written by :func:`stage` once nothing reads it any more."""
    if path := getattr(df, "ridgeline_path", None):
        remove(df.sparkSession, path)


PACK = 50_000
"""Rows of small groups that a Python call gets together."""


def in_packs(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, least: int = PACK) -> DataFrame:
    """What ``work`` makes of the groups of ``rows``, as ``groupBy(*keys).applyInPandas`` would, but of several whole groups at a
    time: many small ones then don't cost a call each. Groups are dealt and sorted by key, and a call gets
    those that follow each other, at least as many rows as given; so memory holds these or one group, whichever is more."""
    use_package(rows.sparkSession)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, enough = [], 0, least
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < enough:
                continue
            whole = pd.concat(held, ignore_index=True)
            other = np.nonzero((whole[keys] != whole[keys].iloc[-1]).any(axis=1).to_numpy())[0]
            if len(other):  # the last group may go on
                cut = other[-1] + 1
                yield work(whole.iloc[:cut].reset_index(drop=True))
                whole, enough = whole.iloc[cut:], least
            held, size = [whole], len(whole)
            enough = max(enough, 2 * size)
        if size:
            yield work(pd.concat(held, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(some, schema)
