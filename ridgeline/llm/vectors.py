"""Dense count vectors of tasks, cut into segments and added up as a tree.

A task adds what it sees to one dense vector and hands it on as segments of bounded length. Segments are
added up by sixteen tasks' vectors at a time until one is left for each, so no task ever holds more than
sixteen segments of a key, however many tasks there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import stage, unstage

SEGMENT = 2048
FAN = 16
PARTS = "segment bigint, part bigint, counts array<bigint>"


def segments(vector: np.ndarray, part: int, first: int = 0, length: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """A task's vector as rows of PARTS; segments of zeros are left out. ``first``: number of the first segment."""
    for k in range(0, len(vector), length):
        piece = vector[k : k + length]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([first + k // length], pa.int64()), pa.array([part], pa.int64()), pa.array([piece], pa.list_(pa.int64()))], names=["segment", "part", "counts"])


def tree_sum(parts: DataFrame) -> DataFrame:
    """Rows of PARTS -> (segment, counts): the element-wise sum for each segment. Segments of one number are
    of one length. No rows give no rows."""
    rows = stage(parts, "vectors")
    top = rows.agg(F.max("part")).first()[0] or 0
    total = lambda many: F.aggregate(F.slice(many, 2, FAN), F.get(many, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    out: DataFrame = rows
    while True:
        top //= FAN
        grouped = out.groupBy("segment", F.floor(F.col("part") / FAN).alias("part")).agg(F.collect_list("counts").alias("many"))
        out = grouped.select("segment", "part", total(F.col("many")).alias("counts"))
        if top == 0:
            break
    done = stage(out.select("segment", "counts"), "summed")
    unstage(rows)
    return done


def dense(summed: DataFrame, size: int, length: int = SEGMENT) -> np.ndarray:
    """The whole vector of ``size`` (bounded by the caller) from the rows of :func:`tree_sum`."""
    out = np.zeros(-(-size // length) * length, np.int64)
    for r in summed.toLocalIterator():
        out[r["segment"] * length : r["segment"] * length + len(r["counts"])] = r["counts"]
    return out[:size]
