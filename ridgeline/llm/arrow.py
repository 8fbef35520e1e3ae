"""Arrow batches in tasks: adding columns to the rows of a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ridgeline.session import use_package


_KEPT: dict = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the latest model with its bounded memory."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def pieces(batch: pa.RecordBatch, text_col: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece holds much more than ``most_bytes``; bounds memory per step."""
    col = batch.column(batch.schema.get_field_index(text_col))
    if pa.types.is_list(col.type):
        lengths = pc.multiply(pc.list_value_length(col), 16)  # numbers weigh more as Python objects
    else:
        lengths = pc.binary_length(col)
    lengths = lengths.fill_null(0).to_pylist()
    start = size = 0
    for row, n in enumerate(lengths):
        size += n
        if size >= most_bytes:
            yield batch.slice(start, row + 1 - start)
            start, size = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def small_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Let no Arrow batch hold more than 8 MB: long texts come in fewer rows, and a task's memory stays bounded.

    The setting is read when a plan runs, so it stays changed; a smaller bound of the caller's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", spark.conf.get(name).lower()).groups()
    now = int(number) << 10 * " kmgtp".index(unit or " ")
    if not 0 < now <= most_bytes:
        spark.conf.set(name, str(most_bytes))


def with_arrow_columns(df: DataFrame, text_col: str, new: str, setup: Callable[[], Callable[[list], list[pa.Array]]], raw: bool = False) -> DataFrame:
    """Append the columns of the DDL string ``new``; ``setup()`` runs once a task and returns a function
    from a list of the column's values (null: None) to one Arrow array for each new column. ``raw``: the
    function takes the Arrow array itself."""
    use_package(df.sparkSession)
    small_batches(df.sparkSession)
    added = T.StructType.fromDDL(new)
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for whole in batches:
            for batch in pieces(whole, text_col):
                values = batch.column(batch.schema.get_field_index(text_col))
                values = values if raw else values.to_pylist()
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(values)], names=schema.names)
                del values
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
