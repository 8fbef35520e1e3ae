"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches of rising ids. A batch's line hashes are reduced to one row each, anti-
joined by merge with every run so far, and what is new becomes a run of its own: hash-bucketed and
sorted, a file a bucket, so the next merge neither shuffles nor sorts it again. Runs can be kept in a
folder of their own and opened again for the next day's documents. When a level holds
``FAN_IN`` runs they are compacted into one run of the next level. A run row is a line hash with the
smallest document id that holds the line; all other documents lose the line.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.session import remove, shared_dir, stage, unstage

FAN_IN = 3
BATCHES = 4
MIN_KEY = 10
"""Keys of fewer code points are never dropped."""
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without outer blanks, A-Z lower-cased (other letters stay)."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


@contextmanager
def runs_read_sorted(spark: SparkSession) -> Iterator[None]:
    """Plans made inside trust the order of runs: each bucket is one sorted file, so a merge needs no sort."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Runs of (h1, h2, first) on levels; keys of different runs are disjoint.

    A run is a folder ``<level>-<first batch>-<last batch>-<buckets>`` below ``path``, known to the session
    as a bucketed table. With a ``path`` of their own the runs outlive the session: opening them again
    finds all finished runs, and what a lost compaction left over is passed over. Without one they
    lie in the job's shared folder and are dropped with it. The session lists runs in its catalog while
    they are open; :meth:`close` takes them off it, :meth:`drop` deletes them. ``kind``: the type of ids.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None, path: str | None = None, kind: str = "bigint"):
        self.spark, self.fan_in, self.kind = spark, fan_in, kind
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = (path or f"{shared_dir(spark)}/runs-{uuid.uuid4().hex[:12]}").rstrip("/")
        self.prefix = f"ridgeline_run_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.batches = 0
        found = [tuple(map(int, name.split("-"))) for name in finished(spark, self.path)]
        if found:
            self.buckets = found[0][3]
        whole = [r for r in found if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)]
        for run in sorted(whole, key=lambda r: r[1]):
            self._list(run)

    def runs(self) -> list[str]:
        """Table names, newest and smallest first."""
        return [self._name(run) for level in self.levels for run in reversed(level)]

    def table(self) -> DataFrame | None:
        """All keys with their first document; None without runs."""
        return self._union([run for level in self.levels for run in level])

    def _union(self, runs: list[tuple[int, ...]]) -> DataFrame | None:
        """Rows of some runs, read as plain files: a union of bucketed tables would pass for dealt already."""
        parts = [self.spark.read.schema(f"h1 BIGINT, h2 BIGINT, first {self.kind}").parquet(self._folder(run)) for run in runs]
        return reduce(DataFrame.union, parts) if parts else None

    def append(self, keys: DataFrame) -> None:
        """Add a batch of (h1, h2, first), keys unique, whose documents come after all earlier ones."""
        with runs_read_sorted(self.spark):
            for name in self.runs():
                keys = keys.join(self.spark.table(name).hint("merge"), HASH, "left_anti")
            self._write(keys, (0, self.batches, self.batches, self.buckets))
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            self._write(self._union(old), (level + 1, old[0][1], old[-1][2], self.buckets))
            self._drop(old)
            level += 1

    def _name(self, run: tuple[int, ...]) -> str:
        return "_".join([self.prefix, *map(str, run)])

    def _folder(self, run: tuple[int, ...]) -> str:
        return f"{self.path}/{'-'.join(map(str, run))}"

    def _write(self, keys: DataFrame, run: tuple[int, ...]) -> None:
        dealt = keys.select(*HASH, F.col("first").cast(self.kind).alias("first")).repartition(self.buckets, *HASH)
        dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self._folder(run)).mode("overwrite").saveAsTable(self._name(run))
        self._list(run, made=True)

    def _list(self, run: tuple[int, ...], made: bool = False) -> None:
        while len(self.levels) <= run[0]:
            self.levels.append([])
        if not made:
            keys = ", ".join(HASH)
            self.spark.sql(f"CREATE TABLE {self._name(run)} (h1 BIGINT, h2 BIGINT, first {self.kind}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {run[3]} BUCKETS LOCATION '{self._folder(run)}'")
        self.levels[run[0]].append(run)
        self.batches = max(self.batches, run[2] + 1)

    def _drop(self, gone: list[tuple[int, ...]]) -> None:
        for run in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
            remove(self.spark, self._folder(run))

    def close(self) -> None:
        """Take the runs off the session's catalog; their files stay."""
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []

    def drop(self) -> None:
        """Delete the runs."""
        self._drop([run for level in self.levels for run in level])
        self.levels = []
        remove(self.spark, self.path)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the run folders below ``path`` whose writing has ended."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    return [f.getPath().getName() for f in files.listStatus(where) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, min_key: int = MIN_KEY, others: list[str] | None = None, runs: LineRuns | None = None
) -> DataFrame:
    """One row per input row: id, ``others``, n_lines, n_dropped, and the kept text as ``text_col``.

    A line is what ``\\n`` ends; its key is the line without outer blanks and with A-Z lower-cased.
    A key of at least ``min_key`` code points held by several documents stays, with all its lines, in
    the one of smallest id and loses all its lines elsewhere. Null or empty text is one empty line.
    Rows with a null id lose nothing and take nothing. Rows that share an id count as one document.
    A text all of whose lines go is empty; a text of any length is split whole; no rows give no rows.
    Columns not in ``others`` are ignored.

    ``runs``: open runs of earlier calls, whose documents come before all of these; the documents'
    lines are added to them. A document whose id comes before one that the runs hold as first is refused
    (ValueError, nothing added), since that one's lines were kept already. Documents are dealt into ``batches`` by id (one where ids are no numbers).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), *(others or []), text.alias("_text"), F.xxhash64(text).alias("_row"))

    numeric = isinstance(docs.schema[id_col].dataType, T.NumericType)
    cuts = [k / batches for k in range(1, batches)] if numeric else []
    bounds = rows.agg(F.percentile_approx(id_col, F.array(*map(F.lit, cuts))).alias("b")).first()["b"] or [] if cuts else []
    split = rows.where(F.col(id_col).isNotNull()).select(id_col, "_row", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    keyed = split.select(F.col(id_col).alias("doc"), "_row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_key)
    lines = stage(keyed.select("doc", "_row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), batch_of("doc", bounds).alias("batch")), "lines", ["batch"])

    if runs is not None and (held := runs.table()) is not None:
        last, least = held.agg(F.max("first")).first()[0], lines.agg(F.min("doc")).first()[0]
        if last is not None and least is not None and least < last:
            unstage(lines)
            raise ValueError(f"document {least} comes before document {last}, whose lines the runs hold")

    known = runs or LineRuns(spark, kind=docs.schema[id_col].dataType.simpleString())
    try:
        for b in range(len(bounds) + 1):
            known.append(lines.where(F.col("batch") == b).groupBy(*HASH).agg(F.min("doc").alias("first")))
        gone = lines.join(known.table(), HASH).where(F.col("first") < F.col("doc"))
        drops = stage(gone.groupBy("doc", "_row").agg(F.collect_set("pos").alias("gone")), "dropped")
    finally:
        if runs is None:
            known.drop()
        unstage(lines)

    all_lines = F.split("_text", "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(all_lines, i)), "\n"))
    # dropped lines grow with the corpus: one strategy at every size, never a broadcast
    theirs = drops.select(F.col("doc").alias("_doc"), F.col("_row").alias("_of"), "gone").hint("merge")
    joined = rows.join(theirs, (F.col(id_col) == F.col("_doc")) & (F.col("_row") == F.col("_of")), "left")
    return joined.select(
        id_col,
        *(others or []),
        F.size(all_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias(text_col),
    )


def batch_of(col: str, bounds: list) -> Column:
    """The batch of a document id: how many bounds it exceeds."""
    return reduce(lambda a, b: a + (F.col(col) > b).cast("int"), bounds, F.lit(0))


DEDUP_SQL = r"""
WITH rows AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.doc_id, k.pos, k.line, coalesce(f.first < k.doc_id, false) AS gone FROM keyed k LEFT JOIN firsts f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
