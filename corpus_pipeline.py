"""A corpus through five operators: quality, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. Between stages the rows are written as
Parquet and read again.

Null and empty texts: the classifier rejects them, the other stages keep them. Rows with a null id are
never copies or leaks. Repeated rows go or stay together; the smallest id of a group stays, so ties don't
arise. Texts of any length are worked on whole. No rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, decontam, lines, neardup, quality
from ridgeline.session import stage

LEAST_WORDS = 6
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id is not in ``gone``. The ids are written first, so Spark knows their size: it
    broadcasts them below its threshold and shuffles both sides above it."""
    ids = stage(gone.select("doc_id").distinct(), "gone")
    return docs.join(ids, "doc_id", "left_anti").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.score_quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows, and a document without lines left stays, empty."""
    kept = lines.dedup_lines(docs, others=["lang", "source"])
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (five-word shingles, similarity 0.8) the document of the smallest id stays."""
    return without(docs, neardup.near_duplicates(docs, words=5).where("NOT kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. An item of fewer than LEAST_WORDS words is no evidence: it
    would take away every document that happens to hold a phrase."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontam.find_leaks(docs, items.where(F.size(decontam.words(F.col("text"))) >= LEAST_WORDS)))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether decoding gave the text back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(docs, path, others=["lang", "source"], digest="_digest"), path)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.xxhash64("decoded") == F.col("_digest")).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("bpe encoding and decoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
