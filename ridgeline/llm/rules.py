"""Quality rules: fixed base rules, and a log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words fall into 2^18 buckets. Two multinomials over the buckets are
counted on all documents: one of the raw corpus, one of the documents named as trusted (the target). A
document's score is the mean, over its n-grams, of the logarithm of target to raw probability, without
its own share in either. The target is smoothed towards the raw corpus, so a bucket that no trusted
document holds costs the more the larger the target is. Every document whose score is at or above the threshold
is kept; unless one is given, it is the score that all but ``missed`` of the trusted documents reach.

Tasks count into dense vectors of fixed size, which are added up as a tree; both vectors (4 MB, whatever
the corpus) are sent to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import kept, pieces, small_batches
from ridgeline.llm.vectors import PARTS, dense, segments, tree_sum
from ridgeline.session import stage, unstage, use_package

BITS = 18
MISSED = 0.005
"""The share of trusted documents that may score below the threshold."""
GRID = 1000
"""Scores are compared in steps of 1 / GRID when the threshold is sought."""
MEMO_WORDS = 150_000
FEWEST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


class Grams:
    """Buckets of the words and word pairs of a text; remembers words (bounded)."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.memo: dict[bytes, int] = {}

    def buckets(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets, and how many n-grams fall into each."""
        from xxhash import xxh3_64_intdigest

        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxh3_64_intdigest(w.lower())
        one = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.unique((np.concatenate([one, two]) >> self.shift).astype(np.int64), return_counts=True)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a run of three that the text holds at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(codes[:-1] * len(number) + codes[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * len(number) + codes[2:], return_inverse=True, return_counts=True)
    again, covered = times[which] > 1, np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, ...]:
    """The columns of BASE."""
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def count_grams(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of buckets over all rows and over the trusted ones. docs: _text, _trusted."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = kept(("grams", bits), lambda: Grams(bits))
        counts = np.zeros(2 * size, np.int64)
        for whole in batches:
            for batch in pieces(whole, "_text"):
                for text, trusted in zip(batch.column("_text").to_pylist(), batch.column("_trusted").to_pylist(), strict=True):
                    u, n = grams.buckets((text or "").encode().split())
                    counts[u] += n
                    if trusted:
                        counts[size + u] += n
        yield from segments(counts, TaskContext.get().partitionId())

    summed = tree_sum(docs.select("_text", "_trusted").mapInArrow(run, PARTS))
    both = dense(summed, 2 * size)
    unstage(summed)
    return both[:size], both[size:]


def log_ratio(own: np.ndarray, at: np.ndarray, raw: np.ndarray, target: np.ndarray, totals: tuple[int, int], trusted: bool) -> float:
    """Mean log ratio of target to raw probability over a document's n-grams, without the document itself."""
    size, m = len(raw), int(own.sum())
    if not m:
        return 0.0
    in_raw = (raw[at] - own + 1) / (totals[0] - m + size)
    in_target = (target[at] - own * trusted + size * in_raw) / (totals[1] - m * trusted + size)
    return float((np.log(in_target / in_raw) * own).sum() / m)


def score_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", missed: float = MISSED, threshold: float | None = None, bits: int = BITS) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Words are what stands between blanks (space, tab to carriage return). base_failed: fewer than 50
    words, or over half of them in runs of three that repeat. trusted: a table with ``id_col``.

    A null or empty text has no words, fails the base rules and scores 0. A null id is never trusted. Without
    trusted documents that pass the base rules all scores are compared with 0. Rows that share an id are judged one by one, equal texts
    of equal trust alike, a score that ties with the threshold is kept. A text of any length is read whole;
    no rows give no rows; other columns are ignored.
    """
    use_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    # written first, so Spark knows how many there are: it broadcasts few and shuffles both sides for many
    ids = stage(trusted.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().withColumn("_is", F.lit(True)), "trusted")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id", "left").select("_id", "_text", F.coalesce("_is", F.lit(False)).alias("_trusted"))
    raw, target = count_grams(rows, bits)
    model = docs.sparkSession.sparkContext.broadcast((raw, target, (int(raw.sum()), int(target.sum()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = kept(("grams", bits), lambda: Grams(bits))
        raw, target, totals = model.value
        for whole in batches:
            for batch in pieces(whole, "_text"):
                counts, scores = [], []
                for text, of_target in zip(batch.column("_text").to_pylist(), batch.column("_trusted").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    at, own = grams.buckets(words)
                    counts.append(base_counts(text or "", words))
                    scores.append(log_ratio(own, at, raw, target, totals, of_target))
                columns = np.array(counts, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_trusted"), *(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(scores, pa.float64())], names=names)

    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _trusted boolean, {BASE}, score double"
    names = ["_id", "_trusted", *(c.split()[0] for c in BASE.split(", ")), "score"]
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = stage(rows.mapInArrow(run, schema).withColumn("base_failed", failed), "scored")
    model.unpersist()
    unstage(ids)
    least = lowest_kept(scored, missed) if threshold is None else threshold
    names = [n for n in names if n not in ("_id", "_trusted", "score")]
    return scored.select(F.col("_id").alias(id_col), *names, "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= least)).alias("kept"))


def lowest_kept(scored: DataFrame, missed: float) -> float:
    """The step of 1 / GRID at or below which at most ``missed`` of the trusted documents lie. The steps that
    occur are few, whatever the corpus: a mean of logarithms of ratios is between -50 and 50."""
    steps = scored.where("_trusted AND NOT base_failed").groupBy(F.floor(F.col("score") * GRID).alias("step")).count().orderBy("step").collect()
    below, most = 0, missed * sum(r["count"] for r in steps)
    for r in steps:
        below += r["count"]
        if below > most:
            return r["step"] / GRID
    return 0.0
