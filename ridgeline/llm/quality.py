"""Quality classifier from weak labels.

Heuristic labellers vote on every document (+1 good, -1 junk, 0 no vote). Expectation-maximisation
over the counts of vote patterns, taken over all documents, estimates how each labeller votes on good
and on junk documents, and so a posterior for every pattern. The posteriors of a bounded sample of
documents then train a linear scorer over hashed features, which judges every document by what its
text looks like, not by the labellers' thresholds. No hand-made label is used.

Texts are read once: votes and compact features are written beside the rows; counting, sampling and
scoring then work on these few numbers, without Python.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import kept, with_arrow_columns
from ridgeline.session import stage

LABELLERS = ["decorated words", "marks", "shouting", "word ends", "stutter", "triples", "narrow windows", "table", "no small words"]
# A statistic above the first bound is a vote for junk, below the second one for good.
JUNK = {"decorated words": 0.15, "marks": 0.15, "shouting": 0.3, "word ends": 0.5, "stutter": 0.2, "triples": 0.1, "narrow windows": 0.6, "table": 0.15, "no small words": 0.92}
GOOD = {"decorated words": 0.02, "marks": 0.06, "shouting": 0.05, "word ends": 0.35, "stutter": 0.03, "triples": 0.01, "narrow windows": 0.3, "table": 0.03, "no small words": 0.75}
TRUST = 0.1
"""Weight of the prior belief in the labellers, as a share of the documents."""
DIMENSIONS = 1024
"""Hashed features."""
FIT_ROWS = 20_000
"""Documents that train the scorer, chosen by a hash of their id; everything else uses all rows."""
MEMO_WORDS = 200_000
"""Words a task remembers; it forgets all of them when there are more."""
JUNK_BOUNDS = np.array([JUNK[k] for k in LABELLERS])
GOOD_BOUNDS = np.array([GOOD[k] for k in LABELLERS])
STATISTICS = [crc32(f"\0{k}".encode()) % DIMENSIONS for k in LABELLERS]

PLAIN_WORDS = 5
"""Every text is judged as if it had this many plain words more, so a few words don't decide alone."""
PLAIN = np.full(PLAIN_WORDS, crc32(b"a") % DIMENSIONS, np.int32)

DECORATED = re.compile(r"([*$&%#@^~=_+<>|\\])\1")
SHAPES = [(re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1"), (re.compile(r"\s+"), " ")]


def case_of(word: str) -> str:
    return "A" if len(word) > 1 and word.isupper() else "Aa" if word[:1].isupper() else "a"


@functools.lru_cache(100_000)
def hashed(shape: str) -> int:
    return crc32(shape.encode()) % DIMENSIONS


def word_shape(word: str) -> str:
    """Letters become ``a``, ``A`` (all capitals) or ``Aa``; digits ``0``; repeated marks two of them."""
    case = case_of(word)
    for rx, to in SHAPES:
        word = rx.sub(case if to == "a" else to, word)
    return word[:12]


class Reader:
    """Statistics of texts and the hashed shapes of their words; what depends on a word alone is remembered."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.facts = np.zeros((0, 8), np.int32)

    @staticmethod
    def of_word(word: str) -> tuple[int, ...]:
        """Decorated, all capitals, without letter or digit, ends in a mark, small; marks, length, hashed shape."""
        size = len(word)
        if word.isalpha():
            return 0, int(size > 2 and word.isupper()), 0, 0, int(size <= 3), 0, size, hashed(case_of(word))
        if word[:-1].isalpha() and not word[-1].isalnum():  # letters and one mark
            return 0, int(size > 2 and word.isupper()), 0, 1, int(size <= 3), 1, size, hashed((case_of(word) + word[-1])[:12])
        if word.isdecimal():
            return 0, 0, 0, 0, int(size <= 3), 0, size, hashed("0")
        plain = sum(map(str.isalnum, word))
        return (
            int(bool(DECORATED.search(word))),
            int(len(word) > 2 and word.isupper()),
            int(not plain),
            int(not word[-1].isalnum()),
            int(len(word) <= 3 and plain > 0),
            size - plain,
            size,
            hashed(word_shape(word)),
        )

    def read(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """For each text its statistics (in the order of LABELLERS) and its words' shapes; None without words."""
        if len(self.number) > MEMO_WORDS:
            self.__init__()
        split = [(t or "").split() for t in texts]
        fresh = list(set().union(*split).difference(self.number))
        if fresh:
            first = len(self.number)
            self.facts = np.concatenate([self.facts, np.array([self.of_word(w) for w in fresh], np.int32)])
            self.number.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return [self._statistics(words) if words else None for words in split]

    def _statistics(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, n)
        facts = self.facts[at]
        decorated, shouting, bare, ends, small, marks, chars = facts[:, :7].sum(0, dtype=np.int64).tolist()
        same = at[1:] == at[:-1]
        triples = int((same[1:] & same[:-1]).sum())
        rest = n % 20 if n > 20 else 0  # the last words are judged by the last twenty
        blocks = np.sort(np.concatenate([at[: n - rest], at[n - 20 :]]).reshape(-1, 20) if rest else at.reshape(-1, min(n, 20)), axis=1)
        again = (blocks[:, 1:] == blocks[:, :-1]).sum(1).tolist()
        narrow = sum(again[:-1]) + again[-1] * rest / 20 if rest else sum(again)
        m, letters = n + PLAIN_WORDS, chars + 5 * PLAIN_WORDS
        stats = [decorated / m, marks / letters, shouting / m, ends / m, int(same.sum()) / m, triples / m, narrow / m, bare / m, 1 - small / n if n >= 20 else 0.6]
        return np.array(stats), np.concatenate([facts[:, 7], PLAIN])


def vote(stats: np.ndarray) -> list[int]:
    """-1 above a labeller's bound for junk, 1 below its bound for good, else 0."""
    return np.where(stats > JUNK_BOUNDS, -1, np.where(stats < GOOD_BOUNDS, 1, 0)).tolist()


def features(stats: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: the share of each word shape, then the statistics; what shares a position adds up."""
    count = np.bincount(shapes)
    index = np.flatnonzero(count)
    return np.concatenate([index, STATISTICS]), np.concatenate([count[index] / len(shapes), stats])


VOTES, FEATURE, VALUE = "_quality_votes", "_quality_feature", "_quality_value"


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append votes (one for each of LABELLERS; none but zeros without words) and the hashed features
    (positions and values; empty without words) to every row."""

    def setup() -> Callable[[list[str | None]], list[pa.Array]]:
        reader = kept("quality reader", Reader)
        none = [0] * len(LABELLERS), np.zeros(0, np.int64), np.zeros(0)

        def work(texts: list[str | None]) -> list[pa.Array]:
            each = [(vote(r[0]), *features(*r)) if r else none for r in reader.read(texts)]
            ends = pa.array(np.cumsum([0, *(len(f) for _, f, _ in each)]).astype(np.int32))
            flat = lambda k, kind: pa.array(np.concatenate([e[k] for e in each]).astype(kind))
            return [pa.array([v for v, _, _ in each], pa.list_(pa.int8())), pa.ListArray.from_arrays(ends, flat(1, np.int32)), pa.ListArray.from_arrays(ends, flat(2, np.float64))]

        return work

    return with_arrow_columns(docs, text_col, f"{VOTES} array<tinyint>, {FEATURE} array<int>, {VALUE} array<double>", setup)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns.

    Returns the posterior of "good" for each pattern, and P(vote | class) as (class, labeller, vote
    -1/0/1). Classes: 0 junk, 1 good. Where it starts is also a prior belief, worth a share TRUST of the
    documents: a good document seldom draws a vote for junk, and documents are mostly good. It keeps
    the two classes from changing places or splitting documents some other way.
    """
    n, m = patterns.shape
    belief = np.array([[0.4, 0.3, 0.3], [0.01, 0.19, 0.8]])
    table = np.repeat(belief[:, None, :], m, axis=1)
    prior = start = np.array([0.2, 0.8])
    one_hot = np.eye(3)[patterns + 1]
    good = np.full(n, 0.5)
    weight_of = TRUST * counts.sum() + 1
    for _ in range(rounds):
        logs = np.log(prior)[:, None] + np.einsum("nmv,cmv->cn", one_hot, np.log(table))
        logs -= logs.max(0)
        p = np.exp(logs)
        good, before = p[1] / p.sum(0), good
        shares = np.stack([(1 - good) * counts, good * counts])
        for c in (0, 1):
            own = weight_of * start[c]
            table[c] = (np.einsum("n,nmv->mv", shares[c], one_hot) + own * belief[c]) / (shares[c].sum() + own)
        prior = (shares.sum(1) + weight_of * start) / (counts.sum() + weight_of)
        if np.abs(good - before).max() < 1e-9:
            break
    return good, table


def fit_scorer(features: list[tuple[list[int], list[float]]], target: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft targets by accelerated gradient descent; the last weight is the bias."""
    x = np.zeros((len(features), DIMENSIONS + 1))
    for row, (index, value) in enumerate(features):
        np.add.at(x[row], index, value)
    x[:, -1] = 1
    used = np.flatnonzero(np.abs(x).sum(0))
    x = x[:, used]
    share = max(target.mean(), 1e-6), max(1 - target.mean(), 1e-6)
    weight = target / share[0] + (1 - target) / share[1]
    weight /= weight.sum()
    step = 4 / np.linalg.norm((x * weight[:, None]).T @ x, 2)
    w = ahead = np.zeros(len(used))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40)))
        new = ahead - step * (x.T @ (weight * (p - target)) + ridge * ahead)
        w, ahead = new, new + t / (t + 3) * (new - w)
    out = np.zeros(DIMENSIONS + 1)
    out[used] = w
    return out


def train(rows: DataFrame, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights of the scorer, from described rows.

    Vote patterns of all documents are counted in Spark; there are at most 3^9 of them, so the counts
    fit the driver whatever the corpus. So does the bounded sample of feature vectors: the documents of
    the smallest hashes of their ids; of rows that tie, those of the smallest id, votes and features.
    """
    table = rows.groupBy(F.col(VOTES).alias("votes")).agg(F.count("*").alias("n")).collect()
    if not table:
        return np.zeros(DIMENSIONS + 1)
    table.sort(key=lambda r: r["votes"])
    patterns = np.array([r["votes"] for r in table])
    good, _ = fit_labellers(patterns, np.array([r["n"] for r in table], dtype=float))
    posterior = {tuple(r["votes"]): g for r, g in zip(table, good, strict=True)}
    known = rows.where(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), VOTES, FEATURE, VALUE)
    last = known.select("h").orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]
    if last is None:
        return np.zeros(DIMENSIONS + 1)
    sample = known.where(F.col("h") <= last).orderBy("h", "id", VOTES, FEATURE, VALUE).limit(fit_rows).collect()
    target = np.array([posterior[tuple(r[VOTES])] for r in sample])
    return fit_scorer([(r[FEATURE], r[VALUE]) for r in sample], target)


def score(feature: Column, value: Column, weights: np.ndarray) -> Column:
    """Probability (rounded to 6 places) that a document is good; 0 without features."""
    w = F.lit(weights[:-1].tolist())  # DIMENSIONS numbers
    z = F.lit(float(weights[-1])) + F.aggregate(F.zip_with(feature, value, lambda f, v: F.get(w, f) * v), F.lit(0.0), lambda a, x: a + x)
    held = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))
    return F.when(F.size(feature) > 0, F.round(1.0 / (1.0 + F.exp(-held)), 6)).otherwise(0.0)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, weights: np.ndarray | None = None, columns: list[str] | None = None) -> DataFrame:
    """Append quality_score and kept to every row.

    quality_score: probability (rounded to 6 places) that the document is good; kept: at least one
    half. A null text or one without words scores 0 and is not kept. Rows with a null id are judged
    but not used for training. Ties can't arise: a row's score depends on its text alone, so repeated
    texts get equal scores. A text of any length is read whole; no rows give no rows. ``columns``: those
    of ``docs`` to return (all unless given). Columns named like the two new ones are replaced.
    """
    names = [c for c in columns or docs.columns if c not in ("quality_score", "kept", VOTES, FEATURE, VALUE)]
    wanted = docs.select(*dict.fromkeys([*names, id_col, text_col]))
    rows = stage(described(wanted, text_col).select(*dict.fromkeys([*names, id_col]), VOTES, FEATURE, VALUE), "described")
    if weights is None:
        weights = train(rows, id_col, fit_rows)
    scored = rows.withColumn("quality_score", score(F.col(FEATURE), F.col(VALUE), weights))
    return scored.select(*names, "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))
