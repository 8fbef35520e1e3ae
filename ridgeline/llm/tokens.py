"""Token counts by prefix dynamic programming.

For a sentencepiece BPE model with an identity normaliser, the operator stores, for every prefix of a
text (by code points), the exact number of tokens the library gives for that prefix. Questions such
as "how many tokens has this text", "where must it be cut to fit 4,096 tokens" or "how many tokens
lie between two positions of the cut" are then array look-ups; nothing is encoded again.

The recurrence: the last token of the encoding of a prefix is the one token t that ends there such
that the last token before it and t, encoded together, stay apart. Its count is one more than the
count of the prefix before t. Pieces contain a word mark only at their start (this is checked), so the
counts of words add up and the programme runs over a word, memoised, not over the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import kept, with_arrow_columns

MARK = "▁"
MEMO_WORDS = 250_000
"""Words a task remembers; it forgets all of them when there are more."""
MEMO_PAIRS = 1_000_000
LAST = float("-inf")
MEMO_CHARS = 48
"""Longer words are not remembered."""


class PrefixCounter:
    """Prefix counts of words under one model."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True):
        """pieces: normal pieces and their scores."""
        if any(MARK in p[1:] and p.strip(MARK) for p in pieces):
            raise ValueError("a piece has a word mark inside; words can't be counted apart")
        self.score = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte_fallback = byte_fallback
        self.made: dict[str, tuple] = {}
        #: for each piece that encodes to itself: tokens before it, and whether they stay apart
        self.apart: dict[str, dict[str, bool]] = {p: {} for p in pieces if self.spines(p)[0]}
        self.pairs = 0
        self.memo: dict[str, bytes] = {}

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """BPE of a short text: merge the best-scored pair, leftmost first, until none is a piece.

        Also the last pair merged."""
        parts, score, last = list(text), self.score, None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def spines(self, piece: str) -> tuple[bool, bool, list[tuple[str, float]], list[tuple[str, float]]]:
        """How a piece comes about: whether it encodes to itself, whether its merges come in order of
        score, and the symbols that stand at its left and right end on the way, largest first, each
        with the score of the merge that takes it up."""
        known = self.made.get(piece)
        if known is None:
            if len(piece) == 1:
                known = (True, True, [(piece, LAST)], [(piece, LAST)])
            else:
                parts, pair = self.merge(piece)
                if parts != [piece]:
                    known = (False, False, [], [])
                else:
                    score, (a, b) = self.score[piece], pair
                    _, a_orderly, a_left, _ = self.spines(a)
                    _, b_orderly, _, b_right = self.spines(b)
                    orderly = a_orderly and b_orderly and all(len(x) == 1 or self.score[x] > score for x in pair)
                    known = (True, orderly, [(piece, LAST), (a, score), *a_left[1:]], [(piece, LAST), (b, score), *b_right[1:]])
            self.made[piece] = known
        return known

    def stays_apart(self, a: str, b: str) -> bool:
        """Whether a and b, encoded together, come out as a and b.

        They don't if two symbols that stand side by side at the border at some time make a piece that
        comes before what else would take them up (on a tie the left merge comes first)."""
        if self.pairs >= MEMO_PAIRS:
            self.pairs = 0
            for known in self.apart.values():
                known.clear()
        (_, a_orderly, _, right), (_, b_orderly, left, _) = self.spines(a), self.spines(b)
        if a_orderly and b_orderly and a[:2] != 2 * MARK:
            apart = not any(self.meets(x, y, x_up, y_up) for x, x_up in right for y, y_up in left)
        else:
            apart = self.merge(a + b)[0] == [a, b]
        self.apart[b][a] = apart
        self.pairs += 1
        return apart

    def meets(self, x: str, y: str, x_up: float, y_up: float) -> bool:
        score = self.score
        own = score.get(x + y)
        if own is None:
            return False
        made = min(own, score[x] if len(x) > 1 else own, score[y] if len(y) > 1 else own)
        return made > x_up and made >= y_up

    def learn(self, words: set[str]) -> None:
        """Run the programme over words (marks, then characters without marks) and remember packed counts.

        Words go in sorted order: what a word shares with the one before it is not computed again."""
        whole, longest, memo, score = self.apart.get, self.longest, self.memo, self.score
        count, last, before = [0], [""], ""
        for word in sorted(words):
            n, shared = len(word), 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            before = word
            marks = n - len(word.lstrip(MARK))
            if marks > 1 or shared < marks:
                shared = 0
            del count[shared + 1 :], last[shared + 1 :]
            if shared < marks:  # merges of marks all tie, so the leftmost goes first: a stack
                run: list[str] = []
                for _ in range(marks):
                    run.append(MARK)
                    while len(run) > 1 and run[-2] + run[-1] in score:
                        run[-2:] = [run[-2] + run[-1]]
                    count.append(len(run))
                    last.append(run[-1])
                shared = marks
            for i in range(shared + 1, n + 1):
                for start in range(i - 1, max(0, i - longest) - 1, -1):
                    befores = whole(word[start:i])
                    if befores is None:
                        continue
                    if start:
                        apart = befores.get(last[start])
                        if apart is None:
                            apart = self.stays_apart(last[start], word[start:i])
                        if not apart:
                            continue
                    count.append(count[start] + 1)
                    last.append(word[start:i])
                    break
                else:  # no piece: the character's bytes
                    t = word[i - 1]
                    count.append(count[i - 1] + (len(t.encode()) if self.byte_fallback else 1))
                    last.append(t)
            memo[word] = array("i", count[1:]).tobytes()

    def prefix_counts(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of every non-empty prefix of each text; the library puts a word mark before a text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        words = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = set().union(*words).difference(memo)
        self.learn(fresh)
        out = [self._add_up(ws) for ws in words]
        for w in fresh:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out

    def _add_up(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=np.int32)
        flat = np.frombuffer(b"".join(map(self.memo.__getitem__, words)), dtype=np.int32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        totals = flat[np.cumsum(lengths) - 1].astype(np.int64)
        before = np.cumsum(totals) - totals
        return (flat + np.repeat(before, lengths)).astype(np.int32)[1:]


WORDS = re.compile(f"{MARK}+[^{MARK}]*")


def model_pieces(model: bytes) -> dict[str, float]:
    """Normal pieces and scores of a sentencepiece model; refuses models that need more than merges."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for probe in ("ﬁ Ａ", "a  b ", "<s>x</s>"):
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model's normaliser changes texts")
    normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): sp.get_score(i) for i in normal}


def read_file(path: str) -> bytes:
    """A vocabulary file, read by the driver."""
    with open(path, "rb") as f:
        return f.read()


def prefix_token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """One row per input row: id, text, and ``out``, an array of ints with an entry for every prefix.

    Entry k (from 1) is the exact token count of the first k code points. A null or empty text has an
    empty array. Special strings inside a text are plain text. Repeated rows stay; other columns are
    ignored. Executors get the pieces in a broadcast variable (one vocabulary, checked to be small).
    """
    spark = docs.sparkSession
    pieces = model_pieces(read_file(model_path))
    if len(pieces) > 1_000_000:
        raise ValueError("vocabulary too large to broadcast")
    shared = spark.sparkContext.broadcast(pieces)

    def setup() -> Callable[[list[str | None]], list[pa.Array]]:
        counter = kept(("prefix counts", model_path), lambda: PrefixCounter(shared.value))

        def work(texts: list[str | None]) -> list[pa.Array]:
            each = counter.prefix_counts([t or "" for t in texts])
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each) if each else np.zeros(0, np.int32)))]

        return work

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    return with_arrow_columns(rows, text_col, f"{out} array<int>", setup)


def total_tokens(prefix: Column) -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at(prefix, F.lit(-1)), F.lit(0)).cast("long")


def chars_within(prefix: Column, budget: int) -> Column:
    """Length, in code points, of the longest prefix of at most ``budget`` tokens.

    Counts may fall when a character completes a longer token, so the last fitting entry is sought."""
    fits = F.transform(prefix, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0)).cast("long")


def truncate(text: Column, prefix: Column, budget: int) -> Column:
    """The longest prefix of the text that encodes to at most ``budget`` tokens."""
    return F.substr(text, F.lit(1), chars_within(prefix, budget).cast("int"))
