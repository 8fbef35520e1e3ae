"""Byte-pair encoding with a segment tree, and decoding.

A word's adjacent pairs are the leaves of a segment tree; a leaf holds the pair's merge rank and, as
the lower digits, its position, so the root is the leftmost pair of the lowest rank. A merge changes
three leaves, each in logarithmic time, until no pair can merge. The trees of many words of like
length stand in one numpy array and take their steps together; a few words, however long, have a tree
each. A text's repeated words are encoded once and remembered (bounded).
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import kept, with_arrow_columns

NONE = np.int64(1) << 62
MEMO_WORDS = 150_000
"""Words a task remembers; it forgets all of them when there are more."""
MEMO_CHARS = 48
"""Longer words are not remembered."""
CELLS = 1 << 19
"""Leaves that step together; bounds a task's memory."""
FEW = 24
"""Words of like length that are stepped one by one: a step of numpy costs as much for one word as for these."""

# Fixed value: how byte-level models split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else 256, 257, ..."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a byte-level BPE file says: ids, merges and added tokens."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        bpe, before = model["model"], model["pre_tokenizer"]
        if bpe["type"] != "BPE" or bpe.get("byte_fallback") or bpe.get("dropout") or bpe.get("ignore_merges") or model["normalizer"]:
            raise ValueError("only plain byte-level BPE without a normaliser")
        if before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError("only byte-level splitting without a prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in model["added_tokens"]):
            raise ValueError("added tokens must match as they stand")
        ids, letters = bpe["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        self.byte_ids = np.array([ids[c] for c in letters], dtype=np.int64)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(order.astype(np.int64), 0)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.merged_ids = self.merged.tolist()
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        of = {c: b for b, c in enumerate(letters)}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in [*ids.items(), *self.added.items()]:
            self.token_bytes[i] = b"".join(bytes([of[c]]) if c in of else c.encode() for c in token)
        self.token_array = pa.array(self.token_bytes, pa.binary())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE where the pair can't merge (or b is -1: no neighbour)."""
        key = np.where(b < 0, np.int64(-1), a << 32 | b)
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as 32-bit numbers. Words are grouped by length (powers of two) and stepped together."""
        out = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for n, word in enumerate(words):
            if len(word) < 2:
                out[n] = self.byte_ids[np.frombuffer(word, np.uint8)].astype(np.int32).tobytes()
            else:
                groups.setdefault(1 << (len(word) - 1).bit_length(), []).append(n)
        for width, members in groups.items():
            if len(members) <= FEW:
                for n in members:
                    out[n] = self._encode_one(width, words[n])
                continue
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for n, ids in zip(part, self._encode(width, [words[n] for n in part]), strict=True):
                    out[n] = ids
        return out

    def _encode_one(self, width: int, word: bytes) -> bytes:
        """Ids of one word, whose adjacent pairs fit ``width`` leaves; about 8 bytes a node of memory."""
        sym = self.byte_ids[np.frombuffer(word, np.uint8)]
        rank = self.rank(sym[:-1], sym[1:])
        nodes = np.full(2 * width, NONE, np.int64)
        nodes[width : width + len(rank)] = np.where(rank < NONE, rank * width + np.arange(len(rank)), NONE)
        level = width
        while level > 1:
            level //= 2
            nodes[level : 2 * level] = np.minimum(nodes[2 * level : 4 * level : 2], nodes[2 * level + 1 : 4 * level : 2])
        n, none = len(word), int(NONE)
        tree, ids = array("q", nodes.tobytes()), array("q", sym.tobytes())
        right, left = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        rank_of, merged = self.rank_of.get, self.merged_ids
        while (root := tree[1]) < none:
            at = root % width
            gone, before = right[at], left[at]
            after = right[at] = right[gone]
            new = ids[at] = merged[root // width]
            tree[width + gone] = tree[width + at] = none
            if after < n:
                left[after] = at
                if (r := rank_of(new << 32 | ids[after])) is not None:
                    tree[width + at] = r * width + at
            first = at
            if before >= 0:
                r = rank_of(ids[before] << 32 | new)
                tree[width + before] = none if r is None else r * width + before
                first = before
            low, mid, high = (width + first) >> 1, (width + at) >> 1, (width + gone) >> 1
            while mid:  # the leaves' paths to the root, most of them one
                a, b = tree[2 * mid], tree[2 * mid + 1]
                tree[mid] = a if a < b else b
                if low != mid:
                    a, b = tree[2 * low], tree[2 * low + 1]
                    tree[low] = a if a < b else b
                if high != mid:
                    a, b = tree[2 * high], tree[2 * high + 1]
                    tree[high] = a if a < b else b
                low, mid, high = low >> 1, mid >> 1, high >> 1
        out, k = array("i"), 0
        while k < n:
            out.append(ids[k])
            k = right[k]
        return out.tobytes()

    def _encode(self, width: int, words: list[bytes]) -> list[bytes]:
        n, row = len(words), width + 2
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), np.int64, n)
        # symbols stand at 1..length; 0 and what lies beyond hold -1
        sym = np.full((n, row), -1, np.int64)
        sym[:, 1:-1] = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1)
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.rank(sym[:, 1:-1], sym[:, 2:])
        tree[:, width:] = np.where((rank < NONE) & (sym[:, 1:-1] >= 0), rank * width + np.arange(width), NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        right = np.tile(np.arange(1, row + 1, dtype=np.int64), (n, 1)).ravel()
        left = np.tile(np.arange(-1, row - 1, dtype=np.int64), (n, 1)).ravel()
        sym, tree = sym.ravel(), tree.ravel()
        active = np.arange(n)
        while True:
            root = tree[active * (2 * width) + 1]
            going = root < NONE
            if not going.all():
                active, root = active[going], root[going]
            if not len(active):
                break
            base, leaves = active * row, active * (2 * width)
            at = root % width + 1
            gone = right[base + at]
            after, before = right[base + gone], left[base + at]
            new = self.merged[root // width]
            sym[base + at] = new
            sym[base + gone] = -1
            right[base + at] = after
            left[base + np.minimum(after, row - 1)] = at
            r = self.rank(new, sym[base + np.minimum(after, row - 1)])
            tree[leaves + width + at - 1] = np.where(r < NONE, r * width + at - 1, NONE)
            tree[leaves + width + gone - 1] = NONE
            b = np.maximum(before, 1)  # without a left neighbour: the merged symbol's own leaf, unchanged
            r = self.rank(sym[base + b], new)
            here = leaves + width + b - 1
            tree[here] = np.where(before < 1, tree[here], np.where(r < NONE, r * width + b - 1, NONE))
            paths = [width + at - 1, width + gone - 1, width + b - 1]
            while width > 1 and paths[0][0] > 1:
                for p in range(3):
                    paths[p] = paths[p] >> 1
                    child = leaves + 2 * paths[p]
                    tree[leaves + paths[p]] = np.minimum(tree[child], tree[child + 1])
        sym = sym.reshape(n, row)
        flat = sym[sym >= 0].astype(np.int32).tobytes()
        ends = (4 * np.cumsum((sym >= 0).sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Texts to ids and back, with remembered words."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.find = regex.compile(PATTERN).findall
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, added)) + ")").split if added else lambda text: [text]
        self.added = {t: np.int32(i).tobytes() for t, i in vocabulary.added.items()}
        self.memo: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Words and added tokens of a text, in order."""
        parts = self.split(text)
        if len(parts) == 1:
            return self.find(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.find(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words not yet known are encoded together."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        each = [self.words(t) for t in texts]
        memo.update(self.added)
        fresh = list(set().union(*each).difference(memo))
        memo.update(zip(fresh, self.vocabulary.encode_words([w.encode() for w in fresh]), strict=True))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, ws)), np.int32) for ws in each]
        for w in fresh:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, rows: pa.ListArray) -> pa.Array:
        """The texts of all rows at once: their tokens' bytes one after another, cut at the rows' ends."""
        ends = np.cumsum([0, *pc.list_value_length(rows).fill_null(0).to_pylist()])
        laid = self.vocabulary.token_array.take(rows.flatten())
        _, offsets, data = laid.buffers()
        cuts = np.frombuffer(offsets, np.int32)[: len(laid) + 1][ends] if len(laid) else np.zeros(len(rows) + 1, np.int32)
        out = pa.StringArray.from_buffers(len(rows), pa.py_buffer(cuts.astype(np.int32)), data or pa.py_buffer(b""))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that are no whole characters
            return pa.array([self.decode(ids or []) for ids in rows.to_pylist()], pa.string())
        return out


def _vocabulary(spark, path: str):
    """The file's text in a broadcast variable; one vocabulary of at most some megabytes."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("vocabulary too large to broadcast")
    Vocabulary(spec)  # refuses what it can't do before any task starts
    return spark.sparkContext.broadcast(spec)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", out: str = "ids", others: list[str] | None = None, digest: str | None = None) -> DataFrame:
    """One row per input row: id, ``others``, and ``out``, an array of token ids.

    ``digest`` names a column for xxhash64 of the text, for checking a round trip later.

    No special tokens are added; added tokens that stand in a text get their ids, as the library does
    by default. Null or empty text: an empty array. A text of any length is encoded whole. Repeated rows
    stay, no rows give no rows; other columns are ignored.
    """
    shared = _vocabulary(docs.sparkSession, path)

    def setup() -> Callable[[list[str | None]], list[pa.Array]]:
        encoder = kept(("bpe", path), lambda: Encoder(Vocabulary(shared.value)))

        def work(texts: list[str | None]) -> list[pa.Array]:
            each = encoder.encode([t or "" for t in texts])
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each) if each else np.zeros(0, np.int32)))]

        return work

    text = F.col(text_col)
    checks = [F.xxhash64(F.coalesce(text, F.lit(""))).alias(digest)] if digest else []
    rows = docs.select(F.col(id_col).alias(id_col), *(others or []), *checks, text.alias("_text"))
    return with_arrow_columns(rows, "_text", f"{out} array<int>", setup).drop("_text")


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the text that the ids stand for (special tokens kept; null ids: empty). Bytes that are no
    character become U+FFFD. A column named ``out`` is replaced; repeated rows stay, no rows give no rows."""
    shared = _vocabulary(df.sparkSession, path)

    def setup() -> Callable[[pa.ListArray], list[pa.Array]]:
        encoder = kept(("bpe", path), lambda: Encoder(Vocabulary(shared.value)))
        return lambda rows: [encoder.decode_all(rows)]

    return with_arrow_columns(df.drop(out), ids_col, f"{out} string", setup, raw=True)
