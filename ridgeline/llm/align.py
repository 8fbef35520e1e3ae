"""Alignment of two tokenizers on one corpus, with corpus-wide counts of linked token pairs.

Each text is encoded by a byte-level BPE vocabulary (A) and by a piece model (B). Byte offsets where tokens
of both end cut the tokens into groups; the tokens that end there are linked. The distinct pairs of linked
ids get a minimal perfect hash: Spark deals them into buckets of about 1,024, and in each bucket a task
finds seeds that send its keys to different slots. Tasks then count links in dense vectors indexed by
the hash (every key is verified in its slot), vectors are added up as a tree, and a second pass aligns the
documents again, from the kept ids, and looks the counts up.

A hash of at most MOST_PAIRS pairs is sent to the tasks at a time (some 34 MB with its counts); more pairs
are counted and looked up by ranges of buckets, one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import kept, pieces, small_batches, with_arrow_columns
from ridgeline.llm.bpe import Encoder, Vocabulary
from ridgeline.llm.tokens import model_pieces, read_file
from ridgeline.llm.vectors import PARTS, dense, segments, tree_sum
from ridgeline.session import stage, unstage, use_package

MOST_PAIRS = 1 << 21
BUCKET = 1024
KEYS_AT_ONCE = 500_000
CUT_CHARS = 1 << 16
"""Longer texts are encoded in parts, cut at a blank between two letters, where no token of either kind can reach across."""
BETWEEN = re.compile(r"(?<=\w) (?=\w)")
C1, C2, C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = (x ^ x >> np.uint64(30)) * C1
    x = (x ^ x >> np.uint64(27)) * C2
    return x ^ x >> np.uint64(31)


def place(mixed: np.ndarray, seed: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slot of keys under a seed, among ``size`` slots."""
    with np.errstate(over="ignore"):
        return (mix(mixed ^ (seed.astype(np.uint64) + np.uint64(1)) * C3) % size.astype(np.uint64)).astype(np.int64)


# ---- the two tokenizers


def piece_bytes(model: bytes) -> list[bytes]:
    """The bytes of each piece: its UTF-8 with word marks as blanks; byte pieces are their byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    text = lambda i: sp.id_to_piece(i).replace("▁", " ").encode()
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else text(i) for i in range(sp.vocab_size())]


class Coder:
    """Encodes texts with both tokenizers."""

    def __init__(self, spec: str, model: bytes):
        import sentencepiece

        vocabulary = Vocabulary(spec)
        vocabulary.added = {}  # their strings are plain text
        self.first = Encoder(vocabulary)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tables = vocabulary.token_array, pa.array(piece_bytes(model), pa.binary())

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of a blank and the text by A, of the text by B; both empty where the text is, or where either's
        bytes are not those of a blank and the text."""
        parts, owner = [], []
        for n, text in enumerate(texts):
            for part in cut(text or ""):
                parts.append(part)
                owner.append(n)
        empty = np.zeros(0, np.int32)
        out = [([], [], []) for _ in texts]
        a, b = self.first.encode([" " + p for p in parts]), [np.array(x, np.int32) for x in self.second.encode(parts, num_threads=1)]
        for n, part, x, y, same in zip(owner, parts, a, b, self.spell(parts, a, b), strict=True):
            for held, value in zip(out[n], (x, y, same and bool(part)), strict=True):
                held.append(value)
        return [(np.concatenate(x), np.concatenate(y)) if ok and all(ok) else (empty, empty) for x, y, ok in out]

    def spell(self, parts: list[str], *ids: list[np.ndarray]) -> list[bool]:
        """For each part, whether both kinds of tokens spell it with a blank before."""
        good = [True] * len(parts)
        wanted = [b" " + p.encode() for p in parts]
        for table, each in zip(self.tables, ids, strict=True):
            ends = np.cumsum([0, *map(len, each)])
            laid = table.take(pa.array(np.concatenate(each) if each else np.zeros(0, np.int32)))
            _, offsets, data = laid.buffers()
            data = memoryview(data or b"").cast("B")
            at = np.frombuffer(offsets, np.int32)[: len(laid) + 1][ends].tolist() if len(laid) else [0] * len(ends)
            good = [g and data[s:e] == w for g, s, e, w in zip(good, at, at[1:], wanted, strict=False)]
        return good


def cut(text: str) -> Iterator[str]:
    """Parts of a text; the blank between two is left out."""
    start = 0
    while len(text) - start > CUT_CHARS and (m := BETWEEN.search(text, start + CUT_CHARS)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:] if start else text


# ---- alignment of a batch


class Aligned:
    """Tokens of many documents laid one after another, their links, and where documents end."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, lengths: tuple[np.ndarray, np.ndarray]):
        self.a, self.b = (x.flatten().to_numpy(zero_copy_only=False) for x in (a, b))
        self.a_ends, self.b_ends = (np.cumsum([0, *pc.list_value_length(x).to_pylist()]) for x in (a, b))
        ends = [np.cumsum(n[x]) for n, x in zip(lengths, (self.a, self.b), strict=True)]
        at = [np.zeros(int(ends[0][-1]) + 1 if len(ends[0]) else 1, bool) for _ in ends]
        for mark, e in zip(at, ends, strict=True):
            mark[e] = True
        # no token is empty, so one of A and one of B end at a shared offset
        self.ia, self.ib = np.nonzero(at[1][ends[0]])[0], np.nonzero(at[0][ends[1]])[0]
        self.ends = np.searchsorted(self.ia, self.a_ends)

    def keys(self, size_b: int) -> np.ndarray:
        return self.a[self.ia].astype(np.int64) * size_b + self.b[self.ib]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of the links' values for each document."""
        total = np.concatenate([[0], np.cumsum(values)])
        return np.diff(total[self.ends])

    def groups(self, words: list[str], of_b: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document. words: see :func:`written`."""
        merged = np.empty(len(self.a) + len(self.b), np.int64)
        for ids, own, other, first, step in ((self.a, self.ia, self.ib, 0, 0), (self.b, self.ib, self.ia, of_b, 1)):
            last = np.zeros(len(ids), np.int64)
            last[own] = 1
            group = np.cumsum(last) - last
            before = np.concatenate([[0], other + 1])[group + step]
            merged[np.arange(len(ids)) + before] = first + 2 * ids.astype(np.int64) + last
        at = (self.a_ends + self.b_ends).tolist()
        return ["".join(map(words.__getitem__, merged[s:e].tolist()))[:-1] for s, e in zip(at, at[1:], strict=False)]


def written(size_a: int, size_b: int) -> list[str]:
    """Every id with the mark after it: A before another of its group and as its last, then the same for B."""
    return [f"{i}{mark}" for n, marks in ((size_a, ",|"), (size_b, ",;")) for i in range(n) for mark in marks]


# ---- minimal perfect hash


def hash_bucket(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a bucket in the order of their slots, and the seeds of its groups of about four. A group of one
    stores its slot as -1 - slot."""
    mixed, m = mix(keys.astype(np.uint64)), len(keys)
    group = (mixed >> np.uint64(40)) % np.uint64(-(-m // 4))
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(-(-m // 4) + 1))
    seeds, taken, out = np.zeros(-(-m // 4), np.int32), np.zeros(m, bool), np.empty(m, np.int64)
    size = np.array(m)
    for g in np.argsort(-np.diff(cuts), kind="stable"):
        mine = order[cuts[g] : cuts[g + 1]]
        if len(mine) > 1:
            at, seed = place(mixed[mine], np.array(0), size), 0
            while taken[at].any() or len(set(at.tolist())) < len(mine):
                seed += 1
                at = place(mixed[mine], np.array(seed), size)
        elif len(mine):
            at = np.array([np.argmin(taken)])
            seed = -1 - int(at[0])
        else:
            continue
        seeds[g], taken[at], out[at] = seed, True, keys[mine]
    return out, seeds


class PairHash:
    """The minimal perfect hash of a range of buckets; verified keys, and what is stored by slot."""

    def __init__(self, buckets: int, first: int, keys: list[bytes], seeds: list[bytes]):
        self.buckets, self.first = buckets, first
        self.sizes = np.array([len(k) // 8 for k in keys], np.int64)
        self.starts = np.cumsum([0, *self.sizes])[:-1]
        self.seed_starts = np.cumsum([0, *(len(s) // 4 for s in seeds)])[:-1]
        self.keys, self.seeds = np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(seeds), np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the hash does not hold."""
        mixed = mix(keys.astype(np.uint64))
        bucket = (mixed % np.uint64(self.buckets)).astype(np.int64) - self.first
        out = np.full(len(keys), -1, np.int64)
        known = np.nonzero((bucket >= 0) & (bucket < len(self.sizes)))[0]
        known = known[self.sizes[bucket[known]] > 0]
        bucket, mixed = bucket[known], mixed[known]
        size = self.sizes[bucket]
        seed = self.seeds[self.seed_starts[bucket] + ((mixed >> np.uint64(40)) % (-(-size // 4)).astype(np.uint64)).astype(np.int64)]
        slot = self.starts[bucket] + np.where(seed < 0, -1 - seed, place(mixed, np.maximum(seed, 0), size))
        out[known] = np.where(self.keys[slot] == keys[known], slot, -1)
        return out


def hashed_pairs(coded: DataFrame, lengths: tuple[np.ndarray, np.ndarray], most: int) -> Iterator[PairHash]:
    """Hashes of all distinct pairs of linked ids, by ranges of buckets with at most about ``most`` pairs."""
    size_b = len(lengths[1])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("links", lambda: None)  # the tokenizers may go
        held = [np.zeros(0, np.int64)]
        for whole in batches:
            for batch in pieces(whole, "a"):
                held.append(np.unique(Aligned(batch.column("a"), batch.column("b"), lengths).keys(size_b)))
                if sum(map(len, held)) > 2 * KEYS_AT_ONCE:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > KEYS_AT_ONCE:
                        yield out(held)
                        held = [np.zeros(0, np.int64)]
        yield out([np.unique(np.concatenate(held))])

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(mix(held[0].astype(np.uint64)).view(np.int64))], names=["pair", "mixed"])

    def build(table: pa.Table) -> pa.Table:
        keys, seeds = hash_bucket(np.sort(table.column("pair").to_numpy()))
        return pa.table({"bucket": table.column("bucket")[:1], "keys": pa.array([keys.tobytes()], pa.binary()), "seeds": pa.array([seeds.tobytes()], pa.binary())})

    pairs = stage(coded.select("a", "b").mapInArrow(distinct, "pair bigint, mixed bigint").distinct(), "pairs")
    n = pairs.count()
    buckets = max(1, -(-n // BUCKET))
    # as unsigned numbers: the upper and the lower half of 64 bits, one after the other
    high, low = F.shiftrightunsigned("mixed", 32), F.col("mixed").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    bucket = ((high % buckets) * ((1 << 32) % buckets) + low) % buckets
    built = stage(pairs.select("pair", bucket.cast("bigint").alias("bucket")).groupBy("bucket").applyInArrow(build, "bucket bigint, keys binary, seeds binary"), "hash")
    step = max(1, most // BUCKET)
    for first in range(0, buckets if n else 0, step):
        rows = {r["bucket"]: r for r in built.where(F.col("bucket").between(first, first + step - 1)).toLocalIterator()}
        each = [rows.get(k) for k in range(first, min(first + step, buckets))]
        yield PairHash(buckets, first, *([bytes(r[c]) if r else b"" for r in each] for c in ("keys", "seeds")))
    unstage(pairs)
    unstage(built)


def count_links(coded: DataFrame, lengths: tuple[np.ndarray, np.ndarray], table: PairHash) -> np.ndarray:
    """How many links hold each pair of the hash, by slot."""
    shared = coded.sparkSession.sparkContext.broadcast(table)
    size_b, size = len(lengths[1]), len(table.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for whole in batches:
            for batch in pieces(whole, "a"):
                u, n = np.unique(Aligned(batch.column("a"), batch.column("b"), lengths).keys(size_b), return_counts=True)
                at = shared.value.slots(u)
                counts[at[at >= 0]] += n[at >= 0]
        yield from segments(counts, TaskContext.get().partitionId())

    summed = tree_sum(coded.select("a", "b").mapInArrow(run, PARTS))
    out = dense(summed, size)
    unstage(summed)
    shared.unpersist()
    return out


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    groups: ids as ``a1,a2|b1;a3|b2,b3``. A pair's count is how many links of the corpus hold it; n_best:
    links whose count is the highest of their B id; count_sum: the counts of all links. Strings of special tokens in
    a text are plain text. A null or empty text, and one whose tokens do not spell a blank and the text, has no
    tokens: zeros and an empty string. Ties for the highest count all count as best. Repeated rows stay
    and count each; a text of any length is encoded whole; a null id stays; no rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    use_package(spark)
    small_batches(spark)
    model = read_file(piece_path)
    model_pieces(model)  # refuses models that change texts
    spec = read_file(byte_path).decode()
    if len(spec) + len(model) > 64 << 20:
        raise ValueError("vocabularies too large to broadcast")
    tables = Vocabulary(spec).token_bytes, piece_bytes(model)
    lengths = tuple(np.array([max(1, len(x)) for x in t], np.int64) for t in tables)
    shared, sizes = spark.sparkContext.broadcast((spec, model)), spark.sparkContext.broadcast(lengths)

    def setup() -> Callable[[list[str | None]], list[pa.Array]]:
        coder = kept(("both", byte_path, piece_path), lambda: Coder(*shared.value))

        def work(texts: list[str | None]) -> list[pa.Array]:
            each = coder.encode(texts)
            ends = [np.cumsum([0, *(len(e[k]) for e in each)]).astype(np.int32) for k in (0, 1)]
            return [pa.ListArray.from_arrays(pa.array(e), pa.array(np.concatenate([x[k] for x in each]) if each else np.zeros(0, np.int32))) for k, e in enumerate(ends)]

        return work

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    coded = stage(with_arrow_columns(rows, "_text", "a array<int>, b array<int>", setup).drop("_text"), "coded")
    hashes = []
    best = np.zeros(len(lengths[1]), np.int64)
    for table in hashed_pairs(coded, lengths, most_pairs):
        counts = count_links(coded, lengths, table)
        np.maximum.at(best, table.keys % len(best), counts)
        hashes.append(spark.sparkContext.broadcast((table, counts)))
    tops = spark.sparkContext.broadcast(best)

    kind = rows.schema["_id"].dataType.simpleString()
    sums = "n_best bigint, count_sum bigint"
    out = coded.withColumn("n_best", F.lit(0).cast("bigint")).withColumn("count_sum", F.lit(0).cast("bigint"))
    for held in hashes[:-1]:
        out = out.mapInArrow(looked_up(held, sizes, tops), f"_id {kind}, a array<int>, b array<int>, {sums}")
    # the last hash and the description share a worker
    described = out.mapInArrow(looked_up(hashes[-1] if hashes else None, sizes, tops, True), f"_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, {sums}, groups string")
    return described.withColumnRenamed("_id", id_col)


def looked_up(held, sizes, tops, last: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to n_best and count_sum what the links' pairs have in one hash; in the last pass, counts and groups take
    the place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, (of_a, of_b) = tops.value, map(len, sizes.value)
        words = kept(("words", of_a, of_b), lambda: written(of_a, of_b) if last else None)  # the tokenizers may go
        for whole in batches:
            for batch in pieces(whole, "a"):
                aligned = Aligned(batch.column("a"), batch.column("b"), sizes.value)
                n_best, count_sum = (batch.column(c).to_numpy() for c in ("n_best", "count_sum"))
                if held is not None:
                    table, counts = held.value
                    keys = aligned.keys(of_b)
                    at = table.slots(keys)
                    count = np.where(at >= 0, counts[at], 0)
                    n_best = n_best + aligned.per_row(((at >= 0) & (count == best[keys % of_b])).astype(np.int64))
                    count_sum = count_sum + aligned.per_row(count)
                sums = pa.array(n_best), pa.array(count_sum)
                if last:
                    links = np.diff(aligned.ends)
                    four = [pa.array(x.astype(np.int64)) for x in (np.diff(aligned.a_ends), np.diff(aligned.b_ends), links, links)]
                    yield pa.RecordBatch.from_arrays([batch.column("_id"), *four, *sums, pa.array(aligned.groups(words, 2 * of_a), pa.string())], names=["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], *sums], names=batch.schema.names)

    return run
