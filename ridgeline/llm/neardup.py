"""Near-duplicate groups by HyperMinHash.

A document's set of word shingles is sketched in registers. A register keeps, of the smallest value
of its own hash function over the set, the count of leading zeros and ten mantissa bits: 16 bits
instead of 64. Each register has a hash function of its own, since a short text would leave most
buckets of a single split hash empty. Four registers make a band; documents that agree in one of 32
bands become candidates (a pair at similarity 0.8 is missed with a probability below 1e-7). Matching
registers, corrected for the collisions that 16 bits cause, estimate the Jaccard similarity; pairs
whose estimate is far too low go, all others are confirmed on full sets.

Equal sets are one class from the start. Within a bucket of a band, members are compared with one hub
(the one that shares most buckets with others, so the most central) instead of with each other; what is
then in one component needs no further comparison. Members still in different components are compared
through the rarest of what they have outside their hub, or of their whole sets where the hub holds
most of them, which is exact (see :func:`links_across`). So groups of thousands cost about a pair a member.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.arrow import kept, with_arrow_columns
from ridgeline.llm.components import connected_components
from ridgeline.session import stage, unstage

BANDS, ROWS = 32, 4
MANTISSA = 10
BLOCK = 2048
MEMO_WORDS = 100_000
PART_OF_HUB = 1_000
"""A hub's pairs are dealt over parts of about so many; all are compared."""


class Sketcher:
    """Shingle sets and their registers. Sets are sorted arrays of 64-bit hashes."""

    def __init__(self, words: int, bands: int = BANDS):
        self.words, self.bands = words, bands
        self.memo: dict[bytes, int] = {}
        odd = np.random.default_rng(20240229).integers(1, 1 << 32, bands * ROWS, dtype=np.uint64) | np.uint64(1)
        self.factors = odd.astype(np.uint32)[:, None]

    def shingles(self, text: str | None) -> np.ndarray:
        """The set: A-Z lower-cased, words cut at blanks; too few words are one shingle."""
        from xxhash import xxh3_64_intdigest

        tokens = (text or "").encode().lower().split()  # bytes: ASCII letters and blanks only
        if not tokens:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for t in set(tokens):
            if t not in memo:
                memo[t] = xxh3_64_intdigest(t)
        hashed = np.fromiter([memo[t] for t in tokens], np.uint64, len(tokens))
        size = min(self.words, len(tokens))
        out = np.full(len(tokens) - size + 1, size, np.uint64)
        for k in range(size):
            out = (out ^ hashed[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        """Compressed registers, 16 bits each: leading zeros, then the bits after the leading one."""
        x = (shingles ^ shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.bands * ROWS, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), BLOCK):
            v = x[None, k : k + BLOCK] * self.factors
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            v ^= v >> np.uint32(12)
            np.minimum(low, v.min(1), out=low)
        part, bits = np.frexp(low.astype(np.float64))
        code = (32 - bits) * (1 << MANTISSA) + (part * (2 << MANTISSA)).astype(np.int64) - (1 << MANTISSA)
        return np.where(low == 0, 32 << MANTISSA, code).astype(np.uint16)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n (set size), f1, f2 (fingerprint of the set), bands (one 64-bit key for four registers)."""

    def setup() -> Callable[[list[str | None]], list[pa.Array]]:
        from xxhash import xxh3_128_digest

        sketcher = kept(("sketch", words), lambda: Sketcher(words))

        def work(texts: list[str | None]) -> list[pa.Array]:
            sizes, prints, bands, ends = [], [], [], [0]
            for text in texts:
                s = sketcher.shingles(text)
                sizes.append(len(s))
                prints.append(xxh3_128_digest(s.tobytes()))
                if len(s):
                    bands.append(sketcher.registers(s).view(np.int64))
                ends.append(len(bands) * BANDS)
            f = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            return [pa.array(sizes, pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]

        return work

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_arrow_columns(rows, "text", "n bigint, f1 bigint, f2 bigint, bands array<bigint>", setup).drop("text")


def full_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id and the whole shingle set."""

    def setup() -> Callable[[list[str | None]], list[pa.Array]]:
        sketcher = kept(("sketch", words), lambda: Sketcher(words))

        def work(texts: list[str | None]) -> list[pa.Array]:
            each = [sketcher.shingles(t).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each) if each else np.zeros(0, np.int64)))]

        return work

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_arrow_columns(rows, "text", "shingles array<bigint>", setup).drop("text")


def estimate(x: Column, y: Column, n: Column, m: Column, bands: int = BANDS) -> Column:
    """Jaccard similarity from two sketches, corrected for registers that agree by compression alone.

    Two different minima share a register with a probability of about 0.1699 / 2^mantissa bits, times
    4nm/(n+m)^2 for sets of n and m elements (the published approximation for this sketch).
    """
    equal = lambda a, b: sum(((F.shiftrightunsigned(a.bitwiseXOR(b), 16 * k).bitwiseAND(F.lit(0xFFFF))) == 0).cast("int") for k in range(ROWS))
    matches = F.aggregate(F.zip_with(x, y, equal), F.lit(0), lambda a, b: a + b) / F.lit(float(bands * ROWS))
    chance = F.lit(0.169919487159739 / (1 << MANTISSA) * 4) * n * m / ((n + m) * (n + m))
    return (matches - chance) / (F.lit(1.0) - chance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A text's set: distinct runs of ``words`` words (A-Z lower-cased, cut at blanks); with fewer words
    the whole sequence as one; empty for a null text or one without words, which links with nothing.
    Documents link when 100 * intersection >= percent * union. component_id: the smallest id
    reachable over links, itself included; kept: id = component_id. A null id has a null component
    and is kept. Rows that share an id are one document: a link of one text links all of them; each row
    has its own n_shingles. Ids may be of any type that has an order. Repeated texts are one class, ties
    don't arise, a text of any length is used whole, no rows give no rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = stage(sketches(texts, "id", "text", words), "sketches")
    classes = stage(drawn.where("n > 0 AND id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")
    links = similar_classes(texts, classes, words, percent)
    parts = classes.select("n", "f1", "f2", "rep").join(links.withColumnRenamed("node", "rep"), "rep", "left")
    parts = parts.select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = drawn.select("id", "n", "f1", "f2").join(parts, ["n", "f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def similar_classes(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Components of classes under exact links: (node, component) for linked representatives."""
    banded = classes.select(F.col("rep"), F.posexplode("bands").alias("band", "key"))
    full = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(banded.join(full, ["band", "key"]), "members")
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    hubs = members.join(degree, "rep").groupBy("band", "key").agg(F.min(F.struct((-F.col("degree")).alias("minus"), "rep")).alias("best"))
    hubs = hubs.select("band", "key", F.col("best.rep").alias("hub"))
    known = classes.select("rep", "n", "bands")

    hubbed = stage(members.select("band", "key", "rep").join(hubs, ["band", "key"]), "hubbed")
    unstage(members)
    wanted = hubbed.select(F.col("rep").alias("id")).distinct()
    # what is wanted grows with the corpus: one strategy at every size, never a broadcast
    sets = stage(full_sets(texts.join(wanted.hint("shuffle_merge"), "id", "left_semi"), "id", "text", words), "sets")
    first = hubbed.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    likely = stage(plausible(first, known, percent), "plausible")
    links = stage(confirm(likely, sets, percent), "links")
    parts = stage(connected_components(links), "components")
    more = links_across(hubbed, parts, known, sets, percent)
    final = stage(connected_components(links.unionByName(more)), "components")
    for table in (hubbed, sets, likely, parts):
        unstage(table)
    return final


def plausible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose sizes allow a link and whose estimate is not six deviations too low."""
    share = percent / 100
    floor = share - 6 * math.sqrt(share * (1 - share) / (BANDS * ROWS))
    left, right = (known.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return met.where(estimate(F.col("bands_a"), F.col("bands_b"), F.col("n_a"), F.col("n_b")) >= floor).select("a", "b", "n_a", "n_b")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Append the full sets s_a and s_b (of the right size, since rows may share an id).

    Half of a corpus may ask for the set of one hub b. So its pairs are dealt over parts of about
    PART_OF_HUB by a hash of a, and its set is sent once to each part."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART_OF_HUB).alias("parts")).where("parts > 1")
    dealt = pairs.join(parts, "b", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a"), "parts"), F.lit(0))).drop("parts")
    hubs = sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b")).join(parts, "b", "left")
    hubs = hubs.select("b", "s_b", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    members = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a"))
    met = dealt.join(members, "a").join(hubs, ["b", "part"]).drop("part")
    return met.where((F.size("s_a") == F.col("n_a")) & (F.size("s_b") == F.col("n_b")))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) that are links on full sets."""
    common = F.size(F.array_intersect("s_a", "s_b"))
    return with_sets(pairs, sets).where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def links_across(members: DataFrame, parts: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between members of one bucket that comparison with its hub has left in different
    components. members: (band, key, hub, rep).

    A link needs |x & y| >= t = p (|x| + |y|) / (100 + p). For members x and y of a hub h,
    |x & y| <= min(|x & h|, |y & h|) + |(x - h) & (y - h)|. So either both have t shingles inside h, or
    they share some outside it. Outside, both sides are looked up by the beginnings of x - h and y - h
    under one order (rarest first among the hub's members): with at least p |x| / 100 - |x & h| common
    shingles outside, all but the last so many and one are enough, and so for y. Where both have t
    inside h, the same is done with their whole sets. :func:`prefix_pairs` does either. That is exact,
    and neither outliers beside a group of thousands nor thousands of different extracts of one text
    cost a row for each pair: what each has of its own is rare and so stands first.
    """
    component = lambda x: F.coalesce(f"part_{x}", x)
    of = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}"))
    n_of = lambda x: known.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"))
    placed = members.withColumnRenamed("rep", "a").withColumnRenamed("hub", "b").join(of("a"), "a", "left").withColumn("c_a", component("a"))
    several = placed.groupBy("band", "key").agg(F.min("c_a").alias("low"), F.max("c_a").alias("high")).where("low < high").select("band", "key")
    asked = placed.join(several, ["band", "key"]).where("a <> b").select("a", "b", "c_a").distinct()
    asked = asked.join(of("b"), "b", "left").withColumn("c_b", component("b")).drop("part_b").join(n_of("a"), "a").join(n_of("b"), "b")
    # ids alone tell where two components meet at a hub: sets are attached only to the members of such hubs
    asked = stage(asked.withColumn("apart", F.col("c_a") != F.col("c_b")), "asked")
    lively = stage(asked.where("apart").select("b").distinct(), "lively")  # its size is known: no shuffle by hub where it is small
    common = F.size(F.array_intersect("s_a", "s_b"))
    met = with_sets(asked.join(lively, "b", "left_semi"), sets).select("b", F.col("a").alias("x"), F.col("c_a").alias("c"), "apart", F.col("n_a").alias("n"), F.col("n_b"), common.alias("inside"), F.array_except("s_a", "s_b").alias("s"))
    met = stage(met, "met")
    # a hub and a member of its own component need no further link
    hub_links = met.where("apart").where(100 * F.col("inside") >= percent * (F.col("n") + F.col("n_b") - F.col("inside"))).select(F.col("x").alias("a"), "b")

    least = F.ceil(percent * F.col("n") / 100)  # of what a link of x has in common
    row = [*"bxcn", "apart", "inside"]
    outside = met.select(*row, "s", F.greatest(least - F.col("inside"), F.lit(1)).alias("least"))
    held = met.where(F.col("inside") >= least).drop("s").join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("s")), "x").where(F.size("s") == F.col("n"))
    held = held.select("b", "x", "c", "n", "apart", F.lit(0).alias("inside"), "s", least.alias("least"))
    pairs = prefix_pairs(outside, percent).unionByName(prefix_pairs(held, percent)).distinct()
    pairs = stage(plausible(pairs, known, percent), "pairs")
    found = stage(confirm(pairs, sets, percent).unionByName(hub_links), "links")
    for table in (asked, lively, met, pairs):
        unstage(table)
    return found


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of members of one hub in different components whose sets may be similar enough.

    rows: b (hub), x (member), c (its component), n (size of its whole set), apart (not in the hub's
    component), inside (shingles that x shares with the hub beside those in s), s (shingles), least (how
    many of s a link of x has at least). At the first shingle in order that x and y share, no more than
    the shorter rest can follow, so that shingle is met only where the rests are long enough for the pair.
    """
    rows = rows.where(F.size("s") >= F.col("least")).withColumn("u", F.xxhash64("s"))  # tells rows apart that share an id
    spread = rows.select("b", "x", "u", F.explode("s").alias("shingle"))
    times = spread.groupBy("b", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    rare = spread.join(times, ["b", "shingle"]).groupBy("b", "x", "u").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("order"))
    # shingles that x alone holds come first in the order and meet nothing, so they are only counted
    begun = rows.withColumn("size", F.size("s")).drop("s").join(rare, ["b", "x", "u"])
    alone = F.col("size") - F.size("order")
    begun = begun.withColumn("first", (F.col("size") - F.col("least") + 1 - alone).cast("int")).where("first > 0")
    cut = begun.select("b", "x", "c", "n", "apart", "inside", F.size("order").alias("held"), F.posexplode(F.slice("order", F.lit(1), F.col("first"))).alias("at", "o"))
    cut = cut.select("b", "x", "c", "n", "apart", "inside", F.col("o.shingle").alias("shingle"), (F.col("held") - F.col("at")).cast("int").alias("rest"))
    y = cut.where("apart").select("b", "shingle", *(F.col(c).alias(f"{c}_y") for c in ("x", "c", "n", "inside", "rest")))
    x = cut.select("b", "shingle", "apart", *(F.col(c).alias(f"{c}_x") for c in ("x", "c", "n", "inside", "rest")))
    n_x, n_y = F.col("n_x"), F.col("n_y")
    need = percent * (n_x + n_y) - (100 + percent) * F.least("inside_x", "inside_y")
    fits = (100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)) & ((100 + percent) * F.least("rest_x", "rest_y") >= need)
    met = y.join(x, ["b", "shingle"]).where(fits & (F.col("c_x") != F.col("c_y")) & (~F.col("apart") | (F.col("x_y") < F.col("x_x"))))
    return met.select(F.least("x_x", "x_y").alias("a"), F.greatest("x_x", "x_y").alias("b")).distinct()
