"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A window of twelve words is four blocks of three. Each of six fixed masks keeps two blocks and
ignores the other two, so two substituted words, wherever they stand, leave at least one mask
untouched. Hashes of the kept words of every window of every document are joined with those of the
benchmark; around each hit the whole window is compared, and windows with at most two substitutions
count. Benchmark items shorter than a window are sought whole, word for word.

The benchmark's hashes are broadcast only if they are few enough (checked); what leaves the scan of
documents is then a row for each verified window. Otherwise the join shuffles every window of the
documents, once a mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, BLOCKS = 3, 4
WINDOW = BLOCK * BLOCKS
SUBSTITUTIONS = 2
# The two blocks that each mask keeps.
MASKS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
MAX_BROADCAST_SEEDS = 250_000
"""A seed carries its window's twelve hashes, measured at some 280 bytes a seed in a broadcast, so about 70 MB; a larger benchmark is joined by shuffle."""
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, at: str) -> DataFrame:
    """A row for each window of ``w`` and mask: the window's start ``at`` and the ``key`` of kept words.

    The row is made and hashed within one span of generated code; the array passes by reference."""
    count = F.size("w") - (WINDOW - 1)
    steps = F.when(count > 0, F.sequence(F.lit(0), count * len(MASKS) - 1))
    rows = df.withColumn("k", F.explode(steps))
    mask, start = F.col("k") % len(MASKS), F.expr(f"CAST(k div {len(MASKS)} AS INT)")
    block = lambda side: F.get(F.array(*(F.lit(BLOCK * m[side]) for m in MASKS)), mask)
    rows = rows.select("*", mask.alias("mask"), start.alias(at)).select("*", (F.col(at) + block(0)).alias("b0"), (F.col(at) + block(1)).alias("b1"))
    kept = [F.get("w", F.col(b) + i) for b in ("b0", "b1") for i in range(BLOCK)]
    return rows.withColumn("key", F.xxhash64("mask", *kept)).drop("k", "b0", "b1")


def matched_windows(docs: DataFrame, items: DataFrame, few: bool) -> DataFrame:
    """(doc, item, at) of verified windows; docs and items have their word hashes in w and v.

    A window that several masks find counts once, for the first mask whose blocks are both whole."""
    cut = lambda at: F.slice("w", F.col(at) + 1, WINDOW)
    own = seeds(items.select("item", F.col("v").alias("w")), "j").select("item", "key", cut("j").alias("v"))  # the key holds the mask
    theirs = seeds(docs, "i")
    if few:  # the words of a window are cut out after the join, in the same span of code, for hits only
        hit = theirs.join(F.broadcast(own), "key").select("doc", "item", "i", "mask", cut("i").alias("u"), "v")
    else:
        hit = theirs.select("doc", "i", "mask", "key", cut("i").alias("u")).join(own, "key")
    hit = hit.withColumn("same", F.explode(F.array(F.zip_with("u", "v", lambda a, b: (a == b).cast("int")))))  # stays above the join
    total = lambda start, length: F.aggregate(F.slice("same", start + 1, length), F.lit(0), lambda a, x: a + x)
    whole = [total(b * BLOCK, BLOCK) == BLOCK for b in range(BLOCKS)]
    first = F.coalesce(*(F.when(whole[a] & whole[b], F.lit(n)) for n, (a, b) in enumerate(MASKS)))
    verified = hit.where((total(0, WINDOW) >= WINDOW - SUBSTITUTIONS) & (F.col("mask") == first))
    return verified.select("doc", "item", "i", F.lit(WINDOW).alias("size"))


def short_items(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Items of fewer words than a window, found whole. lengths: which there are (at most 11)."""
    spans = F.explode(F.array(*map(F.lit, lengths)))
    runs = docs.withColumn("size", spans).where(F.size("w") >= F.col("size")).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
    runs = runs.withColumn("run", F.slice("w", F.col("i") + 1, F.col("size"))).select("doc", "i", "size", "run", F.xxhash64("run").alias("key"))
    short = items.where((F.size("v") > 0) & (F.size("v") < WINDOW)).select("item", "v", F.xxhash64("v").alias("key"))
    return runs.join(short, "key").where(F.col("run") == F.col("v")).select("doc", "item", "i", "size")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that share a passage: id, item, n_windows,
    first_word, last_word.

    A window is twelve consecutive words (runs of letters and digits, lower-cased) of an item that
    stand in the document with at most two of them substituted; a shorter item counts as one window
    when it stands there whole. n_windows: pairs of a document position and an item position that
    match. first_word, last_word: the span of the document, in words from 0, that they cover. Null or
    empty texts share nothing; rows with a null id or null item are passed over; rows that share an
    id add up, so ties don't arise. Texts of any length are searched whole; no documents or no items
    give no rows. Other columns are ignored.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), hashes(F.col(text_col)).alias("w"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), hashes(F.col(item_text_col)).alias("v"))
    size = F.size("v")
    known = items.agg(F.sum(F.greatest(size - (WINDOW - 1), F.lit(0)) * len(MASKS)).alias("seeds"), F.sort_array(F.collect_set(F.when((size > 0) & (size < WINDOW), size))).alias("short")).first()
    found = matched_windows(rows, items, (known["seeds"] or 0) <= MAX_BROADCAST_SEEDS)
    if known["short"]:
        found = found.unionByName(short_items(rows, items, known["short"]))
    out = found.groupBy("doc", "item").agg(F.count("*").alias("n_windows"), F.min("i").cast("long").alias("first_word"), (F.max(F.col("i") + F.col("size")) - 1).cast("long").alias("last_word"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_windows", "first_word", "last_word")


LEAKS_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS v FROM benchmark),
words AS (SELECT 0 AS side, doc_id AS id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM docs
  UNION ALL SELECT 1, item_id, unnest(v), generate_subscripts(v, 1) - 1 FROM items),
blocks AS (SELECT side, id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS b FROM words WINDOW p AS (PARTITION BY side, id ORDER BY i)),
windows AS (SELECT side, id, i, b AS b0, lead(b, 3) OVER p AS b1, lead(b, 6) OVER p AS b2, lead(b, 9) OVER p AS b3 FROM blocks WINDOW p AS (PARTITION BY side, id ORDER BY i)),
t AS (SELECT * FROM windows WHERE side = 0 AND b3 IS NOT NULL),
o AS (SELECT * FROM windows WHERE side = 1 AND b3 IS NOT NULL),
pairs AS (
  SELECT t.id AS doc_id, t.i, o.id AS item_id, o.i AS j FROM t JOIN o ON t.b0 = o.b0 AND t.b1 = o.b1
  UNION SELECT t.id, t.i, o.id, o.i FROM t JOIN o ON t.b0 = o.b0 AND t.b2 = o.b2
  UNION SELECT t.id, t.i, o.id, o.i FROM t JOIN o ON t.b0 = o.b0 AND t.b3 = o.b3
  UNION SELECT t.id, t.i, o.id, o.i FROM t JOIN o ON t.b1 = o.b1 AND t.b2 = o.b2
  UNION SELECT t.id, t.i, o.id, o.i FROM t JOIN o ON t.b1 = o.b1 AND t.b3 = o.b3
  UNION SELECT t.id, t.i, o.id, o.i FROM t JOIN o ON t.b2 = o.b2 AND t.b3 = o.b3),
long_hits AS (SELECT doc_id, item_id, i, 12 AS size FROM pairs JOIN docs USING (doc_id) JOIN items USING (item_id)
  WHERE len(list_filter(list_zip(w[i + 1 : i + 12], v[j + 1 : j + 12]), lambda p: p[1] = p[2])) >= 10),
short_hits AS (SELECT doc_id, item_id, i, len(v) AS size FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM docs)
  JOIN (SELECT item_id, v FROM items WHERE len(v) BETWEEN 1 AND 11) ON w[i + 1 : i + len(v)] = v),
hits AS (SELECT * FROM long_hits UNION ALL SELECT * FROM short_hits)
SELECT doc_id, item_id, count(*) AS n_windows, CAST(min(i) AS BIGINT) AS first_word, CAST(max(i + size) - 1 AS BIGINT) AS last_word
FROM hits GROUP BY doc_id, item_id"""
