"""Alignment, hard negatives and quality rules against brute force, and their odd rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from oracle import same_rows
from pyspark.sql import functions as F

from ridgeline.llm import align, negatives, rules
from ridgeline.llm.bpe import byte_letters
from ridgeline.llm.queries import ORACLE_SQL, QUERIES
from ridgeline.llm.vectors import PARTS, tree_sum

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
CLASHES = ("a", "b", "ids", "key", "tile", "v", "best", "label", "score", "kept", "_id", "_text", "_trusted", "segment", "part", "n_best", "chunk", "third", "place", "groups")


def clashing(df):
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


# ---- op 11


def brute_alignment(texts):
    """{id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)} by the libraries and plain loops."""
    lib, sp = tokenizers.Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lib.encode_special_tokens = True
    of = {c: b for b, c in enumerate(byte_letters())}
    spell_a = lambda i: bytes(of[c] for c in lib.id_to_token(i))
    spell_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    each, counts, top = [], Counter(), Counter()
    for key, text in texts:
        a, b = lib.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        if not text or b"".join(map(spell_a, a)) != (" " + text).encode() or b"".join(map(spell_b, b)) != (" " + text).encode():
            each.append((key, [], [], [], ""))
            continue
        ends, at, links, groups, from_a, from_b = {}, 0, [], [], 0, 0
        for n, i in enumerate(a):
            at += len(spell_a(i))
            ends[at] = n
        at = 0
        for n, i in enumerate(b):
            at += len(spell_b(i))
            if at in ends:
                links.append((a[ends[at]], i))
                groups.append(",".join(map(str, a[from_a : ends[at] + 1])) + "|" + ",".join(map(str, b[from_b : n + 1])))
                from_a, from_b = ends[at] + 1, n + 1
        counts.update(links)
        each.append((key, a, b, links, ";".join(groups)))
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted((str(key), len(a), len(b), len(x), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), g) for key, a, b, x, g in each)


COUNTED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def aligned(df, **more):
    return sorted((str(r["doc_id"]), *(r[c] for c in COUNTED), r["groups"]) for r in align.align(df, BYTES, PIECES, **more).collect())


def test_op11_is_brute_force(spark, sf_dir, documents):
    want = brute_alignment([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])
    rows = QUERIES["op11_cross_tokenizer_alignment"](spark, sf_dir).collect()
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert sorted((str(r["doc_id"]), *(r[c] for c in COUNTED), r["groups_sha256"]) for r in rows) == [(*w[:-1], digest(w[-1])) for w in want]


ODD_TEXTS = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> and <s> </s> <unk> <0x41>"), (6, "naïve 日本語 🙂 é\x00\x01"), (7, "the the  the\n\nthe\t"), (7, "the the  the\n\nthe\t"), (None, "No id here, but tokens."), (8, "x" * 5000)]


def test_alignment_of_odd_rows(make):
    assert align.align(make(), BYTES, PIECES).count() == 0
    got = aligned(clashing(make(*ODD_TEXTS)))
    assert got == brute_alignment(ODD_TEXTS)
    none = {r[0]: r[1:] for r in got}
    assert none["1"] == none["2"] == none["4"] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_by_ranges_of_buckets(make, documents):
    rows = documents.limit(40).select("doc_id", "text").collect()
    docs = make(*((r["doc_id"], r["text"]) for r in rows))
    assert aligned(docs, most_pairs=1024) == brute_alignment([(r["doc_id"], r["text"]) for r in rows])


def test_long_texts_are_cut_where_no_token_reaches_across(make, documents):
    text = " ".join(r["text"] for r in documents.where("length(text) > 5000").limit(12).collect())
    assert len(text) > align.CUT_CHARS and len(list(align.cut(text))) > 1
    assert aligned(make((1, text))) == brute_alignment([(1, text)])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1000, 1500])
def test_hash_is_perfect_and_minimal(n):
    keys = np.sort(np.random.default_rng(n).choice(1 << 40, n, replace=False))
    placed, seeds = align.hash_bucket(keys)
    table = align.PairHash(1, 0, [placed.tobytes()], [seeds.tobytes()])
    assert sorted(table.slots(keys).tolist()) == list(range(n)) and (placed[table.slots(keys)] == keys).all()
    assert (table.slots(keys + (1 << 41)) == -1).all()


def test_vectors_add_up_over_many_tasks(spark):
    rows = [(s, p, [p, s, 1]) for s in (0, 3) for p in range(300)]
    got = {r["segment"]: list(r["counts"]) for r in tree_sum(spark.createDataFrame(rows, PARTS)).collect()}
    assert got == {0: [44850, 0, 300], 3: [44850, 900, 300]}
    assert tree_sum(spark.createDataFrame([], PARTS)).count() == 0


# ---- op 12


def brute_negatives(rows, is_anchor, k=5, m=10, low=30, high=90):
    """rows: (id, label, vector of Python ints), distinct."""
    wide = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, [*v, *[0] * (wide - len(v))]) for i, label, v in rows]
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), n, c == label) for n, c, w in rows if n != i)
        for p in [s for s in scored if s[2]][:k]:
            fits = [s for s in scored if not s[2] and -low * p[0] <= -100 * s[0] <= -high * p[0]][:m]
            out += [(i, p[1], r, s[1], -p[0], -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **more):
    rows = negatives.hard_negatives(df, F.col("id") % 3 == 0, **more).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows)


VECTORS = "id bigint, label int, vector array<bigint>"


@pytest.mark.parametrize("name", ["op12_hard_negatives"])
def test_op12_matches_sql_on_larger_tables(spark, name):
    same_rows(QUERIES[name](spark, "/root/testdata/sf0.1"), ORACLE_SQL[name], "/root/testdata/sf0.1")


@pytest.mark.parametrize("scale", [3, 40, 10**6, 10**9])
def test_negatives_are_brute_force(spark, scale):
    rng = np.random.default_rng(scale)
    rows = [(i, int(rng.integers(3)), rng.integers(-scale, scale, 5).tolist()) for i in range(150)]
    rows += [(200 + i, 1, [scale, scale, 0, 0, 1]) for i in range(1500)]  # copies of one vector: ties by id over several blocks
    want = brute_negatives(rows, lambda i: i % 3 == 0 and i < 200)
    got = [r for r in mined(spark.createDataFrame(rows, VECTORS)) if r[0] < 200]
    assert got == want and got


def test_negatives_of_odd_rows(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    huge = 1 << 62
    odd = [(None, 1, [1, 2]), (3, None, [1, 2]), (6, 1, None), (9, 1, [1, None]), (12, 1, []), (15, 1, [huge, huge]), (18, 1, [5]), (18, 1, [5]), (19, 1, [4, 1]), (20, 2, [2, 0]), (20, 2, [3, 9]), (21, 2, [-1, 0]), (22, 2, [1, 1])]
    plain = [r for r in dict.fromkeys((a, b, tuple(c)) for a, b, c in odd if None not in (a, b, c) and None not in c and huge not in c)]
    assert mined(clashing(spark.createDataFrame(odd, VECTORS))) == brute_negatives(plain, lambda i: i % 3 == 0)


def test_percents_are_exact(spark):
    values = [0, 1, 7, 99, 100, 101, 12345, -1, -7, -100, (1 << 60) + 17]
    df = spark.createDataFrame([(v,) for v in values], "s bigint").select("s", negatives.percent_of(F.col("s"), 30, True).alias("lo"), negatives.percent_of(F.col("s"), 90, False).alias("hi"))
    assert all((r["lo"], r["hi"]) == (-(-30 * r["s"] // 100), 90 * r["s"] // 100) for r in df.collect())


def test_nodes_outside_windows_are_not_opened():
    far = np.full((256, 2), 1000.0)
    lists = negatives.Lists(np.array([1]), np.array([1]), np.array([0]), np.array([[1.0, 1.0]]), np.array([[0]]), np.array([[100]]), 3)
    opened = []
    lists.take = lambda *a: opened.append(a)
    boxes = np.full((4, 2), 1000.0)
    lists.visit(np.arange(256), np.ones(256, int), far, boxes, boxes, False)
    assert not opened


# ---- op 13


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    runs = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + d for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for d in range(3)}
    n, r = len(words), len(inside)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, r, n < 50 or 100 * r > 50 * n


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute_scores(rows, trusted, bits):
    grams = rules.Grams(bits)
    size = 1 << bits
    each = [(i, dict(zip(*(x.tolist() for x in grams.buckets((t or "").encode().split())), strict=True))) for i, t in rows]
    raw, target = Counter(), Counter()
    for i, c in each:
        raw.update(c)
        if i in trusted:
            target.update(c)
    r_all, t_all = sum(raw.values()), sum(target.values())
    out = []
    for i, c in each:
        m, own = sum(c.values()), i in trusted
        total = 0.0
        for b, n in c.items():
            p = (raw[b] - n + 1) / (r_all - m + size)
            total += n * math.log((target[b] - own * n + size * p) / (t_all - own * m + size) / p)
        out.append((i, total / m if m else 0.0))
    return out


def test_op13_is_brute_force(spark, sf_dir, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    got = {r["doc_id"]: r for r in QUERIES["op13_quality_rules"](spark, sf_dir).collect()}
    base = {i: brute_base(t) for i, t in rows}
    scores = dict(brute_scores(rows, trusted, rules.BITS))
    ranked = sorted(math.floor(scores[i] * rules.GRID) for i in trusted if not base[i][-1])
    least = ranked[int(rules.MISSED * len(ranked))] / rules.GRID
    for i, _ in rows:
        assert tuple(got[i][c] for c in BASE) == base[i]
        assert got[i]["score"] == pytest.approx(scores[i], abs=1e-9)
        assert got[i]["kept"] == (not base[i][-1] and scores[i] >= least)


def test_op13_agrees_with_labels(spark):
    """Held out: the trusted documents are half of the labelled ones."""
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("quality = 1 AND toxic = 0 AND doc_id % 2 = 0")
    rows = rules.score_rules(docs, half).join(labels.where("doc_id % 2 = 1 OR quality = 0"), "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_rules_of_odd_rows(make, spark):
    none = spark.createDataFrame([], "doc_id bigint")
    assert rules.score_rules(make(), none).count() == 0
    long = "word " * 3 + " ".join(f"w{k}" for k in range(60_000))
    odd = [(1, None), (2, ""), (3, " \n \n"), (4, "same line\nsame line\n same line\n\n\n"), (5, "a a a a"), (6, long), (6, long), (None, long), (7, "a b c " * 30), (8, "   x\x0by")]
    rows = rules.score_rules(clashing(make(*odd)), none).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in BASE)) for r in rows) == sorted((str(i), *brute_base(t)) for i, t in odd)
    assert all(r["score"] == 0.0 and r["kept"] == (not r["base_failed"]) for r in rows)  # nothing trusted: nothing tells them apart
    trusted = make((6, None), (None, None), (6, None)).select("doc_id")
    assert {r["kept"] for r in rules.score_rules(make(*odd), trusted, threshold=-9.0).where("doc_id = 6").collect()} == {True}
