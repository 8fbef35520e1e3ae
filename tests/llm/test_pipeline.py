"""Each stage against a brute-force version on the rows it was given."""

from __future__ import annotations

import public_tokenizers
import tokenizers
from test_llm_queries import brute_groups

import corpus_pipeline as p


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, sf_dir, documents, tmp_path):
    docs, seen = documents, []
    for k, (_, work) in enumerate(p.STAGES):
        out = work(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((by_id(docs), by_id(out)))
        docs = out
    quality, lines, near, leaks, coded = seen

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [(i in quality[1]) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.97

    before, after = lines
    strip = lambda t: t.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = {}
    for i in sorted(before):
        for line in (before[i]["text"] or "").split("\n"):
            first.setdefault(strip(line), i)
    for i, r in before.items():
        kept = "\n".join(x for x in (r["text"] or "").split("\n") if len(strip(x)) < 10 or first[strip(x)] == i)
        assert after[i]["text"] == kept and after[i]["n_chars"] == len(kept)

    groups = brute_groups({i: r["text"] for i, r in near[0].items()}, 5)
    assert set(near[1]) == {i for i, g in groups.items() if g[2]}

    import re

    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    items = [cut(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = [it[k : k + 12] for it in items for k in range(len(it) - 11)]
    for i, r in leaks[0].items():
        w = cut(r["text"])
        words = set(w)
        near_ones = [x for x in windows if sum(t in words for t in x) >= 10]
        hit = any(sum(a == b for a, b in zip(w[k : k + 12], x, strict=True)) >= 10 for x in near_ones for k in range(len(w) - 11))
        assert (i in leaks[1]) != hit

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(coded[1]) == set(coded[0])
    for i, r in coded[1].items():
        assert r["ids"] == lib.encode(coded[0][i]["text"] or "", add_special_tokens=False).ids and r["round_trip"]


def test_clean_documents_stay(spark, sf_dir):
    labels = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in p.keep_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    assert len(labels - kept) <= 0.02 * len(labels)


ODD = [(1, None), (2, ""), (3, "a"), (4, "Some words stand here, more than twelve of them, so that any window of words fits into them."), (4, "Some words stand here, more than twelve of them, so that any window of words fits into them."), (None, "x y z"), (6, " \n\t "), (7, "w" * 50_000)]


def test_stages_take_nulls_empties_repeats_and_nothing(spark, make, sf_dir):
    """What each stage returns for odd rows: the classifier rejects what has no words, the others keep it;
    rows that share an id and a text go or stay together; a null id is never dropped as a copy or leak."""
    odd, none = make(*ODD), make()
    for k, (_, work) in enumerate(p.STAGES):
        assert work(spark, none, sf_dir).count() == 0
        ids = sorted((r["doc_id"] for r in work(spark, odd, sf_dir).collect()), key=str)
        if k == 0:
            assert 1 not in ids and 2 not in ids and 6 not in ids and ids.count(4) in (0, 2)
        else:
            assert ids == sorted((i for i, _ in ODD), key=str)


def test_a_very_short_benchmark_item_is_no_evidence(spark, make, tmp_path):
    spark.createDataFrame([(1, "words"), (2, "six words are enough for this")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make((1, "clean words stay"), (2, "here six words are enough for this one"))
    assert [r["doc_id"] for r in p.drop_leaks(spark, docs, str(tmp_path)).collect()] == [1]
