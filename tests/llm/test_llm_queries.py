"""Registered corpus queries against SQL, or against a brute-force version where SQL can't say them."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from oracle import same_rows

from ridgeline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op2_is_the_library(spark, sf_dir, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op2_token_counts"](spark, sf_dir).collect()}
    want = {i: (len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in texts(documents).items()}
    assert got == want


def test_op5_is_the_library(spark, sf_dir, documents):
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op5_bpe"](spark, sf_dir).collect()}
    for i, t in texts(documents).items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_op7_gives_payloads_back(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in QUERIES["op7_media_columns"](spark, sf_dir).collect()}
    for i, t in texts(documents).items():
        data = t.encode()
        padded = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), sha(padded), zlib.crc32(padded[-16:]))
        assert r["media_bytes"] % 188 == 0 and "gaps=0 broken=0" in r["feature"]


def test_op8_agrees_with_labels(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op8_quality_classifier"](spark, sf_dir).collect()
    right = [r["kept"] == bool(labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    assert len(right) > 50 and sum(right) / len(right) > 0.97


def brute_groups(texts, words, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_op10_is_brute_force(spark, sf_dir, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op10_minhash_near_dedup"](spark, sf_dir).collect()}
    assert got == brute_groups(texts(documents), 2)
