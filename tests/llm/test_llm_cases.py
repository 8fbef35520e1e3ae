"""Small cases of each corpus operator: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_llm_queries import brute_groups

from ridgeline.llm import bpe, chat, components, decontam, licenses, lines, media, neardup, quality, tokens, urls

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
OPERATORS = {
    "licenses": licenses.scan_licenses,
    "tokens": lambda d: tokens.prefix_token_counts(d, PIECES),
    "bpe": lambda d: bpe.decode(bpe.encode(d, BYTES), BYTES),
    "leaks": lambda d: decontam.find_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "media": lambda d: media.read_media(media.store_media(d)),
    "quality": quality.score_quality,
    "lines": lines.dedup_lines,
    "neardup": neardup.near_duplicates,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_nulls_repeats_and_clashing_columns(spark, make, name):
    op = OPERATORS[name]
    assert op(make()).count() == 0
    odd = make((1, None), (2, ""), (3, "a"), (3, "a"), (None, "Some words stand here, twelve of them, so that windows of any kind fit in."), (4, " \n\t "))
    for c in ("ids", "w", "key", "pos", "rep", "n", "bands", "_text", "_row", "media", "kept", "component", "i", "mask", "votes", "hub"):
        odd = odd.withColumn(c, F.lit("x"))
    rows = op(odd).collect()
    assert name == "leaks" or len(rows) == 6


def test_license_rules_take_adjacent_sentences_longest_first(spark, make):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    text = f"Words first.\n{apache}\nhttp://x\nAll rights reserved.\nno mit license here\nMIT License"
    r = licenses.scan_licenses(make((1, text))).first()
    assert r["licenses"] == "Apache-2.0,LicenseRef-all-rights-reserved,MIT" and r["n_unmatched"] == 0
    alone = licenses.scan_licenses(make((1, "You may obtain a copy of the License at"))).first()
    assert alone["licenses"] == "" and alone["sentence_ids"] == "apache2_obtain_copy" and alone["n_unmatched"] == 1
    with pytest.raises(ValueError, match="unknown"):
        licenses.check_tables({"a": "x"}, [("L", ["b"])])


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


ISC = """ISC License

Copyright (c) 2020, Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_wrapped_numbered_and_commented_licences_count(spark, make):
    flat = lambda t: " ".join(t.split())
    commented = lambda t, sign: "\n".join(f"{sign} {line}".rstrip() for line in t.splitlines())
    listed = lambda t, a, b, c: t.replace("1. ", a).replace("2. ", b).replace("3. ", c)
    bsd = "BSD-3-Clause"
    cases = [(MIT, "MIT"), (GPL, "GPL-3.0-or-later"), (BSD, bsd), (ISC, "ISC")]
    want = []
    for text, names in cases:
        want += [(text, names), (text.replace("\n", "\r\n"), names)] + [(commented(text, sign), names) for sign in (" *", "#", "//", ";;", "%", "--", "dnl", "REM", "C")]
    want += [(flat(GPL), "GPL-3.0-or-later"), (flat(BSD.split("reserved.")[1]), "BSD-3-Clause"), (BSD.split("3. ")[0], bsd.replace("3", "2"))]
    want += [(listed(BSD, *m), bsd) for m in (("a) ", "b) ", "c) "), ("(1) ", "(2) ", "(3) "), ("i. ", "ii. ", "iii. "), ("* ", "* ", "* "), ("\u2022 ", "\u2022 ", "\u2022 "))]
    want += [("This work is licensed under the GNU General Public License version\n3.\n", "GPL-3.0-only"), ("a MIT license", ""), ("MIT License and\nmore", ""), (BSD.replace("2. ", "Not so. 2. "), "LicenseRef-all-rights-reserved"), ("BSD 3-Clause License\n\n" + BSD, bsd), (MIT + "\n" + ISC, "MIT,ISC")]
    docs = make(*enumerate(t for t, _ in want), (900, want[0][0]), (901, None), (902, "no licence " * 3000))
    rows = licenses.scan_licenses(docs).collect()
    got = {r["doc_id"]: r["licenses"] for r in rows}
    assert [(t, got[k]) for k, (t, _) in enumerate(want)] == want
    joined = licenses.scan_licenses(docs, max_sentences=0).collect()  # a table too large for the plan
    assert sorted(map(tuple, joined)) == sorted(map(tuple, rows))


SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
COUNTER = tokens.PrefixCounter(tokens.model_pieces(tokens.read_file(PIECES)))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("  abcdethin▁\n\téß日本語😀0123.,<s>")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_prefix_counts_are_the_librarys(text):
    assert COUNTER.prefix_counts([text])[0].tolist() == [len(SP.encode(text[:k])) for k in range(1, len(text) + 1)]


def test_truncation_needs_no_encoding(spark, make):
    text = "The thing that was here, 日本語 and more of it. " * 20
    r = tokens.prefix_token_counts(make((1, text)), PIECES).select(tokens.truncate(F.col("text"), F.col("prefix_tokens"), 50).alias("cut"), tokens.total_tokens(F.col("prefix_tokens")).alias("n")).first()
    assert r["n"] == len(SP.encode(text)) and len(SP.encode(r["cut"])) <= 50 < len(SP.encode(text[: len(r["cut"]) + 12]))


LIB = tokenizers.Tokenizer.from_file(BYTES)
ENCODER = bpe.Encoder(bpe.Vocabulary(open(BYTES, encoding="utf-8").read()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=30), st.sampled_from(["<|endoftext|>", "  x  <|endoftext|>\n\n", "aaaa" * 40])), max_size=4))
def test_segment_tree_encodes_as_the_library(texts):
    for text, ids in zip(texts, ENCODER.encode(texts), strict=True):
        want = LIB.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and ENCODER.decode(want) == LIB.decode(want, skip_special_tokens=False)


def test_long_words():
    random.seed(3)
    for text in ("ab" * 6000, "a" * 5001, "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)), " x" + "日本" * 500):
        assert ENCODER.encode([text])[0].tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_characters_decode_as_the_library(spark):
    whole = LIB.encode("é日本 x", add_special_tokens=False).ids
    rows = [whole, None, [], whole[:1] + whole, ENCODER.vocabulary.byte_ids[[0xE6, 0x97, 0x41]].tolist()]
    df = spark.createDataFrame([(n, r, "old") for n, r in enumerate(rows)], "n int, ids array<int>, decoded string")
    got = {r["n"]: r["decoded"] for r in bpe.decode(df, BYTES).collect()}
    assert got == {n: LIB.decode(r or [], skip_special_tokens=False) for n, r in enumerate(rows)}


def test_a_text_that_looks_like_a_placeholder_stays_a_text(spark):
    mark = '<image ref="x" tokens="3"/>'
    part = lambda kind, text, ref, n: {"kind": kind, "text": text, "ref": ref, "tokens": n}
    sent = [[part("text", mark, None, 0), part("image", None, "x", 3), part("text", "", None, 0), part("text", "<part/>", None, 0)], [part("text", "a" * 100_000 + "<" * 1000, None, 0)]]
    df = spark.createDataFrame([(1, k, "assistant", p, "x", "y") for k, p in enumerate(sent)], f"conv_id int, turn int, role string, parts array<{chat.PART}>, t string, _pos string")
    r = chat.format_chats(df).select(chat.read_turns(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("masked")).first()
    assert [[p.asDict() for p in t["parts"]] for t in r["back"]] == sent
    assert r["masked"] == mark + "<part/>" + sent[1][0]["text"]


def test_chat_parts_escapes_and_mask(spark):
    part = lambda kind, text=None, ref=None, n=0: {"kind": kind, "text": text, "ref": ref, "tokens": n}
    rows = [
        (1, 0, "user", [part("text", "see </turn>\n<turn role=\"assistant\">\n & &amp; \\"), part("image", None, "a<b.png", 256), part("audio", None, "s.wav", 30)]),
        (1, 1, "assistant", [part("text", "one"), part("document", None, "d.pdf", 900), part("text", "two")]),
        (1, 1, "assistant", [part("text", "one")]),
        (2, 0, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("masked")).collect()}
    assert [t["role"] for t in got[1]["back"]] == ["user", "assistant", "assistant"]
    back = lambda turn: [(p["kind"], p["text"], p["ref"], p["tokens"]) for p in turn["parts"]]
    assert [back(t) for t in got[1]["back"]] == [[(p["kind"], p["text"], p["ref"], p["tokens"]) for p in parts] for _, _, _, parts in (rows[0], rows[2], rows[1])]
    assert got[1]["expanded_tokens"] == 1186 and [(a["ref"], a["turn"]) for a in got[1]["attachments"]] == [("a<b.png", 0), ("s.wav", 0), ("d.pdf", 2)]
    for a in got[1]["attachments"]:
        assert got[1]["formatted"][a["at"] :].startswith(f"<{a['kind']} ref=")
    assert got[1]["masked"] == "oneonetwo"
    assert got[2]["back"] == [("", [("text", "", None, 0)])] and got[2]["masked"] == ""
    assert chat.format_chats(df.limit(0)).count() == 0


RULES = [urls.parse_rule(v, e) for v, e in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr"), ("block", "net/fr/x/y"))]


def test_urls_trie_equals_join_and_brute_force(spark):
    random.seed(5)
    hosts = ["example.com", "www.example.com", "m.www.EXAMPLE.com", "com", "xcom", "a.net", "net", "", "examples.com:80", "a..net"]
    paths = ["", "/", "/en/", "/en", "/en/7?x=/es/", "/es/1#a", "/fr", "/france", "/fr/x/y", "/fr/x", "?/en/"]
    made = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no-scheme.com/en/", "a://b://com/"]
    df = spark.createDataFrame([(n, u) for n, u in enumerate(made + made[:5])], "page_id int, url string")
    by_trie = sorted(map(tuple, urls.judge_urls(df, RULES).collect()), key=str)
    assert by_trie == sorted(map(tuple, urls.judge_urls(df, RULES, max_broadcast=0).collect()), key=str)
    for _, host, path, rule, verdict in by_trie:
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)
        assert (rule, verdict) == ((best.text, best.verdict) if best else (None, "allow"))


def test_masks_cover_any_two_substitutions(spark, make):
    item = " ".join(f"w{k}" for k in range(12))
    rows = []
    for a in range(12):
        for b in range(a, 12):
            w = item.split()
            w[a] = w[b] = "other"
            rows.append((len(rows), f"before it {' '.join(w)} after"))
    bench = spark.createDataFrame([(7, item), (8, "too short to window"), (9, None)], "item_id int, text string")
    found = decontam.find_leaks(make(*rows, (900, "It is Too short: to WINDOW, no?"), (901, " ".join(["x", "y", "z", *item.split()[3:]]))), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["n_windows"], r["first_word"], r["last_word"]) for r in found} == {(k, 7, 1, 2, 13) for k in range(len(rows))} | {(900, 8, 1, 2, 5)}


def test_broadcast_and_shuffle_find_the_same(spark, sf_dir, documents):
    docs = documents.select(F.col("doc_id").alias("doc"), decontam.hashes(F.col("text")).alias("w"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("item"), decontam.hashes(F.col("text")).alias("v"))
    one, two = (sorted(map(tuple, decontam.matched_windows(docs, items, few).collect())) for few in (True, False))
    assert one == two and one


def test_stream_survives_inspection():
    data = media.padded(b"payload" * 5000)
    stream = media.mux(data)
    assert len(stream) % 188 == 0
    r = media.Demuxer(stream)
    assert r.payload == data and r.counts["gaps"] == r.counts["broken"] == 0
    assert [p["pts"] for p in r.points] == [n * media.TICKS for n in range(len(r.points))]
    assert [n for n, p in enumerate(r.points) if p["random_access"]] == list(range(0, len(r.points), media.RANDOM_ACCESS_EVERY))
    assert [c["pcr"] for c in r.clocks] == [300 * p["pts"] for p in r.points if p["random_access"]]
    assert all(media.read_time_stamp(media.time_stamp(t)) == t for t in (0, 1, 90_000, (1 << 33) - 1))
    packets = [stream[k : k + 188] for k in range(0, len(stream), 188)]
    lost = media.Demuxer(b"".join(packets[:10] + packets[11:])).counts
    assert lost["gaps"] == 1 and lost["broken"] == 1
    twice = media.Demuxer(b"".join(packets[:10] + packets[9:]))
    assert twice.payload == data and twice.counts["gaps"] == 0
    assert media.Demuxer(b"".join(p for p in packets if p[1] & 0x1F or p[2])).payload == b""  # without tables nothing is read
    shifted = media.Demuxer(b"noise" + stream)
    assert shifted.payload == data and shifted.counts["broken"] == 1


def crc(data):
    c = 0xFFFFFFFF
    for bit in (byte >> k & 1 for byte in data for k in range(7, -1, -1)):
        c = (c << 1 ^ (0x04C11DB7 if c >> 31 ^ bit else 0)) & 0xFFFFFFFF
    return c.to_bytes(4, "big")


def test_a_foreign_stream_is_read():
    """Built apart from the writer: video of open length with two time stamps, audio with padding, a table
    over several packets, a private section stream, null, damaged and scrambled packets, a jump of the counter."""
    counters = {}

    def ts(pid, data, start=False, marks=None, extra=b"", error=False, scrambled=0, step=1):
        counters[pid] = counters.get(pid, -1) + step & 15
        if marks is not None or len(data) < 184:
            room = 183 - len(data)
            field = (bytes([marks or 0]) + extra).ljust(room, b"\xff")[:room] if room else b""
            data = bytes([len(field)]) + field + data
            control = 3
        else:
            control = 1
        assert len(data) == 184
        return bytes([0x47, error << 7 | start << 6 | pid >> 8, pid & 255, scrambled << 6 | control << 4 | counters[pid]]) + data

    def section(table, body):
        head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\1\xc1\0\0"
        return head + body + crc(head + body)

    stamp = lambda prefix, t: bytes([prefix << 4 | (t >> 30) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])
    es = lambda kind, pid, about=b"": bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(about)).to_bytes(2, "big") + about
    pat = b"\0" + section(0, b"\0\0\xe0\x10" + b"\0\1" + (0xE000 | 0x1E0).to_bytes(2, "big"))
    pmt = b"\0" + section(2, b"\xe1\x00\xf0\x00" + es(0x1B, 0x200, b"d" * 250) + es(0x0F, 0x201) + es(0x05, 0x202))
    picture = bytes(range(256)) * 3
    video = b"\0\0\1\xe0\0\0\x80\xc0\x0a" + stamp(3, 9000 + (1 << 32)) + stamp(1, 6000) + picture
    sound = b"\0\0\1\xc0" + (8 + 100).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(2, 9100) + b"s" * 100
    padding = b"\0\0\1\xbe" + (50).to_bytes(2, "big") + b"\xff" * 50
    out = [ts(0, pat.ljust(184, b"\xff"), True)]
    out += [ts(0x1E0, pmt[:184], True), ts(0x1E0, pmt[184:].ljust(184, b"\xff"))]
    pcr = (12345 << 15 | 0x7E00 | 7).to_bytes(6, "big")
    out += [ts(0x200, video[:100], True, 0x50, pcr)]
    out += [ts(0x200, video[k : k + 184]) for k in range(100, len(video), 184)]
    out += [ts(0x201, sound, True), ts(0x202, b"x" * 184, True), ts(0x1FFF, b"\0" * 184), ts(0x201, padding, True)]
    out += [ts(0x200, b"\0\0\1\xe0\0\0\x80\0\0" + b"more", True, 0x80, step=9)]
    out += [ts(0x201, b"y" * 184, error=True), ts(0x201, b"z" * 184, scrambled=2, step=0)]
    r = media.Demuxer(b"".join(out))
    assert r.payload == picture + b"more" + b"s" * 100
    assert [(p["pid"], p["stream_type"], p["pts"], p["dts"], p["random_access"], p["size"]) for p in r.points] == [
        (0x200, 0x1B, 9000 + (1 << 32), 6000, True, 768), (0x201, 0x0F, 9100, 9100, False, 100), (0x200, 0x1B, None, None, False, 4)]
    assert r.clocks == [{"pid": 0x200, "packet": 3, "pcr": 12345 * 300 + 7}]
    assert r.counts == {"packets": len(out), "programs": 1, "streams": 2, "elementary": 3, "gaps": 0, "broken": 0, "discontinuities": 1, "errors": 1, "scrambled": 1}


def test_em_tells_labellers_apart():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.85
    votes = np.where(rng.random((4000, 9)) < np.where(good[:, None], 0.97, 0.45), 1, -1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, table = quality.fit_labellers(patterns, counts.astype(float))
    of = {tuple(p): g for p, g in zip(patterns, posterior, strict=True)}
    right = np.mean([(of[tuple(v)] > 0.5) == g for v, g in zip(votes, good, strict=True)])
    assert right > 0.97 and (table[1, :, 0] < table[0, :, 0]).all()


def plain_posteriors(patterns, counts, rounds):
    """Expectation-maximisation as loops over documents' votes."""
    belief = {1: {-1: 0.01, 0: 0.19, 1: 0.8}, 0: {-1: 0.4, 0: 0.3, 1: 0.3}}
    start, extra = {0: 0.2, 1: 0.8}, quality.TRUST * sum(counts) + 1
    prior, table = dict(start), {c: [dict(belief[c]) for _ in patterns[0]] for c in (0, 1)}
    for _ in range(rounds):
        post = []
        for p in patterns:
            joint = {c: prior[c] * np.prod([table[c][k][v] for k, v in enumerate(p)]) for c in (0, 1)}
            post.append(joint[1] / (joint[0] + joint[1]))
        for c in (0, 1):
            mass = [n * (g if c else 1 - g) for n, g in zip(counts, post, strict=True)]
            own = extra * start[c]
            for k in range(len(patterns[0])):
                for v in (-1, 0, 1):
                    table[c][k][v] = (sum(m for m, p in zip(mass, patterns, strict=True) if p[k] == v) + own * belief[c][v]) / (sum(mass) + own)
            prior[c] = (sum(mass) + own) / (sum(counts) + extra)
    return post


def test_posteriors_are_those_of_plain_loops():
    rng = np.random.default_rng(4)
    patterns = np.unique(rng.integers(-1, 2, (60, 5)), axis=0)
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    got, _ = quality.fit_labellers(patterns, counts, rounds=40)
    assert got == pytest.approx(plain_posteriors(patterns.tolist(), counts.tolist(), 40), abs=1e-8)


def test_scorer_is_at_the_optimum_and_scores_follow_from_texts(spark, make):
    """The gradient of the stated loss vanishes, and Spark's scores are those of a plain reading of each text."""
    rng = np.random.default_rng(2)
    rows = [(rng.choice(40, 6, replace=False).tolist(), rng.random(6).tolist()) for _ in range(300)]
    target = np.array([0.9 if 0 in f or 1 in f else 0.2 for f, _ in rows])
    w = quality.fit_scorer(rows, target, rounds=20_000, ridge=1e-2)
    share = target.mean(), 1 - target.mean()
    weight = target / share[0] + (1 - target) / share[1]
    weight /= weight.sum()
    gradient = 1e-2 * w
    for (f, v), t, a in zip(rows, target, weight, strict=True):
        z = w[-1] + sum(w[k] * x for k, x in zip(f, v, strict=True))
        err = a * (1 / (1 + np.exp(-z)) - t)
        gradient[-1] += err
        for k, x in zip(f, v, strict=True):
            gradient[k] += err * x
    assert np.abs(gradient[[*range(40), -1]]).max() < 1e-6

    texts = ["Some plain words, here and there; 12 of them (or so) stand in a row today.", "$$ %% ~~ ||", "WORD WORD WORD x x x", "", None, "a\u0301 _x_ 1st"]
    weights = rng.normal(size=quality.DIMENSIONS + 1)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(make(*enumerate(texts)), weights=weights).collect()}
    for n, text in enumerate(texts):
        words = (text or "").split()
        if not words:
            assert got[n] == 0
            continue
        stats = quality.Reader().read([text])[0][0]
        shapes = [quality.crc32(quality.word_shape(x).encode()) % quality.DIMENSIONS for x in words] + [quality.crc32(b"a") % quality.DIMENSIONS] * quality.PLAIN_WORDS
        z = weights[-1] + sum(weights[k] for k in shapes) / len(shapes) + sum(weights[k] * x for k, x in zip(quality.STATISTICS, stats, strict=True))
        assert got[n] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-6)


@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZ019.,_-$$~~éßǅ٣²")), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=9).filter(lambda t: len(t.split()) == 1 and t.split()[0] == t))
@settings(max_examples=300, deadline=None)
def test_shortcuts_for_words_give_what_the_rules_say(word):
    plain = sum(map(str.isalnum, word))
    want = (int(bool(quality.DECORATED.search(word))), int(len(word) > 2 and word.isupper()), int(not plain), int(not word[-1].isalnum()), int(len(word) <= 3 and plain > 0), len(word) - plain, len(word), quality.crc32(quality.word_shape(word).encode()) % quality.DIMENSIONS)
    assert quality.Reader.of_word(word) == want


def test_line_dedup_small(spark, make):
    docs = make((5, "Shared line here\nown five five"), (2, "  SHARED line HERE\t\nshort\nshared LINE here"), (9, "Shared line here\nshort"), (None, "Shared line here"), (7, None))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(docs, batches=3).collect()}
    assert got == {5: (2, 1, "own five five"), 2: (3, 0, "  SHARED line HERE\t\nshort\nshared LINE here"), 9: (2, 1, "short"), None: (1, 0, "Shared line here"), 7: (1, 0, "")}


def test_runs_compact(spark):
    runs = lines.LineRuns(spark, fan_in=2, buckets=2)
    for b in range(4):
        runs.append(spark.createDataFrame([(h, h, b) for h in range(b, b + 3)], "h1 long, h2 long, first int"))
    assert sorted((r["h1"], r["first"]) for r in runs.table().collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 3)]
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    runs.drop()


def test_runs_outlive_their_session(spark, make, tmp_path):
    """Yesterday's runs, opened again for today's documents, give what one call over both gives."""
    first = make((1, "A line of some length\nand another one"), (2, "something else here"))
    second = make((7, "a LINE of some length\nsomething else here\nnew line of today"), (9, "new line of today"))
    path = str(tmp_path / "runs")
    seen = []
    for day in (first, second):
        runs = lines.LineRuns(spark, fan_in=2, path=path)
        seen += lines.dedup_lines(day, batches=2, runs=runs).collect()
        assert runs.batches == 2 * (1 + (day is second))
        runs.close()
    assert sorted(seen) == sorted(lines.dedup_lines(first.unionByName(second)).collect())
    (tmp_path / "runs" / "0-9-9-4").mkdir()  # a run whose writing never ended
    again = lines.LineRuns(spark, path=path)
    assert again.batches == 4 and again.table().count() == 4
    with lines.runs_read_sorted(spark):
        name = again.runs()[0]
        plan = spark.table(name).join(spark.table(name).hint("merge"), lines.HASH, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "Exchange" not in plan
    again.drop()
    assert not (tmp_path / "runs").exists()


def test_documents_before_the_runs_are_refused(spark, make):
    runs = lines.LineRuns(spark, buckets=2)
    lines.dedup_lines(make((5, "a line of some length")), batches=1, runs=runs).collect()
    with pytest.raises(ValueError, match="document 2 comes before document 5"):
        lines.dedup_lines(make((2, "a line of some length"), (9, "another line of some length")), batches=1, runs=runs)
    assert runs.batches == 1 and runs.table().count() == 1
    got = lines.dedup_lines(make((7, "a line of some length"), (2, None), (3, "short")), batches=1, runs=runs).collect()
    assert sorted((r["doc_id"], r["n_dropped"], r["text"]) for r in got) == [(2, 0, ""), (3, 0, "short"), (7, 1, "")]
    runs.drop()


def test_ids_may_be_strings(spark):
    df = spark.createDataFrame([("b", "one two three four five six\nshort"), ("a", "one two three four five six\nshort"), ("c", None)], "doc_id string, text string")
    near = {r["doc_id"]: (r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert near == {"a": ("a", True), "b": ("a", False), "c": ("c", True)}
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == {"a": "one two three four five six\nshort", "b": "short", "c": ""}


def test_an_id_with_two_texts_is_one_document(spark, make):
    one, two = " ".join(f"u{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))
    got = sorted(tuple(r) for r in neardup.near_duplicates(make((5, one), (5, two), (3, one + " end"), (9, two + " end"), (8, "w x y z"))).collect())
    assert got == [(3, 27, 3, True), (5, 26, 3, False), (5, 26, 3, False), (8, 1, 8, True), (9, 27, 3, False)]


def test_very_long_texts(spark, make):
    """Each operator takes a text of some hundred thousand words whole: its end counts."""
    words = " ".join(f"w{k % 5000}x{k}" for k in range(120_000))
    item = "this very passage of a benchmark stands at the end of a long text today"
    text = f"{words}\n{item}\nMIT License"
    docs = make((1, text), (2, text + "."), (3, item))
    assert {r["licenses"] for r in licenses.scan_licenses(docs.where("doc_id = 1")).collect()} == {"MIT"}
    bench = spark.createDataFrame([(7, item)], "item_id int, text string")
    assert {r["doc_id"] for r in decontam.find_leaks(docs, bench).collect()} == {1, 2, 3}
    near = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3}
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    assert kept == {1: text, 2: "MIT License.", 3: ""}
    back = media.read_media(media.store_media(docs)).where("doc_id = 1").first()
    assert bytes(back["payload"]).rstrip(b" ").decode() == text
    assert bpe.decode(bpe.encode(docs, BYTES), BYTES).where("doc_id = 1").first()["decoded"] == text
    assert tokens.prefix_token_counts(docs, PIECES).where("doc_id = 1").select(tokens.total_tokens(F.col("prefix_tokens"))).first()[0] == len(SP.encode(text))
    assert {r["doc_id"] for r in quality.score_quality(docs).where("quality_score IS NOT NULL").collect()} == {1, 2, 3}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    random.seed(1)
    random.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_are_brute_force(spark, make, words):
    random.seed(words)
    bases = [[f"w{random.randrange(400)}" for _ in range(n)] for n in (1, 2, 3, 6, 12, 40, 120)]
    texts = []
    for base in bases:
        for _ in range(14):
            w = list(base)
            for _ in range(random.choice((0, 0, 1, 2, 5))):
                w[random.randrange(len(w))] = f"x{random.randrange(9)}"
            texts.append(" ".join(w).upper() if random.random() < 0.3 else "\t ".join(w))
    rows = list(enumerate(texts))
    random.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(make(*rows), words=words).collect()}
    assert got == brute_groups(dict(rows), words)


@pytest.mark.parametrize("part", [7, 1_000])
def test_outliers_beside_a_large_group_link_where_they_should(spark, make, monkeypatch, part):
    monkeypatch.setattr(neardup, "PART_OF_HUB", part)
    random.seed(8)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(120):
        w = list(base)
        for at in random.sample(range(100), random.choice((2, 4, 7, 9))):
            w[at] = f"n{k % 40}_{at}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(make(*rows), words=2).collect()}
    assert got == brute_groups(dict(rows), 2)


def test_registers_estimate_similarity(spark):
    sketcher = neardup.Sketcher(1)
    a, b = (" ".join(map(str, range(*r))) for r in ((0, 900), (100, 1000)))
    x, y = (sketcher.registers(sketcher.shingles(t)).view(np.int64).tolist() for t in (a, b))
    df = spark.createDataFrame([(x, y)], "x array<long>, y array<long>")
    got = df.select(neardup.estimate(F.col("x"), F.col("y"), F.lit(900), F.lit(900)).alias("j")).first()["j"]
    assert abs(got - 0.8) < 0.12


def test_narrow_windows_see_the_last_words():
    words = [f"word{k}" for k in range(60)]
    narrow = lambda ws: quality.Reader().read([" ".join(ws)])[0][0][quality.LABELLERS.index("narrow windows")]
    for n in (1, 19, 20, 21, 39, 40, 60):
        assert narrow(words[:n]) == 0
    m = 39 + quality.PLAIN_WORDS
    assert narrow(words[:20] + ["up", "down"] * 9 + ["up"]) == pytest.approx(17 * 19 / 20 / m)
    assert narrow(["up", "down"] * 9 + ["up", "x"] + words[:19]) == pytest.approx(17 / m)
    assert narrow(["up", "down"] * 10) == pytest.approx(18 / (20 + quality.PLAIN_WORDS))


def test_license_scan_of_many_lines_without_letters(make):
    """Time grows with the text: rules and dashes between licence lines are neither read again from each line end nor counted."""
    rules = "\u2500\u2500\n" * 100_000
    began = time.time()
    r = licenses.scan_licenses(make((1, rules + "MIT License\n" + rules + "other words\n" + rules))).first()
    assert time.time() - began < 30
    short = licenses.scan_licenses(make((1, "\u2500\u2500\nMIT License\n\u2500\u2500\nother words\n\u2500\u2500"))).first()
    assert (r["licenses"], r["sentence_ids"], r["n_unmatched"]) == (short["licenses"], short["sentence_ids"], short["n_unmatched"]) and r["licenses"] == "MIT"
