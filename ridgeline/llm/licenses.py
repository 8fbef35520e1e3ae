"""License scan by sentence rules, in DataFrame functions only.

A text is cut into pieces at line ends and at marks before a blank; a run of pieces that spells a
sentence of a table of known licence sentences is that sentence, however it is wrapped, commented out
or numbered; the identifiers, in order, are matched against ordered licence rules. A rule is a run of
adjacent identifiers; a title or the like that may stand before them, with a copyright line between, ends
in ``?``. Rules are tried in the order given (longest first), and what one rule has matched no later
rule sees.

With a sentence table of up to MAX_SENTENCES entries everything happens inside the row: no shuffle, no
join, no Python; the table and the rules become literals of the plan. A larger table is joined: hashes of
the runs of pieces of each distinct text meet hashes of the sentences.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SENTENCES = 2_000
"""Known sentences that become literals of the plan; a larger table is joined."""

# Identifiers and normalised wording of public licence sentences.
SENTENCES: dict[str, str] = {
    "all_rights_reserved": "all rights reserved",
    "apache2_licensed": "licensed under the apache license version 2.0",
    "apache2_the_license": "licensed under the apache license version 2.0 the license",
    "apache2_may_not_use": "you may not use this file except in compliance with the license",
    "apache2_obtain_copy": "you may obtain a copy of the license at",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2_title": "bsd 2 clause license",
    "bsd3_title": "bsd 3 clause license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc_by_4": "licensed under cc by 4.0",
    "cc_by_nc_4": "licensed under cc by nc 4.0",
    "cc_by_sa_4": "licensed under cc by sa 4.0",
    "gpl2_licensed": "this work is licensed under the gnu general public license version 2",
    "gpl3_licensed": "this work is licensed under the gnu general public license version 3",
    "gpl_redistribute_3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_no_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc_title": "isc license",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit_released": "released under the mit license",
    "mit_title": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "public_domain": "this work is in the public domain",
}

# Ordered rules, each a licence and the sentences that state it, longest first.
RULES: list[tuple[str, list[str]]] = [
    ("BSD-3-Clause", ["bsd3_title?", "all_rights_reserved?", "bsd_redistribution", "bsd_source", "bsd_binary", "bsd_name"]),
    ("BSD-2-Clause", ["bsd2_title?", "all_rights_reserved?", "bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache2_the_license", "apache2_may_not_use", "apache2_obtain_copy"]),
    ("MIT", ["mit_title?", "all_rights_reserved?", "mit_grant", "mit_notice"]),
    ("ISC", ["isc_title?", "all_rights_reserved?", "isc_grant"]),
    ("GPL-3.0-or-later", ["gpl_redistribute_3", "gpl_no_warranty"]),
    ("Apache-2.0", ["apache2_the_license"]),
    ("Apache-2.0", ["apache2_licensed"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC0-1.0", ["cc0"]),
    ("GPL-2.0-only", ["gpl2_licensed"]),
    ("GPL-3.0-only", ["gpl3_licensed"]),
    ("GPL-3.0-or-later", ["gpl_redistribute_3"]),
    ("BSD-2-Clause", ["bsd2_title"]),
    ("BSD-3-Clause", ["bsd3_title"]),
    ("ISC", ["isc_title"]),
    ("MIT", ["mit_released"]),
    ("MIT", ["mit_title"]),
    ("LicenseRef-public-domain", ["public_domain"]),
    ("LicenseRef-all-rights-reserved", ["all_rights_reserved"]),
]

END = r"([.!?:;])[ \t\r\n\f]+"
PUNCTUATION = r"[] \t\r\f\"'(),:;/*#<>_\[{}|~=&%$@!?\\-]+"
MARK, FOUND = "\x02", "\x03"
"""Stand behind a list marker, and around a known sentence; both are taken out of texts first."""

COMMENT_WORDS = {"c", "dnl", "rem"}
"""Begin comment lines in Fortran, M4 and Basic; other comment signs are punctuation."""

MARKER = r"(?dm)^([^\p{L}\p{N}\n]*+(?:(?:c|dnl|rem)[ \t][^\p{L}\p{N}\n]*+)?(?:[0-9]{1,3}(?:\.[0-9]{1,3}){0,3}|[a-z]|[ivx]{2,5}))[.:)\]]+(?=[ \t\r\f]|$)"
NO_WORD = r"[^\p{L}\p{N}]*"
GAP = rf"{MARK}?(?: |\n{NO_WORD})"


def pieces(text: Column) -> Column:
    """The normalised, non-empty pieces of a text, in order; list markers end with MARK.

    A piece ends at ``.``, ``!``, ``?``, ``:`` or ``;`` before white space, or at a line end.
    Lower-cased; runs of punctuation and blanks become one space; outer blanks and full stops go.
    """
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARK + FOUND, "\x01\x01")
    cut = F.regexp_replace(F.regexp_replace(plain, END, "$1\n"), MARKER, f"$1{MARK}")
    flat = F.regexp_replace(cut, PUNCTUATION, " ")
    return F.filter(F.transform(F.split(flat, "\n"), lambda s: F.btrim(s, F.lit(" ."))), lambda s: s != "")


def lines_of(cut: Column, known: dict[str, str]) -> Column:
    """The pieces of a text that hold a letter or digit, each between line ends, without words that only begin comments.

    Pieces without either say nothing, and a search for what follows a line end would run over all of them from each."""
    spoken = F.filter(cut, lambda s: F.regexp_like(s, F.lit(r"[\p{L}\p{N}]")))
    text = F.concat(F.lit("\n"), F.array_join(spoken, "\n"), F.lit("\n"))
    if words := COMMENT_WORDS - {w for s in known.values() for w in s.split()}:
        text = F.regexp_replace(text, rf"(?<=\n)(?:{'|'.join(sorted(words))})(?: |(?=\n))", "")
    return text


def identifiers(cut: Column, known: dict[str, str]) -> Column:
    """``<id>`` for each known sentence and ``.`` for each stretch of other words, in order, as one string.

    A known sentence begins with a piece, behind a list marker or not, and ends with a piece. Within it
    any piece may end: a line, or a mark that the table leaves out ("free software: you can"). The
    longest sentence counts.
    """
    if not known:
        return F.lit(".")
    text = lines_of(cut, known)
    spelled = "|".join(GAP.join(map(re.escape, s.split(" "))) for s in sorted(known.values(), key=len, reverse=True))
    held = F.regexp_replace(text, rf"\n(?:[0-9a-z.]+{MARK}[ \n])?{NO_WORD}({spelled}){MARK}?(?=\n)", f"\n{FOUND}$1{FOUND}")
    table = F.create_map(*[F.lit(x) for i, s in known.items() for x in (s, f"<{i}>")])

    def name(s: Column, k: Column) -> Column:
        other = F.when(F.regexp_like(s, F.lit(r"[\p{L}\p{N}]")), ".").otherwise("")
        return F.when(k % 2 == 1, F.coalesce(table[F.regexp_replace(s, GAP, " ")], F.lit("."))).otherwise(other)

    return F.array_join(F.transform(F.split(held, FOUND), name), "")


def identifiers_by_join(texts: DataFrame, known: dict[str, str]) -> DataFrame:
    """(d1, d2, _ids) for each (d1, d2, _s), digests and pieces of distinct texts: what :func:`identifiers`
    gives, for any number of sentences.

    A text is a row of words. A sentence may start where a piece does, or what stands behind its list
    marker, and end where a piece does. The runs of words between such points that are as long as some
    sentence meet the sentences by 128 bits of hash. Of hits at one place the longest counts, of hits
    that overlap the first."""
    lengths = sorted({len(s.split(" ")) for s in known.values()})
    hashed = lambda words: (F.xxhash64(words).alias("h1"), F.xxhash64(F.lit(1), words).alias("h2"))
    table = texts.sparkSession.createDataFrame(list(known.items()), "id string, s string").select("id", *hashed(F.split("s", " ")))
    bare = F.filter(F.transform(F.split(lines_of(F.col("_s"), known), "\n"), lambda p: F.regexp_replace(p, r"^[^\p{L}\p{N}]+", "")), lambda p: p != "")

    def words_of(piece: Column) -> Column:
        words = F.split(piece, " ")
        behind = F.regexp_like(words[0], F.lit(f"^[0-9a-z.]+{MARK}$"))
        return F.transform(words, lambda w, k: F.struct(F.translate(w, MARK, "").alias("word"), (k == 0) | (k == 1) & behind, (k == 0) & behind, k == F.size(words) - 1))

    rows = texts.select("d1", "d2", F.flatten(F.transform(bare, words_of)).cast("array<struct<word:string,opens:boolean,marker:boolean,ends:boolean>>").alias("t"))
    at_all = F.sequence(F.lit(0), F.size("t") - 1)
    where = lambda flag: F.when(F.size("t") > 0, F.filter(at_all, lambda k: F.get("t", k)[flag]))
    rows = rows.select("d1", "d2", "t", F.transform("t", lambda x: x["word"]).alias("w"), where("ends").alias("ends"), where("opens").alias("opens"))
    size = lambda a, e: e - a + 1
    fits = lambda a: F.filter("ends", lambda e: F.array_contains(F.lit(lengths), size(a, e)))
    run = lambda a, e: F.struct(a.alias("at"), size(a, e).alias("size"), F.coalesce(F.get("t", a - 1)["marker"], F.lit(False)).cast("int").alias("skip"), *hashed(F.slice("w", a + 1, size(a, e))))
    runs = rows.select("d1", "d2", F.explode(F.flatten(F.transform("opens", lambda a: F.transform(fits(a), lambda e: run(a, e))))).alias("r")).select("d1", "d2", "r.*")
    hits = runs.join(table, ["h1", "h2"]).groupBy("d1", "d2").agg(F.array_sort(F.collect_set(F.struct("at", (-F.col("size")).alias("minus"), "skip", "id"))).alias("hits"))
    start = F.struct(F.lit(0).alias("next"), F.lit("").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        begin = h["at"] - h["skip"]
        name = F.concat(acc["out"], F.when(begin > acc["next"], ".").otherwise(""), F.lit("<"), h["id"], F.lit(">"))
        return F.when(begin < acc["next"], acc).otherwise(F.struct((h["at"] - h["minus"]).alias("next"), name.alias("out")))

    n = F.size("t")
    spelled = F.aggregate(F.coalesce("hits", F.array().cast("array<struct<at:int,minus:int,skip:int,id:string>>")), start, step, lambda acc: F.concat(acc["out"], F.when(acc["next"] < n, ".").otherwise("")))
    return rows.join(hits, ["d1", "d2"], "left").select("d1", "d2", spelled.alias("_ids"))


def check_tables(known: dict[str, str], rules: list[tuple[str, list[str]]]) -> None:
    """Refuse sentences with two identifiers, and rules that name unknown sentences or only optional ones."""
    if len(set(known.values())) < len(known):
        raise ValueError("two identifiers have the same sentence")
    for licence, ids in rules:
        if {i.removesuffix("?") for i in ids} - set(known) or all(i.endswith("?") for i in ids):
            raise ValueError(f"rule for {licence} names no or unknown sentences")


def rule_pattern(ids: list[str]) -> str:
    """A rule as a regular expression over identifiers; other words may follow an optional one."""
    return "".join(rf"(?:<{i[:-1]}>\.*)?" if i.endswith("?") else f"<{i}>" for i in ids)


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, max_sentences: int = MAX_SENTENCES
) -> DataFrame:
    """One row per input row: id, n_sentences, sentence_ids, licenses, n_unmatched.

    n_sentences: pieces of the text, so a wrapped sentence counts once a line. sentence_ids: recognised
    identifiers in order, joined by commas. licenses: the licence of each matched rule in text order,
    joined by commas. n_unmatched: recognised sentences that no rule used. A null or empty text has no
    sentence and empty strings; a text of any length is scanned whole. Repeated rows each get their row,
    no rows give no rows, ties can't arise; other columns are ignored, whatever their names. Above
    ``max_sentences`` known sentences the table is joined instead of being part of the plan.
    """
    check_tables(known, rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias(id_col), pieces(text).alias("_s"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    if len(known) > max_sentences:
        texts = found.groupBy("d1", "d2").agg(F.first("_s").alias("_s"))
        found = found.select(id_col, "d1", "d2", F.size("_s").cast("long").alias("n_sentences")).join(identifiers_by_join(texts, known), ["d1", "d2"]).select(id_col, "n_sentences", "_ids")
    else:
        found = found.select(id_col, F.size("_s").cast("long").alias("n_sentences"), identifiers(F.col("_s"), known).alias("_ids"))
    matched = F.col("_ids")
    for licence, ids in rules:
        matched = F.regexp_replace(matched, rule_pattern(ids), f"[{licence}]") if any(i.endswith("?") for i in ids) else F.replace(matched, F.lit("".join(f"<{i}>" for i in ids)), F.lit(f"[{licence}]"))
    joined = lambda c, rx: F.array_join(F.regexp_extract_all(c, F.lit(rx), F.lit(1)), ",")
    found = found.withColumn("_rules", matched)
    return found.select(
        id_col,
        "n_sentences",
        joined(F.col("_ids"), r"<([^>]*)>").alias("sentence_ids"),
        joined(F.col("_rules"), r"\[([^\]]*)\]").alias("licenses"),
        F.size(F.regexp_extract_all("_rules", F.lit("<"), F.lit(0))).cast("long").alias("n_unmatched"),
    )


def scan_sql(table: str = "documents", known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    """The scan as DuckDB SQL, for texts whose known sentences are pieces of their own: not wrapped, not numbered."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    matched = "ids"
    for licence, ids in rules:
        matched = f"regexp_replace({matched}, {quote(rule_pattern(ids))}, {quote(f'[{licence}]')}, 'g')"
    cut = rf"regexp_replace(lower(coalesce(text, '')), '{END}', '\1' || chr(10), 'g')"
    flat = f"regexp_replace({cut}, {quote(PUNCTUATION)}, ' ', 'g')"
    pairs = ", ".join(f"({quote(s)}, {quote(f'<{i}>')})" for i, s in known.items())
    return f"""
WITH known(s, id) AS (VALUES {pairs}),
m AS (SELECT map_from_entries(list((s, id))) AS known FROM known),
cut AS (SELECT doc_id, list_filter(list_transform(string_split({flat}, chr(10)), lambda x: trim(x, ' .')), lambda x: x <> '') AS s FROM {table}),
seq AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences,
  coalesce(array_to_string(list_transform(s, lambda x: coalesce(m.known[x], '.')), ''), '') AS ids FROM cut, m),
done AS (SELECT *, {matched} AS done FROM seq)
SELECT doc_id, n_sentences,
  coalesce(array_to_string(regexp_extract_all(ids, '<([^>]*)>', 1), ','), '') AS sentence_ids,
  coalesce(array_to_string(regexp_extract_all(done, '\\[([^\\]]*)\\]', 1), ','), '') AS licenses,
  CAST(len(regexp_extract_all(done, '<')) AS BIGINT) AS n_unmatched
FROM done"""
