"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an array of parts, each of a kind: text, image, audio or document. A visitor turns the
parts, in order, into one string: text is escaped, every other part becomes a placeholder that names
its kind, its reference and the tokens it expands to; a mark stands between two parts.

Template, one turn after another::

    <turn role="user">
    ...escaped text...<part/><image ref="..." tokens="..."/></turn>

Escaping replaces ``&``, ``<``, ``>`` and ``"`` by their XML entities, so neither a text, a role nor a
reference can hold a control string, and reading gives back the very parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"
OPEN, MIDDLE, CLOSE, BETWEEN = '<turn role="', '">\n', "</turn>\n", "<part/>"
PLACEHOLDER = r'^<(image|audio|document) ref="([^"]*)" tokens="(-?[0-9]+)"/>$'
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escape(text: Column) -> Column:
    for raw, entity in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: entities in reverse order, so ``&amp;lt;`` gives ``&lt;``."""
    for raw, entity in reversed(ESCAPES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A message of a single text part (null text: empty)."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("tokens"))).cast(f"array<{PART}>")


def visit(part: Column) -> Column:
    """A part as it stands in the output."""
    mark = lambda kind: F.concat(F.lit(f'<{kind} ref="'), escape(F.coalesce(part["ref"], F.lit(""))), F.lit('" tokens="'), F.coalesce(part["tokens"], F.lit(0)).cast("string"), F.lit('"/>'))
    return F.when(part["kind"] == "image", mark("image")).when(part["kind"] == "audio", mark("audio")).when(part["kind"] == "document", mark("document")).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def is_text(part: Column) -> Column:
    return ~F.coalesce(part["kind"], F.lit("text")).isin("image", "audio", "document")


def placed(parts: Column) -> Column:
    """Each part of a message with where it stands in the content, its length, and whether it is text."""
    pieces = F.transform(parts, visit)
    before = lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x) + len(BETWEEN))
    return F.transform(parts, lambda p, k: F.struct(before(k).alias("at"), F.length(visit(p)).cast("bigint").alias("size"), is_text(p).alias("is_text"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: id, formatted, loss_spans, attachments, expanded_tokens.

    Messages are ordered by turn, then role, then content, so ties have one order and repeated rows
    stay repeated. loss_spans: half-open spans, in code points of ``formatted``, of each text part of an
    assistant message (never of a placeholder). attachments: kind, ref, tokens, the position of its turn
    (from 0) and of its placeholder in ``formatted``, of every non-text part, in order. expanded_tokens:
    the sum of their tokens. A null role or reference counts as empty, null tokens as 0, null parts as no
    part, which reads back as one empty text; a part of unknown kind counts as text. Null conversation
    ids are one conversation. No rows give no rows; other columns, whatever their names, are ignored.

    A conversation is the unit of the output (its digest covers all of its turns), so its turns meet
    in one row; nothing else does. Positions are running sums over its turns.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    turns = messages.select(
        F.col(conv_col).alias(conv_col),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.array_join(F.transform(parts, visit), BETWEEN).alias("content"),
            placed(parts).alias("parts"),
        ).alias("t"),
    )
    chats = turns.groupBy(conv_col).agg(F.array_sort(F.collect_list("t")).alias("_turns"))
    each = chats.select(conv_col, F.posexplode("_turns").alias("_pos", "_t"))
    head = F.concat(F.lit(OPEN), escape(F.col("_t.role")), F.lit(MIDDLE))
    each = each.select(conv_col, "_pos", "_t", head.alias("_head"), F.concat(head, F.col("_t.content"), F.lit(CLOSE)).alias("_text"))
    so_far = F.sum(F.length("_text").cast("bigint")).over(Window.partitionBy(conv_col).orderBy("_pos"))
    each = each.withColumn("_at", so_far - F.length("_text") + F.length("_head"))
    spans = F.transform(F.filter("_t.parts", lambda p: p["is_text"]), lambda p: F.struct((F.col("_at") + p["at"]).alias("start"), (F.col("_at") + p["at"] + p["size"]).alias("stop")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    heard = F.when(F.col("_t.role") == "assistant", F.when(F.size("_t.parts") > 0, spans).otherwise(none)).otherwise(none)
    attached = F.transform(F.filter("_t.parts", lambda p: ~p["is_text"]), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), F.col("_pos").alias("turn"), (F.col("_at") + p["at"]).alias("at")))
    each = each.select(conv_col, F.struct("_pos", F.col("_text").alias("text"), heard.alias("spans"), attached.alias("attached")).alias("_row"))
    whole = each.groupBy(conv_col).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    attachments = F.flatten(F.transform("_rows", lambda r: r["attached"]))
    return whole.select(
        conv_col,
        F.array_join(F.transform("_rows", lambda r: r["text"]), "").alias("formatted"),
        F.flatten(F.transform("_rows", lambda r: r["spans"])).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(p["tokens"], F.lit(0))).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Parse a formatted conversation: array of struct(role, parts); parts as they were given, with empty
    strings and zeros for what was null."""
    pieces = F.slice(F.split(formatted, CLOSE), 1, F.size(F.split(formatted, CLOSE)) - 1)
    got = lambda x, k: F.regexp_extract(x, PLACEHOLDER, k)

    def part(x: Column) -> Column:
        kind = got(x, 1)
        other = F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("text"), unescape(got(x, 2)).alias("ref"), got(x, 3).cast("bigint").alias("tokens"))
        text = F.struct(F.lit("text").alias("kind"), unescape(x).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("tokens"))
        return F.when(F.startswith(x, F.lit("<")), other).otherwise(text)

    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), '"', 1)).alias("role"),
        F.transform(F.split(F.substr(p, F.locate(MIDDLE, p) + len(MIDDLE)), BETWEEN), part).alias("parts"),
    ))


def turn_text(turn: Column) -> Column:
    """The text of a turn that was read: its text parts, joined."""
    return F.array_join(F.transform(F.filter(turn["parts"], lambda p: p["kind"] == "text"), lambda p: p["text"]), "")


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, un-escaped, in order, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))), ""))
