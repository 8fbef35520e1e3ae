"""URL filter: a broadcast trie over reversed host labels, then path segments.

Rules allow or block a host (with all its subdomains) under a path prefix. Walking the trie along a
URL meets every rule that fits it; the last host node with a fitting path wins, and under that node
the longest path. So an allow entry may sit below a block entry and the other way round.

The trie goes to the executors as one broadcast variable, so its size is checked first; rule sets
beyond that bound are applied by an equi-join on host suffixes instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.session import use_package

MAX_BROADCAST_RULES = 200_000
"""About 100 MB of trie; more rules go through :func:`judge_by_join`."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, entry: str) -> Rule:
    """``example.com/en/`` -> host and path prefix."""
    if verdict not in ("allow", "block"):
        raise ValueError(f"verdict {verdict!r} is neither allow nor block")
    host, slash, path = entry.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts: host labels from the right, then ``/``, then path segments.

    A rule's last path segment may be cut anywhere, so it is kept at its node as a prefix.
    """

    RULES = 0  # no label is an int, so this key is free

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            *whole, cut = rule.path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(self.RULES, {})[cut] = (rule.verdict, rule.text)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and text of the rule that wins, or None."""
        node, best, segments = self.root, None, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                return best
            if "/" in node:
                segments = path.split("/") if segments is None else segments
                best = self._longest_path(node["/"], segments) or best
        return best

    def _longest_path(self, node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            cuts = node.get(self.RULES)
            if cuts:
                fits = [cut for cut in cuts if segment.startswith(cut)]
                best = cuts[max(fits, key=len)] if fits else best
            node = node.get(segment)
            if node is None:
                break
        return best


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """One row per input row: id, host, path, rule (null if none fits), verdict.

    A rule's host fits itself and all subdomains; its path must be a prefix of the URL's path. The
    longest host wins, then the longest path. No rule: ``default``. A null URL, or one without
    ``://``, has an empty host and path. Of two rules with equal host and path the last given counts.
    Repeated rows stay; other columns are ignored.
    """
    spark = pages.sparkSession
    split = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if len(rules) > max_broadcast:
        return judge_by_join(split, rules, id_col, default)
    use_package(spark)
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("verdict string, rule string")
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        longest, none = trie.value.longest, (default, None)
        for host, path in batches:
            yield pd.DataFrame([longest(h, p) or none for h, p in zip(host, path, strict=True)], columns=["verdict", "rule"])

    return split.withColumn("_found", walk("host", "path")).select(id_col, "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("verdict"))


def judge_by_join(split: DataFrame, rules: list[Rule], id_col: str, default: str = "allow") -> DataFrame:
    """The way for rule sets too large to broadcast: join on host suffixes, keep the longest fit.

    Rows are numbered by their content, so repeated rows are judged once and handed back to each. The
    suffixes of distinct hosts are few; a hot host is one row of the join.
    """
    spark = split.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict, r.text, n) for n, r in enumerate(rules)], "r_host string, r_path string, verdict string, rule string, n long")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    distinct = split.select("host", "path").distinct()
    hits = distinct.withColumn("r_host", F.explode(suffixes)).join(table, "r_host").where(F.startswith("path", "r_path"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("r_host"), F.length("r_path"), "n")).alias("b"))
    return split.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("b.rule").alias("rule"), F.coalesce(F.col("b.verdict"), F.lit(default)).alias("verdict"))
