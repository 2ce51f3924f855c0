"""URL filter: allow and block entries in a trie over reversed host labels, then path segments.

A rule names a host and a path prefix. It fits a url when the url's host is the rule's host or a
subdomain of it, and the url's path starts with the rule's path. Of the fitting rules the longest
wins: the one with more host labels, then the one with the longer path; of an allow and a block
entry with the same host and path the block entry counts.

The trie is broadcast only while the rules stay within ``MAX_BROADCAST_RULES``; larger rule tables
meet the urls through equality joins on (host suffix, whole leading path segments) instead, which
gives the same verdicts.

Defined results: a null url, or one without ``://``, has an empty host and path; an empty host fits
no rule; empty rule tables give every url the default verdict; rules with a null host, path or verdict
are left aside; urls of any length are read whole; repeated rows each get their own verdict; an empty
table of urls gives an empty table; columns named like an output are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

RULES_SCHEMA = "host string, path string, verdict string"
#: About 200 bytes a rule as Python objects: 40 MB in each worker at most.
MAX_BROADCAST_RULES = 200_000
RULE, PARTIAL = "\0rule", "\0partial"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, 'allow' or 'block')."""
    return spark.createDataFrame(rules, RULES_SCHEMA)


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the last one on, then path segments; rules sit at the end of
    their whole segments, with the part of a last, unfinished segment."""
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *whole, rest = path.split("/")
        node = node.setdefault(RULE, {})
        for segment in whole:
            node = node.setdefault("/" + segment, {})
        ends = node.setdefault(PARTIAL, {})
        if ends.get(rest, ("", ""))[0] != "block":
            ends[rest] = (verdict, host + path)
    return root


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest fitting rule."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")) if host else ():
        node = node.get(label)
        if node is None:
            break
        if RULE in node:
            best = _longest_path(node[RULE], segments) or best
    return best


def _longest_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for i, segment in enumerate(segments):
        fitting = [r for r in node.get(PARTIAL, ()) if segment.startswith(r)]
        if fitting:
            best = node[PARTIAL][max(fitting, key=len)]
        # A rule's segment is whole only if the url's path goes on behind it.
        node = node.get("/" + segment) if i + 1 < len(segments) else None
        if node is None:
            break
    return best


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict (``default`` if none fits)."""
    rules = rules.select("host", "path", "verdict").dropna()
    df = df.withColumns({"host": host_of(url), "path": path_of(url)}).drop("rule", "verdict")
    known = rules.limit(max_broadcast_rules + 1).collect()
    if len(known) > max_broadcast_rules:
        return _by_join(df, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(build_trie([tuple(r) for r in known]))

    @F.pandas_udf("verdict string, rule string")
    def judge(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tree = trie.value
        for hosts, paths in pairs:
            found = [look_up(tree, h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["verdict", "rule"])

    judged = fresh(df, "judged")
    return df.withColumn(judged, judge("host", "path")).select(*df.columns, F.col(f"{judged}.rule").alias("rule"), F.col(f"{judged}.verdict").alias("verdict"))


def _by_join(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for rule tables of any size. Each distinct (host, path) is judged once."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.split("path", "/", -1)
    heads = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.array_join(F.slice(segments, 1, i), "/"))
    depth = F.size(F.split(F.col("path"), "/", -1)) - 1
    keys = rules.select(
        F.col("host").alias("_suffix"), depth.alias("_depth"), F.array_join(F.slice(F.split("path", "/", -1), F.lit(1), depth), "/").alias("_head"), F.col("path").alias("_rule_path"), F.col("verdict").alias("_verdict"),
    )
    urls = df.select("host", "path").where("host <> ''").distinct()
    probes = urls.withColumn("_suffix", F.explode(suffixes)).select("*", F.posexplode(heads).alias("_depth", "_head"))
    met = probes.join(keys, ["_suffix", "_depth", "_head"]).where(F.col("path").startswith(F.col("_rule_path")))
    rank = F.struct(F.size(F.split("_suffix", r"\.")), F.length("_rule_path"), F.col("_verdict"))
    best = met.groupBy("host", "path").agg(F.max_by(F.struct((F.concat("_suffix", "_rule_path")).alias("rule"), F.col("_verdict").alias("verdict")), rank).alias("_best"))
    return df.join(best, ["host", "path"], "left").select(*df.columns, F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


