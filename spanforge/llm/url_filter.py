"""URL filters: a trie over reversed host labels and path segments, broadcast, with longest-match precedence.

A rule is a host and the beginning of a path, with the verdict allow or block. It fits its host and all subdomains, if
the url's path starts with the rule's. Of the rules that fit, the one with the longest host decides, then the one with
the longest path; of an allow and a block of the same host and path, block does. Without any, the default verdict holds.

The trie goes down the host's labels from the last one, and from a label's node down the path's segments; where a rule's
path ends inside a segment, the node holds that beginning. Urls are looked up in batches, a path once for each rule host
that it passes. The trie is broadcast where the rules' text is at most TRIE_BYTES, which one aggregation finds; longer
lists are joined by (host, beginning of path), with the same results, so that no list is too long.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, save, unsave

TRIE_BYTES = 64 << 20  # text of the rules that a broadcast trie is built of, at most
VERDICTS = ("block", "allow")  # of one host and path the first wins
RULE_SCHEMA = "host string, path string, verdict string"


class UrlTrie:
    """Longest match over rules (host, path, verdict)."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.top, self.rules = _Label(), list(rules)
        for host, path, verdict in self.rules:
            node = self.top
            for label in reversed(host.split(".")):
                node = node.below.setdefault(label, _Label())
            *whole, rest = path.split("/")
            at = node.paths = node.paths or _Segment()
            for segment in whole:
                at = at.below.setdefault(segment, _Segment())
            old = at.ends.get(rest)
            if old is None or VERDICTS.index(verdict) < VERDICTS.index(old[1]):
                at.ends[rest] = (host + path, verdict)
                at.sizes = sorted({*at.sizes, len(rest)}, reverse=True)

    def __reduce__(self):  # the rules travel, each worker builds its trie once
        return UrlTrie, (self.rules,)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule's text and verdict, or None."""
        node, passed = self.top, []
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths is not None:
                passed.append(node.paths)
        segments = path.split("/") if passed else []
        for root in reversed(passed):  # the longest host first
            if (found := root.find(segments)) is not None:
                return found
        return None


class _Label:
    __slots__ = ("below", "paths")

    def __init__(self):
        self.below: dict[str, _Label] = {}
        self.paths: _Segment | None = None


class _Segment:
    __slots__ = ("below", "ends", "sizes")

    def __init__(self):
        self.below: dict[str, _Segment] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []

    def find(self, segments: list[str]) -> tuple[str, str] | None:
        best, node = None, self
        for k, segment in enumerate(segments):
            for n in node.sizes:
                if n <= len(segment) and (found := node.ends.get(segment[:n])) is not None:
                    best = found
                    break
            if k + 1 == len(segments) or (node := node.below.get(segment)) is None:
                break
        return best


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def clean_rules(rules: DataFrame) -> DataFrame:
    """One row for each host (lower-cased) and path, with its verdict; rules without a host or a verdict are none, a null path is empty."""
    unknown = rules.where(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(True))).limit(1).collect()
    if unknown:
        raise ValueError(f"a rule's verdict is allow or block, not {unknown[0]['verdict']!r}")
    named = rules.where("coalesce(host, '') <> '' and verdict is not null")
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return named.groupBy(host.alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))  # block sorts behind allow


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """pages' columns with host, path, rule (host + path of the deciding rule, or null) and verdict; columns of these names are replaced.

    rules: host, path, verdict (allow or block); see clean_rules. A null url and one without :// have an empty host and path
    and get the default verdict. Ports and user names are part of the host as it stands, so `org:80` is no subdomain of
    `org`. Rows that repeat stay. The broadcast trie needs no shuffle; see the module for longer lists of rules.
    """
    new = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c.lower() not in new]
    parts = fresh("parts", pages.columns)
    address = F.struct(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    pages = pages.withColumn(parts, address).select(*kept, parts)
    rules = save(clean_rules(rules), "url_rules")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0]
    found = _by_trie(pages, parts, rules) if size <= trie_bytes else _by_join(pages, parts, rules)
    return found.select(*kept, f"{parts}.host", f"{parts}.path", "found.rule", F.coalesce("found.verdict", F.lit(default)).alias("verdict"))


def _by_trie(pages: DataFrame, parts: str, rules: DataFrame) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(map(tuple, rules.select("host", "path", "verdict").collect())))
    unsave(rules)

    def run(host: pa.Array, path: pa.Array) -> pa.Array:
        find = trie.value.find
        found = [find(h, p) or (None, None) for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["rule", "verdict"])

    return pages.withColumn("found", F.arrow_udf(run, "rule string, verdict string")(f"{parts}.host", f"{parts}.path"))


def _by_join(pages: DataFrame, parts: str, rules: DataFrame) -> DataFrame:
    """Each distinct address meets, for each of its host's suffixes that has rules, the beginnings of its path of the lengths that these rules have."""
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))  # as many as an address is long, at most
    labels = F.split(F.col("host"), r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    address = pages.select(f"{parts}.host", f"{parts}.path").distinct()
    hosts = address.select("host").distinct().withColumn("at", F.explode(suffix))
    ranks = hosts.join(lengths.withColumnRenamed("host", "at"), "at").select("host", "at", F.explode("lengths").alias("n"))
    wanted = address.join(ranks, "host").where(F.length("path") >= F.col("n")).select("host", "path", "at", F.substring("path", F.lit(1), F.col("n")).alias("start"))
    fitting = wanted.join(rules.select(F.col("host").alias("at"), F.col("path").alias("start"), "verdict"), ["at", "start"])
    best = F.max(F.struct(F.length("at").alias("a"), F.length("start").alias("b"), F.concat("at", "start").alias("rule"), "verdict"))
    found = fitting.groupBy("host", "path").agg(best.alias("found"))
    key = (F.col(f"{parts}.host") == found["host"]) & (F.col(f"{parts}.path") == found["path"])
    return pages.join(found, key, "left").select(*pages.columns, "found")


#: The rules that the query applies.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; pages that no rule fits are allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


_FITS = "(host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)"
OP11_SQL = f"""
WITH r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
a AS (SELECT row_number() OVER () AS k, page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM a),
f AS (SELECT k, arg_max(struct_pack(rule := r.h || r.p, verdict := r.v), (length(r.h), length(r.p))) AS best FROM b JOIN r ON {_FITS} GROUP BY k)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM b LEFT JOIN f USING (k)
"""

