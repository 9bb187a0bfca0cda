"""URL filter: a trie over reversed host labels and path segments, longest match first.

A rule is (action, host, path). It fits a URL when the URL's host is the rule's host or one of its
subdomains and the URL's path starts with the rule's path. Among the rules that fit, the one with
the most host labels wins; among those, the one with the longest path; a rule given twice with both
actions blocks. A URL that no rule fits gets ``default``.

Up to ``max_broadcast_rules`` rules travel to the executors as one trie. Larger rule tables are
joined on the URL's host suffixes instead, with the same answers.

Edge cases: a URL of any length is read whole; a null URL or one without ``://`` has empty host and path, and only a rule with an
empty host could fit it, so it gets the default. An empty table gives an empty result. Repeated
rows are judged one by one. Other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_RULES = 200_000
RULES_SCHEMA = "action string, host string, path string"


def _rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _raw_host_of(url: Column) -> Column:
    return F.regexp_extract(_rest_of(url), r"^[^/?#]*", 0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(_raw_host_of(url), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; a later ``://`` is nothing special."""
    return F.regexp_extract(F.substr(_rest_of(url), F.length(_raw_host_of(url)) + 1), r"^[^?#]*", 0)


class RuleTrie:
    """Nested dicts: host labels from the right, then path segments from the left."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault(_PATHS, {})
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(_ENDS, {})  # beginnings that the next segment must have
            if ends.get(last, ("",))[0] != "block":
                ends[last] = (action, host + path)
            node[_LONGEST] = max(node.get(_LONGEST, 0), len(last))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if _PATHS in node:
                best = self._path_match(node[_PATHS], path) or best
        return best

    @staticmethod
    def _path_match(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            if ends := node.get(_ENDS):
                sizes = range(min(len(segment), node[_LONGEST]), -1, -1)
                best = next((ends[segment[:n]] for n in sizes if segment[:n] in ends), best)
            node = node.get(segment)
            if node is None:
                break
        return best


#: Keys that no label or segment can equal.
_PATHS, _ENDS, _LONGEST = ("paths",), ("ends",), ("longest",)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``. ``rules``: action, host, path."""
    rules = rules.select("action", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    url = F.col(f"`{url_col}`").cast("string")
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    first = rules.limit(max_broadcast_rules + 1).collect()
    if len(first) > max_broadcast_rules:
        return judge_by_join(parts, rules, default)
    trie = parts.sparkSession.sparkContext.broadcast(RuleTrie((r.action, r.host, r.path) for r in first))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            ids, hosts, paths = batch.columns
            found = [match(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            rule = pa.array([f and f[1] for f in found], pa.string())
            verdict = pa.array([f[0] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def judge_by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by joins of the distinct (host, path), for rule tables of any size.

    A rule's path is whole segments (its folder) and the beginning of the next one. A URL meets the rules by host suffix, folder
    and that beginning, all three by equality, so a host with many rules costs no more than one with few.
    """
    folder = F.regexp_extract("path", r"(?s)^.*/", 0)
    r = rules.select("action", "host", folder.alias("folder"), F.substr("path", F.length(folder) + 1).alias("next"))
    # how deep URLs need to be cut: one row, at most the longest rule's
    deepest = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.size(F.split("path", "/"))).alias("folders")).first()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffix = F.transform(F.sequence(F.lit(0), F.least(F.size(labels), F.lit(deepest["labels"])) - 1), lambda i: F.array_join(F.slice(labels, -1 - i, i + 1), "."))
    above = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(deepest["folders"])) - 1), lambda i: F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.when(i > 0, "/").otherwise("")))
    urls = parts.select("host", "path").distinct()
    places = urls.select("host", "path", F.explode(suffix).alias("r_host")).select("host", "path", "r_host", F.explode(above).alias("r_folder"))
    sizes = r.groupBy(F.col("host").alias("r_host"), F.col("folder").alias("r_folder")).agg(F.collect_set(F.length("next")).alias("sizes"))  # as many as a segment has characters at most
    places = places.join(sizes, ["r_host", "r_folder"]).withColumn("size", F.explode("sizes"))
    rest = F.substr("path", F.length("r_folder") + 1)
    places = places.where(F.length(rest) >= F.col("size")).withColumn("r_next", F.substr(rest, F.lit(1), F.col("size"))).drop("sizes", "size")
    r = r.toDF("r_action", "r_host", "r_folder", "r_next").groupBy("r_host", "r_folder", "r_next").agg(F.max("r_action").alias("r_action"))  # block before allow
    rank = F.struct(F.size(F.split("r_host", r"\.")), F.length("r_folder") + F.length("r_next"))
    best = places.join(r, ["r_host", "r_folder", "r_next"]).groupBy("host", "path").agg(F.max_by(F.struct("r_action", F.concat("r_host", "r_folder", "r_next").alias("rule")), rank).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_action", F.lit(default)).alias("verdict")
    )
