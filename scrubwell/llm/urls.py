"""Host and path rules on URLs by a sort-merge sweep over reversed hosts.

A host is written label by label from the right with a dot after each label, so a rule's host is
a plain prefix of its own and of every subdomain's key: the rule is an interval of keys. URLs and
rules are dealt into ranges of that order; in each range a sweep keeps a stack of the nested
intervals that are open, and looks the path up in the rules of each.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.tables import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Paths:
    """Path rules of one host: the longest one that begins a path."""

    def __init__(self, rules: dict[str, tuple[str, str]]):
        self.paths, self.rules, self.parent, stack = sorted(rules), rules, [], []
        for i, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.parent.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> str | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.parent[i]
        return self.paths[i] if i >= 0 else None


def _sweep(urls: pa.Table, rules: pa.Table) -> pa.Table:
    hosts: dict[str, dict] = {}
    for key, path, host, verdict in zip(*(rules[c].to_pylist() for c in ("key", "path", "host", "verdict"))):
        held = hosts.setdefault(key, {})
        held[path] = (host, max(verdict, held.get(path, ("", ""))[1]))
    order = sorted(hosts)
    urls = urls.sort_by([("key", "ascending"), ("path", "ascending")])
    stack, following, out = [], 0, []
    for key, path in zip(urls["key"].to_pylist(), urls["path"].to_pylist()):
        while following < len(order) and order[following] <= key:
            opened = order[following]
            while stack and not opened.startswith(stack[-1][0]):
                stack.pop()
            stack.append((opened, Paths(hosts[opened])))
            following += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = (-1, -1, None, None)
        for opened, paths in stack:
            found = paths.longest(path)
            if found is not None:
                host, verdict = paths.rules[found]
                best = max(best, (len(host) + len(found), len(host), host + found, verdict))
        out.append(best)
    return pa.table({"host": urls["host"], "path": urls["path"], "rule": pa.array([b[2] for b in out], pa.string()),
                     "ruled": pa.array([b[3] for b in out], pa.string())})


def _buckets(bounds: list[tuple[str, str]]):
    def run(batches):
        for batch in batches:
            keys = zip(batch.column("key").to_pylist(), batch.column("path").to_pylist())
            yield batch.append_column("bucket", pa.array([bisect_right(bounds, k) for k in keys], pa.int64()))
    return run


def _spread(bounds: list[tuple[str, str]]):
    def run(batches):
        for batch in batches:
            ranges = [(bisect_right(bounds, (k, "")), bisect_left(bounds, (k + _LAST, ""))) for k in batch.column("key").to_pylist()]
            rows = [i for i, (a, b) in enumerate(ranges) for _ in range(a, b + 1)]
            numbers = [n for a, b in ranges for n in range(a, b + 1)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(numbers, pa.int64())],
                                             names=[*batch.schema.names, "bucket"])
    return run


def filter_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow",
                range_rows: int = 200_000, sample: int = 8192) -> DataFrame:
    """The rows of ``pages`` with host, path, rule and verdict (these names replace any such columns).

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the path
    begins with the rule's; the longest (host and path together, then host) wins; of equal rules
    the verdict that sorts last ("block" over "allow") wins. Without a fitting rule: rule null and
    the default verdict. A null url, or one without ``://``, has empty host and path. Rules with a
    null part or an empty host fit nothing. Equal URLs are judged once; empty tables give no rows.
    ``sample`` keys, chosen by hash, only place the range bounds; every URL is judged.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    pages = pages.select(host.alias("host"), path.alias("path"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("page"))
    keys = stage(pages.select("host", "path").distinct().withColumn("key", reversed_host(F.col("host"))), "url-keys")
    count = keys.count()
    parts = max(1, -(-count // range_rows))
    drawn = keys.orderBy(F.xxhash64("key", "path"), "key", "path").limit(sample).select("key", "path").collect() if parts > 1 else []
    drawn = sorted((r.key, r.path) for r in drawn)
    bounds = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where(
        "host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").withColumn("key", reversed_host(F.col("host")))
    placed = keys.mapInArrow(_buckets(bounds), "host string, path string, key string, bucket long")
    spread = rules.mapInArrow(_spread(bounds), "host string, path string, verdict string, key string, bucket long")
    judged = (placed.groupBy("bucket").cogroup(spread.groupBy("bucket"))
              .applyInArrow(_sweep, "host string, path string, rule string, ruled string"))
    out = pages.join(judged, ["host", "path"], "left")
    return out.select(*(F.col("page").getField(c).alias(c) for c in kept), "host", "path", "rule",
                      F.coalesce("ruled", F.lit(default)).alias("verdict"))
