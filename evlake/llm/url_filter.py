"""URL verdicts from a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, written

#: Rules beyond this many bytes are joined and not broadcast.
MAX_RULE_BYTES = 16 << 20
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    found = _URL.search(url or "")
    return (re.sub("[A-Z]+", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


class UrlTrie:
    """Rules by reversed host label, then by path segment.

    A path rule reaches its last full segment's node; what is left of it is a prefix of the next
    segment. The deepest host with a fitting path wins, then the longest path; block wins a tie.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("labels", {}).setdefault(label, {})
            at = node.setdefault("paths", {})
            *full, rest = path.split("/")
            for part in full:
                at = at.setdefault("parts", {}).setdefault(part, {})
            kept = at.setdefault("ends", {})
            if kept.get(rest, ("", ""))[0] != "block":
                kept[rest] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        node, nodes = self.root, []
        if "paths" in node:
            nodes.append(node["paths"])
        for label in reversed(host.split(".")) if host else ():
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                nodes.append(node["paths"])
        for at in reversed(nodes):
            best = None
            for part in path.split("/"):
                fits = [r for r in at.get("ends", {}) if part.startswith(r)]
                if fits:
                    best = at["ends"][max(fits, key=len)]
                at = at.get("parts", {}).get(part)
                if at is None:
                    break
            if best:
                return best
        return None, None


def _split(pages: DataFrame, id_col: str, url_col: str, decide: Callable[[list[tuple[str, str]]], list[pa.Array]], names: list[str], types: str) -> DataFrame:
    """(page_id, host, path) of each row, and what decide() says of hosts and paths."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [split_url(u) for u in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), *decide(split)], ["page_id", "host", "path", *names])

    return arrow_map(pages.selectExpr(f"cast(`{id_col}` as long) page_id", f"`{url_col}` url"), rows, "page_id long, host string, path string" + types)


def _by_trie(pages: DataFrame, rules: list[tuple[str, str, str]], default: str, id_col: str, url_col: str) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def decide(split: list[tuple[str, str]]) -> list[pa.Array]:
        found = [trie.value.match(h, p) for h, p in split]
        return [pa.array([r for _, r in found], pa.string()), pa.array([v or default for v, _ in found], pa.string())]

    return _split(pages, id_col, url_col, decide, ["rule", "verdict"], ", rule string, verdict string")


def _by_join(pages: DataFrame, rules: DataFrame, default: str, id_col: str, url_col: str) -> DataFrame:
    """The same verdicts for rules of any number: a url's host suffixes and path prefixes are joined with the rules.

    Each different url is looked up once, by prefixes of the lengths that rules have. A prefix is a hash;
    rules that it brings are compared themselves.
    """
    key = F.xxhash64("r_host", "r_path")
    known = rules.select(F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path")).groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    known = written(known.withColumn("key", key), "rules")
    split = written(_split(pages, id_col, url_col, lambda split: [], [], "").withColumn("url_key", F.xxhash64("host", "path")), "split")
    different = split.select("url_key", "host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")), F.array(F.lit(""))))
    # only prefixes as long as some rule's path; there are no more such lengths than the longest has characters
    lengths = sorted(r.n for r in known.select(F.length("r_path").alias("n")).distinct().collect())
    paths = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    tried = different.select("url_key", "host", "path", F.explode(hosts).alias("t_host"), F.col("path").alias("_p")).select("url_key", "host", "path", "t_host", F.explode(paths).alias("t_path"))
    met = tried.withColumn("key", F.xxhash64("t_host", "t_path")).join(known, "key").where("t_host = r_host and t_path = r_path")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), F.struct(F.length("r_host"), F.length("r_path"))).alias("b"))
    best = written(best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "b.rule", "b.verdict"), "best")
    joined = split.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row, by rules of (verdict, host, path), a list or a table.

    A rule fits its host and all subdomains where the path starts with the rule's; the most specific
    host wins, then the longest path. No fitting rule: rule is null and verdict is default. A null or
    unparsable url has an empty host and path. Repeated rules count once, block before allow. The trie
    is broadcast if the rules' texts take at most max_bytes (as Python objects some ten times as much);
    larger sets of rules are joined instead, with the same results.
    """
    if isinstance(rules, list):
        size = sum(len(h) + len(p) for _, h, p in rules)
        if size <= max_bytes:
            return _by_trie(pages, rules, default, id_col, url_col)
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    else:
        size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()[0]
        if size <= max_bytes:
            return _by_trie(pages, [tuple(r) for r in rules.select("verdict", "host", "path").collect()], default, id_col, url_col)
    return _by_join(pages, rules, default, id_col, url_col)
