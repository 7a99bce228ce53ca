"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule ``(action, host, path)`` fits its host and all of its subdomains when the url's path starts with the rule's
path. The longest rule (host and path together) wins; of equally long ones the longer host; of the same rule under both
actions, block. A url that no rule fits gets the default action.

Defined cases: a null url, or one without ``://``, has an empty host and an empty path (only rules with an empty host
could fit, and there are none); repeated rows are judged each; an empty table gives no rows; other columns pass through, and
results come in one struct whose name must not be taken.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many characters in all are broadcast as a trie; more are joined.
MAX_BROADCAST_CHARS = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple:
        return len(self.host) + len(self.path), len(self.host), self.action == "block"


class _Paths:
    """One path segment: whole next segments, and prefixes that may end inside the next segment."""

    __slots__ = ("children", "lengths", "prefixes")

    def __init__(self) -> None:
        self.children: dict[str, _Paths] = {}
        self.prefixes: dict[str, Rule] = {}
        self.lengths: tuple[int, ...] = ()


class _Host:
    __slots__ = ("children", "paths")

    def __init__(self) -> None:
        self.children: dict[str, _Host] = {}
        self.paths: _Paths | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[Rule | tuple[str, str, str]]) -> None:
        self.root = _Host()
        for rule in rules:
            self.add(Rule(*rule))

    def add(self, rule: Rule) -> None:
        node = self.root
        for label in reversed(rule.host.split(".")):
            node = node.children.setdefault(label, _Host())
        here = node.paths = node.paths or _Paths()
        *whole, last = rule.path.split("/")
        for segment in whole:
            here = here.children.setdefault(segment, _Paths())
        if last not in here.prefixes or here.prefixes[last].rank < rule.rank:
            here.prefixes[last] = rule
        here.lengths = tuple(sorted({len(p) for p in here.prefixes}))

    @staticmethod
    def _longest(here: _Paths | None, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            if here is None:
                break
            for n in here.lengths:
                if n <= len(segment) and (rule := here.prefixes.get(segment[:n])):
                    best = rule  # deeper and longer each time
            here = here.children.get(segment)
        return best

    def match(self, host: str, path: str) -> Rule | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            rule = self._longest(node.paths, segments)
            if rule and (best is None or rule.rank > best.rank):
                best = rule
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)).otherwise("")
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def judge_urls(spark: SparkSession, urls: DataFrame, rules: Iterable[tuple[str, str, str]], *, url: str = "url", default: str = "allow", result: str = "judged") -> DataFrame:
    """``urls`` with one more column, a struct of host, path, rule, action of the rule (null: none) and verdict.

    Map-only: the trie goes to the executors once, as a broadcast, if its rules are within ``MAX_BROADCAST_CHARS``;
    a larger rule set must be given to ``judge_urls_by_join``."""
    if result in urls.columns:
        raise ValueError(f"column {result} exists already; give another name as result")
    rules = [Rule(*r) for r in rules]
    if (size := sum(len(r.text) for r in rules)) > MAX_BROADCAST_CHARS:
        raise ValueError(f"{size} characters of rules are too many to broadcast; use judge_urls_by_join")
    trie = spark.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, action string")
    def looked_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        found = [match(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [r and r.text for r in found], "action": [r and r.action for r in found]}, dtype=object)

    host, path = host_and_path(F.col(url))
    found = looked_up(host, path)
    return urls.withColumn(result, F.struct(host.alias("host"), path.alias("path"), found.alias("found"))).withColumn(
        result,
        F.struct(*(F.col(f"{result}.{c}").alias(c) for c in ("host", "path")), *(F.col(f"{result}.found.{c}").alias(c) for c in ("rule", "action")), F.coalesce(F.col(f"{result}.found.action"), F.lit(default)).alias("verdict")),
    )


def judge_urls_by_join(urls: DataFrame, rules: DataFrame, key: str, *, url: str = "url", default: str = "allow") -> DataFrame:
    """The same judgement for any number of rules (columns action, host, path), in shuffled joins: each distinct host and path
    is looked up by every suffix of the host and every prefix of the path of a length that a rule of that host has. Returns
    key, host, path, rule, verdict, a row for each of ``urls``, whose keys may repeat or be null."""
    host, path = host_and_path(F.col(url))
    rows = urls.select(F.col(key), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = rules.select("action", F.col("host").alias("_h"), F.col("path").alias("_p")).distinct()
    lengths = rules.groupBy("_h").agg(F.collect_set(F.length("_p")).alias("_n"))
    keys = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("_h")).join(lengths, "_h")
    keys = keys.select("host", "path", "_h", F.explode("_n").alias("_n")).where(F.col("_n") <= F.length("path")).select("host", "path", "_h", F.substring(F.col("path"), F.lit(1), F.col("_n")).alias("_p"))
    rank = F.struct((F.length("_h") + F.length("_p")).alias("n"), F.length("_h").alias("h"), (F.col("action") == "block").alias("b"), F.concat("_h", "_p").alias("rule"), F.col("action"))
    best = keys.join(rules, ["_h", "_p"]).groupBy("host", "path").agg(F.max(rank).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
