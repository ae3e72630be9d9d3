"""URL filters: allow and block entries in a trie of reversed host labels and path segments.

The rules are a list of the caller. They go to the workers in tries of at most ``BLOCK`` rules each, so
what is broadcast at once is bounded whatever the number of rules; the best match over all tries counts.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import carried

#: Rules in one broadcast trie.
BLOCK = 200_000
ALLOW, BLOCKED = "allow", "block"

_MATCH = "struct<labels: int, chars: int, blocked: boolean, rule: string>"


def url_host(url: str | Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, with A-Z lower-cased; empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: str | Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def trie(rules: Iterable[tuple[str, str]]) -> dict:
    """A trie of ``(verdict, rule)``; a rule is a host and, from its first ``/``, a path.

    A node of the host part has ``labels`` and ``paths``; a node of the path part has ``segments`` that
    end with a slash and ``ends``: starts of a further segment with the rule that ends there. Of equal
    rules with both verdicts the block counts.
    """
    root: dict = {"labels": {}, "paths": None}
    for verdict, rule in rules:
        host, slash, rest = rule.partition("/")
        node = root
        for label in reversed(host.lower().split(".")):
            node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
        if node["paths"] is None:
            node["paths"] = {"segments": {}, "ends": {}}
        node = node["paths"]
        *segments, end = (slash + rest).split("/")
        for segment in segments:
            node = node["segments"].setdefault(segment, {"segments": {}, "ends": {}})
        found = node["ends"].get(end)
        if found is None or verdict == BLOCKED:
            node["ends"][end] = (verdict == BLOCKED, rule, len(slash + rest))
    return root


def longest(root: dict, host: str, path: str) -> tuple[int, int, bool, str] | None:
    """Labels, path length, verdict and text of the longest rule that fits: more labels first, then more path."""
    best = None
    node = root
    parts = path.split("/")
    for depth, label in enumerate(reversed(host.split(".")), 1):
        node = node["labels"].get(label)
        if node is None:
            break
        place = node["paths"]
        deepest = None
        for part in parts:
            if place is None:
                break
            ends = place["ends"]
            for length in sorted({len(end) for end in ends}, reverse=True) if ends else ():
                if part[:length] in ends and len(part) >= length:
                    deepest = ends[part[:length]]
                    break
            place = place["segments"].get(part)
        if deepest is not None:
            best = (depth, deepest[2], deepest[0], deepest[1])
    return best


def _matcher(root):
    """``root`` is a broadcast trie."""

    @F.arrow_udf(_MATCH)
    def match(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        tree = root.value
        names = ("labels", "chars", "blocked", "rule")
        found = (longest(tree, h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True))
        return pa.array(
            [None if one is None else dict(zip(names, one, strict=True)) for one in found],
            pa.struct([("labels", pa.int32()), ("chars", pa.int32()), ("blocked", pa.bool_()), ("rule", pa.string())]),
        )

    return match


def judged(
    df: DataFrame,
    block: Iterable[str],
    allow: Iterable[str],
    url: str = "url",
    carry: list[str] | None = None,
    default: str = ALLOW,
    rules_at_once: int = BLOCK,
) -> DataFrame:
    """``row, host, path, rule, verdict`` for every input row.

    ``row`` holds the ``carry`` columns (default: the url). A rule fits its host and all subdomains if
    the path starts with the rule's. A url that is null, empty or without ``://`` has an empty host and
    path, which no rule fits. Without a rule the verdict is ``default`` and ``rule`` is null. Rows are
    judged one by one, so repeated rows stay and an empty table gives an empty result.
    """
    spark = df.sparkSession
    rules = [(BLOCKED, rule) for rule in block] + [(ALLOW, rule) for rule in allow]
    parts = df.select(
        carried(carry or [url]),
        url_host(F.col(f"`{url}`").cast("string")).alias("host"),
        url_path(F.col(f"`{url}`").cast("string")).alias("path"),
    )
    matches = [
        _matcher(spark.sparkContext.broadcast(trie(rules[start : start + rules_at_once])))("host", "path")
        for start in range(0, len(rules), rules_at_once)
    ]
    best = F.lit(None).cast(_MATCH) if not matches else matches[0] if len(matches) == 1 else F.greatest(*matches)
    verdict = F.when(F.col("best.blocked"), BLOCKED).when(~F.col("best.blocked"), ALLOW).otherwise(default)
    return parts.withColumn("best", best).select(
        "row", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict")
    )
