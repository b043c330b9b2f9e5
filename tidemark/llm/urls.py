"""URL rules by a sort-merge range join with a sweep.

A rule (host, path) becomes a canonical key: the host's labels in reverse order, ``/``, the path. A
URL has such a key for each suffix of its host, so that a rule fits the URL exactly if its key is a
prefix of the URL's key of the same depth. A prefix is an interval of the sorted keys, and the
intervals of all rules nest or are disjoint: a sweep over the sorted keys keeps the stack of rules
that are open, and its top is the longest one that fits. Of a URL's depths, the longest rule wins.

Distinct URLs are swept, in key ranges whose bounds are quantiles of a bounded, hash-ordered set of
keys (they decide only which task does what). A rule goes to every range that its interval meets,
and rows of a very common key are dealt over all ranges that this key spans. Neither rules nor URLs
are broadcast or collected.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and the
verdict ``block`` (``unknown_host``); other URLs without a rule get ``default``. A host is lower-cased in A-Z
only; a port or user part belongs to it. Rules with null host or path, or an empty host, fit nothing;
of equal rules ``block`` wins; of two rules of equal length the one with the longer host wins.
Repeated rows are judged each; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_hash_order, shuffle_width, written

#: Keys per range looked at for the ranges' bounds.
BOUND_KEYS = 10


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """The host, lower-cased in A-Z, and the path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(after, r"^[^?#]*", 0)


def _suffix(labels: Column, depth: Column) -> Column:
    """The reversed last ``depth`` labels."""
    return F.array_join(F.slice(labels, 1, depth), ".")


def _rule_keys(rules: DataFrame) -> DataFrame:
    host = ascii_lower(F.col("host"))
    text = F.concat(host, F.col("path"))
    kept = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
    keyed = kept.select(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), "path").alias("key"),
        text.alias("rule"),
        F.length(host).alias("host_length"),
        (F.col("verdict") == "block").alias("blocks"),
    )
    return keyed.groupBy("key").agg(F.max(F.struct("blocks", "rule", "host_length")).alias("r")).select("key", "r.*")


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by (range, key, rules first): the innermost open rule of each URL key."""
    stack: list[tuple[str, str, int, bool]] = []
    current = None
    for frame in frames:
        out = []
        for at, key, url, rule, host_length, blocks in zip(frame["range"], frame["key"], frame["url"], frame["rule"], frame["host_length"], frame["blocks"], strict=True):
            if at != current:
                current, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if url is None:
                stack.append((key, rule, int(host_length), bool(blocks)))
            elif stack:
                out.append((url, *stack[-1][1:]))
        yield pd.DataFrame(out, columns=["url", "rule", "host_length", "blocks"])


def _bounds(keys: DataFrame, width: int) -> list[str]:
    """At most ``width`` - 1 sorted bounds, from the keys of lowest hash; repeated where a key is very common."""
    picked = keys.select("key", F.xxhash64("url", "key").alias("h")).orderBy("h", "key").limit(BOUND_KEYS * width)
    found = sorted(r["key"] for r in picked.select("key").collect())
    return [found[i * len(found) // width] for i in range(1, width)] if found else []


_ROW = "range int, key string, url string, rule string, host_length int, blocks boolean"


def _placed(bounds: list[str]):
    """Gives rows their range by bisection: a rule's are all that hold a key it is a prefix of."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ranges: list[list[int]] = []
            for key, url in zip(frame["key"], frame["url"], strict=True):
                low = bisect_left(bounds, key)
                if url is None:
                    ranges.append(list(range(low, bisect_right(bounds, key, key=lambda b, n=len(key): b[:n]) + 1)))
                else:  # a key that is itself a bound may go to any of its ranges
                    ranges.append([low + zlib.crc32(url.encode()) % (bisect_right(bounds, key) - low + 1)])
            frame["range"] = ranges
            yield frame.explode("range").astype({"range": "int32"})[["range", "key", "url", "rule", "host_length", "blocks"]]

    return run


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct non-null ``url`` that a rule fits: ``url``, ``rule`` and ``blocks`` of the longest."""
    spark = urls.sparkSession
    width = row_hash_order(shuffle_width(spark))
    host, path = split_url(F.col("url"))
    parts = urls.where("url is not null").select("url").distinct().select("url", host.alias("host"), path.alias("path")).where("host != ''")
    labels = F.reverse(F.split("host", r"\."))
    keys = (
        parts.select("url", "path", labels.alias("labels"))
        .select("url", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("depth"))
        .select("url", F.concat(_suffix(F.col("labels"), F.col("depth")), "path").alias("key"))
    )
    no_rule = [F.lit(None).cast(t).alias(c) for c, t in (("rule", "string"), ("host_length", "int"), ("blocks", "boolean"))]
    no_url = F.lit(None).cast("string").alias("url")
    rows = keys.select("key", "url", *no_rule).unionByName(_rule_keys(rules).select("key", no_url, "rule", "host_length", "blocks"))
    swept = (
        rows.mapInPandas(_placed(_bounds(keys, width)), _ROW)
        .repartition(shuffle_width(spark), "range")
        .sortWithinPartitions("range", "key", F.col("url").asc_nulls_first())
        .mapInPandas(_sweep, "url string, rule string, host_length int, blocks boolean")
    )
    best = F.max(F.struct(F.length("rule").alias("n"), "host_length", "blocks", "rule"))
    return swept.groupBy("url").agg(best.alias("r")).select("url", "r.rule", "r.blocks")


def judge(pages: DataFrame, rules: DataFrame, keys: list[str], default: str = "allow", unknown_host: str = "block") -> DataFrame:
    """``keys`` of every row with its host, path, rule (null if none fits) and verdict.

    The join back is by URL over all rows. What rules say of the distinct URLs is written first, so that this is a
    join of two plain exchanges, of which adaptive execution splits a very common URL.
    """
    host, path = split_url(F.col("url"))
    matched = written(match_rules(pages, rules), "matched").withColumnRenamed("url", "__url")
    rows = pages.select(*keys, F.col("url").alias("__page_url"), host.alias("host"), path.alias("path"))
    joined = rows.join(matched.hint("merge"), F.col("__page_url") == F.col("__url"), "left")
    verdict = F.when(F.col("blocks"), "block").when(~F.col("blocks"), "allow").when(F.col("host") == "", unknown_host).otherwise(default)
    return joined.select(*keys, "host", "path", "rule", verdict.alias("verdict"))
