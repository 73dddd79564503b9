"""URL rules as a sort-merge range join.

A rule (host, path) fits its host and all subdomains if a URL's path starts with the rule's.
Canonical keys put a host's labels in reverse and the path behind, so that a rule is the
interval of all keys that begin with its own. A URL has one key for every suffix of its host,
as many as the host has labels. Distinct keys and rules are dealt into ranges of the key order,
sorted, and swept once per range: a stack holds the nested rules that are open at a key, and
its top is the longest of them. Of the answers for its host suffixes a URL takes the longest.

Ranges are cut at a bounded, deterministic sample of keys, which only balances the tasks. A
rule goes to its own range and to every further one that it reaches into, so every range is
swept from an empty stack. Hosts that hold most URLs are spread over ranges by path; equal
keys are swept once.

Defined results: a NULL URL, or one without ``://``, has empty host and path and no rule. Of
rules with equal host and path a block wins; of rules of equal length the one with the longer
host. Empty tables of URLs or rules give an empty result, or no matches. Repeated URLs are
judged alike.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 64
SAMPLE_PER_RANGE = 16
# Neither can occur in a host or a path.
LABEL_END = "?"
PATH_MARK = "#"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, ASCII letters lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, upper.lower()), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), LABEL_END)


def host_keys(host: Column) -> Column:
    """The keys' host part for every suffix of the host."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), LABEL_END), F.lit(PATH_MARK)),
    )


def _cuts(keys: DataFrame, ranges: int) -> list[str]:
    """Range bounds from the keys with the smallest hashes, a bounded sample."""
    picked = [
        r["key"] for r in
        keys.orderBy(F.xxhash64("key"), "key").limit(ranges * SAMPLE_PER_RANGE).collect()
    ]
    picked.sort()
    step = max(1, len(picked) // ranges)
    return sorted(set(picked[step::step]))


def sweep(keys: DataFrame, rules: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(key, rule) with the longest rule whose key is a prefix, for every distinct key that
    has one. ``keys`` holds distinct keys; ``rules`` one row (key, rule) per key."""
    cuts = _cuts(keys, ranges)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, rule in zip(batch["key"], batch["rule"], strict=True):
                own = bisect_right(cuts, key)
                out.append((own, key, rule))
                if rule is not None:
                    # Later ranges that begin inside the rule's interval.
                    at = bisect_left(cuts, key)
                    while at < len(cuts) and cuts[at].startswith(key):
                        if at + 1 > own:
                            out.append((at + 1, key, rule))
                        at += 1
            yield pd.DataFrame(out, columns=["range", "key", "rule"])

    def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, stack = None, []
        for batch in batches:
            out = []
            for part, key, rule in zip(batch["range"], batch["key"], batch["rule"], strict=True):
                if part != current:
                    current, stack = part, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule is not None:
                    stack.append((key, rule))
                elif stack:
                    out.append((key, stack[-1][1]))
            yield pd.DataFrame(out, columns=["key", "rule"])

    both = keys.select("key", F.lit(None).cast("string").alias("rule")).unionByName(
        rules.select("key", "rule")
    )
    # Rules come before the keys they are equal to.
    return (
        both.mapInPandas(place, "range int, key string, rule string")
        .repartition("range")
        .sortWithinPartitions("range", "key", F.col("rule").isNull())
        .mapInPandas(swept, "key string, rule string")
    )


def judge(
    pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url",
    default: str = "allow", ranges: int = RANGES,
) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``; ``rules`` has the columns
    host, path and verdict."""
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(id), host.alias("host"), path.alias("path"))
    rules = rules.select(
        F.concat(reversed_host(F.col("host")), F.lit(PATH_MARK), F.col("path")).alias("key"),
        F.struct(
            F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"), F.col("verdict"),
        ).alias("rule"),
    )
    rules = rules.groupBy("key").agg(F.max_by("rule", F.col("rule.verdict") == "block").alias("rule"))
    rules = rules.withColumn("rule", F.to_json("rule"))
    places = parsed.filter("host <> ''").select("host", "path").distinct().select(
        "host", "path", F.explode(host_keys(F.col("host"))).alias("host_key")
    ).withColumn("key", F.concat("host_key", "path"))
    found = sweep(places.select("key").distinct(), rules, ranges)
    answers = (
        places.join(found, "key")
        .withColumn("rule", F.from_json("rule", "size int, host_size int, rule string, verdict string"))
        .groupBy("host", "path").agg(F.max("rule").alias("best"))
    )
    return parsed.join(answers, ["host", "path"], "left").select(
        id, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
