"""Splitting graphs by commit, without leaks.

Whole commits go to train, val or test. Within the CWE a commit mostly belongs to, commits are
dealt largest first, each to the split furthest below its share. Dealing looks sequential,
but among commits of one size it is not: each split's deficit falls by that size per commit it
takes, so the j-th commit of the size goes where the j-th largest of three arithmetic
sequences lies. Only the distinct sizes of a CWE are folded one after the other, and there are
at most sqrt(2 * graphs) of them.
"""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.config import SplitConfig
from lineflow.functions import text
from lineflow.operators.positions import BROADCAST_ROWS, BUCKET_ROWS, join_lookup, ranked, small_or_plain
from lineflow.schema import SPLITS
from lineflow.session import written


class LeakageError(AssertionError):
    """A commit or a function body appears in more than one split."""


def commit_key() -> Column:
    """The commit, or the function itself where none is known."""
    return F.when(
        F.coalesce(F.col("commit_id"), F.lit("")) == "", F.concat(F.lit("sample:"), F.col("sample_id"))
    ).otherwise(F.col("commit_id"))


def commits(graphs: DataFrame) -> DataFrame:
    """``key, stratum, size``: the stratum is the commit's most common CWE, first seen on ties."""
    per_cwe = graphs.groupBy(commit_key().alias("key"), "cwe").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first")
    )
    # Ids sort like row positions, so among equally common CWEs the smallest id was seen first.
    top = per_cwe.groupBy("key").agg(F.sum("n").alias("size"), F.max("n").alias("most"))
    tied = per_cwe.join(top, "key").filter("n = most")
    return tied.groupBy("key", "size").agg(F.min_by("cwe", "first").alias("stratum"))


def deal(counts: list[int], shares: list[float], total: int, size: int, picks: int) -> tuple[list[int], list[int]]:
    """Counts per split after ``picks`` commits of ``size``, and the last few splits chosen.

    Splits of equal standing take turns, so all but the last picks follow from how far each
    deficit lies above the common level they are drawn down to.
    """
    counts, live = list(counts), [i for i, share in enumerate(shares) if share > 0]
    gaps = sorted((shares[i] * total - counts[i] for i in live), reverse=True)
    level = gaps[0]
    for used in range(1, len(gaps) + 1):
        level = (sum(gaps[:used]) - picks * size) / used
        if used == len(gaps) or level >= gaps[used]:
            break
    left = picks
    for i in live:
        sure = max(0, int((shares[i] * total - counts[i] - level) / size) - 2)
        counts[i] += sure * size
        left -= sure
    chosen = []
    for _ in range(left):
        best = max(live, key=lambda i: (shares[i] * total - counts[i], -i))
        counts[best] += size
        chosen.append(best)
    return counts, chosen


def _fold_sizes(key, sizes: pd.DataFrame, shares: list[float]) -> pd.DataFrame:
    """Counts per split before each size is dealt, for one stratum."""
    rows, counts = [], [0] * len(shares)
    total = int((sizes["size"] * sizes["m"]).sum())
    for size, m in sorted(zip(sizes["size"], sizes["m"]), reverse=True):
        rows.append((key[0], int(size), total, list(counts)))
        counts, _ = deal(counts, shares, total, int(size), int(m))
    return pd.DataFrame(rows, columns=["stratum", "size", "total", "counts"])


def _choose(counts, total, size, rank, shares) -> pd.Series:
    picked = []
    for c, t, s, j in zip(counts, total, size, rank):
        before, _ = deal(list(map(int, c)), shares, int(t), int(s), int(j))
        _, last = deal(before, shares, int(t), int(s), 1)
        picked.append(SPLITS[last[-1]])
    return pd.Series(picked)


def assign_commits(graphs: DataFrame, config: SplitConfig | None = None) -> DataFrame:
    """``key, stratum, size, split`` for every commit. Commits of one size are shuffled by a
    hash of the seed and the commit, so the outcome needs no global permutation."""
    config = config or SplitConfig()
    shares = list(config.ratios)
    groups = written(commits(graphs).withColumn(
        "at", F.md5(F.concat_ws(":", F.lit(str(config.seed)), "key").cast("binary"))
    ))
    sizes = groups.groupBy("stratum", "size").agg(F.count(F.lit(1)).alias("m"))
    states = sizes.groupBy("stratum").applyInPandas(
        partial(_fold_sizes, shares=shares), "stratum string, size long, total long, counts array<long>"
    )
    # Hash prefixes follow the hash order; they are as long as the number of commits asks.
    count, digits = groups.count(), 1
    while count > BUCKET_ROWS * 16**digits:
        digits += 1
    bucket = F.conv(F.substring("at", 1, digits), 16, 10).cast("long")
    placed = ranked(groups, ["stratum", "size"], bucket, [F.col("at"), F.col("key")], "rank", BROADCAST_ROWS + 1)

    @F.pandas_udf("string")
    def choose(counts: pd.Series, total: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        return _choose(counts, total, size, rank, shares)

    return placed.join(small_or_plain(states), ["stratum", "size"]).select(
        "key", "stratum", "size", choose("counts", "total", "size", "rank").alias("split")
    )


def split_by_commit(
    graphs: DataFrame, config: SplitConfig | None = None, check: bool = True
) -> DataFrame:
    """The graphs with their ``split``. One commit may hold very many graphs, so the few
    commits that do are looked up by broadcast. A body that would land in several splits is
    an error; ``check=False`` leaves it to the caller to look for ``leaks``."""
    homes = written(assign_commits(graphs, config).select("key", "split"))
    placed = join_lookup(graphs.withColumn("key", commit_key()), homes, "key", "inner").drop("key")
    if check:
        check_no_leakage(placed)
    return placed


def source_hash() -> Column:
    return text.body_hash(F.array_join("source_lines", "\n"))


def leaks(split: DataFrame) -> DataFrame:
    """``kind, key, splits`` of every commit or body found in more than one split.

    Bounds of the split name tell one home from several and merge map-side, whatever the
    number of copies.
    """
    found = None
    for kind, key in (("commit", commit_key()), ("body", source_hash())):
        homes = split.groupBy(key.alias("key")).agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        part = homes.filter("lo <> hi").select(F.lit(kind).alias("kind"), "key", F.concat_ws(",", "lo", "hi").alias("splits"))
        found = part if found is None else found.unionByName(part)
    return found


def check_no_leakage(split: DataFrame) -> None:
    first = leaks(split).limit(1).collect()
    if first:
        raise LeakageError(f"{first[0]['kind']} {first[0]['key']} appears in splits {first[0]['splits']}")


def split_summary(split: DataFrame) -> DataFrame:
    """``split, graphs, share, commits, by_cwe``; a row per split that has graphs."""
    per_cwe = split.groupBy("split", "cwe", commit_key().alias("key")).agg(F.count(F.lit(1)).alias("n"))
    # A commit keeps to one split, so commits can be counted once their CWEs are merged.
    per_commit = per_cwe.groupBy("split", "key").agg(F.sum("n").alias("n"))
    main = per_commit.groupBy("split").agg(F.sum("n").alias("graphs"), F.count(F.lit(1)).alias("commits"))
    total = main.agg(F.sum("graphs")).scalar()
    cwes = per_cwe.groupBy("split", "cwe").agg(F.sum("n").alias("n")).groupBy("split").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cwe", "n")))).alias("by_cwe")
    )
    return main.join(cwes, "split").select(
        "split", "graphs", F.bround(F.col("graphs") / total, 4).alias("share"), "commits", "by_cwe"
    )
