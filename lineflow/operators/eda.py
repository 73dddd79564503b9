"""Exploratory counts over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vulnerable_cwe_counts(df: DataFrame) -> DataFrame:
    """Vulnerable functions per CWE, most frequent first; an unknown CWE reads ``(none)``."""
    name = F.when(F.col("cwe") == "", "(none)").otherwise(F.col("cwe"))
    return (
        df.filter("vul = 1").groupBy(name.alias("cwe")).agg(F.count("*").alias("functions"))
        .orderBy(F.desc("functions"), "cwe")
    )


def relative_flaw_positions(filtered: DataFrame) -> DataFrame:
    """One row per flaw line: its place in the function, 0 the first line and 1 the last."""
    span = F.greatest(F.col("num_lines") - 1, F.lit(1))
    return filtered.select("sample_id", F.explode("flaw_line_indices").alias("index"), span.alias("span")).select(
        "sample_id", (F.col("index") / F.col("span")).alias("position")
    )


def first_flaw_positions(filtered: DataFrame) -> DataFrame:
    span = F.greatest(F.col("num_lines") - 1, F.lit(1))
    return filtered.select(
        "sample_id", (F.array_min("flaw_line_indices") / span).alias("position")
    )


def position_summary(positions: DataFrame, bins: int = 10) -> DataFrame:
    """Share of positions per equal-width bin of [0, 1], the last bin closed on the right."""
    inner = F.array(*[F.lit(i / bins) for i in range(1, bins)]).cast("array<double>")
    placed = positions.filter(F.col("position").between(0.0, 1.0)).select(
        F.size(F.filter(inner, lambda edge: edge <= F.col("position"))).alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    every = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # ``bins`` rows at most from here on, so the unpartitioned window is tiny.
    table = every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))
    return table.select(
        F.round(F.col("bin") / bins, 2).alias("from"),
        F.round((F.col("bin") + 1) / bins, 2).alias("to"),
        (F.col("n") / total).alias("share"),
        F.lit(1.0 / bins).alias("uniform"),
    )


def dataset_summary(filtered: DataFrame) -> DataFrame:
    """Headline facts of a filtered corpus in one row."""
    flaws = F.size("flaw_line_indices")
    projects = filtered.groupBy("project").agg(F.count("*").alias("n"))
    largest = projects.agg((F.max("n") / F.sum("n")).alias("share")).scalar()
    # The exact medians aggregate value frequencies, so their state is one entry per distinct
    # line count, merged map-side.
    return filtered.agg(
        F.count("*").alias("functions"),
        F.count_distinct("project").alias("projects"),
        F.count_distinct("commit_id").alias("fixing_commits"),
        F.median("num_lines").alias("median_lines"),
        F.avg("num_lines").alias("mean_lines"),
        F.median(flaws).alias("median_flaw_lines"),
        F.avg(flaws).alias("mean_flaw_lines"),
        F.avg((flaws == 1).cast("double")).alias("single_flaw_line_share"),
    ).withColumn("largest_project_share", largest)
