"""Metrics over per-episode tables. Every aggregate is partial before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------
SIZE_BUCKETS = ((20, "<=20"), (50, "21-50"), (100, "51-100"))
DISTANCE_BUCKETS = ((2, "1-2"), (5, "3-5"), (10, "6-10"))
METRIC_COLUMNS = (
    "episodes", "localization_accuracy", "success_rate", "nodes_inspected_success",
    "nodes_inspected_all", "actions_success", "actions_all", "normalised_cost",
    "cumulative_reward", "path_efficiency",
)
# ----------------------------------------------------------------------------------------


def _bucket(value: Column, bounds: Sequence[tuple[int, str]], beyond: str) -> Column:
    label = F.lit(beyond)
    for upper, name in reversed(bounds):
        label = F.when(value <= upper, name).otherwise(label)
    return label


def add_buckets(df: DataFrame) -> DataFrame:
    """Add the breakdown columns. A distance of 0 or -1 counts as ``1-2``."""
    return df.withColumns(
        {
            "size_bucket": _bucket(F.col("num_nodes"), SIZE_BUCKETS, ">100"),
            "distance_bucket": _bucket(F.col("dist_to_vuln"), DISTANCE_BUCKETS, ">10"),
            "vuln_bucket": F.when(F.col("num_vuln") > 1, "multiple").otherwise("single"),
        }
    )


def _share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def exact_mean(reward: str) -> Column:
    """The mean of rewards, which are decimals of few digits, without rounding on the way: sums of
    doubles depend on their order, and a mean half way between two roundings could go either."""
    return F.avg(F.col(reward).cast("decimal(20,10)")).cast("double")


def metric_columns() -> list[Column]:
    """A failed episode is charged every node and the whole budget; means over successes are
    NULL where there are none."""
    won = F.col("success")
    nodes = F.when(won, F.col("nodes_inspected")).otherwise(F.col("num_nodes"))
    actions = F.when(won, F.col("actions_taken")).otherwise(F.col("max_steps"))
    moves = (F.col("actions_taken") - 1) / F.col("dist_to_vuln")
    return [
        F.count(F.lit(1)).alias("episodes"),
        _share("first_declare_correct").alias("localization_accuracy"),
        _share("success").alias("success_rate"),
        F.avg(F.when(won, F.col("nodes_inspected"))).alias("nodes_inspected_success"),
        F.avg(nodes).alias("nodes_inspected_all"),
        F.avg(F.when(won, F.col("actions_taken"))).alias("actions_success"),
        F.avg(actions).alias("actions_all"),
        F.avg(nodes / F.col("num_nodes")).alias("normalised_cost"),
        exact_mean("cumulative_reward").alias("cumulative_reward"),
        F.avg(F.when(won & (F.col("dist_to_vuln") > 0), moves)).alias("path_efficiency"),
    ]


def compute_metrics(df: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """One row of metrics per group; rows without a key value are left out."""
    keyed = df
    for name in by:
        keyed = keyed.filter(F.col(name).isNotNull())
    return keyed.groupBy(*by).agg(*metric_columns())


def breakdown(df: DataFrame, by: str) -> DataFrame:
    if by.endswith("_bucket") and by not in df.columns:
        df = add_buckets(df)
    return compute_metrics(df, (by, "method"))


def breakdowns(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Several breakdowns from one scan: ``breakdown, bucket, method`` and the metrics.

    Each episode is counted once per breakdown, but the partial aggregate shrinks the
    expanded rows to a handful per task before the shuffle.
    """
    rows = add_buckets(df)
    sides = F.array(
        *[F.struct(F.lit(name).alias("breakdown"), F.col(name).cast("string").alias("bucket")) for name in by]
    )
    return compute_metrics(rows.select("*", F.inline(sides)), ("breakdown", "bucket", "method"))


def metrics_across_seeds(df: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over the seeds of a method."""
    per_seed = compute_metrics(df, ("method", "seed"))
    names = METRIC_COLUMNS[1:]
    return per_seed.groupBy("method").agg(
        F.count_distinct("seed").alias("seeds"),
        *[F.avg(n).alias(f"{n}_mean") for n in names],
        *[F.stddev_pop(n).alias(f"{n}_std") for n in names],
    )


def summarize(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain means, failures counted with the steps they used."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"),
        _share("success").alias("success_rate"),
        F.avg("nodes_inspected").alias("nodes_inspected"),
        F.avg("actions_taken").alias("actions_taken"),
        exact_mean("cumulative_reward").alias("cumulative_reward"),
    )


def end_shares(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of episodes per end reason, in long form."""
    counts = df.groupBy(*by, "end_reason").agg(F.count(F.lit(1)).alias("n"))
    # A handful of rows per group is left for the window: one per end reason.
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, "end_reason", (F.col("n") / total).alias("share"))


def action_mix(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of moves, backtracks and declarations among recorded actions."""
    kind = F.regexp_extract("action", "^([A-Z]+)", 1)
    return steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("actions"),
        *[
            F.avg((kind == name).cast("double")).alias(f"{name.lower()}_share")
            for name in ("MOVE", "BACKTRACK", "DECLARE", "INSPECT")
        ],
    )


def best_evaluation(history: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The best row per group: most success, then fewest nodes, then the earliest ``order``."""
    rank = F.struct(F.col("success_rate"), -F.col("nodes_inspected"), -F.col(order))
    rest = [c for c in history.columns if c not in by]
    return history.groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("_best")).select(*by, "_best.*")


def running_best(history: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Best evaluation so far at each point: most success, then fewest nodes."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(F.col("success_rate"), -F.col("nodes_inspected"), -F.col(order))
    return history.withColumn("best_at", F.max_by(F.col(order), rank).over(upto))
