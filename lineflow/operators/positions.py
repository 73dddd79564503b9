"""Global positions and running totals without a single-task window.

A window with no partition key runs in one task, and a window over a hot key does too. Both
helpers below work in two levels instead: rows fall into buckets that follow the sort order,
one small table of bucket totals gives every bucket its offset, and only rows of one bucket
are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.session import written

BROADCAST_ROWS = 200_000
HOT_SHARE = 200
BUCKET_ROWS = 50_000  # distinct values that one task sorts, on average


def small_or_plain(df: DataFrame) -> DataFrame:
    """``df``, written once, with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows:
    joins with a larger one are shuffled like any other."""
    df = written(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key) although a few keys may hold most rows.

    Fewer than ``HOT_SHARE`` keys can each hold more than one row in ``HOT_SHARE``: their
    lookup rows are broadcast, so hot rows stay where they are, and the rest joins evenly.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.filter(F.col("n") * HOT_SHARE > total).select(key).collect()]
    hot = [value for value in hot if value is not None]
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = rows.filter(is_hot).join(F.broadcast(lookup.filter(is_hot)), key, how)
    return near.unionByName(rows.filter(~is_hot).join(lookup, key, how))


def ranked(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], name: str,
    max_buckets: int,
) -> DataFrame:
    """Add ``name``, the 0-based position of each row within ``by`` under ``order``.

    ``bucket`` must not decrease along ``order``. ``max_buckets`` bounds the distinct buckets
    over all groups; the offset table is broadcast only below ``BROADCAST_ROWS``.
    """
    keys = [*by, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    if max_buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    # Group keys may be NULL and must keep their rows; the bucket never is.
    matched = rows.join(
        offsets.withColumnsRenamed({key: f"_o_{key}" for key in keys}),
        [F.col("_bucket") == F.col("_o__bucket")]
        + [F.col(key).eqNullSafe(F.col(f"_o_{key}")) for key in by],
    )
    return matched.withColumn(name, F.col("_inside") + F.col("_offset")).drop(
        "_bucket", "_inside", "_offset", *[f"_o_{key}" for key in keys]
    )


def positioned(df: DataFrame, ordinal: str, name: str, width: int = 1 << 18) -> DataFrame:
    """Add ``name``: the dense 0-based position of each row in ``ordinal`` order.

    Ordinals are row positions of the loaded table, so ranges of ``width`` of them hold at
    most ``width`` rows each, however the frame was filtered since.
    """
    bucket = F.floor(F.col(ordinal) / width)
    # Ranges are few (rows / width) but their number is not known here: no broadcast.
    return ranked(df, [], bucket, [F.col(ordinal)], name, BROADCAST_ROWS + 1)


def value_cuts(df: DataFrame, value: str, buckets: int) -> list[float]:
    """At most ``buckets`` ascending cut points that spread the distinct values evenly."""
    grid = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(value, grid, 10_000).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def running_totals(
    df: DataFrame, value: str, totals: Sequence[str], by: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """For one row per distinct ``value`` (within ``by``), add ``<total>_before``, the sum over
    smaller values, and ``<total>_all``, the sum over all. The number of buckets follows from
    the number of rows."""
    by = list(by)
    df = written(df)
    buckets = 1 + df.count() // bucket_rows
    cuts = value_cuts(df, value, buckets) if buckets > 1 else []
    edges = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    bucket = F.size(F.filter(edges, lambda e: e < F.col(value)))
    rows = df.withColumn("_bucket", bucket)
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and bucket from here on.
    sums = rows.groupBy(*by, "_bucket").agg(*[F.sum(t).alias(f"_{t}") for t in totals])
    offsets = sums.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_{t}").over(before), F.lit(0)).alias(f"_{t}") for t in totals],
        *[F.sum(f"_{t}").over(group).alias(f"{t}_all") for t in totals],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # The window leaves rows partitioned on the join keys already.
    return (
        rows.withColumns({f"_{t}_in": F.coalesce(F.sum(t).over(inside), F.lit(0)) for t in totals})
        .join(offsets, [*by, "_bucket"])
        .withColumns({f"{t}_before": F.col(f"_{t}") + F.col(f"_{t}_in") for t in totals})
        .drop("_bucket", *[f"_{t}" for t in totals], *[f"_{t}_in" for t in totals])
    )


def medians(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ``median`` per group of a table of distinct values and their counts ``n``."""
    by = list(by)

    def at(position):
        here = (F.col("n_before") <= position) & (F.col("n_before") + F.col("n") > position)
        return F.max(F.when(here, F.col(value)))

    low, high = F.floor((F.col("n_all") - 1) / 2), F.floor(F.col("n_all") / 2)
    return running_totals(counts, value, ["n"], by).groupBy(*by).agg(
        ((at(low) + at(high)) / 2).alias("median")
    )
