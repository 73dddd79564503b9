"""Tail probabilities as Columns: sums of series and of counts, folded over arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on the continued fraction converges faster than the series.
FAR = 2.5
TERMS = 80


def normal_tail(z: Column) -> Column:
    """The chance that a standard normal value lies further from 0 than ``z``, on either side."""
    x = F.abs(z) / math.sqrt(2.0)
    start = F.struct(x.alias("term"), x.alias("sum"))

    def grown(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, grown)["sum"]
    near = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-x * x) * series
    fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), x, lambda t, k: x + k / 2.0 / t)
    far = F.exp(-x * x) / (math.sqrt(math.pi) * fraction)
    return F.when(x < FAR, near).otherwise(far)


def signed_rank_tail(statistic: Column, n: Column) -> Column:
    """The exact two-sided chance of a rank sum of at most ``statistic`` among ``n`` untied
    differences: of all 2**n choices of signs, those whose positive ranks sum to so little.
    Counts are exact up to 62 differences."""
    none = F.array(F.lit(1).cast("bigint"))
    most = F.floor(statistic).cast("int")
    ways = F.concat(none, F.array_repeat(F.lit(0).cast("bigint"), most))

    def dealt(w: Column, rank: Column) -> Column:
        return F.transform(w, lambda count, s: count + F.when(s >= rank, F.get(w, s - rank)).otherwise(F.lit(0).cast("bigint")))

    counts = F.aggregate(F.sequence(F.lit(1), n.cast("int")), ways, dealt)
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2.0 * total / F.pow(F.lit(2.0), n))
