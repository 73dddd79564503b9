"""Top-k quality of node scores. A graph ranks its own nodes, so nothing moves but sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.functions import graph


def statements(nodes: Column) -> Column:
    """Ids of the nodes that can be declared."""
    return F.filter(nodes, lambda n: graph.is_statement(n["kind"]))["id"]


def ranked_statements(scores: Column) -> Column:
    """Statement ids by descending score, ties in node order."""
    keyed = F.transform(
        statements(F.col("nodes")),
        lambda i: F.struct((-F.get(scores, i)).alias("at"), i.alias("id")),
    )
    return F.array_sort(keyed)["id"]


def top_k_accuracy(graphs: DataFrame, score: str = "score", ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Share of graphs with a label among the k highest-scoring statements: ``top<k>``."""
    rows = graphs.withColumn("_ranked", graph.settled(ranked_statements(F.col(score))))
    return rows.agg(
        *[
            F.avg(F.arrays_overlap(F.slice("_ranked", 1, k), "vuln_nodes").cast("double")).alias(f"top{k}")
            for k in ks
        ]
    )


def chance_top_k(graphs: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Expected top-k accuracy of a uniformly random ranking."""
    n, v = F.size(statements(F.col("nodes"))), F.size("vuln_nodes")
    rows = graphs.select(n.alias("n"), v.alias("v"))

    def hit(k):
        draws = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i < F.col("n"))
        miss = F.aggregate(
            draws, F.lit(1.0),
            lambda acc, i: acc * F.greatest(F.col("n") - F.col("v") - i, F.lit(0)) / (F.col("n") - i),
        )
        return F.avg(1.0 - miss).alias(f"top{k}")

    return rows.agg(*[hit(k) for k in ks])


def feature_ceiling(flagged: DataFrame, p_vuln: float, p_other: float) -> DataFrame:
    """Best success of one declaration that sees a single binary feature.

    ``flagged`` has one boolean array ``flags`` per graph, the feature of every candidate. The
    best guess is the candidate most likely to be the label; its posterior is averaged.
    """
    inf = float("inf")
    yes = p_vuln / p_other if p_other else inf
    no = (1 - p_vuln) / (1 - p_other) if p_other < 1 else inf
    weights = F.transform("flags", lambda f: F.when(f, F.lit(yes)).otherwise(F.lit(no)))
    certain = F.size(F.filter("_w", lambda w: w == F.lit(inf)))
    total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w)
    best = (
        F.when(certain > 0, 1.0 / certain)
        .when(total == 0, 1.0 / F.size("_w"))
        .otherwise(F.array_max("_w") / total)
    )
    return flagged.withColumn("_w", graph.settled(weights)).agg(F.avg(best).alias("ceiling"))
