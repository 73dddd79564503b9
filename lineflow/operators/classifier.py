"""A node classifier over features: which statement looks vulnerable?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.functions import graph
from lineflow.operators.features import feature_dim, featurize
from lineflow.operators.ranking import top_k_accuracy
from lineflow.operators.rewrite import draw


def node_rows(graphs: DataFrame, tier: str = "L", **options) -> DataFrame:
    """One row per statement: ``sample_id, id, x, label``."""
    rows = featurize(graphs, tier, **options)
    cells = F.zip_with(
        "nodes", "x", lambda n, x: F.struct(n["id"].alias("id"), n["kind"].alias("kind"), x.alias("x"))
    )
    flat = rows.select("sample_id", "vuln_nodes", F.inline(cells)).filter(graph.is_statement(F.col("kind")))
    return flat.select(
        "sample_id", "id", "x", F.array_contains("vuln_nodes", F.col("id")).cast("double").alias("label")
    )


def balanced(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Repeat positives so that both classes weigh alike; the perceptron takes no weights.

    The fractional part of the ratio is decided per row by hash, so no row is lost.
    """
    counts = rows.agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    positives, n = counts["pos"] or 0.0, counts["n"]
    if not positives or positives == n:
        return rows
    ratio = max(1.0, (n - positives) / positives)
    chance = F.conv(F.substring(draw(seed, F.col("sample_id"), F.col("id")), 1, 8), 16, 10).cast("double") / 2**32
    extra = F.when(chance < ratio - int(ratio), 1).otherwise(0)
    copies = F.when(F.col("label") > 0, F.lit(int(ratio)) + extra).otherwise(1)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


@dataclass
class NodeClassifier:
    """A two-hidden-layer perceptron; ``fit`` keeps the run length with the best validation
    ranking (top-1, then top-3)."""

    tier: str = "L"
    hidden: int = 64
    iterations: tuple[int, ...] = (25, 50, 100)
    seed: int = 0
    model: MultilayerPerceptronClassificationModel | None = None

    def fit(self, train: DataFrame, val: DataFrame, **options) -> NodeClassifier:
        rows = balanced(node_rows(train, self.tier, **options), self.seed)
        data = rows.select(
            array_to_vector(F.col("x").cast("array<double>")).alias("features"), "label"
        ).persist()
        best = -1.0
        layers = [feature_dim(self.tier), self.hidden, self.hidden, 2]
        for steps in self.iterations:
            tried = MultilayerPerceptronClassifier(layers=layers, maxIter=steps, seed=self.seed).fit(data)
            quality = top_k_accuracy(self._scored(val, tried, **options)).first()
            value = (quality["top1"] or 0.0) + 1e-3 * (quality["top3"] or 0.0)
            if value > best:
                best, self.model = value, tried
        data.unpersist()
        return self

    def _scored(self, graphs: DataFrame, model, **options) -> DataFrame:
        rows = node_rows(graphs, self.tier, **options)
        data = rows.withColumn("features", array_to_vector(F.col("x").cast("array<double>")))
        chance = model.transform(data).select(
            "sample_id", "id", F.get(vector_to_array("probability"), F.lit(1)).alias("p")
        )
        per_graph = chance.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "p"))).alias("_p"))
        return graphs.join(per_graph, "sample_id").withColumn(
            "score",
            graph.settled(F.transform("nodes", lambda n: F.coalesce(F.try_element_at("_p", n["id"]), F.lit(0.0)))),
        ).drop("_p")

    def scores(self, graphs: DataFrame, **options) -> DataFrame:
        """Add ``score``: the probability of each node, 0 for ENTRY and EXIT."""
        return self._scored(graphs, self.model, **options)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(str(path))

    @classmethod
    def load(cls, path: str, tier: str = "L") -> NodeClassifier:
        return cls(tier=tier, model=MultilayerPerceptronClassificationModel.load(str(path)))
