"""Statement embeddings: texts, encoding once per distinct text, projection, attachment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.functions import graph
from lineflow.operators.features import EMBED_DIM, EMBED_KEY
from lineflow.operators.positions import join_lookup

# --- Fixed values -----------------------------------------------------------------------
BATCH_TEXTS = 64
# ----------------------------------------------------------------------------------------


def statement_texts(graphs: DataFrame) -> DataFrame:
    """``sample_id, id, text``: the kind for ENTRY and EXIT, else the code or, if empty, the kind."""
    rows = graphs.select("sample_id", F.inline("nodes"))
    shown = F.when(~graph.is_statement(F.col("kind")) | (F.col("code") == ""), F.col("kind"))
    return rows.select("sample_id", "id", shown.otherwise(F.col("code")).alias("text"))


def encode_texts(texts: DataFrame, load: Callable[[], Callable], batch: int = BATCH_TEXTS) -> DataFrame:
    """``text, vector`` for every distinct text.

    ``load`` runs once per task and returns an encoder of a list of texts; nothing here
    assumes a particular model library.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = model(part["text"].tolist())
                yield pd.DataFrame({"text": part["text"], "vector": [list(map(float, v)) for v in vectors]})

    return texts.select("text").distinct().mapInPandas(encode, "text string, vector array<double>")


def fit_projection(vectors: DataFrame, dim: int = EMBED_DIM, column: str = "vector") -> PipelineModel:
    """Centre, rotate to the leading components and scale each to unit deviation.

    Fit on training rows only. The covariance is aggregated in a tree over the rows, and only
    it (input width squared) reaches the driver.
    """
    width = vectors.select(F.size(column).alias("w")).first()
    rows = vectors.limit(dim).count()
    if width is None or dim > min(width["w"], rows):
        raise ValueError(f"cannot fit {dim} components to data of shape ({rows}+, {width and width['w']})")
    data = vectors.select(array_to_vector(F.col(column).cast("array<double>")).alias("_in"))
    stages = [
        StandardScaler(inputCol="_in", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=dim, inputCol="_centred", outputCol="_components"),
        StandardScaler(inputCol="_components", outputCol="_scaled", withMean=False, withStd=True),
    ]
    return Pipeline(stages=stages).fit(data)


def project(vectors: DataFrame, model: PipelineModel, column: str = "vector", name: str = "reduced") -> DataFrame:
    """Add ``name``: components squashed into [0, 1], 0.5 being the training mean."""
    data = vectors.withColumn("_in", array_to_vector(F.col(column).cast("array<double>")))
    out = model.transform(data)
    squashed = F.transform(vector_to_array("_scaled"), lambda v: 0.5 + 0.5 * F.tanh(v / 2.0))
    return out.withColumn(name, squashed.cast("array<float>")).drop("_in", "_centred", "_components", "_scaled")


def save_projection(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(str(path))


def load_projection(path: str) -> PipelineModel:
    return PipelineModel.load(str(path))


def attach_embeddings(graphs: DataFrame, reduced: DataFrame) -> DataFrame:
    """Store projected vectors (``text, reduced``) on the records, rounded to four digits.

    A text such as "}" or "ENTRY" occurs in every graph, so common texts are looked up by
    broadcast; a graph's vectors then meet in its row.
    """
    found = join_lookup(statement_texts(graphs), reduced.select("text", "reduced"), "text").groupBy(
        "sample_id"
    ).agg(F.array_sort(F.collect_list(F.struct("id", "reduced"))).alias("_v"))
    rounded = F.transform("_v", lambda p: F.transform(p["reduced"], lambda x: F.bround(x.cast("double"), 4)))
    kept = F.map_filter("features", lambda k, _: k != EMBED_KEY)
    return (
        graphs.join(found, "sample_id")
        .withColumn("features", F.map_concat(kept, F.create_map(F.lit(EMBED_KEY), rounded)))
        .select(*graphs.columns)
    )
