"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its letter pairs and triples, hashed to ``DIM``
slots. Document frequencies come from all training documents. Every language is described by
up to ``CLUSTERS`` centroids, clustered on a sample of about ``SAMPLE`` of its training
documents chosen by a hash of their ids; a text gets the language of the centroid with the
highest cosine, and is rejected if that centroid is further away than anything seen in
training allows (``SLACK``).

Defined results: a NULL text, or one without a letter, is ``und`` with score 0 and rejected;
so is every text if nothing could be learned. Rows without id or language teach nothing. Ties
go to the alphabetically first language. Repeated rows are judged alike. Whole texts count;
their memory is one array of code points at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.llm.memory import give_back
from lineflow.llm.tokens import forget_pieces, once_per_process

DIM = 4096
CLUSTERS = 4
ROUNDS = 10
SAMPLE = 1000
SLACK = 0.5
UNKNOWN = "und"
BLOCK = 256


def _letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    return once_per_process(
        "letters", lambda: np.array([chr(c).isalpha() for c in range(0x110000)])
    )


def grams(text: str | None) -> np.ndarray | None:
    """How often each slot's letter pairs and triples occur; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    codes = np.where(_letters()[codes], codes, 32).astype(np.uint32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    if len(codes) < 3:
        return None
    pairs = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    slots = np.concatenate((pairs * np.uint32(0x165667B1), triples)) >> np.uint32(20)
    return np.bincount(slots, minlength=DIM).astype(np.float32)


def vectors(texts: list, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts and a flag for those that have letters."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    known = np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        counts = grams(text)
        if counts is not None:
            row = np.log1p(counts) * idf
            length = np.sqrt(row @ row)
            if length > 0:
                out[i], known[i] = row / length, True
    return out, known


def cluster(points: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from far-apart starts; deterministic."""
    centers = [points.mean(0)]
    near = points @ centers[0]
    centers = []
    for _ in range(min(k, len(points))):
        pick = points[int(near.argmin())]
        centers.append(pick)
        near = np.maximum(near, points @ pick)
    middle = np.array(centers)
    for _ in range(rounds):
        owner = (points @ middle.T).argmax(1)
        for j in range(len(middle)):
            members = points[owner == j]
            if len(members):
                mean = members.mean(0)
                middle[j] = mean / max(float(np.sqrt(mean @ mean)), 1e-12)
    return middle


class LanguageModel(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: np.ndarray


def _slot_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forget_pieces()
    give_back()  # what earlier stages left in this worker
    seen = np.zeros(DIM, dtype=np.int64)
    docs = 0
    for batch in batches:
        for text in batch["text"]:
            counts = grams(text)
            if counts is not None:
                seen += counts > 0
                docs += 1
    give_back()
    if docs:
        yield pd.DataFrame({"slot": np.arange(-1, DIM), "n": np.concatenate(([docs], seen))})


def fit(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
    sample: int = SAMPLE, clusters: int = CLUSTERS,
) -> LanguageModel:
    """A model from all rows of ``docs`` that have a language; ``sample`` bounds what is
    clustered per language. The driver receives one count per slot and the centroids only."""
    train = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    slots = (
        train.select("text").mapInPandas(_slot_counts, "slot int, n long")
        .groupBy("slot").agg(F.sum("n").alias("n")).collect()
    )
    counts = np.zeros(DIM + 1)
    for slot, n in slots:
        counts[slot + 1] = n
    idf = (np.log((1 + counts[0]) / (1 + counts[1:])) + 1).astype(np.float32)

    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        points, known = vectors(pdf.sort_values("id")["text"].tolist(), idf)
        points = points[known]
        if not len(points):
            return pd.DataFrame({"lang": [], "cluster": [], "vector": [], "floor": []})
        middle = cluster(points, clusters)
        best = (points @ middle.T).max(1)
        return pd.DataFrame({
            "lang": pdf["lang"].iloc[0], "cluster": range(len(middle)),
            "vector": [m.tolist() for m in middle], "floor": float(best.min()) * SLACK,
        })

    share = train.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    dice = F.pmod(F.xxhash64(F.col("id"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    shares = {r["lang"]: float(r["share"]) for r in share.collect()}
    if not shares:
        return LanguageModel(idf, np.zeros((0, DIM), np.float32), [], np.zeros(0))
    table = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    picked = train.filter(dice < F.element_at(table, F.col("lang")))
    rows = (
        picked.groupBy("lang")
        .applyInPandas(describe, "lang string, cluster int, vector array<float>, floor double")
        .collect()
    )
    rows.sort(key=lambda r: (r["lang"], r["cluster"]))
    return LanguageModel(
        idf,
        np.array([r["vector"] for r in rows], dtype=np.float32).reshape(-1, DIM),
        [r["lang"] for r in rows],
        np.array([r["floor"] for r in rows]),
    )


def predicted(text: Column, model: LanguageModel, once: bool = False) -> Column:
    """Struct of language, score (the cosine, 0 to 1) and whether the text is rejected. With
    ``once`` Spark evaluates it in one place only, also where a filter on it could move."""
    langs = np.array([*model.langs, UNKNOWN], dtype=object)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget_pieces()
        give_back()
        try:
            yield from judged(batches)
        finally:
            give_back()

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for i in range(0, len(texts), BLOCK):
                points, known = vectors(texts.iloc[i : i + BLOCK].tolist(), model.idf)
                if len(model.langs):
                    near = points @ model.centroids.T
                    best = near.argmax(1)
                    score = np.clip(near[np.arange(len(best)), best].astype(float), 0, 1)
                    too_far = score < model.floors[best]
                else:
                    known = np.zeros(len(points), dtype=bool)
                    best, score = np.zeros(len(points), dtype=int), np.zeros(len(points))
                    too_far = known
                best = np.where(known, best, len(model.langs))
                parts.append(pd.DataFrame({
                    "lang": langs[best], "score": np.where(known, score, 0.0),
                    "rejected": ~known | too_far,
                }))
            yield pd.concat(parts) if parts else pd.DataFrame(
                {"lang": [], "score": [], "rejected": []}
            ).astype({"lang": object, "score": float, "rejected": bool})

    return (predict.asNondeterministic() if once else predict)(text)
