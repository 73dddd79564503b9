"""Toxicity by weak supervision.

Voters look at a text: lexicon voters fire on a word or a word beginning, pattern voters on
shouting, exclamation and repetition. The lexicon is drawn from counts over all training rows:
entries that toxic texts hold far more often than others, and more often than chance would
give to one of all entries tried. The ``OWN_COLUMNS`` most frequent are voters and features of
their own, all others share ``POOLS`` of them, by their odds. A generative label model takes the label as
hidden; expectation maximisation estimates how often each voter fires on toxic and on clean
texts, starting from and tempered by the rates in the training rows, and how strongly voters
agree beyond what the label explains, by which correlated voters share their weight. A linear
classifier is then trained on the model's posterior labels, put on the scale of the training
labels by one slope and one shift, and scores every text.

Label model and classifier read at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash
of their ids; scoring reads every whole text. Neither language, source nor id is an input of a score.

Defined results: NULL and empty texts are scored as texts in which no voter fires. Without a
toxic and a clean training row nothing can be learned and every score is 0. Repeated rows get
the same score. A label that is NULL teaches nothing; of several labels of one id the highest
counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.session import written

TRAIN_ROWS = 20_000
OWN_COLUMNS = 400
POOLS = 16
MIN_DOCS = 4
MIN_ODDS = 20.0
STEMS = (4, 5, 6)
STEM_MARK = "*"
ROUNDS = 4
#: Weight of the training rates in the label model, as a number of documents.
PRIOR_DOCS = 2000.0
HELD_ENTRIES = 1_000_000
#: Up to so many labels go to the texts; more meet them by id.
BROADCAST_ROWS = 1_000_000

_WORD = re.compile(r"\w+")
PATTERNS = ("shouting", "exclaiming", "repeating")


def entries_of(words: Counter) -> Counter:
    """A text's lexicon entries: its words and, marked, their beginnings."""
    out = Counter(words)
    for word, n in words.items():
        for size in STEMS:
            if len(word) >= size:
                out[word[:size] + STEM_MARK] += n
    return out


def patterns(text: str, words: list[str]) -> tuple[float, float, float]:
    """Shares of shouted words, exclamation marks per word, words repeated at once."""
    n = max(len(words), 1)
    shouted = sum(map(str.isupper, text.split()))
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return min(1.0, shouted / n), min(1.0, text.count("!") / n), repeated / n


class ToxicityModel(NamedTuple):
    entries: dict[str, int]
    weights: np.ndarray
    bias: float

    @property
    def columns(self) -> int:
        return 1 + max(self.entries.values(), default=-1)

    def features(self, texts: list) -> np.ndarray:
        """Per text: log counts of each column's entries, log count of all, the patterns."""
        k = self.columns
        out = np.zeros((len(texts), k + 1 + len(PATTERNS)), dtype=np.float32)
        get = self.entries.get
        for i, text in enumerate(texts):
            if not text:
                continue
            words = _WORD.findall(text.lower())
            for word, n in Counter(words).items():
                at = get(word)
                if at is not None:
                    out[i, at] += n
                for size in STEMS:
                    if len(word) >= size:
                        at = get(word[:size] + STEM_MARK)
                        if at is not None:
                            out[i, at] += n
            out[i, k + 1 :] = patterns(text, words)
        out[:, k] = out[:, :k].sum(1)
        out[:, : k + 1] = np.log1p(out[:, : k + 1])
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def votes(features: np.ndarray) -> np.ndarray:
    """Which voters fire, as 0 and 1; patterns fire from half of their range."""
    entries = features[:, : -len(PATTERNS) - 1] > 0
    shapes = features[:, -len(PATTERNS) :] > 0.5
    return np.hstack((entries, shapes)).astype(np.float64)


def label_model(
    fired: np.ndarray, toxic_rate: np.ndarray, clean_rate: np.ndarray, share: float,
    rounds: int = ROUNDS, prior: float = PRIOR_DOCS,
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the hidden label per row, and the voters' weights under correlation."""
    a0, b0 = (np.clip(x, 1e-4, 1 - 1e-4) for x in (toxic_rate, clean_rate))
    a, b, p = a0, b0, np.clip(share, 1e-3, 1 - 1e-3)
    weight = np.ones(fired.shape[1])
    posterior = np.full(len(fired), p)
    for _ in range(rounds):
        on, off = np.log(a / b), np.log((1 - a) / (1 - b))
        logit = np.log(p / (1 - p)) + fired @ (weight * (on - off)) + (weight * off).sum()
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        toxic, clean = posterior.sum(), (1 - posterior).sum()
        a = np.clip((posterior @ fired + prior * a0) / (toxic + prior), 1e-4, 1 - 1e-4)
        b = np.clip(((1 - posterior) @ fired + prior * b0) / (clean + prior), 1e-4, 1 - 1e-4)
        p = np.clip((toxic + prior * share) / (len(fired) + prior), 1e-3, 1 - 1e-3)
        # What the label leaves unexplained shows which voters say the same thing.
        rest = fired - np.outer(posterior, a) - np.outer(1 - posterior, b)
        scale = np.sqrt((rest**2).sum(0)) + 1e-9
        agree = np.clip((rest.T @ rest) / np.outer(scale, scale), 0, 1)
        agree[agree < 0.2] = 0
        weight = 1 / np.maximum(agree.sum(1), 1)
    return posterior, weight


def linear_classifier(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method; the last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per entry and label, counted within the task."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pd.DataFrame:
        names = list(set(held[0]) | set(held[1]))
        return pd.DataFrame({
            "entry": pd.Series(names, dtype=object), "clean": [held[0][n] for n in names],
            "toxic": [held[1][n] for n in names],
        }).astype({"clean": "int64", "toxic": "int64"})

    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            held[int(label)].update(entries_of(Counter(_WORD.findall((text or "").lower()))).keys())
            if len(held[0]) + len(held[1]) > HELD_ENTRIES:
                yield out()
                held[0].clear(), held[1].clear()
    yield out()


def _counted(rows: DataFrame) -> DataFrame:
    return (
        rows.select("text", "toxic").mapInPandas(_count, "entry string, clean long, toxic long")
        .groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )


def lexicon(rows: DataFrame) -> list[tuple[str, int, int]]:
    """(entry, toxic, clean) of the entries that tell, from the labelled texts ``rows``."""
    sizes = {int(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    tried = written(_counted(rows).filter(F.col("toxic") >= MIN_DOCS))
    n_tried = tried.count()
    if not n_clean or not n_tried:
        return []
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    odds = ((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1))
    # Chernoff's bound on the log odds of so many toxic texts by chance; one false entry in all.
    base = n_toxic / (n_toxic + n_clean)
    surprise = t * F.log(t / (t + c) / base) + F.when(
        c > 0, c * F.log(c / (t + c) / (1 - base))
    ).otherwise(0.0)
    told = tried.filter((odds >= MIN_ODDS) & (surprise >= float(np.log(n_tried)))).collect()
    counts = {r["entry"]: (r["toxic"], r["clean"]) for r in told}
    return sorted(((e, *n) for e, n in counts.items()), key=lambda r: (-r[1], r[0]))


def columns_of(entries: list[tuple[str, int, int]]) -> dict[str, int]:
    """Each entry's column: the most frequent have their own, the rest share by their odds. A
    beginning that has the texts of one longer entry only shares the column of that entry."""
    counts = {e: n for e, *n in entries}
    longer = {}
    for e in sorted(counts, reverse=True):
        for size in STEMS:
            stem = e[:size] + STEM_MARK
            if len(e.rstrip(STEM_MARK)) >= size and stem != e and counts.get(stem) == counts[e]:
                longer[stem] = e if not e.endswith(STEM_MARK) else longer.get(stem, e)
    own = [r for r in entries if r[0] not in longer]
    out = {e: i for i, (e, _, _) in enumerate(own[:OWN_COLUMNS])}
    rest = sorted(own[OWN_COLUMNS:], key=lambda r: ((r[1] + 0.5) / (r[2] + 0.5), r[0]))
    out |= {e: OWN_COLUMNS + i * POOLS // len(rest) for i, (e, _, _) in enumerate(rest)}
    for stem in longer:
        word = stem
        while word in longer:
            word = longer[word]
        out[stem] = out[word]
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
    label: str = "toxic", train_rows: int = TRAIN_ROWS,
) -> ToxicityModel:
    """A model from the labelled rows; ``labels`` must hold training rows only."""
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(id).alias("id")
    ).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    total = known.count()
    dice = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(dice < train_rows / max(total, 1))
    # About train_rows ids: small enough to broadcast, whatever the number of labels.
    rows = written(
        docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
        .join(F.broadcast(picked), "id")
    )
    sizes = {int(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return ToxicityModel({}, np.zeros(1 + len(PATTERNS)), -np.inf)
    labelled = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(known) if total <= BROADCAST_ROWS else known, "id"
    )
    model = ToxicityModel(columns_of(lexicon(labelled)), np.zeros(0), 0.0)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = model.features(batch["text"].tolist())
            yield pd.DataFrame({
                "id": batch["id"], "toxic": batch["toxic"],
                "x": [row.astype("<f2").tobytes() for row in x],
            })

    sample = rows.mapInPandas(featured, "id long, toxic int, x binary").collect()
    sample.sort(key=lambda r: (r["id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], "<f2") for r in sample]).astype(np.float64)
    seen = np.array([r["toxic"] for r in sample]) == 1
    fired = votes(x)
    posterior, _ = label_model(fired, fired[seen].mean(0), fired[~seen].mean(0), float(seen.mean()))
    w = linear_classifier(x, posterior)
    # The classifier's logit is put on the scale of the training labels.
    logit = x @ w[:-1] + w[-1]
    slope, shift = linear_classifier(logit[:, None], seen.astype(float), ridge=1e-3)
    if slope <= 0:
        slope, shift = 1.0, 0.0
    return model._replace(weights=slope * w[:-1], bias=float(slope * w[-1] + shift))


def score(text: Column, model: ToxicityModel) -> Column:
    """Score between 0 and 1 of every text."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [
                model.scores(model.features(texts.iloc[i : i + 512].tolist()))
                for i in range(0, len(texts), 512)
            ]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return F.lit(0.0) if np.isneginf(model.bias) else scored(text)
