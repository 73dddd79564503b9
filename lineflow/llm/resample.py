"""Importance resampling towards a target distribution of hashed word runs.

Every run of one to three consecutive words falls into one of ``BUCKETS`` buckets by its
checksum. A bucket's gain compares how often the target and the corpus use it, with one added
to either count, and a document weighs the sum of the gains of its runs, looked up in one array.
Weight plus Gumbel noise, drawn from a hash of the id, is its score; the highest scores are a
sample without replacement in proportion to the weights.

The k-th score is found by quickselect over the written scores: random pivot keys are drawn
from the rows still in question, one pass counts the rows before and at each pivot, and the
interval that holds the k-th key is kept. It shrinks by about ``PIVOTS`` times a round, and a
round returns the pivots and two numbers for each to the driver. Only winners are sorted, into
ranges, and ranked by the ranges' sizes.

Defined results: a NULL or empty text has no words, no runs and weight 0. Without any run in the
corpus or the target all counts are 0 and gains follow from the added ones. Rows with equal
scores rank by id, NULL ids last and hashed as an empty id, then by their number of runs; rows
that agree in all of these are alike in every returned column but the rank. Texts are read in
blocks of ``BLOCK_BYTES``, so a very long one needs no more memory than its bytes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.session import written

BUCKETS = 10_000
MAX_RUN = 3
BLOCK_BYTES = 1 << 20
#: Pivots of a round, on average.
PIVOTS = 24
#: The noise's resolution: the hash has so many values.
HASHES = 1 << 32

# Bytes of UTF-8: everything beyond ASCII is part of a word. Capitals are lowered before.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def _blocks(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of lowered ``text`` in lists, cut between words about every ``size`` bytes."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def run_buckets(text: bytes, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of ``text``, how many words it has and the buckets of the runs that end
    in it. A run's checksum goes on from the checksum of the run without its last word."""
    crc = zlib.crc32
    carried: list[bytes] = []
    for words in _blocks(text.lower(), size):
        if not words:
            continue
        all_words, old = carried + words, len(carried)
        ends = [b" " + word for word in all_words]
        sums = list(map(crc, all_words))
        found = [sums[old:]]
        for length in range(2, MAX_RUN + 1):
            sums = list(starmap(crc, zip(ends[length - 1 :], sums, strict=False)))
            # Runs that end in a carried word were counted with the block before.
            found.append(sums[max(0, old - length + 1) :])
        carried = all_words[1 - MAX_RUN :]
        yield len(words), np.concatenate([np.array(f, dtype=np.int64) for f in found]) % BUCKETS


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many runs of all texts fall into each bucket: as many rows as buckets reach the
    driver, whatever the size of the table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for value in batch["text"]:
                for _, buckets in run_buckets(value or b""):
                    total += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    out = np.zeros(BUCKETS, dtype=np.int64)
    source = texts.select(F.col(text).cast("binary").alias("text"))
    for bucket, n in source.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket, in doubles."""
    s_all, t_all = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratios], dtype=np.int64)


def noise(id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / float(HASHES))))


def scores(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text",
    target_text: str = "text", seed: int = 42,
) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document, with ``id`` as long."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, features, weights = [], [], []
            for value in batch["text"]:
                n, runs, weight = 0, 0, 0
                for more, buckets in run_buckets(value or b""):
                    n, runs, weight = n + more, runs + len(buckets), weight + int(gain[buckets].sum())
                words.append(n), features.append(runs), weights.append(weight)
            yield pd.DataFrame({
                "id": batch["id"].astype("Int64"), "n_words": words, "n_features": features, "weight": weights,
            })

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    weighed = source.mapInPandas(weigh, "id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumnRenamed("id", id)


def order_key(*parts: Column) -> Column:
    """A string that sorts like the long ``parts``, one after the other."""
    return F.concat(*[F.lpad(F.hex(p.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") for p in parts])


def kth_key(rows: DataFrame, k: int, seed: int = 0, pivots: int = PIVOTS) -> str | None:
    """The k-th smallest ``key`` of ``rows``, a written table without equal keys; None if it has
    fewer rows."""
    inside = rows.count()
    if not 0 < k <= inside:
        return None
    low, high = "", None
    skipped, turn = 0, 0  # rows at or before ``low``
    while True:
        live = rows.filter(F.col("key") > low)
        if high is not None:
            live = live.filter(F.col("key") < high)
        # Rows whose hash falls into the smallest share; all of them once few are left.
        turn += 1
        chosen = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "key"), F.lit(inside)) < pivots
        cuts = sorted(r["key"] for r in live.filter(chosen).select("key").collect())
        if not cuts:
            continue
        counted = live.agg(
            *[F.count_if(F.col("key") < p).alias(f"less{i}") for i, p in enumerate(cuts)],
            *[F.count_if(F.col("key") == p).alias(f"same{i}") for i, p in enumerate(cuts)],
        ).first()
        end, base = skipped + inside, skipped
        for i, pivot in enumerate(cuts):
            less = base + counted[f"less{i}"]
            upto = less + counted[f"same{i}"]
            if less < k <= upto:
                return pivot
            if k <= less:
                high, end = pivot, less
                break
            low, skipped = pivot, upto
        inside = end - skipped


def drawn(
    scored: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20,
    id: str = "doc_id", seed: int = 42,
) -> DataFrame:
    """``scored``, from :func:`scores`, with ``rank``: 1 for the highest score among the drawn
    documents, NULL for the others. Of the documents with at least ``least_words`` words the
    share ``share``, rounded down, is drawn."""
    kept = [c for c in scored.columns if c != id]
    # Higher scores first, then smaller ids, those without one last, then fewer runs; the row's
    # own number makes the key unique.
    key = order_key(
        -F.col("score"), F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("n_features"),
        F.monotonically_increasing_id(),
    )
    rows = written(scored.withColumnRenamed(id, "id").withColumn("key", key))
    able = rows.filter(F.col("n_words") >= least_words)
    last = kth_key(able, able.count() * share[0] // share[1], seed)
    won = F.lit(False) if last is None else (F.col("n_words") >= least_words) & (F.col("key") <= last)
    # A winner's number is its partition's, in key order, with its place there.
    winners = written(
        rows.filter(won).repartitionByRange("key").sortWithinPartitions("key")
        .withColumn("at", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so the running total and the broadcast are as few.
    firsts = winners.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")
    )
    ranked = winners.withColumn("part", part).join(F.broadcast(firsts), "part").select(
        F.col("id").alias(id), *kept, (F.col("first") + place + 1).alias("rank")
    )
    rest = rows.filter(~won).select(F.col("id").alias(id), *kept, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", **how) -> DataFrame:
    """The documents of ``docs`` that are drawn, with all their columns. Where an id repeats,
    all rows of a drawn id come along."""
    options = {k: how.pop(k) for k in ("share", "least_words") if k in how}
    found = drawn(scores(docs, target, id, **how), id=id, seed=how.get("seed", 42), **options)
    ids = found.filter("rank IS NOT NULL").select(F.col(id).alias("_drawn")).distinct()
    return docs.join(ids, F.col(id).cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
