"""Hard negatives by coordinate pruning in buckets of similar length.

Vectors are sorted by length, longest first, and cut into buckets. A bucket keeps, for every
coordinate, its rows in order of that coordinate's value in the vector scaled to length one. A
search asks for scores of at least a floor: by Cauchy-Schwarz only buckets whose longest vector
times the anchor's length reaches it take part, and they need a cosine of at least
floor / (anchor's length x longest length). On the few coordinates where the anchor is largest,
a vector within that angle can only have values in a range, found by binary search in the sorted
lists. Rows in all ranges are scored exactly, in integers.

A first search finds every anchor's positives, its best rows of its own label; a second one
finds, for each positive, the best rows of other labels that score within a share of it. Either
asks the bucket with the longest vectors first, whose k-th scores raise the floors. Pairs of an
anchor block and a bucket are chosen by length alone, before any vector moves; each is a group
of its own and reports k rows a search at most.

Defined results: rows without id or label, and rows whose vector is NULL or holds NULL or a
component that is not finite take no part. Vectors of unequal length count as padded with zeros.
Rows that repeat an id are candidates of their own, though never of an anchor with that id, and
each is an anchor. Ties go to the smaller id. A positive with a negative score has no negatives,
as no score lies between. Scores are exact while they stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineflow.llm.topk import SCALE, integers
from lineflow.session import written

BUCKET_ROWS = 4096
ANCHOR_ROWS = 1024
#: Coordinates of an anchor whose ranges are intersected.
FOCUS = 4
#: Room for rounding in cosines and angles.
ROOM = 1e-7


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), dtype="<i8")
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(float) ** 2).sum(1))


def _units(rows: np.ndarray) -> np.ndarray:
    lengths = _lengths(rows)
    return rows / np.where(lengths > 0, lengths, 1.0)[:, None]


def _packed(dims: int, lists: bool):
    """One row for a block of rows: ids, labels and vectors in order, and what searches need."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        rows = _matrix(block["v"], dims)
        out = {
            "number": [key[0]], "ids": [block["id"].to_numpy(dtype="<i8").tobytes()],
            "labels": [block["label"].to_numpy(dtype="<i8").tobytes()], "rows": [rows.tobytes()],
        }
        if lists:  # one sorted list a coordinate
            order = np.argsort(_units(rows), axis=0, kind="stable").T
            out |= {"order": [np.ascontiguousarray(order, dtype="<u4").tobytes()], "longest": [float(_lengths(rows).max())]}
        else:
            out["lengths"] = [_lengths(rows).tolist()]
        return pd.DataFrame(out)

    return run


def _in_blocks(rows: DataFrame, order: tuple[Column, ...], size: int) -> DataFrame:
    """``rows`` with their ``position`` in ``order`` and ``number``, the block of ``size`` rows it
    lies in: blocks follow from the rows alone, however many partitions they lie in."""
    laid = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so the running total and the broadcast are as few.
    firsts = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")
    )
    placed = laid.withColumn("part", part).join(F.broadcast(firsts), "part").withColumn("position", F.col("first") + place)
    return placed.withColumn("number", F.floor(F.col("position") / size))


class Bucket:
    """A bucket's vectors with a sorted list for every coordinate."""

    def __init__(self, ids: bytes, labels: bytes, rows: bytes, order: bytes, dims: int) -> None:
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.rows = np.frombuffer(rows, "<i8").reshape(-1, dims).astype(float)
        self.order = np.frombuffer(order, "<u4").reshape(dims, -1)
        self.longest = float(_lengths(self.rows).max())
        self.sorted = np.take_along_axis(_units(self.rows).T, self.order, axis=1)

    def feasible(self, anchor: np.ndarray, length: float, floor: float, focus: int = FOCUS) -> np.ndarray:
        """Rows that may score at least ``floor`` with ``anchor``, by ranges of coordinates."""
        if floor <= 0:  # no angle excludes a short vector
            return np.arange(len(self.ids))
        reach = length * self.longest
        if floor > reach * (1 + ROOM):
            return np.zeros(0, dtype=np.int64)
        angle = np.arccos(min(1.0, floor / reach * (1 - ROOM))) + ROOM
        unit = anchor / length
        at = np.argsort(-np.abs(unit), kind="stable")[:focus]
        own = np.arccos(np.clip(unit[at], -1, 1))
        low = np.cos(np.minimum(np.pi, own + angle)) - ROOM
        high = np.cos(np.maximum(0.0, own - angle)) + ROOM
        spans = [
            (int(np.searchsorted(self.sorted[f], a, "left")), int(np.searchsorted(self.sorted[f], b, "right")), f)
            for f, a, b in zip(at, low, high, strict=True)
        ]
        spans.sort(key=lambda s: s[1] - s[0])
        met = np.zeros(len(self.ids), dtype=np.uint8)
        for a, b, f in spans:
            met[self.order[f, a:b]] += 1
        return np.flatnonzero(met == len(spans))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 64 + k:
        few = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def searched(bucket: Bucket, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, wants: list, k: int, own: bool) -> pd.DataFrame:
    """The best k rows for every wish (anchor number, slot, floor, ceiling) that lie between its
    floor and its ceiling, among rows of the anchor's own label or among all others."""
    lengths = _lengths(anchors)
    by_anchor: dict[int, list] = {}
    for want in wants:
        by_anchor.setdefault(want["query"], []).append(want)
    out: list[tuple] = []
    for q, here in by_anchor.items():
        least = min(w["floor"] for w in here)
        found = bucket.feasible(anchors[q], lengths[q], least)
        same = bucket.labels[found] == labels[q]
        found = found[(same if own else ~same) & (bucket.ids[found] != ids[q])]
        scores = bucket.rows[found] @ anchors[q]
        for w in here:
            fits = np.flatnonzero((scores >= w["floor"]) & (scores <= w["ceiling"]))
            for i in fits[best(bucket.ids[found[fits]], scores[fits], k)]:
                out.append((q, w["slot"], int(bucket.ids[found[i]]), int(scores[i])))
    return pd.DataFrame(out, columns=["query", "slot", "vec_id", "score"])


class Searcher:
    """Vectors in buckets by length, and anchors in blocks, both written."""

    def __init__(self, rows: DataFrame, dims: int, bucket_rows: int, anchor_rows: int) -> None:
        self.dims = dims
        length = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
        sorted_by = (F.col("length").desc(), F.col("id"))
        layout = "number long, ids binary, labels binary, rows binary"
        self.buckets = written(
            _in_blocks(rows.withColumn("length", length), sorted_by, bucket_rows).groupBy("number")
            .applyInPandas(_packed(dims, True), layout + ", order binary, longest double").withColumnRenamed("number", "bucket")
        )
        self.anchors = written(
            _in_blocks(rows.filter("is_anchor"), (F.col("id"),), anchor_rows).groupBy("number")
            .applyInPandas(_packed(dims, False), layout + ", lengths array<double>").withColumnRenamed("number", "group")
        )
        self.count = self.buckets.count()

    def pairs(self, wishes: DataFrame, first: bool) -> DataFrame:
        """(group, bucket, wants) of the anchor blocks and buckets that may hold what is wished,
        by lengths alone. Bucket 0 has the longest vectors."""
        reach = F.when(F.col("floor") > 0, F.when(F.col("length") > 0, F.col("floor") / F.col("length")).otherwise(float("inf")))
        asked = wishes.groupBy("group").agg(
            F.min(F.coalesce(reach, F.lit(float("-inf")))).alias("need"),
            # As many as an anchor block has searches.
            F.collect_list(F.struct("query", "slot", "floor", "ceiling")).alias("wants"),
        )
        if first:
            # No literal: an equality with one would make the join a product.
            return asked.select("group", F.when(F.size("wants") > 0, F.lit(0).cast("long")).alias("bucket"), "wants")
        others = F.slice(F.sequence(F.lit(0).cast("long"), F.lit(self.count - 1).cast("long")), 2, self.count)
        numbers = asked.select("group", "need", F.explode(others).alias("bucket"))
        chosen = numbers.join(self.buckets.select("bucket", "longest"), "bucket").filter((1 + ROOM) * F.col("longest") >= F.col("need"))
        return chosen.select("group", "bucket").join(asked.select("group", "wants"), "group")

    def _compare(self, pairs: DataFrame, buckets: DataFrame, k: int, own: bool) -> DataFrame:
        dims = self.dims

        def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            row = part.iloc[0]
            bucket = Bucket(row.ids, row.labels, row.rows, row.order, dims)
            anchors = np.frombuffer(row.a_rows, "<i8").reshape(-1, dims).astype(float)
            ids, labels = np.frombuffer(row.a_ids, "<i8"), np.frombuffer(row.a_labels, "<i8")
            out = searched(bucket, anchors, ids, labels, list(row.wants), k, own)
            out.insert(0, "group", row.group)
            return out

        asked = self.anchors.select("group", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("rows").alias("a_rows"))
        met = pairs.join(asked, "group").join(buckets.drop("longest"), "bucket")
        return met.groupBy("group", "bucket").applyInPandas(
            compare, "group long, query int, slot int, vec_id long, score long"
        )

    def search(self, wishes: DataFrame, k: int, own: bool) -> DataFrame:
        """(group, query, slot, rank, vec_id, score): the best k rows for every wish (group,
        query, slot, length, floor, ceiling)."""
        keys = ["group", "query", "slot"]
        # One row, as large as a bucket may be.
        one = F.broadcast(self.buckets.filter("bucket = 0"))
        start = written(self._compare(self.pairs(wishes, True), one, k, own))
        kth = start.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("known")).filter(F.col("n") >= k)
        raised = wishes.join(kth.drop("n"), keys, "left").withColumn(
            "floor", F.greatest("floor", F.coalesce("known", "floor"))
        ).drop("known")
        both = start.unionByName(self._compare(self.pairs(raised, False), self.buckets, k, own))
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
        return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, percent: int = 80, scale: float = SCALE,
    bucket_rows: int = BUCKET_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every
    anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows
    of other labels that score at least ``percent`` per cent of the positive and no more than it."""
    rows = written(
        vectors.select(
            F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
            integers(F.col(embedding), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        ).filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    )
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dims:
        return vectors.sparkSession.createDataFrame([], empty)
    searcher = Searcher(rows, dims, bucket_rows, anchor_rows)
    each = searcher.anchors.select("group", F.posexplode("lengths").alias("query", "length"))
    any_score = each.withColumns({"slot": F.lit(0), "floor": F.lit(float("-inf")), "ceiling": F.lit(float("inf"))})
    near = written(
        searcher.search(any_score, positives, True).select(
            "group", "query", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ).join(each, ["group", "query"])
    )
    between = near.filter("positive_score >= 0").withColumns({
        "floor": F.ceil(F.col("positive_score") * percent / 100).cast("double"), "ceiling": F.col("positive_score").cast("double"),
    }).select("group", "query", "slot", "length", "floor", "ceiling")
    found = searcher.search(between, negatives, False)
    @F.pandas_udf("array<long>")
    def unpacked(ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<i8") for x in ids])

    names = searcher.anchors.select("group", F.posexplode(unpacked("ids")).alias("query", "anchor_id"))
    return (
        found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        .join(near.select("group", "query", "slot", "positive_id", "positive_score"), ["group", "query", "slot"])
        .join(names, ["group", "query"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
