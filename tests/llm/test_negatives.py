"""Hard negatives against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineflow.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int, length double, slot int, group long, v string, is_anchor int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, y, 1.0, 2, 3, "x", 4) for i, e, y in rows], ROWS)


def expected(rows, anchor, k_pos, k_neg, percent=80):
    width = max((len(e) for _, e, _ in rows if e), default=0)
    known = []
    for i, e, y in rows:
        if i is None or y is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        known.append((i, np.array([np.floor(256 * float(np.float32(x))) for x in e] + [0] * (width - len(e))), y))
    out = []
    for i, e, y in known:
        if not anchor(i):
            continue
        others = sorted(((-int(e @ f), j, z) for j, f, z in known if j != i))
        for s, j, _ in [o for o in others if o[2] == y][:k_pos]:
            fits = [o for o in others if o[2] != y and percent * -s <= 100 * -o[0] <= 100 * -s]
            out += [(i, j, r + 1, o[1], -s, -o[0]) for r, o in enumerate(fits[:k_neg])]
    return sorted(out)


def random_rows(seed, n, dims, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        y = int(rng.integers(labels))
        rows.append((i, [float(x) for x in (centres[y] + rng.normal(size=dims)) * rng.uniform(0.1, 2)], y))
    return rows


@pytest.mark.parametrize("sizes", [(4096, 1024), (16, 4)])
def test_random_ties_and_odd_rows(spark, sizes):
    rows = random_rows(1, 150, 6, 3)
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], i % 2) for i in range(30)]  # many equal vectors
    rows += [
        (300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0),
        (None, [1.0] * 6, 0), (304, [1.0] * 6, None), (305, [], 0), (306, [0.0] * 6, 1), (307, [1.0, 2.0], 2),
        (310, [-0.5] * 6, 1), (200, [2.0] * 6, 1), (200, [0.5] * 6, 0), (320, [1.0] * 6, 9),
    ]
    got = negatives.hard_negatives(
        frame(spark, rows), F.col("vec_id") % 10 == 0, bucket_rows=sizes[0], anchor_rows=sizes[1], positives=4, negatives=3
    )
    assert sorted(tuple(r) for r in got.collect()) == expected(rows, lambda i: i % 10 == 0, 4, 3)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert negatives.hard_negatives(none, F.col("vec_id") % 2 == 0).count() == 0
    alone = frame(spark, [(2, [1.0], 1), (3, [1.0], 1)])
    assert negatives.hard_negatives(alone, F.col("vec_id") % 2 == 0).count() == 0
    assert negatives.hard_negatives(alone, F.lit(None).cast("boolean")).count() == 0


def test_ranges_keep_all_that_reach_the_floor():
    rng = np.random.default_rng(3)
    for dims in (2, 8, 64):
        rows = np.floor(256 * rng.normal(size=(500, dims))).astype("<i8")
        order = np.argsort(negatives._units(rows), axis=0, kind="stable").T.astype("<u4")
        ids = np.arange(500, dtype="<i8")
        bucket = negatives.Bucket(ids.tobytes(), ids.tobytes(), rows.tobytes(), np.ascontiguousarray(order).tobytes(), dims)
        pruned = 0
        for anchor in rows[:50].astype(float):
            scores = rows @ anchor
            for floor in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
                found = bucket.feasible(anchor, float(np.sqrt(anchor @ anchor)), floor)
                assert set(np.flatnonzero(scores >= floor)) <= set(found)
                pruned += 500 - len(found)
        assert pruned > 0


def test_pairs_beyond_reach_are_not_sent(spark):
    """Short vectors cannot reach what long ones score: their buckets meet no anchor."""
    rows = [(i, [10.0 + i % 7, 1.0], i % 2) for i in range(64)] + [(100 + i, [0.01, 0.0], i % 2) for i in range(640)]
    data = frame(spark, rows).select("vec_id", "embedding", "label")
    ready = data.select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"),
        negatives.integers(F.col("embedding")).alias("v"), (F.col("vec_id") < 4).alias("is_anchor"),
    )
    searcher = negatives.Searcher(ready, 2, 32, 4)
    each = searcher.anchors.select("group", F.posexplode("lengths").alias("query", "length"))
    wishes = each.withColumns({"slot": F.lit(0), "floor": F.lit(1e6), "ceiling": F.lit(float("inf"))})
    assert searcher.buckets.count() >= 22
    assert searcher.pairs(wishes, False).count() <= 3
