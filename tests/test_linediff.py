"""Line diffs against what a diff has to satisfy, and against the longest common subsequence."""

import random

import pytest
from pyspark.sql import functions as F

from lineflow.operators import linediff

PAIR = "id long, b string, a string"


def versions(spark, pairs):
    return spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(pairs)], PAIR)


def matched(spark, pairs):
    rows = linediff.matches(versions(spark, pairs), "id", F.col("b"), F.col("a")).collect()
    return {r.id: [(m.i, m.j) for m in r.matched] for r in rows}


def common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            kept = best[j]
            best[j] = before + 1 if x == y else max(best[j], best[j - 1])
            before = kept
    return best[-1]


def test_matches_rise_and_come_near_the_longest(spark):
    rng, pairs = random.Random(5), []
    for _ in range(200):
        old = [rng.choice("abcdefghij}}}}") for _ in range(rng.randint(0, 30))]
        new = [x for x in old if rng.random() > 0.2]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice("abxyz}"))
        if rng.random() < 0.2:  # a block moves
            new = new[len(new) // 2 :] + new[: len(new) // 2]
        pairs.append(("\n".join(old), "\n".join(new)))
    got, mine, most = matched(spark, pairs), 0, 0
    for i, (b, a) in enumerate(pairs):
        old, new, run = b.split("\n"), a.split("\n"), got.get(i, [])
        assert all(old[x] == new[y] for x, y in run)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(run, run[1:]))
        mine, most = mine + len(run), most + common(old, new)
    assert mine >= 0.97 * most


def test_distinct_lines_give_the_longest_common_subsequence(spark):
    rng, pairs = random.Random(6), []
    for n in (1, 5, 20, 60):
        old = [f"l{k}" for k in range(n)]
        new = rng.sample(old, k=n) if n > 1 else old
        pairs.append(("\n".join(old), "\n".join(new)))
    got = matched(spark, pairs)
    for i, (b, a) in enumerate(pairs):
        assert len(got[i]) == common(b.split("\n"), a.split("\n"))


def test_repeated_lines_stay_linear(spark):
    same = "}\n" * 3000
    lines = matched(spark, [(same + "x", same + "y"), (same, "}\n" * 2000)])
    assert len(lines[0]) == 3000 and len(lines[1]) == 2001


@pytest.mark.parametrize("before,after,changed", [
    ("a\nb\nc", "a\nc", [1]),
    ("a\nb\nc", "a\nx\nc\nd", [1]),
    ("a\nb", "a\nnew\nb", []),
    ("x", "x", []),
    ("", "y", [0]),
    ("", "", []),
    ("a\nb", "c", [0, 1]),
    ("a\na\na", "a\na", [0]),
])
def test_changed_lines(spark, before, after, changed):
    rows = linediff.changed_lines(versions(spark, [(before, after)]), "id", F.col("b"), F.col("a")).collect()
    assert [r.changed for r in rows] == [changed]


def test_nulls_and_empty_tables(spark):
    rows = versions(spark, [(None, "a"), ("a", None), ("a", "a")])
    assert [r.id for r in linediff.changed_lines(rows, "id", F.col("b"), F.col("a")).collect()] == [2]
    assert linediff.fix_rows(rows.limit(0), "id", F.col("b"), F.col("a")).count() == 0


def shown(spark, before, after, context):
    rows = linediff.fix_rows(versions(spark, [(before, after)]), "id", F.col("b"), F.col("a"), context)
    return [(r.kind, r.line, r.text) for r in rows.orderBy("at").collect()]


def test_fix_rows(spark):
    assert shown(spark, "a\nb\nc\n", "a\nx\nc\n", 1) == [
        ("context", 1, "a"), ("removed", 2, "b"), ("added", None, "x"), ("context", 3, "c")]
    got = shown(spark, "a\nb\nc\nd\ne\nf\ng\nh\n", "a\nx\nc\nd\ne\nf\ng\ny\nh", 1)
    assert got == [
        ("context", 1, "a"), ("removed", 2, "b"), ("added", None, "x"), ("context", 3, "c"), ("gap", None, ""),
        ("context", 7, "g"), ("added", None, "y"), ("context", 8, "h")]
    # Two changes closer than twice the context share it.
    assert [k for k, _, _ in shown(spark, "a\nb\nc\nd", "A\nb\nc\nD", 1)] == [
        "removed", "added", "context", "context", "removed", "added"]
    assert shown(spark, "a\nb", "a\nb", 2) == []
    assert shown(spark, "", "x", 2) == []
    assert shown(spark, "a", "b", 0) == [("removed", 1, "a"), ("added", None, "b")]
