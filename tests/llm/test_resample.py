"""Importance resampling against a plain version of it."""

import hashlib
import math
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lineflow.llm import queries, resample

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score double, rank int, low int, row string, n_words string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def buckets_of(text):
    words = WORD.findall(lowered(text))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def expected(docs, target, least=20, share=(5, 100)):
    known = [(d, *buckets_of(t)) for d, t in docs]
    s, t = [0] * 10000, [0] * 10000
    for _, _, found in known:
        for b in found:
            s[b] += 1
    for text in target:
        for b in buckets_of(text)[1]:
            t[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for d, n, found in known:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = {}
    for place, r in enumerate(able[: len(able) * share[0] // share[1]]):
        ranks.setdefault(r, []).append(place + 1)
    out = []
    for r in rows:
        out.append((r[0], r[2], r[3], r[4], ranks[r].pop() if ranks.get(r) else None))
    return out


def plain(rows):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in rows), key=repr)


EDGES = [None, "", " \n\t", "a", "A a a", "é É ß 日本 語", "x" * 5000, "W0rd, " * 40_000, "_ - !", "ab\x7fcd\x00ef"]


def test_runs_do_not_depend_on_blocks():
    for text in [*EDGES, "one two three four five " * 300, "é" * 99 + " b"]:
        n, found = buckets_of(text)
        for size in (1, 7, 100, 1 << 20):
            got = list(resample.run_buckets((text or "").encode(), size))
            assert sum(g[0] for g in got) == n
            assert sorted(int(b) for g in got for b in g[1]) == sorted(found)


@pytest.mark.parametrize("share", [(50, 100), (0, 100)])
def test_edges_ties_and_repeats(spark, share):
    long = "the cat sat on the mat and looked at the other cats that sat on their own mats all day long"
    texts = [*EDGES, long, long, long + " again", "stop words only the the the " * 9]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, long), (3, long), (None, long), (None, long + " b"), (None, None)]
    target = ["cats on mats", None, "", long]
    frame = spark.createDataFrame([(d, t, 1.0, 2, 3, "x", "y") for d, t in docs], DOCS)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.drawn(resample.scores(frame, bench), share)
    assert plain(got.collect()) == sorted(expected(docs, target, share=share), key=repr)
    kept = resample.resample(frame, bench, share=share)
    assert kept.columns == frame.columns
    ids = {r[0] for r in expected(docs, target, share=share) if r[4]}
    assert kept.count() == sum(d in ids for d, _ in docs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "text string")
    assert resample.drawn(resample.scores(none, bench)).count() == 0
    assert resample.resample(none, bench).count() == 0
    one = spark.createDataFrame([(1, "a b", 1.0, 2, 3, "x", "y")], DOCS)
    assert plain(resample.drawn(resample.scores(one, bench)).collect()) == sorted(expected([(1, "a b")], []), key=repr)


@pytest.mark.parametrize("pivots", [4, 64])
def test_quickselect(spark, pivots):
    values = [((i * 7919) % 101 - 50, i) for i in range(1500)]
    rows = spark.createDataFrame(values, "v long, i long").select(resample.order_key(F.col("v"), F.col("i")).alias("key"), "v", "i").cache()
    order = [r.key for r in sorted(rows.collect(), key=lambda r: (r.v, r.i))]
    assert order == sorted(order)
    for k in (1, 749):
        assert resample.kth_key(rows, k, pivots=pivots) == order[k - 1]
    assert resample.kth_key(rows, 0) is None and resample.kth_key(rows, 1501) is None
    rows.unpersist()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_op12(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select(F.col("text")).collect()]
    assert plain(queries.op12_resample(spark, SF_DIR).collect()) == sorted(expected(docs, target), key=repr)
