"""Links of alike texts against all pairs, with groups cut into parts and common passages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineflow.llm import nearcopies, simhash

DOCS = "doc_id long, text string, lang string, fp long, sig string, band int"


def texts_of(seed, families, copies, words, edits):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"w{rng.randrange(2000)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits + 1)):
                text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(text))
    rng.shuffle(out)
    return out


def components_of(texts, least=0.8):
    sets = [set(nearcopies.shingles(t, 5).tolist()) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9
            if alike and (sets[i] or not sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(sets))}


@pytest.mark.parametrize("part_rows", [2048, 7])
def test_components_are_those_of_all_pairs(spark, monkeypatch, part_rows):
    monkeypatch.setattr(nearcopies, "PART_ROWS", part_rows)
    texts = texts_of(3, 12, 9, 120, 5) + ["", "", " \n", "a", "a b", "short text here"]
    docs = spark.createDataFrame([(i, t, "en", 1, "s", 2) for i, t in enumerate(texts)], DOCS)
    got = simhash.near_duplicates(docs, rule=nearcopies.Similar()).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(texts)


def test_a_common_passage_makes_few_pairs(spark, monkeypatch):
    """Texts that share a passage share keys, but few of their pairs reach the exact comparison."""
    rng = random.Random(1)
    common = " ".join(f"c{rng.randrange(10**6)}" for _ in range(200))
    texts = [common + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(100)) for _ in range(1200)]
    docs = spark.createDataFrame([(i, t, "en", 1, "s", 2) for i, t in enumerate(texts)], DOCS)
    seen = []
    exact = nearcopies._verified

    def counted(pairs, sets, least):
        seen.append(pairs.count())
        return exact(pairs, sets, least)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    got = simhash.near_duplicates(docs, rule=nearcopies.Similar())
    assert got.select("component_id").distinct().count() == 1200
    assert sum(seen) < 5 * 1200  # of 719,400 pairs


@pytest.mark.parametrize("part_rows", [2048, 50])
def test_near_misses_make_no_square_of_pairs(spark, monkeypatch, part_rows):
    """Around the limit most pairs pass the sieve, and many miss: members move, not their pairs."""
    monkeypatch.setattr(nearcopies, "PART_ROWS", part_rows)
    texts = texts_of(5, 1, 300, 150, 5)
    docs = spark.createDataFrame([(i, t, "en", 1, "s", 2) for i, t in enumerate(texts)], DOCS)
    seen, stored, exact = [], nearcopies.written, nearcopies._verified

    def counted(pairs, sets, least):
        seen.append(pairs.count())
        return exact(pairs, sets, least)

    def kept(df):
        out = stored(df)
        if out.columns == ["a", "b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "_verified", counted)
    monkeypatch.setattr(nearcopies, "written", kept)
    got = simhash.near_duplicates(docs, rule=nearcopies.Similar()).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(texts)
    assert max(seen) < 6 * 300  # of 44,850 pairs


def test_only_wanted_texts_are_cut_again(spark, monkeypatch, tmp_path):
    """Shingles are made once for every text, and again only for those that are compared."""
    calls, made = str(tmp_path / "calls"), nearcopies.shingles

    def counted(text, size):
        with open(calls, "a") as out:
            out.write("x")
        return made(text, size)

    monkeypatch.setattr(nearcopies, "shingles", counted)
    rng = random.Random(8)
    texts = texts_of(6, 4, 5, 120, 3) + [" ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "en", 1, "s", 2) for i, t in enumerate(texts)], DOCS)
    got = simhash.near_duplicates(docs, rule=nearcopies.Similar()).select("doc_id", "component_id").collect()
    with open(calls) as seen:
        assert len(seen.read()) < 1.5 * len(texts)  # four times as many, if all were
    monkeypatch.setattr(nearcopies, "shingles", made)
    assert {r.doc_id: r.component_id for r in got} == components_of(texts)


@pytest.mark.parametrize("most_words", [1 << 21, 1])
def test_no_wanted_text_is_lost_on_the_way(spark, monkeypatch, most_words):
    """Texts pass whose bits are set: all wanted ones, copies too, however few the bits are."""
    monkeypatch.setattr(nearcopies, "MOST_WORDS", most_words)
    docs = spark.createDataFrame([(i, f"text {i // 2}", "en", 1, "s", 2) for i in range(2000)] + [(None, None, "en", 1, "s", 2)], DOCS)
    wanted = docs.filter("doc_id % 200 < 20").select(F.xxhash64("text").alias("mark")).distinct()
    got = [r.text for r in nearcopies.possibly_wanted(docs, "text", wanted).collect()]
    sure = {f"text {i // 2}" for i in range(2000) if i % 200 < 20}
    assert sure <= set(got) and all(got.count(t) == 2 for t in sure)
    assert most_words == 1 or len(got) < 2 * 2 * len(sure)


def test_sieve_keeps_alike_sets():
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        shared, own = 400, 50  # similarity 0.8
        pool = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
        pool = nearcopies._mixed(pool)
        one, two = np.unique(pool[: shared + own]), np.unique(np.r_[pool[:shared], pool[shared + own :]])
        a, b = ((nearcopies.minima(x) & np.uint32(0xFF)).astype(np.uint8) for x in (one, two))
        lost += np.count_nonzero(a == b) < nearcopies.SIEVE
    assert lost == 0


def test_no_links_without_texts(spark):
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(none, rule=nearcopies.Similar()).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f", "en", 1, "s", 2), (None, "a b c d e f", "en", 1, "s", 2)], DOCS)
    assert simhash.one_of_each(one.withColumnRenamed("fp", "x"), rule=nearcopies.Similar()).count() >= 1
    assert one.filter(F.col("doc_id").isNull()).count() == 1
