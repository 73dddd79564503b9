"""The training-data operators on small fixtures, against brute force."""

import math
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lineflow.llm import bpe, langid, packing, pii, quality, simhash, tokenfile, tokens, topk, toxicity, urlrules

LONG = "word " * 60_000
# Extra columns whose names operators use themselves.
DOCS = "doc_id long, text string, lang string, kept boolean, score double, fp long, item int"


def frame(spark, texts, lang="en"):
    rows = [(i, t, lang, True, 0.5, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", "   \n\t ", "a", "a", "é ", "x" * 50_000, LONG]


# PII


def test_pii_spans(spark):
    texts = [
        "mail: a.b+c@x.org, ip 1.2.3.4 and 300.1.1.1",
        "card 4111 1111 1111 1111 or 4111 1111 1111 1112",
        "call +1 (743) 555-3824.",
        "IBAN DE89 3704 0044 0532 0130 00 but DE89 3704 0044 0532 0130 01",
        "my ssn 123-45-6789; 123-45-6789 and code 666-45-6789",
        "a@b.cc+d@e.ff",
        "😀 x@y.zz",
        *EDGES,
        "b@c.de " * 3000,
    ]
    got = pii.find(frame(spark, texts)).orderBy("doc_id").select(pii.listed(F.col("_pii")).alias("s")).collect()
    got = [r.s for r in got]
    assert got[0] == "email:6:17,ip:22:29"
    assert got[1] == "card:5:24"
    assert got[2] == "phone:5:22"
    assert got[3] == "iban:5:32"
    assert got[4] == "ssn:7:18"
    assert got[5] == "email:0:6,email:6:13"
    assert got[6] == "email:2:8"
    assert all(s == "" for s in got[7 : 7 + len(EDGES)])
    assert got[-1].split(",")[-1] == f"email:{7 * 2999}:{7 * 2999 + 6}" and got[-1].count(",") == 2999


def test_pii_mask(spark):
    docs = frame(spark, ["write a@b.cc or +1 743 555 3824!", None, "clean", "4111111111111111@x.org"])
    got = [r.text for r in pii.mask(docs).orderBy("doc_id").collect()]
    assert got == ["write [EMAIL] or [PHONE]!", None, "clean", "[EMAIL]"]
    assert pii.mask(docs).columns == docs.columns
    assert pii.mask(docs.limit(0)).count() == 0


# BPE


@pytest.fixture(scope="module")
def ranks():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("chars", [10, 16_000_000])
def test_bpe_round_trip(spark, ranks, chars, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
    texts = [*EDGES, "Don't stop: 日本語 naïve\r\n  x\t\t12 3", "same same", "same same"]
    docs = frame(spark, texts)
    got = bpe.encode(docs, ranks, public_tokenizers.PATTERN, back=True)
    got = got.withColumn("again", bpe.decoded(F.col("ids"), ranks)).collect()
    model = bpe.encoding(ranks, public_tokenizers.PATTERN)
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == model.encode_ordinary(text)
        assert bytes(r.bytes).decode() == bytes(r.again).decode() == text


def test_bpe_repeated_and_missing_ids(spark, ranks):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "d e f")], "doc_id long, text string")
    got = bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, len(r.ids) // 4) for r in got) == [(0, 2), (1, 1), (1, 3)]
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


# Toxicity


def test_toxicity_learns_from_few_labels(spark):
    rng = np.random.default_rng(0)
    calm = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(calm, 30))
        toxic = i % 6 == 0
        if toxic:
            words[int(rng.integers(30))] = str(rng.choice(["vilefoo", "vilebar", "scoundrel"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(1, None), (None, 1)]
    docs = spark.createDataFrame([*rows, (601, None), (602, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id IS NULL OR doc_id % 4 <> 0")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    held = [i for i in range(600) if i % 4 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    assert 0 <= got[601] == got[602] < 0.5
    nothing = toxicity.fit(docs, marks.limit(0))
    assert docs.select(toxicity.score(F.col("text"), nothing).alias("s")).distinct().collect()[0].s == 0.0


def test_toxicity_counts_every_labelled_row(spark):
    rng = np.random.default_rng(2)
    insults = [f"{a}{b}{c}ulous" for a in "bcdfghjklm" for b in "aeiou" for c in "npqrstvwxz"][:440]
    rows, labels = [], []
    for i in range(6000):
        words = [f"w{j}" for j in rng.integers(0, 60, 20)]
        toxic = i % 3 == 0
        if toxic and i % 600:
            words[:2] = insults[2 * i // 3 % 440], insults[(2 * i // 3 + 1) % 440]
        elif toxic:
            words[0] = "snarfblat"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), train_rows=600)
    assert "snarfblat" in model.entries and set(insults) <= {w for w in model.entries if w[-1] != "*"}
    assert model.columns <= toxicity.OWN_COLUMNS + toxicity.POOLS
    rare, calm = model.scores(model.features(["w1 w2 w3 w4 w5 snarfblat", "w1 w2 w3 w4 w5 w6"]))
    assert calm < 0.5 < rare


def test_columns_of_lexicon_entries():
    entries = [("vile*", 9, 0), ("scou*", 5, 0), ("scoun*", 5, 0), ("scoundrel", 5, 0), ("vilefoo", 5, 0), ("vilebar", 4, 0)]
    got = toxicity.columns_of(entries)
    assert got["scou*"] == got["scoun*"] == got["scoundrel"]
    assert len({got[e] for e in ("vile*", "scoundrel", "vilefoo", "vilebar")}) == 4


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(1)
    truth = rng.random(2000) < 0.3
    good = (rng.random((2000, 3)) < np.where(truth, 0.8, 0.1)[:, None]).astype(float)
    poor = (rng.random(2000) < np.where(truth, 0.6, 0.4)).astype(float)
    fired = np.hstack((good, np.repeat(poor[:, None], 6, axis=1)))
    posterior, weight = toxicity.label_model(fired, fired[truth].mean(0), fired[~truth].mean(0), 0.3)
    assert ((posterior > 0.5) == truth).mean() > 0.9
    assert weight[3:].max() < 0.3 < weight[:3].min()


# Quality


def test_quality_counts(spark):
    repeat = "a b c " * 20
    texts = ["one two three", "x\nx\n\ny\nx", repeat, "# $ a%b", *EDGES]
    got = [r._quality for r in quality.quality(frame(spark, texts)).orderBy("doc_id").collect()]
    assert (got[0].n_words, got[0].word_chars, got[0].n_repeat_words) == (3, 11, 0)
    assert (got[1].n_dup_lines, got[1].n_lines) == (2, 4)
    assert got[2].n_repeat_words == 60 and got[2].base_failed and not got[2].kept
    assert got[3].n_symbols == 3
    assert got[4].n_words == got[5].n_words == got[6].n_words == 0 and not got[4].kept
    assert got[-1].n_repeat_words == 60_000
    assert quality.quality_filter(frame(spark, texts)).columns == frame(spark, []).columns


def repeat_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {x for x in windows if windows.count(x) > 1}
    return len({j for i, x in enumerate(windows) if x in seen for j in range(i, i + 3)})


def test_repeat_words_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in range(0, 60)]
    got = quality.quality(frame(spark, texts)).orderBy("doc_id").select("_quality.n_repeat_words").collect()
    assert [r[0] for r in got] == [repeat_words(t) for t in texts]


# Top k


@pytest.mark.parametrize("size", [3, 16, 4096])
def test_top_k_brute_force(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (0.1 + i % 7)]) for i in range(90)]
    rows += [(90, rows[5][1]), (91, rows[5][1]), (92, None), (93, [None] * 6), (94, [math.nan] * 6),
             (95, [math.inf] * 6), (96, [0.5, 0.25]), (97, []), (None, [1.0] * 6), (50, rows[3][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(vectors, F.col("vec_id") % 10 == 0, k=5, block_rows=size, query_rows=size)
    known = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (6 - len(v)))
        for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = []
    for q, v in known:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(8)
    near = 1e6 * (1 + 1e-7 * rng.normal(size=(300, 8)))  # scores that differ beyond 2**53
    far = rng.normal(size=(300, 8))
    far[3] = [0, 0, 0, 0, 0, 0, 0, 1e30]
    far[:, 7] = np.where(np.arange(300) == 3, 1e30, 0)  # zeros meet a component beyond a long
    for part in (near, far):
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(part)]
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
        want = []
        for q, v in whole[::50]:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=4)
        assert sorted(map(tuple, got.collect())) == want
    rows = [(i, [1e30]) for i in range(2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(vectors, F.col("vec_id") == 0).collect()
    bare = spark.createDataFrame([(i, []) for i in range(3)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(bare, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_top_k_meets_blocks_of_all_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    whole = np.array([[math.floor(256 * x) for x in v] for _, v in rows])
    scores = whole[::10] @ whole.T
    scores[np.arange(40), np.arange(0, 400, 10)] = -2**62
    want = [(10 * q, r + 1, int(i), int(scores[q, i])) for q in range(40)
            for r, i in enumerate(np.lexsort((np.arange(400), -scores[q]))[:5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = topk.top_k(vectors, F.col("vec_id") % 10 == 0, block_rows=8, query_rows=4)
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_top_k_broadcasts_no_vectors(spark):
    """Query blocks times candidate blocks are many times the file they come from."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, F.col("vec_id") % 10 == 0, block_rows=16, query_rows=4)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    above = []  # columns of the broadcasts that a line lies under
    for line in plan:
        at = len(line) - len(line.lstrip(" :+-"))
        above = [a for a in above if a < at]
        assert not above or "rows#" not in line, line
        above += [at] if "BroadcastExchange" in line else []


# Token files


@pytest.mark.parametrize("file, cutting", [("byte_bpe_50k.json", tokens.SPACED), ("word_bpe_49k.json", tokens.BARE)])
def test_pieces_encode_like_whole_texts(file, cutting, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    rng = np.random.default_rng(4)
    parts = [*"ab.,' \n!éß1_", "'s", "don't", "  ", " \n", "\n\n", "\t", "\xa0", "\u2003", "<|endoftext|>", "Ab",
             "日本", "e\u0301", "\u0301", " the", "\x00", "Σ", "İ", "$$$", ".\nThe "]
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 14, 3000)]
    path = public_tokenizers.path(file)
    whole = Tokenizer.from_file(path)
    encode = tokens.encoder(path, cutting)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], encode(texts[at : at + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_boundaries():
    rng = np.random.default_rng(5)
    for n in (1, 2, 300, 1500):
        for high in (2, 1000, 100_000):
            ends = np.cumsum(rng.integers(1, high, n))
            coded = tokenfile.Boundaries.encode(ends)
            assert coded.values().tolist() == ends.tolist()
            assert all(coded.select(i) == ends[i] for i in range(n))
            assert len(coded.high) * 8 <= 3 * n + 8


@pytest.mark.parametrize("segment", [1, 50, 1 << 20])
def test_token_files(spark, segment):
    path = tokenfile.new_path(spark)
    texts = [*EDGES, "one two", "three"]
    docs = frame(spark, texts).union(frame(spark, ["again"]))
    model = public_tokenizers.path("byte_bpe_50k.json")
    tokenfile.write(docs.repartition(3), path, model, segment_ids=segment)
    got = tokenfile.read(spark, path).orderBy("start").collect()
    whole = Tokenizer.from_file(model)
    at = 0
    assert [r.doc_id for r in got] == sorted([*range(len(texts)), 0])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        allowed = [whole.encode(t or "", add_special_tokens=False).ids + [0] for t in (texts[r.doc_id], "again")]
        assert ids in allowed and r.start == at and r.n_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
    empty = tokenfile.new_path(spark)
    tokenfile.write(docs.limit(0), empty, model)
    assert tokenfile.read(spark, empty).count() == 0


# SimHash


def simhash_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [*EDGES[:6], "The QUICK brown fox", "ÀB c d e", "a b", "a\x1fb c\u00a0d e f"]
    got = frame(spark, texts).select("doc_id", simhash.spelled(simhash.fingerprint("text")).alias("p")).collect()
    assert {r.doc_id: int(r.p, 16) for r in got} == {i: simhash_of(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("limit", [2, 2048])
def test_components_of_dense_groups(spark, limit):
    rng = np.random.default_rng(6)
    centers = rng.integers(0, 1 << 63, 3, dtype=np.int64).tolist()
    fps = set()
    for c in centers:
        for _ in range(150):
            x = c
            for b in rng.integers(0, 64, int(rng.integers(0, 4))):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= set(rng.integers(0, 1 << 63, 200, dtype=np.int64).tolist())
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.v: r.root for r in simhash.components(simhash.links(df, limit)).collect()}
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = np.array(signed, dtype="i8").view("u8")
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 2) + i + 1:
            a, b = root(signed[i]), root(signed[j])
            parent[max(a, b)] = min(a, b)
    ours, theirs = {}, {}
    for x in signed:
        ours.setdefault(got.get(x, x), set()).add(x)
        theirs.setdefault(root(x), set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_one_of_each(spark):
    rows = [(5, "a b c d"), (3, "A B c d"), (3, "A B c d"), (7, "other text of its own"), (None, "a b c d"),
            (None, None), (None, ""), (3, "something else with id three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or -1, (r.text or "").lower()) for r in simhash.one_of_each(docs).collect())
    assert kept == [(-1, ""), (3, "a b c d"), (3, "something else with id three"), (7, "other text of its own")]
    found = simhash.near_duplicates(docs.limit(0))
    assert found.count() == 0


def test_pipeline_drops_texts_alike_by_five_words(spark):
    rng = np.random.default_rng(11)
    texts, edits = [], [(60, 1), (200, 1), (200, 4), (500, 5), (500, 12), (2000, 20)]
    for n, changes in [*edits * 5, *[(300, 40)] * 5]:
        words = [f"w{i}" for i in rng.integers(0, 5000, n)]
        copy = list(words)
        for at in rng.choice(n, changes, replace=False):
            copy[at] = f"v{at}"
        texts += [" ".join(words), " ".join(copy)]
    # A chain of neighbours whose ends are not alike, and copies of one text beyond its letter case.
    words = [f"c{i}" for i in range(300)]
    texts += [" ".join(words[i * 20 : 200 + i * 20]) for i in range(5)]
    texts += [texts[0].upper(), None, "", "two words"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set()
            for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    heads = {i for i in range(len(texts)) if root(i) == i}
    assert len(texts) - len(heads) > 25
    kept = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, frame(spark, texts), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(heads)


# Language


def test_language(spark):
    rng = np.random.default_rng(7)
    words = {"aa": ["bana", "lomo", "tirra"], "bb": ["schrk", "pfftz", "grmwl"]}
    rows = [(i, " ".join(rng.choice(words[x], 20)), x) for i, x in enumerate(["aa", "bb"] * 60)]
    train = spark.createDataFrame([*rows, (500, None, "aa"), (501, "x y", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    asked = frame(spark, ["lomo bana", "pfftz schrk", None, "", "12 34 !!", "语言 文字 语言 文字", LONG, "LOMO! Tirra?"])
    got = [r.p for r in asked.select(langid.predicted(F.col("text"), model).alias("p"), "doc_id").orderBy("doc_id").collect()]
    assert [p.lang for p in got[:5]] == ["aa", "bb", "und", "und", "und"] and got[7].lang == "aa"
    assert not got[0].rejected and got[2].rejected and got[4].rejected and got[5].rejected
    assert all(0 <= p.score <= 1 for p in got)
    none = langid.fit(train.limit(0))
    assert asked.select(langid.predicted(F.col("text"), none).alias("p")).distinct().count() == 1


# Packing


def test_packing(spark):
    docs = frame(spark, [*EDGES, "one two three"] * 5)
    model = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed_documents(docs, model, capacity=500).toPandas()
    whole = Tokenizer.from_file(model)
    texts = {i: t for i, t in enumerate([*EDGES, "one two three"] * 5)}
    want = set()
    for i, t in texts.items():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 500):
            want.add((i, k // 500, k, len(ids[k : k + 500]), zlib.crc32(ids[k : k + 500].tobytes())))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert set(got[cols].itertuples(index=False, name=None)) == want and len(got) == len(want)
    got = got.sort_values(["sequence_id", "offset"])
    fill = got.groupby("sequence_id")["length"]
    assert (fill.cumsum() - got["length"] == got["offset"]).all() and fill.sum().max() <= 500
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / 500) + 1
    assert packing.packed_documents(docs.limit(0), model).count() == 0


def test_evolution_only_improves():
    rng = np.random.default_rng(8)
    lengths = sorted(map(int, rng.integers(20, 60, 200)), reverse=True)
    start = packing.Packing(lengths, 100).place(list(range(len(lengths))))
    best = packing.evolve(lengths, [start.genes()], 1, 100, generations=40)
    assert sorted(i for b in best.bins for i in b) == list(range(200))
    assert all(sum(lengths[i] for i in b) <= 100 for b in best.bins)
    assert best.fitness() >= start.fitness()
    again = packing.from_genes(best.genes(), lengths, 100)
    assert sorted(map(sorted, again.bins)) == sorted(map(sorted, best.bins))


# URL rules


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_url_rules_brute_force(spark, ranges):
    rng = np.random.default_rng(9)
    hosts = ["com", "a.com", "b.a.com", "x.org", "aa.com", "org", "a.b.c.d.org", "com.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/A/b?c", "/a#b"]
    rules = [(str(h), str(p), str(v)) for h, p, v in {
        (h, p): (h, p, v) for h, p, v in
        zip(rng.choice(hosts, 40), rng.choice(paths[:6], 40), rng.choice(["allow", "block"], 40))}.values()]
    urls = [f"http://{h}{p}" for h in [*hosts, "A.com", "q.net", "", ".com", "a..com"] for p in paths]
    urls += [None, "", "no-scheme.com/a", "http://", "x://com://a", "http://com/a"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urlrules.judge(pages, given, ranges=ranges).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert urlrules.judge(pages, given.limit(0)).filter("rule IS NOT NULL").count() == 0
    assert urlrules.judge(pages.limit(0), given).count() == 0



def test_pieces_are_found_once():
    class Merges:
        asked: list = []

        class Token:
            id = 7

        def tokenize(self, spelled):
            self.asked.append(spelled)
            return [self.Token]

    class Model:
        model = Merges()

        def get_vocab_size(self):
            return 9

    pieces = tokens.Pieces(Model(), tokens.SPACED, {" old": b"old"})
    found = [pieces[p] for p in (" ab", " ab", " old", " é", "x" * 65, "x" * 65)]
    seven = (7).to_bytes(4, "little")
    assert found == [seven, seven, b"old", seven, seven, seven]
    assert Merges.asked == ["Ġab", "ĠÃ©", "x" * 65, "x" * 65] and set(pieces) == {" ab", " old", " é"}


def test_pieces_are_forgotten():
    path = public_tokenizers.path("word_bpe_49k.json")
    first = tokens.encoder(path, tokens.BARE)(["some words"])
    tokens.forget_pieces()
    assert not [name for name in vars(sys.modules["_lineflow_held"]) if name.startswith("ids ")]
    assert tokens.encoder(path, tokens.BARE)(["some words"]) == first


def test_spelled_as_the_characters_of_all_bytes():
    for text in (" old", "".join(map(chr, range(0xD800))), "déjà vu"):
        assert tokens._spelled(text) == "".join(tokens._BYTES[b] for b in text.encode())
