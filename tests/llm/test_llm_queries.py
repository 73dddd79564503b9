"""Operator queries without SQL, and the pipeline, against brute force over whole small tables."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lineflow.llm import bpe, queries
from test_operators import simhash_of

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()


def test_op2(spark, docs):
    model = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in queries.op2_bpe(spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(model.encode_ordinary(d.text or ""), dtype="<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_op3_and_op8(spark, docs):
    fold = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) for d in docs}
    toxic = queries.op3_toxicity(spark, SF_DIR).collect()
    assert len(toxic) == len(docs) and all(r.held_out == (fold[r.doc_id] % 5 == 0) for r in toxic)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in toxic)
    lang = {d.doc_id: d.lang for d in docs}
    found = queries.op8_language(spark, SF_DIR).collect()
    assert len(found) == len(docs) and all(r.held_out == (fold[r.doc_id] % 3 == 1) for r in found)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in found if r.held_out]) > 0.97


def test_op6(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op6_tokenfile(spark, SF_DIR).collect()}
    start = 0
    for d in docs:
        ids = np.array([*whole.encode(d.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op7(spark, docs):
    got = {r.doc_id: r for r in queries.op7_simhash(spark, SF_DIR).collect()}
    prints = {d.doc_id: simhash_of(d.text) for d in docs}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    names = sorted(prints)
    for k, i in enumerate(names):
        for j in names[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in names}


def test_op9(spark, docs):
    got = queries.op9_packing(spark, SF_DIR).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096
    assert got["length"].sum() / 4096 / got["sequence_id"].nunique() > 0.9
    assert set(got["doc_id"]) == {d.doc_id for d in docs}


def test_pipeline_stages(spark, docs):
    stages, frame = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {}
    for name in ("language", "quality", "near-duplicates", "personal data"):
        before = frame
        frame = stages[name](spark, frame, SF_DIR)
        assert frame.columns == before.columns
        texts[name] = {r.doc_id: r.text for r in frame.collect()}
    assert set(texts["quality"]) <= set(texts["language"])
    prints = {i: simhash_of(t) for i, t in texts["quality"].items()}
    heads = set()
    for i in sorted(prints):  # every dropped document has a near copy, transitively, that stays
        if not any((prints[i] ^ prints[j]).bit_count() <= 2 for j in prints if j < i):
            heads.add(i)
    assert set(texts["near-duplicates"]) <= heads and set(texts["personal data"]) == set(texts["near-duplicates"])
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts["personal data"])


def test_languages_are_predicted_once_and_columns_stay(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("_lang", F.lit("mine")).withColumn("found", F.lit(1))
    kept = corpus_pipeline.keep_languages(spark, frame, SF_DIR)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert kept.columns == frame.columns and {(r._lang, r.found) for r in kept.select("_lang", "found").collect()} == {("mine", 1)}
