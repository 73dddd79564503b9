"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.llm import (
    bpe, langid, negatives, packing, pii, quality, resample, simhash, sql, tokenfile, topk, toxicity, urlrules, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int) -> Column:
    """The fold a document belongs to, from its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op6_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.new_path(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenfile.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read(spark, path, ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.spelled(F.col("fp")).alias("fingerprint"), "component_id")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("_pii", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k.name))).cast("long").alias(f"n_{k.name}")
        for k in pii.KINDS
    ]
    return docs.select(
        "doc_id", *counts,
        F.sha2(pii.listed(pii.base_only(F.col("_pii"))), 256).alias("base_sha256"),
        pii.listed(F.col("_pii")).alias("spans"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN, back=True)
    return ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    model = toxicity.fit(docs, labels)
    scored = docs.withColumn("score", toxicity.score(F.col("text"), model))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select("doc_id", "_quality.*").drop("n_lines")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    model = langid.fit(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    found = docs.withColumn("_lang", langid.predicted(F.col("text"), model))
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("_lang.lang").alias("lang_pred"),
        "_lang.score", "_lang.rejected",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


#: Host, path and verdict of the rules that ``op10_url_rules`` judges by.
URL_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlrules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = resample.scores(docs, _table(spark, sf_dir, "benchmark").select("text"))
    return resample.drawn(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_path(spark)
    warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_top_k": op5_top_k,
    "op6_tokenfile": op6_tokenfile,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_url_rules": op10_url_rules,
    "op11_negatives": op11_negatives,
    "op12_resample": op12_resample,
    "op13_warc": op13_warc,
}

ORACLE = {
    "op1_pii": sql.OP1,
    "op4_quality": sql.OP4,
    "op5_top_k": sql.OP5,
    "op10_url_rules": sql.OP10,
    "op11_negatives": sql.OP11,
    "op13_warc": sql.OP13,
}
