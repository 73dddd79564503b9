"""Projections, the classifier and run bookkeeping over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineflow.operators import metrics
from lineflow.operators.classifier import NodeClassifier
from lineflow.operators.embeddings import fit_projection, project, statement_texts
from lineflow.operators.ranking import top_k_accuracy
from lineflow.operators.split import split_by_commit
from lineflow.plans.corpus_queries import SQL_CORPUS, _rounded
from lineflow.plans.graph_queries import graph_sql
from lineflow.plans.views import PROSE_LEXICON, corpus, graphs, table
from lineflow.session import written_once
from lineflow.sources.files import attach_background, collect_runs


def embedding_projection(spark, sf):
    """Vectors projected to eight squashed components; means by label."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    model = fit_projection(vectors, 8)
    rows = project(vectors, model).select("label", F.posexplode("reduced").alias("component", "v"))
    return rows.groupBy("label", "component").agg(F.count("*").alias("vectors"), F.avg("v").alias("mean"))


def distinct_statements(spark, sf):
    """Texts an encoder would see once, and how often each occurs."""
    rows = statement_texts(graphs(spark, sf))
    return rows.groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count("*").alias("uses"))


def classifier_top_k(spark, sf):
    """Ranking quality of a perceptron on held-out commits."""
    rows = written_once(spark, f"split:{sf}", lambda: split_by_commit(graphs(spark, sf)))
    parts = {s: rows.filter(F.col("split") == s) for s in ("train", "val", "test")}
    model = NodeClassifier(hidden=16, iterations=(25,)).fit(parts["train"], parts["val"], lexicon=PROSE_LEXICON)
    return top_k_accuracy(model.scores(parts["test"], lexicon=PROSE_LEXICON))


def function_background(spark, sf):
    """Release facts of every function, found by its row position."""
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ordinal"),
        F.when(F.col("lang") != "es", F.concat(F.lit("CVE-"), F.col("n_chars").cast("string"))).alias("CVE ID"),
        F.lit(None).cast("string").alias("CVE Page"), F.col("text").alias("commit_message"),
        F.col("source").alias("codeLink"),
    )
    facts = attach_background(corpus(spark, sf), raw)
    return facts.select(
        "sample_id", "cve", "cve_url", "commit_url",
        F.md5(F.col("commit_message").cast("binary")).alias("message_md5"),
    )


def _runs(spark, sf):
    cents = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 7).alias("seed"),
        (cents / 600000).alias("success_rate"), (cents / 700000).alias("localization_accuracy"),
        (cents / 800000).alias("train_success"), (cents / 90000).alias("nodes_inspected_success"),
        (cents / 10000).alias("actions_success"), (cents / -1000000).alias("cumulative_reward"),
    )


def run_collection(spark, sf):
    return _rounded(collect_runs(_runs(spark, sf)))


def best_evaluations(spark, sf):
    """The best evaluation of each arm: most success, then fewest nodes, then the earliest."""
    history = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("arm"), F.col("o_orderkey").alias("step"),
        F.floor(F.col("o_totalprice") / 10000).alias("success_rate"),
        (F.col("o_custkey") % 1000).alias("nodes_inspected"),
    )
    return metrics.best_evaluation(history, ["arm"], "step").select("arm", "step", "success_rate", "nodes_inspected")


QUERIES = {
    f.__name__: f
    for f in (
        embedding_projection, distinct_statements, classifier_top_k, function_background, run_collection,
        best_evaluations,
    )
}

ORACLE = {
    "distinct_statements": graph_sql(
        "SELECT md5(CASE WHEN kind IN ('ENTRY', 'EXIT') OR code = '' THEN kind ELSE code END) AS text_md5, count(*) AS uses FROM node GROUP BY 1"
    ),
    "function_background": f"""WITH {SQL_CORPUS} SELECT c.sample_id, CASE WHEN d.lang <> 'es' THEN 'CVE-' || d.n_chars ELSE '' END AS cve,
        '' AS cve_url, d.source AS commit_url, md5(substr(trim(d.text), 1, 700)) AS message_md5
        FROM corpus c JOIN documents d ON d.doc_id = c.ordinal""",
    "run_collection": """WITH r AS (SELECT o_orderpriority AS arm, o_custkey % 7 AS seed, o_totalprice AS c FROM orders)
        SELECT arm, count(DISTINCT seed) AS seeds, round(avg(c / 600000), 6) AS success_rate, round(stddev_pop(c / 600000), 6) AS success_std,
          round(avg(c / 700000), 6) AS localization_accuracy, round(avg(c / 800000), 6) AS train_success,
          round(avg(c / 90000), 6) AS nodes_inspected_success, round(avg(c / 10000), 6) AS actions_success,
          round(avg(c / -1000000), 6) AS cumulative_reward FROM r GROUP BY arm""",
    "best_evaluations": """SELECT arm, step, success_rate, nodes_inspected FROM (
        SELECT o_orderpriority AS arm, o_orderkey AS step, CAST(floor(o_totalprice / 10000) AS BIGINT) AS success_rate, o_custkey % 1000 AS nodes_inspected,
          row_number() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 10000) DESC, o_custkey % 1000, o_orderkey) AS r FROM orders) WHERE r = 1""",
}
