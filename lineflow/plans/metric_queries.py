"""Metrics and statistics over an episode table derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineflow.operators import metrics, stats
from lineflow.plans.corpus_queries import _rounded
from lineflow.plans.views import table

EPISODE_SQL = """
    l_returnflag AS method, l_linenumber AS seed, 'val' AS split, CAST(l_partkey AS {text}) AS graph_id,
    l_linestatus AS project, CASE WHEN l_partkey % 4 = 0 THEN 'CWE-125' ELSE 'CWE-119' END AS cwe,
    CAST(5 + l_partkey % 120 AS INT) AS num_nodes, CAST(1 + l_partkey % 3 AS INT) AS num_vuln,
    CAST(l_partkey % 15 - 1 AS INT) AS dist_to_vuln,
    CAST(least(200, 4 * (5 + l_partkey % 120)) AS INT) AS max_steps,
    (CAST(l_quantity AS INT) + l_linenumber) % 3 <> 0 AS success,
    (CAST(l_quantity AS INT) + l_linenumber) % 3 <> 0 AND CAST(l_quantity AS INT) % 2 = 0 AS first_declare_correct,
    CAST(1 + l_suppkey % (5 + l_partkey % 120) AS INT) AS nodes_inspected,
    CAST(2 + l_suppkey % (5 + l_partkey % 120) AS INT) AS actions_taken,
    l_discount - l_tax AS cumulative_reward,
    CASE WHEN (CAST(l_quantity AS INT) + l_linenumber) % 3 <> 0 THEN 'correct'
         WHEN l_linenumber % 2 = 0 THEN 'timeout' ELSE 'wrong_declare' END AS end_reason
"""


def line_episodes(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    return spark.sql(f"SELECT {EPISODE_SQL.format(text='STRING')} FROM {{lineitem}}", lineitem=lineitem)


def episode_metrics(spark, sf):
    return _rounded(metrics.compute_metrics(line_episodes(spark, sf)))


def metrics_by_size(spark, sf):
    return _rounded(metrics.breakdown(line_episodes(spark, sf), "size_bucket"))


def metrics_by_distance(spark, sf):
    return _rounded(metrics.breakdown(line_episodes(spark, sf), "distance_bucket"))


def metrics_by_labels(spark, sf):
    return _rounded(metrics.breakdown(line_episodes(spark, sf), "vuln_bucket"))


def metrics_by_cwe(spark, sf):
    return _rounded(metrics.breakdown(line_episodes(spark, sf), "cwe"))


def all_breakdowns(spark, sf):
    sides = ("size_bucket", "distance_bucket", "vuln_bucket", "cwe")
    return _rounded(metrics.breakdowns(line_episodes(spark, sf), sides))


def metrics_across_seeds(spark, sf):
    return _rounded(metrics.metrics_across_seeds(line_episodes(spark, sf)))


def episode_summary(spark, sf):
    return _rounded(metrics.summarize(line_episodes(spark, sf)))


def end_reason_shares(spark, sf):
    return _rounded(metrics.end_shares(line_episodes(spark, sf), ["method"]))


def graph_means(spark, sf):
    # Means of a few episodes often end in a 5 at the seventh digit: keep more of them.
    return _rounded(stats.per_graph(line_episodes(spark, sf)), 10)


def paired_graphs(spark, sf):
    pairs = stats.paired(line_episodes(spark, sf), "A", "N")
    return _rounded(pairs.select("graph_id", "success_a", "success_b", "nodes_inspected_a", "nodes_inspected_b"), 10)


def mcnemar_success(spark, sf):
    return _rounded(stats.mcnemar_success(line_episodes(spark, sf), "A", "N"))


def signed_rank_parts(spark, sf):
    pairs = stats.paired(line_episodes(spark, sf), "A", "N")
    return _rounded(stats.signed_rank(pairs))


def wilcoxon_nodes_inspected(spark, sf):
    return _rounded(stats.wilcoxon_nodes_inspected(line_episodes(spark, sf), "A", "N"))


def signed_rank_tails(spark, sf):
    """Signed-rank tests of account balances against 5,000 by nation and segment: groups small
    enough for exact tails and larger ones."""
    pairs = table(spark, sf, "customer").select(
        "c_nationkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("nodes_inspected_a"), F.lit(5000.0).alias("nodes_inspected_b")
    )
    keys = ["c_nationkey", "c_mktsegment"]
    parts = stats.signed_rank_p(stats.signed_rank(pairs, by=keys))
    return _rounded(parts.select(*keys, "graphs", "nonzero", "tied", "statistic", "p_value"))


def interval_facts(spark, sf):
    """What the intervals of every method and metric stand on."""
    rows = stats.confidence_intervals(line_episodes(spark, sf), n_resamples=20)
    return _rounded(rows.withColumn("holds", (F.col("low") <= F.col("high"))).select("method", "metric", "mean", "graphs", "holds"))


def comparison_tests(spark, sf):
    """Both tests of every method against the reference, as in the comparison table."""
    means = stats.per_graph(line_episodes(spark, sf))
    solved = stats.mcnemar_against(means, "A").select("method_b", "graphs", F.col("p_value").alias("p_success"))
    nodes = stats.wilcoxon_against(means, "A").select("method_b", "statistic", F.col("p_value").alias("p_nodes"))
    return _rounded(solved.join(nodes, "method_b"))


def confidence_intervals(spark, sf):
    return stats.confidence_intervals(line_episodes(spark, sf))


def comparison_table(spark, sf):
    return stats.comparison_table(line_episodes(spark, sf), "A")


QUERIES = {
    f.__name__: f
    for f in (
        episode_metrics, metrics_by_size, metrics_by_distance, metrics_by_labels, metrics_by_cwe,
        all_breakdowns, metrics_across_seeds, episode_summary, end_reason_shares, graph_means,
        paired_graphs, mcnemar_success, signed_rank_parts, wilcoxon_nodes_inspected,
        confidence_intervals, comparison_table, signed_rank_tails, interval_facts, comparison_tests,
    )
}

# --- the same in SQL ----------------------------------------------------------------------

_EP = f"""WITH ep AS (SELECT {EPISODE_SQL.format(text="VARCHAR")} FROM lineitem),
b AS (SELECT *,
  CASE WHEN num_nodes <= 20 THEN '<=20' WHEN num_nodes <= 50 THEN '21-50' WHEN num_nodes <= 100 THEN '51-100' ELSE '>100' END AS size_bucket,
  CASE WHEN dist_to_vuln <= 2 THEN '1-2' WHEN dist_to_vuln <= 5 THEN '3-5' WHEN dist_to_vuln <= 10 THEN '6-10' ELSE '>10' END AS distance_bucket,
  CASE WHEN num_vuln > 1 THEN 'multiple' ELSE 'single' END AS vuln_bucket,
  CASE WHEN success THEN nodes_inspected ELSE num_nodes END AS nodes_all,
  CASE WHEN success THEN actions_taken ELSE max_steps END AS steps_all FROM ep)"""


def metric_sql(digits: bool = True) -> str:
    cells = {
        "localization_accuracy": "avg(CAST(first_declare_correct AS INT))",
        "success_rate": "avg(CAST(success AS INT))",
        "nodes_inspected_success": "avg(nodes_inspected) FILTER (success)",
        "nodes_inspected_all": "avg(nodes_all)",
        "actions_success": "avg(actions_taken) FILTER (success)",
        "actions_all": "avg(steps_all)",
        "normalised_cost": "avg(nodes_all / num_nodes)",
        "cumulative_reward": "CAST(sum(CAST(cumulative_reward AS DECIMAL(20, 10))) AS DOUBLE) / count(*)",
        "path_efficiency": "avg((actions_taken - 1) / dist_to_vuln) FILTER (success AND dist_to_vuln > 0)",
    }
    wrap = (lambda c: f"round({c}, 6)") if digits else (lambda c: c)
    return "count(*) AS episodes, " + ", ".join(f"{wrap(c)} AS {n}" for n, c in cells.items())


def _by(*keys: str) -> str:
    return f"{_EP} SELECT {', '.join(keys)}, {metric_sql()} FROM b GROUP BY {', '.join(keys)}"


_GRAPH = """, pg AS (SELECT method, graph_id, avg(CAST(success AS INT)) AS success,
  avg(CAST(first_declare_correct AS INT)) AS localization_accuracy, avg(nodes_all) AS nodes_inspected,
  avg(steps_all) AS actions_taken, avg(nodes_all / num_nodes) AS normalised_cost,
  avg(cumulative_reward) AS cumulative_reward FROM b GROUP BY ALL),
pr AS (SELECT x.graph_id, x.success AS success_a, y.success AS success_b, x.nodes_inspected AS nodes_inspected_a,
  y.nodes_inspected AS nodes_inspected_b FROM pg x JOIN pg y USING (graph_id) WHERE x.method = 'A' AND y.method = 'N')"""

ORACLE = {
    "episode_metrics": _by("method"),
    "metrics_by_size": _by("size_bucket", "method"),
    "metrics_by_distance": _by("distance_bucket", "method"),
    "metrics_by_labels": _by("vuln_bucket", "method"),
    "metrics_by_cwe": _by("cwe", "method"),
    "all_breakdowns": f"""{_EP}, s AS (
        SELECT 'size_bucket' AS breakdown, size_bucket AS bucket, * FROM b UNION ALL
        SELECT 'distance_bucket', distance_bucket, * FROM b UNION ALL
        SELECT 'vuln_bucket', vuln_bucket, * FROM b UNION ALL SELECT 'cwe', cwe, * FROM b)
        SELECT breakdown, bucket, method, {metric_sql()} FROM s GROUP BY ALL""",
    "metrics_across_seeds": f"""{_EP}, m AS (SELECT method, seed, {metric_sql(False)} FROM b GROUP BY method, seed)
        SELECT method, count(DISTINCT seed) AS seeds, """
    + ", ".join(f"round(avg({n}), 6) AS {n}_mean, round(stddev_pop({n}), 6) AS {n}_std" for n in metrics.METRIC_COLUMNS[1:])
    + " FROM m GROUP BY method",
    "episode_summary": f"""{_EP} SELECT count(*) AS episodes, round(avg(CAST(success AS INT)), 6) AS success_rate,
        round(avg(nodes_inspected), 6) AS nodes_inspected, round(avg(actions_taken), 6) AS actions_taken,
        round(CAST(sum(CAST(cumulative_reward AS DECIMAL(20, 10))) AS DOUBLE) / count(*), 6) AS cumulative_reward FROM b""",
    "end_reason_shares": f"""{_EP} SELECT method, end_reason, round(count(*) / sum(count(*)) OVER (PARTITION BY method), 6) AS share
        FROM b GROUP BY method, end_reason""",
    "graph_means": f"""{_EP}{_GRAPH} SELECT method, graph_id, """
    + ", ".join(f"round({m}, 10) AS {m}" for m in stats.GRAPH_METRICS) + " FROM pg",
    "paired_graphs": f"""{_EP}{_GRAPH} SELECT graph_id, round(success_a, 10) AS success_a, round(success_b, 10) AS success_b,
        round(nodes_inspected_a, 10) AS nodes_inspected_a, round(nodes_inspected_b, 10) AS nodes_inspected_b FROM pr""",
    "mcnemar_success": f"""{_EP}{_GRAPH}, c AS (SELECT count(*) AS graphs,
        count(*) FILTER (success_a >= 0.5 AND success_b < 0.5) AS a_only,
        count(*) FILTER (success_b >= 0.5 AND success_a < 0.5) AS b_only FROM pr)
        SELECT 'A' AS method_a, 'N' AS method_b, graphs, a_only, b_only, round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0,
          (SELECT 2 * sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2)))
           FROM range(least(a_only, b_only) + 1) r(i))) END, 6) AS p_value FROM c""",
    "signed_rank_parts": f"""{_EP}{_GRAPH}, d AS (SELECT round(nodes_inspected_a - nodes_inspected_b, 9) AS d FROM pr),
        r AS (SELECT d, rank() OVER (ORDER BY abs(d)) AS lo, count(*) OVER (PARTITION BY abs(d)) AS n FROM d WHERE d <> 0)
        SELECT round(coalesce((SELECT sum(lo + (n - 1) / 2) FROM r WHERE d > 0), 0), 6) AS w_plus,
          round(coalesce((SELECT sum(lo + (n - 1) / 2) FROM r WHERE d < 0), 0), 6) AS w_minus,
          (SELECT count(*) FROM r) AS nonzero,
          round(coalesce((SELECT sum(CAST(n AS DOUBLE) * n - 1) FROM r), 0), 6) AS ties,
          (SELECT count(DISTINCT abs(d)) FROM r WHERE n > 1) AS tied,
          count(*) AS graphs, round(median(d), 6) AS median_difference, round(avg(d), 6) AS mean_difference,
          count(*) FILTER (d = 0) AS zeros FROM d""",
}


def _sql_p(statistic: str, n: str, ties: str, exact: str) -> str:
    """Two-sided p-value: signs counted by rank sum, or the normal tail as series and fraction."""
    x = f"(abs(({statistic} - {n} * ({n} + 1) / 4.0) / sqrt({n} * ({n} + 1.0) * (2 * {n} + 1) / 24.0 - {ties} / 48.0)) / sqrt(2.0))"
    ways = (
        f"list_sum(list_reduce(range(1, {n} + 1), lambda w, r: list_transform(range(1, len(w) + 1),"
        " lambda s: w[s] + CASE WHEN s > r THEN w[s - r] ELSE 0 END),"
        f" list_transform(range(CAST(floor({statistic}) AS BIGINT) + 1), lambda s: CASE WHEN s = 0 THEN CAST(1 AS BIGINT) ELSE 0 END)))"
    )
    series = (
        f"list_sum(list_transform(range(0, 81), lambda k: {x} * exp(k * ln(2.0 * {x} * {x})"
        " - list_sum(list_transform(range(0, k + 1), lambda i: ln(2 * i + 1.0))))))"
    )
    fraction = f"list_reduce(list_transform(range(80, 0, -1), lambda k: CAST(k AS DOUBLE)), lambda t, k: {x} + k / 2.0 / t, {x})"
    return (
        f"CASE WHEN {n} = 0 THEN 1.0 WHEN {exact} THEN least(1.0, 2.0 * {ways} / pow(2.0, {n}))"
        f" WHEN {x} = 0 THEN 1.0 WHEN {x} < 2.5 THEN 1.0 - 2.0 / sqrt(pi()) * exp(-{x} * {x}) * {series}"
        f" ELSE exp(-{x} * {x}) / (sqrt(pi()) * {fraction}) END"
    )


def _ranked(by: str, source: str) -> str:
    """Parts of the signed-rank tests of ``source(by, d)``."""
    return f"""ranks AS (SELECT {by}, d, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) AS lo, count(*) OVER (PARTITION BY {by}, abs(d)) AS n FROM {source} WHERE d <> 0),
sr AS (SELECT {by}, least(coalesce(sum(lo + (n - 1) / 2) FILTER (d > 0), 0), coalesce(sum(lo + (n - 1) / 2) FILTER (d < 0), 0)) AS statistic,
  count(*) AS nonzero, sum(CAST(n AS DOUBLE) * n - 1) AS ties, count(DISTINCT abs(d)) FILTER (n > 1) AS tied FROM ranks GROUP BY {by}),
whole AS (SELECT {by}, count(*) AS graphs, count(*) FILTER (d = 0) AS zeros, median(d) AS median_difference, avg(d) AS mean_difference FROM {source} GROUP BY {by}),
tests AS MATERIALIZED (SELECT * EXCLUDE (statistic, nonzero, ties, tied), coalesce(statistic, 0) AS statistic, coalesce(nonzero, 0) AS nonzero, coalesce(ties, 0) AS ties, coalesce(tied, 0) AS tied
  FROM whole LEFT JOIN sr USING ({by}))"""


_P = "round(" + _sql_p("statistic", "nonzero", "ties", f"nonzero <= {stats.EXACT_PAIRS} AND tied = 0 AND zeros = 0") + ", 6)"
_AGAINST = f"""{_EP}{_GRAPH}, dif AS (SELECT y.method, round(x.nodes_inspected - y.nodes_inspected, 9) AS d, x.success AS sa, y.success AS sb
  FROM pg x JOIN pg y ON x.method = 'A' AND y.method <> 'A' AND y.graph_id = x.graph_id), """ + _ranked("method", "dif")
ORACLE["wilcoxon_nodes_inspected"] = (
    f"{_AGAINST} SELECT 'A' AS method_a, method AS method_b, graphs, round(median_difference, 6) AS median_difference,"
    f" round(mean_difference, 6) AS mean_difference, round(statistic, 6) AS statistic, {_P} AS p_value FROM tests WHERE method = 'N'"
)
ORACLE["signed_rank_tails"] = (
    "WITH bal AS (SELECT c_nationkey, c_mktsegment, round(CAST(c_acctbal AS DOUBLE) - 5000.0, 9) AS d FROM customer), "
    + _ranked("c_nationkey, c_mktsegment", "bal")
    + f" SELECT c_nationkey, c_mktsegment, graphs, nonzero, tied, round(statistic, 6) AS statistic, {_P} AS p_value FROM tests"
)
ORACLE["comparison_tests"] = f"""{_AGAINST}, disc AS (SELECT method, count(*) FILTER (sa >= 0.5 AND sb < 0.5) AS a_only, count(*) FILTER (sb >= 0.5 AND sa < 0.5) AS b_only FROM dif GROUP BY method)
  SELECT method AS method_b, graphs, round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, (SELECT 2 * sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1)
    - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))) FROM range(least(a_only, b_only) + 1) r(i))) END, 6) AS p_success,
    round(statistic, 6) AS statistic, {_P} AS p_nodes FROM tests JOIN disc USING (method)"""
ORACLE["interval_facts"] = f"{_EP}{_GRAPH} " + " UNION ALL ".join(
    f"SELECT method, '{m}' AS metric, round(avg({m}), 6) AS mean, count({m}) AS graphs, true AS holds FROM pg GROUP BY method" for m in stats.GRAPH_METRICS
)
