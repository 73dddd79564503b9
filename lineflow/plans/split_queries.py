"""Commit splits of the graphs of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineflow.operators import split
from lineflow.plans.graph_queries import graph_sql
from lineflow.plans.views import graphs
from lineflow.session import written_once


def _split(spark, sf):
    return written_once(spark, f"split:{sf}", lambda: split.split_by_commit(graphs(spark, sf)))


def commit_strata(spark, sf):
    return split.commits(graphs(spark, sf))


def split_by_commit(spark, sf):
    return _split(spark, sf).select("sample_id", "split")


def split_leaks(spark, sf):
    """Commits and bodies found in two splits: none."""
    return split.leaks(_split(spark, sf))


def random_split_leaks(spark, sf):
    """The leaks a split by function id would have."""
    rows = graphs(spark, sf)
    third = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")),
                         (F.conv(F.substring(F.md5(F.col("sample_id").cast("binary")), 1, 2), 16, 10).cast("int") % 3) + 1)
    return split.leaks(rows.withColumn("split", third))


def split_summary(spark, sf):
    rows = split.split_summary(_split(spark, sf))
    return rows.select("split", "graphs", "share", "commits", F.to_json("by_cwe").alias("by_cwe"))


QUERIES = {
    f.__name__: f
    for f in (commit_strata, split_by_commit, split_leaks, random_split_leaks, split_summary)
}

_COMMITS = """,
member AS MATERIALIZED (SELECT k.ordinal, k.sample_id, c.commit_id AS key, c.cwe FROM kept k JOIN corpus c USING (ordinal)),
percwe AS (SELECT key, cwe, count(*) AS n, min(sample_id) AS first FROM member GROUP BY ALL),
commit AS MATERIALIZED (
  SELECT key, cwe AS stratum, size FROM (SELECT *, sum(n) OVER (PARTITION BY key) AS size,
    row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS r FROM percwe) WHERE r = 1)
"""
# The deal, literally: one commit after the other within its stratum.
_DEAL = _COMMITS + """,
queue AS MATERIALIZED (
  SELECT key, stratum, size, row_number() OVER (PARTITION BY stratum ORDER BY size DESC, md5('0:' || key), key) AS pos,
         sum(size) OVER (PARTITION BY stratum) AS total FROM commit),
dealt AS (
  SELECT stratum, CAST(0 AS BIGINT) AS pos, CAST('' AS VARCHAR) AS key, CAST('' AS VARCHAR) AS split,
         CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c FROM (SELECT DISTINCT stratum FROM queue)
  UNION ALL
  SELECT stratum, pos, key, split, a + CASE split WHEN 'train' THEN size ELSE 0 END,
         b + CASE split WHEN 'val' THEN size ELSE 0 END, c + CASE split WHEN 'test' THEN size ELSE 0 END
  FROM (SELECT q.stratum, q.pos, q.key, q.size, d.a, d.b, d.c,
          CASE WHEN 0.8::DOUBLE * total - a >= 0.1::DOUBLE * total - b AND 0.8::DOUBLE * total - a >= 0.1::DOUBLE * total - c THEN 'train'
               WHEN 0.1::DOUBLE * total - b >= 0.1::DOUBLE * total - c THEN 'val' ELSE 'test' END AS split
        FROM dealt d JOIN queue q ON q.stratum = d.stratum AND q.pos = d.pos + 1)),
home AS MATERIALIZED (SELECT m.sample_id, m.cwe, m.key, d.split FROM member m JOIN dealt d ON d.key = m.key AND d.pos > 0)
"""

ORACLE = {
    "split_summary": graph_sql(
        "SELECT split, count(*) AS graphs, round_even(count(*) / (SELECT count(*) FROM home), 4) AS share,"
        " count(DISTINCT key) AS commits, (SELECT '{' || string_agg('\"' || cwe || '\":' || n, ',' ORDER BY cwe) || '}'"
        " FROM (SELECT cwe, count(*) AS n FROM home i WHERE i.split = h.split GROUP BY cwe)) AS by_cwe"
        " FROM home h GROUP BY split", _DEAL
    ),
    "commit_strata": graph_sql("SELECT key, stratum, CAST(size AS BIGINT) AS size FROM commit", _COMMITS),
    "split_by_commit": graph_sql("SELECT sample_id, split FROM home", _DEAL),
    "split_leaks": graph_sql(
        "SELECT 'commit' AS kind, key, min(split) || ',' || max(split) AS splits FROM home GROUP BY key HAVING min(split) <> max(split)", _DEAL
    ),
    "random_split_leaks": graph_sql(
        "SELECT 'commit' AS kind, key, min(s) || ',' || max(s) AS splits FROM (SELECT key, ['train', 'val', 'test'][CAST('0x' || substr(md5(sample_id), 1, 2) AS INTEGER) % 3 + 1] AS s FROM member)"
        " GROUP BY key HAVING min(s) <> max(s)", _COMMITS,
    ),
}
