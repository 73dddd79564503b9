"""Graph-building and graph queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineflow.functions import graph
from lineflow.functions import lexical as lx
from lineflow.operators import build, embeddings, features, ranking, rewrite, traces
from lineflow.operators import graphs as records
from lineflow.plans.corpus_queries import S_CLASS, S_TRIVIAL, SQL_CORPUS, _rounded
from lineflow.plans.views import (
    PROSE_LEXICON, candidates, graphs, methods, parsed, scored_graphs,
)
from lineflow.schema import GRAPH_JSON_DDL
from lineflow.session import written_once
from lineflow.sources import records as jsonl

def _joined(column):
    return F.array_join(column, "|")


def method_selection(spark, sf):
    """The parse chosen for every function."""
    return build.select_methods(methods(spark, sf)).select(
        "sample_id", F.col("method.file").alias("file"), F.col("method.name").alias("name"),
        F.size("method.nodes").alias("flow_nodes"), F.size("method.edges").alias("flow_edges"),
    )


def _line_graphs(spark, sf):
    return build.line_graphs(parsed(spark, sf)).filter("nodes IS NOT NULL")


def line_graph_nodes(spark, sf):
    """Contracted nodes with kind, text, calls and operators."""
    return _line_graphs(spark, sf).select("sample_id", F.inline("nodes")).select(
        "sample_id", "id", "line", "kind", F.md5(F.col("code").cast("binary")).alias("code_md5"),
        "depth", _joined("calls").alias("calls"), _joined("ops").alias("ops"),
    )


def line_graph_edges(spark, sf):
    return _line_graphs(spark, sf).select("sample_id", F.inline("edges"))


def line_coverage(spark, sf):
    return _line_graphs(spark, sf).select("sample_id", F.round("coverage", 6).alias("coverage"))


def flaw_alignment(spark, sf):
    """Labels of every contracted function before any drop."""
    aligned = build.align_flaw_lines(_line_graphs(spark, sf))
    return aligned.select(
        "sample_id", _joined(F.col("vuln_nodes").cast("array<string>")).alias("vuln_nodes"),
        "mapped", "unmapped", "align_reason",
    )


def build_attrition(spark, sf):
    return build.build_attrition(candidates(spark, sf))


def build_reasons(spark, sf):
    return build.build_reasons(candidates(spark, sf))


def graph_edges(spark, sf):
    """Edges of the finished records, dispatch chains included."""
    return graphs(spark, sf).select("sample_id", F.inline("edges"))


def graph_nodes(spark, sf):
    return graphs(spark, sf).select("sample_id", F.inline("nodes")).select(
        "sample_id", "id", "line", "kind", "depth", "in_loop",
        F.md5(F.col("code").cast("binary")).alias("code_md5"),
    )


def successor_slots(spark, sf):
    """Slot number of every edge in its node's action space, and whether it closes a loop."""
    return records.edge_list(graphs(spark, sf)).select("sample_id", "u", "v", "slot")


def back_edges(spark, sf):
    return graphs(spark, sf).select("sample_id", F.inline("back_edges"))


def graph_metadata(spark, sf):
    return records.graph_metadata(graphs(spark, sf))


def distance_to_vulnerable(spark, sf):
    rows = records.distance_to_vulnerable(graphs(spark, sf))
    return rows.select("sample_id", F.posexplode("distance").alias("id", "distance"))


def out_degree_table(spark, sf):
    return _rounded(records.out_degree_table(graphs(spark, sf)))


def smallest_k(spark, sf):
    return records.smallest_k(records.out_degree_table(graphs(spark, sf)))


def graph_distributions(spark, sf):
    measures = records.graph_measures(graphs(spark, sf))
    return _rounded(records.distribution(measures, measures.columns))


def graph_counts(spark, sf):
    return records.graph_counts(graphs(spark, sf))


def record_violations(spark, sf):
    """Structural rules broken by records whose edges are read back to front."""
    flipped = F.transform("edges", lambda e: F.struct(e["v"].alias("u"), e["u"].alias("v")))
    rows = records.with_violations(graphs(spark, sf).withColumn("edges", flipped))
    return rows.select("sample_id", F.array_join("violations", "|").alias("violations"))


def shuffled_labels(spark, sf):
    rows = rewrite.shuffle_labels(graphs(spark, sf), seed=7)
    return rows.select("sample_id", _joined(F.col("vuln_nodes").cast("array<string>")).alias("vuln_nodes"))


def permuted_edges(spark, sf):
    return rewrite.permute_node_ids(graphs(spark, sf), seed=7).select("sample_id", F.inline("edges"))


def lexical_flags(spark, sf):
    rows = features.with_lexical(graphs(spark, sf), PROSE_LEXICON)
    flat = rows.select("sample_id", F.posexplode("lexical").alias("id", "f"))
    return _rounded(flat.select("sample_id", "id", "f.*"))


def heuristic_score(spark, sf):
    rows = scored_graphs(spark, sf).select("sample_id", F.posexplode("score").alias("id", "score"))
    return _rounded(rows)


def structural_features(spark, sf):
    """All of Tier S per node: kind, degrees, depth, cycle membership, loop headers, relative line."""
    names = features.TIER_S_NAMES
    rows = features.featurize(graphs(spark, sf), "S").select("sample_id", F.posexplode("x").alias("id", "x"))
    return rows.select(
        "sample_id", "id",
        *[
            F.round(F.get(F.col("x"), F.lit(features.TIER_S_NAMES.index(n))).cast("double"), 5).alias(n)
            for n in names
        ],
    )


def full_features(spark, sf):
    """Column means of the 30-wide Tier L matrix."""
    rows = features.featurize(graphs(spark, sf), "L", PROSE_LEXICON).select(F.explode("x").alias("x"))
    return rows.agg(
        F.count("*").alias("nodes"),
        *[F.avg(F.get(F.col("x"), F.lit(i))).alias(n) for i, n in enumerate(features.TIER_L_NAMES)],
    )


def top_k_accuracy(spark, sf):
    return _rounded(ranking.top_k_accuracy(scored_graphs(spark, sf)))


def chance_top_k(spark, sf):
    return _rounded(ranking.chance_top_k(graphs(spark, sf)))


def feature_ceiling(spark, sf):
    rows = features.with_lexical(graphs(spark, sf), PROSE_LEXICON)
    flags = F.filter(
        F.zip_with("nodes", "lexical", lambda n, f: F.when(graph.is_statement(n["kind"]), f["dangerous_call"] > 0)),
        lambda f: f.isNotNull(),
    )
    return _rounded(ranking.feature_ceiling(rows.select(graph.settled(flags).alias("flags")), 0.9, 0.1))


def sampled_graphs(spark, sf):
    """Forty graphs of at most sixty nodes, drawn uniformly."""
    return records.sample_graphs(graphs(spark, sf), 40, seed=3, max_nodes=60).select("sample_id")


def graph_width(spark, sf):
    """Graphs wider than three slots before any chain, and graphs at the step cap."""
    return records.wide_graphs(_line_graphs(spark, sf), 3)


def node_labels(spark, sf):
    """Display labels: line and collapsed code, cut to width."""
    shown = F.transform("nodes", lambda n: F.struct(n["id"].alias("id"), traces.node_label(n).alias("label")))
    return graphs(spark, sf).select("sample_id", F.inline(shown))


def json_records(spark, sf):
    """Records written as JSON text and parsed back: none may change."""
    rows = graphs(spark, sf)
    texts = jsonl.graph_json(rows)
    parsed = texts.select("sample_id", F.from_json("json", GRAPH_JSON_DDL).alias("r"))
    def joined(parts, by):
        return F.array_join(parts.cast("array<string>"), by)

    nodes = F.transform(F.array_sort("r.nodes"), lambda n: F.concat_ws(
        ":", n["id"].cast("string"), n["line"].cast("string"), n["kind"], n["code"], joined(n["calls"], "|"), joined(n["ops"], "|")
    ))
    edges = F.transform(F.array_sort("r.edges"), lambda e: joined(e, "-"))
    content = F.concat_ws("#", "r.project", "r.cwe", joined(nodes, "#"), joined(edges, ","), joined(F.array_sort("r.vuln_nodes"), ","))
    return parsed.select(
        "sample_id", F.size("r.nodes").alias("nodes"), F.size("r.edges").alias("edges"), F.size("r.vuln_nodes").alias("labels"),
        F.sha1(F.encode(content, "UTF-8")).alias("content_sha1"),
    )


def _letter_vectors():
    """A stand-in for a text encoder: letter frequencies."""

    def encode(batch):
        letters = "abcdefghijklmnopqrstuvwxyz0123456789.,;:!?*/<>=+-()[]{}"
        return [[text.lower().count(c) / (len(text) + 1) for c in letters] for text in batch]

    return encode


def embedded_features(spark, sf):
    """Statement texts encoded once each, projected, stored on the records, read as Tier E."""
    rows = graphs(spark, sf)
    vectors = written_once(
        spark, f"vectors:{sf}",
        lambda: embeddings.encode_texts(embeddings.statement_texts(rows), _letter_vectors),
    )
    reduced = embeddings.project(vectors, embeddings.fit_projection(vectors, features.EMBED_DIM))
    full = features.featurize(embeddings.attach_embeddings(rows, reduced), "E", PROSE_LEXICON)
    return full.select(F.explode("x").alias("x")).groupBy(F.size("x").alias("width")).agg(
        F.count("*").alias("nodes"), F.avg(F.get(F.col("x"), F.lit(30))).alias("first_component")
    )


QUERIES = {
    f.__name__: f
    for f in (
        method_selection, line_graph_nodes, line_graph_edges, line_coverage, flaw_alignment,
        build_attrition, build_reasons, graph_edges, graph_nodes, successor_slots, back_edges,
        graph_metadata, distance_to_vulnerable, out_degree_table, smallest_k,
        graph_distributions, graph_counts, record_violations, shuffled_labels, permuted_edges,
        lexical_flags, heuristic_score, structural_features, full_features, top_k_accuracy,
        chance_top_k, feature_ceiling, sampled_graphs, graph_width, node_labels, json_records,
        embedded_features,
    )
}

# --- the same in SQL ----------------------------------------------------------------------



def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{S_CLASS}+', ''), '{S_CLASS}+$', '')"


SQL_LINES = f"""{SQL_CORPUS},
src AS MATERIALIZED (
  SELECT s.ordinal, s.sample_id, s.num_lines, l.i + 1 AS line, l.x, length(l.x) AS size,
         length(l.x) - length(replace(l.x, ',', '')) AS commas,
         NOT regexp_matches(l.bare, '{S_TRIVIAL}') AS code
  FROM survivors s JOIN corpus_lines l USING (ordinal)),
pl0 AS (
  SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY line) AS k,
         count(*) OVER (PARTITION BY ordinal) AS m
  FROM src WHERE code AND line > 1),
spans AS (SELECT ordinal, line FROM pl0 WHERE size % 19 = 0),
pl1 AS (
  SELECT p.*, CASE WHEN o.line IS NULL AND b.line IS NOT NULL THEN p.line - 1 ELSE p.line END AS canon
  FROM pl0 p LEFT JOIN spans o ON o.ordinal = p.ordinal AND o.line = p.line
  LEFT JOIN spans b ON b.ordinal = p.ordinal AND b.line = p.line - 1),
pl AS MATERIALIZED (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY ordinal ORDER BY canon) AS INTEGER) AS g FROM pl1),
fn AS MATERIALIZED (
  SELECT ordinal, sample_id, num_lines, max(m) AS m, max(g) AS top, CAST(max(g) + 1 AS INTEGER) AS exit
  FROM pl GROUP BY ALL),
hops0 AS (
  SELECT ordinal, k, unnest(CASE WHEN size % 11 = 0 THEN [m + 1] ELSE list_concat([k + 1],
    CASE WHEN commas >= 1 AND size % 3 = 0 THEN [least(k + 2, m + 1)] ELSE [] END,
    CASE WHEN regexp_matches(x, '^[AEIOUaeiou]') AND size % 3 = 1 THEN [greatest(k - 3, 1)] ELSE [] END,
    CASE WHEN size % 7 = 0 AND commas >= 2 THEN list_transform(range(2, commas + 2), lambda j: least(k + j, m + 1)) ELSE [] END)
    END) AS t FROM pl
  UNION ALL SELECT ordinal, 0, 1 FROM fn),
e0 AS MATERIALIZED (
  SELECT DISTINCT h.ordinal, coalesce(a.g, 0) AS u, coalesce(b.g, f.exit) AS v
  FROM hops0 h JOIN fn f USING (ordinal)
  LEFT JOIN pl a ON a.ordinal = h.ordinal AND a.k = h.k
  LEFT JOIN pl b ON b.ordinal = h.ordinal AND b.k = h.t
  WHERE coalesce(a.g, 0) <> coalesce(b.g, f.exit)),
words AS (
  SELECT ordinal, g, line, unnest(regexp_extract_all(x, '([A-Za-z]+),', 1)) AS w,
         generate_subscripts(regexp_extract_all(x, '([A-Za-z]+),', 1), 1) AS j FROM pl),
calls AS (
  SELECT ordinal, g, string_agg(w, '|' ORDER BY line, j) AS calls FROM (
    SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY ordinal, g, w ORDER BY line, j) = 1) GROUP BY ALL),
oplist AS (
  SELECT ordinal, g, line, unnest(CASE WHEN size % 4 = 0 THEN ['<operator>.assignment', '<operator>.addition']
    WHEN size % 4 = 1 THEN ['<operator>.indirectIndexAccess'] ELSE [] END) AS w,
    generate_subscripts(CASE WHEN size % 4 = 0 THEN [1, 2] WHEN size % 4 = 1 THEN [1] ELSE [] END, 1) AS j FROM pl),
ops AS (
  SELECT ordinal, g, string_agg(w, '|' ORDER BY line, j) AS ops FROM (
    SELECT * FROM oplist QUALIFY row_number() OVER (PARTITION BY ordinal, g, w ORDER BY line, j) = 1) GROUP BY ALL),
n0 AS MATERIALIZED (
  SELECT p.ordinal, p.g AS id, p.canon AS line,
    CASE WHEN bool_or(commas >= 1 AND size % 3 = 0) THEN 'BRANCH'
         WHEN bool_or(regexp_matches(x, '^[AEIOUaeiou]') AND size % 3 = 1) THEN 'LOOP'
         WHEN bool_or(size % 7 = 0 AND commas >= 2) THEN 'SWITCH'
         WHEN bool_or(size % 11 = 0) THEN 'RETURN' WHEN bool_or(size % 17 = 0) THEN 'JUMP'
         WHEN bool_or(size % 4 = 0) THEN 'ASSIGN' WHEN max(c.calls) IS NOT NULL THEN 'CALL'
         WHEN bool_or(size % 6 = 0) THEN 'DECL' ELSE 'OTHER' END AS kind,
    coalesce(max(c.calls), '') AS calls, coalesce(max(o.ops), '') AS ops,
    bool_or(p.line = p.canon AND size % 19 = 0) AS spanning
  FROM pl p LEFT JOIN calls c USING (ordinal, g) LEFT JOIN ops o USING (ordinal, g)
  GROUP BY p.ordinal, p.g, p.canon),
n1 AS MATERIALIZED (
  SELECT n.ordinal, n.id, n.line, n.kind, n.calls, n.ops,
    {_strip('a.x')} || CASE WHEN n.spanning AND s.line IS NULL AND {_strip("coalesce(b.x, '')")} <> ''
      THEN ' ' || {_strip('b.x')} ELSE '' END AS code
  FROM n0 n JOIN src a ON a.ordinal = n.ordinal AND a.line = n.line
  LEFT JOIN src b ON b.ordinal = n.ordinal AND b.line = n.line + 1
  LEFT JOIN spans s ON s.ordinal = n.ordinal AND s.line = n.line + 1
  UNION ALL SELECT ordinal, 0, 1, 'ENTRY', '', '', '' FROM fn
  UNION ALL SELECT ordinal, exit, num_lines, 'EXIT', '', '', '' FROM fn),
bfs0(ordinal, id, depth) USING KEY (ordinal, id) AS (
  SELECT ordinal, 0, 0 FROM fn
  UNION
  SELECT b.ordinal, e.v, b.depth + 1 FROM bfs0 b JOIN e0 e ON e.ordinal = b.ordinal AND e.u = b.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs0 r WHERE r.ordinal = e.ordinal AND r.id = e.v)),
cov AS (
  SELECT ordinal, coalesce(count(*) FILTER (line = 1 OR parsed OR own OR merged OR size % 6 = 0 AND parsed)
           / greatest(count(*), 1), 0) AS coverage
  FROM (SELECT s.*, EXISTS (SELECT 1 FROM pl p WHERE p.ordinal = s.ordinal AND p.line = s.line) AS parsed,
          EXISTS (SELECT 1 FROM spans q WHERE q.ordinal = s.ordinal AND q.line = s.line) AS own,
          EXISTS (SELECT 1 FROM spans q WHERE q.ordinal = s.ordinal AND q.line = s.line - 1) AS merged
        FROM src s WHERE s.code AND NOT {_strip('s.x')} LIKE '#%')
  GROUP BY ordinal),
flawed AS (
  SELECT s.ordinal, s.line, n.id FROM src s
  LEFT JOIN spans o ON o.ordinal = s.ordinal AND o.line = s.line
  LEFT JOIN spans b ON b.ordinal = s.ordinal AND b.line = s.line - 1
  LEFT JOIN n0 n ON n.ordinal = s.ordinal
       AND n.line = CASE WHEN o.line IS NULL AND b.line IS NOT NULL THEN s.line - 1 ELSE s.line END
  WHERE s.size % 5 = 0 AND s.code),
aligned AS MATERIALIZED (
  SELECT f.ordinal, f.sample_id, f.exit, f.num_lines, f.top,
    coalesce((SELECT string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) FROM (SELECT DISTINCT id FROM flawed w WHERE w.ordinal = f.ordinal AND id IS NOT NULL)), '') AS vuln_nodes,
    CAST(count(w.id) AS INTEGER) AS mapped, CAST(count(w.ordinal) - count(w.id) AS INTEGER) AS unmapped,
    count(b.id) AS seen
  FROM fn f LEFT JOIN flawed w USING (ordinal) LEFT JOIN bfs0 b ON b.ordinal = w.ordinal AND b.id = w.id
  GROUP BY ALL),
cand AS MATERIALIZED (
  SELECT s.ordinal, s.sample_id, a.exit, a.num_lines,
    CASE WHEN a.ordinal IS NULL THEN 'no_statements'
         WHEN c.coverage < 0.6 THEN 'low_coverage' WHEN b.id IS NULL THEN 'exit_unreachable'
         WHEN a.mapped = 0 THEN 'no_flaw_on_node' WHEN a.seen = 0 THEN 'flaw_unreachable'
         WHEN a.exit + 1 < 5 THEN 'too_few_nodes' WHEN a.exit + 1 > 300 THEN 'too_many_nodes' END AS reason
  FROM survivors s LEFT JOIN aligned a USING (ordinal) LEFT JOIN cov c USING (ordinal)
  LEFT JOIN bfs0 b ON b.ordinal = a.ordinal AND b.id = a.exit),
kept AS MATERIALIZED (SELECT ordinal, sample_id, exit FROM cand WHERE reason IS NULL),
slots0 AS (
  SELECT e.ordinal, e.u, e.v, row_number() OVER (PARTITION BY e.ordinal, e.u ORDER BY n.line, e.v) - 1 AS r,
         count(*) OVER (PARTITION BY e.ordinal, e.u) AS d
  FROM e0 e JOIN kept USING (ordinal) JOIN n1 n ON n.ordinal = e.ordinal AND n.id = e.v),
chains AS (
  SELECT ordinal, u, c, exit + 1 + coalesce(sum(c) OVER (PARTITION BY ordinal ORDER BY u
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT DISTINCT ordinal, u, CASE WHEN d <= 6 THEN 0 ELSE CAST(ceil((d - 6) / 5) AS BIGINT) END AS c FROM slots0)
  JOIN kept USING (ordinal)),
edge AS MATERIALIZED (
  SELECT s.ordinal, CAST(CASE WHEN least(r // 5, c) = 0 THEN s.u ELSE base + least(r // 5, c) - 1 END AS INTEGER) AS u,
         CAST(s.v AS INTEGER) AS v
  FROM slots0 s JOIN chains USING (ordinal, u)
  UNION ALL
  SELECT ordinal, CAST(CASE WHEN j = 0 THEN u ELSE base + j - 1 END AS INTEGER), CAST(base + j AS INTEGER)
  FROM (SELECT *, unnest(range(c)) AS j FROM chains)),
node AS MATERIALIZED (
  SELECT n.ordinal, k.sample_id, CAST(n.id AS INTEGER) AS id, CAST(n.line AS INTEGER) AS line, n.kind, n.calls, n.ops, n.code
  FROM n1 n JOIN kept k USING (ordinal)
  UNION ALL
  SELECT n.ordinal, k.sample_id, CAST(c.base + c.j AS INTEGER), CAST(n.line AS INTEGER), n.kind, n.calls, n.ops, n.code
  FROM (SELECT *, unnest(range(c)) AS j FROM chains) c
  JOIN n1 n ON n.ordinal = c.ordinal AND n.id = c.u JOIN kept k ON k.ordinal = n.ordinal),
label AS MATERIALIZED (SELECT DISTINCT f.ordinal, k.sample_id, CAST(f.id AS INTEGER) AS id FROM flawed f JOIN kept k USING (ordinal) WHERE f.id IS NOT NULL),
bfs(ordinal, id, depth) USING KEY (ordinal, id) AS (
  SELECT ordinal, 0, 0 FROM kept
  UNION
  SELECT b.ordinal, e.v, b.depth + 1 FROM bfs b JOIN edge e ON e.ordinal = b.ordinal AND e.u = b.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.ordinal = e.ordinal AND r.id = e.v))
"""

SQL_CYCLES = """,
reach AS (
  SELECT ordinal, u, v FROM edge
  UNION
  SELECT r.ordinal, r.u, e.v FROM reach r JOIN edge e ON e.ordinal = r.ordinal AND e.u = r.v)
"""


def graph_sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {SQL_LINES}{more} {body}"


_BUILD = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(build.BUILD_STAGES)) + ") s(position, step)"
_LEVEL = "CASE reason " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in build.REASON_LEVEL.items()) + " ELSE 6 END"

ORACLE = {
    "method_selection": f"""WITH {SQL_CORPUS}, p AS (
        SELECT c.sample_id, c.func_before, l.x, length(l.x) AS size, row_number() OVER (PARTITION BY c.ordinal ORDER BY l.i) AS k,
               count(*) OVER (PARTITION BY c.ordinal) AS m, length(l.x) - length(replace(l.x, ',', '')) AS commas,
               len(regexp_extract_all(l.x, '([A-Za-z]+),', 1)) + CASE size % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END
               + CASE WHEN size % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END AS chain
        FROM corpus c JOIN corpus_lines l USING (ordinal)
        WHERE NOT regexp_matches(l.bare, '{S_TRIVIAL}') AND l.i >= 1)
        SELECT c.sample_id, 'src/' || c.sample_id || CASE WHEN length(c.func_before) % 3 = 0 THEN '.cpp' ELSE '.c' END AS file, 'f' AS name,
          CAST(2 + coalesce(sum(1 + chain), 0) + CASE WHEN length(c.func_before) % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS flow_nodes,
          CAST(coalesce(sum(chain), 0) + CASE WHEN count(p.k) > 0 THEN 1 ELSE 0 END + coalesce(sum(CASE WHEN p.k IS NULL THEN 0 WHEN size % 11 = 0 THEN 1 ELSE 1
            + CASE WHEN commas >= 1 AND size % 3 = 0 THEN 1 ELSE 0 END
            + CASE WHEN regexp_matches(p.x, '^[AEIOUaeiou]') AND size % 3 = 1 THEN 1 ELSE 0 END
            + CASE WHEN size % 7 = 0 AND commas >= 2 THEN commas ELSE 0 END END), 0) AS INTEGER) AS flow_edges
        FROM corpus c LEFT JOIN p USING (sample_id)
        GROUP BY c.sample_id, c.func_before""",
    "line_graph_nodes": graph_sql(
        "SELECT f.sample_id, CAST(n.id AS INTEGER) AS id, CAST(n.line AS INTEGER) AS line, n.kind, md5(n.code) AS code_md5,"
        " CAST(coalesce(b.depth, -1) AS INTEGER) AS depth, n.calls, n.ops FROM n1 n JOIN fn f USING (ordinal)"
        " LEFT JOIN bfs0 b ON b.ordinal = n.ordinal AND b.id = n.id"
    ),
    "line_graph_edges": graph_sql(
        "SELECT f.sample_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v FROM e0 JOIN fn f USING (ordinal)"
    ),
    "line_coverage": graph_sql(
        "SELECT f.sample_id, round(c.coverage, 6) AS coverage FROM cov c JOIN fn f USING (ordinal)"
    ),
    "flaw_alignment": graph_sql(
        "SELECT sample_id, vuln_nodes, mapped, unmapped, CASE WHEN mapped = 0 THEN 'no_flaw_on_node'"
        " WHEN seen = 0 THEN 'flaw_unreachable' END AS align_reason FROM aligned"
    ),
    "build_attrition": graph_sql(
        f"SELECT CAST(s.position AS INTEGER) AS position, s.step, (SELECT count(*) FROM cand WHERE {_LEVEL} > s.position) AS rows FROM {_BUILD}"
    ),
    "build_reasons": graph_sql(
        "SELECT reason, count(*) AS functions FROM cand WHERE reason IS NOT NULL GROUP BY 1 UNION ALL"
        " SELECT 'rewritten_wide_nodes', n FROM (SELECT count(DISTINCT ordinal) AS n FROM slots0 WHERE d > 6) WHERE n > 0"
    ),
    "graph_edges": graph_sql("SELECT k.sample_id, u, v FROM edge JOIN kept k USING (ordinal)"),
    "graph_nodes": graph_sql(
        "SELECT n.sample_id, n.id, n.line, n.kind, CAST(coalesce(b.depth, -1) AS INTEGER) AS depth,"
        " n.kind NOT IN ('ENTRY', 'EXIT') AND c.ordinal IS NOT NULL AS in_loop, md5(n.code) AS code_md5"
        " FROM node n LEFT JOIN bfs b ON b.ordinal = n.ordinal AND b.id = n.id"
        " LEFT JOIN (SELECT ordinal, u FROM reach WHERE u = v) c ON c.ordinal = n.ordinal AND c.u = n.id", SQL_CYCLES
    ),
}

SQL_FLAT = """,
size AS (SELECT ordinal, count(*) AS n FROM node GROUP BY 1),
dist AS (SELECT l.ordinal, min(b.depth) AS d FROM label l JOIN bfs b ON b.ordinal = l.ordinal AND b.id = l.id GROUP BY 1)
"""


def _re(pattern: str) -> str:
    return pattern.replace(r"\x85", r"\x{85}").replace("'", "''")


def _ops(names) -> str:
    listed = ", ".join(f"'<operator>.{n}'" for n in names)
    return f"list_has_any(string_split(ops, '|'), [{listed}])"


def _flag(names, pattern, text="code") -> str:
    return f"CASE WHEN ops <> '' THEN {_ops(names)} ELSE regexp_matches({text}, '{_re(pattern)}') END"


def _named(names) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"calls <> '' AND list_has_any(string_split(calls, '|'), [{listed}])"


_FLAGS = {
    "has_call": "calls <> ''",
    "dangerous_call": _named(PROSE_LEXICON.dangerous_calls),
    "alloc_call": _named(PROSE_LEXICON.alloc_calls),
    "free_call": _named(PROSE_LEXICON.free_calls),
    "array_subscript": _flag(lx.SUBSCRIPT_OPS, lx.SUBSCRIPT),
    "pointer_deref": _flag(lx.DEREF_OPS, lx.DEREF),
    "pointer_arith": f"regexp_matches(code, '{_re(lx.POINTER_ARITH)}')",
    "arith_op": _flag(lx.ARITH_OPS, lx.ARITH),
    "comparison": _flag(lx.COMPARE_OPS, lx.COMPARE),
    "uses_sizeof": _flag(lx.SIZEOF_OPS, lx.SIZEOF),
    "has_cast": _flag(lx.CAST_OPS, lx.CAST, "replace(code, 'sizeof(', 'sizeof#')"),
    "length_like_ident": f"len(list_filter(regexp_extract_all(code, '{_re(lx.IDENTIFIER)}', 1),"
    f" lambda w: lower(w) <> 'sizeof' AND regexp_matches(lower(w), '{_re(lx.length_pattern())}'))) > 0",
}
_FLAG_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for n, c in _FLAGS.items())
_TOKENS = f"least(len(regexp_extract_all(code, '{_re(lx.TOKEN)}')), 40) / 40"
_SCORE = " + ".join(f"{w} * {n}" for n, w in lx.DEFAULT_WEIGHTS.items())

SQL_SCORES = f""",
flag AS MATERIALIZED (SELECT ordinal, sample_id, id, kind, {_FLAG_SQL}, {_TOKENS} AS token_count FROM node),
score AS MATERIALIZED (SELECT ordinal, sample_id, id, kind, dangerous_call, ({_SCORE}) / 10.5 AS score FROM flag)
"""

_LABELLED = "EXISTS (SELECT 1 FROM label l WHERE l.ordinal = {0}.ordinal AND l.id = {0}.id)"

ORACLE |= {
    "sampled_graphs": graph_sql(
        "SELECT k.sample_id FROM kept k JOIN size s USING (ordinal) WHERE s.n <= 60 ORDER BY md5('3:' || k.sample_id), k.sample_id LIMIT 40", SQL_FLAT
    ),
    "graph_width": graph_sql(
        "SELECT count(*) AS graphs, count(*) FILTER (w > 3) AS graphs_wider_than_k, count(*) FILTER (4 * (exit + 1) >= 200) AS graphs_at_step_cap"
        " FROM (SELECT f.ordinal, f.exit, max(d) AS w FROM fn f LEFT JOIN (SELECT ordinal, u, count(*) AS d FROM e0 GROUP BY ALL) USING (ordinal) GROUP BY ALL)"
    ),
    "node_labels": graph_sql(
        "SELECT sample_id, id, CASE WHEN kind IN ('ENTRY', 'EXIT') THEN kind ELSE CAST(line AS VARCHAR) || ': ' || CASE WHEN c = '' THEN kind"
        " WHEN length(c) > 34 THEN substr(c, 1, 33) || '…' ELSE c END END AS label"
        f" FROM (SELECT *, trim(regexp_replace(code, '{S_CLASS}+', ' ', 'g')) AS c FROM node)"
    ),
    "json_records": graph_sql(
        "SELECT k.sample_id, CAST(s.n AS INTEGER) AS nodes, CAST((SELECT count(*) FROM edge e WHERE e.ordinal = k.ordinal) AS INTEGER) AS edges,"
        " CAST((SELECT count(*) FROM label l WHERE l.ordinal = k.ordinal) AS INTEGER) AS labels,"
        " sha1(c.project || '#' || c.cwe || '#' || (SELECT string_agg(x.id || ':' || x.line || ':' || x.kind || ':' || x.code || ':'"
        " || x.calls || ':' || x.ops, '#' ORDER BY x.id) FROM node x WHERE x.ordinal = k.ordinal) || '#'"
        " || (SELECT string_agg(e.u || '-' || e.v, ',' ORDER BY e.u, e.v) FROM edge e WHERE e.ordinal = k.ordinal) || '#'"
        " || (SELECT string_agg(CAST(l.id AS VARCHAR), ',' ORDER BY l.id) FROM label l WHERE l.ordinal = k.ordinal)) AS content_sha1"
        " FROM kept k JOIN size s USING (ordinal) JOIN corpus c USING (ordinal)", SQL_FLAT
    ),
    "successor_slots": graph_sql(
        "SELECT n.sample_id, e.u, e.v, CAST(row_number() OVER (PARTITION BY e.ordinal, e.u ORDER BY n.line, e.v) - 1 AS INTEGER) AS slot"
        " FROM edge e JOIN node n ON n.ordinal = e.ordinal AND n.id = e.v"
    ),
    "graph_metadata": graph_sql(
        "SELECT k.sample_id AS graph_id, c.project, c.cwe, CAST(s.n AS INTEGER) AS num_nodes,"
        " CAST((SELECT count(*) FROM label l WHERE l.ordinal = k.ordinal) AS INTEGER) AS num_vuln,"
        " CAST(coalesce(d.d, -1) AS INTEGER) AS dist_to_vuln FROM kept k JOIN corpus c USING (ordinal)"
        " JOIN size s USING (ordinal) LEFT JOIN dist d USING (ordinal)", SQL_FLAT
    ),
    "distance_to_vulnerable": graph_sql(
        "SELECT n.sample_id, n.id, CAST(coalesce(u.depth, s.n) AS INTEGER) AS distance FROM node n JOIN size s USING (ordinal)"
        " LEFT JOIN und u ON u.ordinal = n.ordinal AND u.id = n.id",
        SQL_FLAT + """, both_ways AS MATERIALIZED (SELECT ordinal, u, v FROM edge UNION SELECT ordinal, v, u FROM edge),
        und(ordinal, id, depth) USING KEY (ordinal, id) AS (SELECT ordinal, id, 0 FROM label UNION
          SELECT b.ordinal, e.v, b.depth + 1 FROM und b JOIN both_ways e ON e.ordinal = b.ordinal AND e.u = b.id
          WHERE NOT EXISTS (SELECT 1 FROM recurring.und r WHERE r.ordinal = e.ordinal AND r.id = e.v))""",
    ),
    "out_degree_table": graph_sql(
        "SELECT CAST(g.g AS INTEGER) AS out_degree, count(*) FILTER (d.d = g.g) AS nodes,"
        " round(count(*) FILTER (d.d <= g.g) / count(*), 6) AS nodes_covered,"
        " round((SELECT count(*) FILTER (w.w <= g.g) / count(*) FROM wide w), 6) AS graphs_covered"
        " FROM range((SELECT max(d) + 1 FROM deg)) g(g), deg d GROUP BY g.g",
        """, deg AS (SELECT n.ordinal, n.id, count(e.u) AS d FROM node n LEFT JOIN edge e ON e.ordinal = n.ordinal AND e.u = n.id GROUP BY ALL),
        wide AS (SELECT ordinal, max(d) AS w FROM deg GROUP BY 1)""",
    ),
    "smallest_k": graph_sql(
        "SELECT CAST(greatest(min(d), 1) AS INTEGER) AS smallest_k FROM (SELECT d, sum(count(*)) OVER (ORDER BY d) / sum(count(*)) OVER () AS c FROM deg GROUP BY d) WHERE c >= 0.99",
        ", deg AS (SELECT n.ordinal, n.id, count(e.u) AS d FROM node n LEFT JOIN edge e ON e.ordinal = n.ordinal AND e.u = n.id GROUP BY ALL)",
    ),
    "graph_distributions": graph_sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS measure, round(avg({col}), 6) AS mean, "
            + ", ".join(f"round(quantile_cont(CAST({col} AS DOUBLE), {q / 100}), 6) AS p{q}" for q in records.PERCENTILES)
            + " FROM m"
            for name, col in (("nodes", "n"), ("vulnerable_nodes", "v"), ("vulnerable_node_fraction", "v / n"), ("distance_entry_to_vulnerable", "d"))
        ),
        SQL_FLAT + ", m AS (SELECT s.n, (SELECT count(*) FROM label l WHERE l.ordinal = s.ordinal) AS v, dist.d FROM size s LEFT JOIN dist USING (ordinal))",
    ),
    "graph_counts": graph_sql(
        "SELECT 'kind' AS measure, kind AS value, count(*) AS n FROM node GROUP BY kind UNION ALL"
        " SELECT 'cwe', c.cwe, count(*) FROM kept JOIN corpus c USING (ordinal) GROUP BY c.cwe"
    ),
    "shuffled_labels": graph_sql(
        "SELECT sample_id, string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) AS vuln_nodes FROM ("
        " SELECT n.ordinal, n.sample_id, n.id, row_number() OVER (PARTITION BY n.ordinal ORDER BY md5('7:' || n.sample_id || ':' || CAST(n.id AS VARCHAR))) AS r"
        " FROM node n JOIN bfs b ON b.ordinal = n.ordinal AND b.id = n.id WHERE n.kind NOT IN ('ENTRY', 'EXIT')) q"
        " JOIN (SELECT ordinal, count(*) AS c FROM label GROUP BY 1) w USING (ordinal) WHERE r <= c GROUP BY sample_id"
    ),
    "permuted_edges": graph_sql(
        "SELECT a.sample_id, a.j AS u, b.j AS v FROM edge e JOIN p a ON a.ordinal = e.ordinal AND a.id = e.u"
        " JOIN p b ON b.ordinal = e.ordinal AND b.id = e.v",
        ", p AS MATERIALIZED (SELECT ordinal, sample_id, id, CAST(row_number() OVER (PARTITION BY ordinal ORDER BY md5('7:' || sample_id || ':' || CAST(id AS VARCHAR))) - 1 AS INTEGER) AS j FROM node)",
    ),
    "lexical_flags": graph_sql(
        f"SELECT sample_id, id, {', '.join(_FLAGS)}, round(token_count, 6) AS token_count FROM flag", SQL_SCORES
    ),
    "heuristic_score": graph_sql("SELECT sample_id, id, round(score, 6) AS score FROM score", SQL_SCORES),
    "top_k_accuracy": graph_sql(
        "SELECT " + ", ".join(f"round(count(*) FILTER (best <= {k}) / count(*), 6) AS top{k}" for k in (1, 3, 5))
        + f" FROM (SELECT ordinal, min(r) FILTER (hit) AS best FROM (SELECT s.ordinal, {_LABELLED.format('s')} AS hit,"
        " row_number() OVER (PARTITION BY s.ordinal ORDER BY score DESC, id) AS r FROM score s WHERE kind NOT IN ('ENTRY', 'EXIT')) GROUP BY 1)",
        SQL_SCORES,
    ),
    "chance_top_k": graph_sql(
        "SELECT "
        + ", ".join(
            f"round(avg(1 - coalesce((SELECT product(greatest(s - v - i, 0) / (s - i)) FROM range(least({k}, s)) r(i)), 1)), 6) AS top{k}"
            for k in (1, 3, 5)
        )
        + " FROM (SELECT n.ordinal, count(*) AS s, (SELECT count(*) FROM label l WHERE l.ordinal = n.ordinal) AS v"
        " FROM node n WHERE kind NOT IN ('ENTRY', 'EXIT') GROUP BY n.ordinal)"
    ),
    "feature_ceiling": graph_sql(
        "SELECT round(avg(best), 6) AS ceiling FROM (SELECT max(w) / sum(w) AS best FROM (SELECT ordinal,"
        " CASE WHEN dangerous_call > 0 THEN 0.9 / 0.1 ELSE (1 - 0.9) / (1 - 0.1) END AS w FROM score WHERE kind NOT IN ('ENTRY', 'EXIT')) GROUP BY ordinal)",
        SQL_SCORES,
    ),
}
# ``loop_header`` follows back edges, which depend on the search order and have no set form.

