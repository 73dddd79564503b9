"""Search, trace and replay queries over the graphs of the driver tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from lineflow.config import EnvConfig
from lineflow.operators import metrics, stats, traces
from lineflow.operators.search import best_threshold, best_thresholds, run_evaluation, threshold_curve, threshold_table
from lineflow.plans.corpus_queries import _rounded
from lineflow.plans.graph_queries import SQL_CYCLES, SQL_FLAT, SQL_SCORES, graph_sql
from lineflow.plans.metric_queries import metric_sql
from lineflow.schema import NODE_KINDS
from lineflow.plans.views import SEARCHERS, THRESHOLDS, episodes, graphs, scored_graphs

SEEDS = (0, 1, 2)
GRID = tuple(round(0.05 * i, 4) for i in range(1, 20))


def _episodes_of(spark, sf, method):
    rows = episodes(spark, sf).filter(F.col("method") == method)
    return _rounded(rows)


def line_order_by_size(spark, sf):
    """Success and cost of line-order search by function size."""
    rows = run_evaluation(graphs(spark, sf), ["line_order"])
    return _rounded(metrics.breakdown(rows, "size_bucket"))


def search_metrics(spark, sf):
    """All methods under both declare rules."""
    return _rounded(metrics.compute_metrics(episodes(spark, sf)))


def search_across_seeds(spark, sf):
    return _rounded(metrics.metrics_across_seeds(episodes(spark, sf)))


def search_end_reasons(spark, sf):
    return _rounded(metrics.end_shares(episodes(spark, sf), ["method"]))


def heuristic_methods(spark, sf):
    rows = episodes(spark, sf).filter(F.col("method").rlike(r"\+heuristic"))
    return _rounded(metrics.compute_metrics(rows))


def search_comparison(spark, sf):
    return stats.comparison_table(episodes(spark, sf), "line_order+heuristic")


def search_intervals(spark, sf):
    return stats.confidence_intervals(episodes(spark, sf))


def dfs_three_declares(spark, sf):
    rows = run_evaluation(
        scored_graphs(spark, sf), ["dfs"], env=EnvConfig(max_declares=3), threshold=0.1
    )
    return _rounded(rows)


def dfs_without_backtracking(spark, sf):
    rows = run_evaluation(graphs(spark, sf), ["dfs"], env=EnvConfig(allow_backtrack=False))
    return _rounded(rows)


def _curve(spark, sf, name):
    return _rounded(threshold_curve(scored_graphs(spark, sf), name, GRID, seeds=SEEDS))


def all_thresholds(spark, sf):
    """Every method at every threshold, over all seeds, in one pass."""
    return _rounded(threshold_table(scored_graphs(spark, sf), SEARCHERS, GRID, seeds=SEEDS))


def best_thresholds_by_method(spark, sf):
    return _rounded(best_thresholds(threshold_table(scored_graphs(spark, sf), SEARCHERS, GRID, seeds=SEEDS)))


def best_line_order_threshold(spark, sf):
    return _rounded(best_threshold(threshold_curve(scored_graphs(spark, sf), "line_order", GRID)))


def _all_traces(spark, sf):
    """Every method declaring on labels, and breadth-first by threshold."""
    rows = scored_graphs(spark, sf)
    out = traces.search_traces(rows, "bfs", threshold=0.1)
    for name in SEARCHERS:
        out = out.unionByName(traces.search_traces(rows, name))
    return out


def _three_declares(spark, sf):
    return traces.search_traces(scored_graphs(spark, sf), "dfs", env=EnvConfig(max_declares=3), threshold=0.1)


def declared_steps(spark, sf):
    """Every action of the depth-first walks that may declare three times, with the return so far."""
    return _rounded(traces.running_return(_three_declares(spark, sf)))


def trace_checks(spark, sf):
    """Broken traces by method: none are expected."""
    rows = _all_traces(spark, sf)
    return rows.groupBy("method").agg(
        F.count("*").alias("traces"), F.count(traces.trace_problem()).alias("broken"),
        F.sum(F.size("steps")).alias("steps"),
    )


def running_return(spark, sf):
    """Return so far at every step of the line-order traces."""
    rows = traces.running_return(traces.search_traces(graphs(spark, sf), "line_order"))
    return _rounded(rows)


def step_table(spark, sf):
    rows = traces.search_traces(graphs(spark, sf), "line_order")
    return traces.step_table(rows, graphs(spark, sf))


def _replayed(rows):
    return traces.replay(rows).select(
        "graph_id", "current", F.size("visits").alias("visited"), F.size("stack").alias("depth"),
        F.array_join(F.col("declared").cast("array<string>"), ",").alias("declared"),
        F.size("taken_edges").alias("edges"), F.round("running_return", 6).alias("running_return"),
        "finished",
    )


def replay_fold(spark, sf):
    """Where the depth-first replays stand after all their steps."""
    return _replayed(traces.search_traces(graphs(spark, sf), "dfs"))


def replay_three_declares(spark, sf):
    return _replayed(_three_declares(spark, sf))


def action_mix(spark, sf):
    return _rounded(metrics.action_mix(traces.step_rows(_all_traces(spark, sf)), ["method"]))


QUERIES = {
    f.__name__: f
    for f in (
        line_order_by_size, search_metrics, search_across_seeds, search_end_reasons,
        heuristic_methods, search_comparison, search_intervals, dfs_three_declares,
        dfs_without_backtracking, best_line_order_threshold, trace_checks, running_return,
        step_table, replay_fold, action_mix, all_thresholds, best_thresholds_by_method,
        declared_steps, replay_three_declares,
    )
}
for _name in SEARCHERS:
    QUERIES[f"{_name}_episodes"] = partial(_episodes_of, method=_name)
    QUERIES[f"{_name}_heuristic_episodes"] = partial(_episodes_of, method=f"{_name}+heuristic")
    QUERIES[f"{_name}_threshold_curve"] = partial(_curve, name=_name)

# --- the same in SQL: orders are sorts, walks and searches go step by step ------------------

_SEED_ROWS = "(VALUES " + ", ".join(f"({s})" for s in SEEDS) + ") s(seed)"
_ORDERS = {
    "line_order": "SELECT ordinal, 0 AS seed, id, row_number() OVER (PARTITION BY ordinal ORDER BY line, id) - 1 AS p FROM node",
    "random_order": "SELECT ordinal, s.seed, id, row_number() OVER (PARTITION BY ordinal, s.seed ORDER BY md5(CAST(s.seed AS VARCHAR) || ':' || sample_id || ':' || CAST(id AS VARCHAR))) - 1 AS p"
    f" FROM node, {_SEED_ROWS}",
    # Among shortest paths the queue prefers the smallest sequence of slots.
    "bfs": "SELECT ordinal, 0 AS seed, id, row_number() OVER (PARTITION BY ordinal ORDER BY depth, path) - 1 AS p FROM wave",
    # A walk stands on nodes more than once; m counts the different ones so far, rv the returns to
    # one of them that were not a step back.
    "dfs": "SELECT ordinal, 0 AS seed, node AS id, t AS p, len(met) AS m, 0 AS rv FROM walk",
    "random_walk": "SELECT ordinal, seed, node AS id, t AS p, len(met) AS m, rv FROM rwalk",
    "heuristic_first": "SELECT ordinal, 0 AS seed, node AS id, t AS p FROM best",
}
_WALKS = ("dfs", "random_walk")
_SLOTTED = """, slotted AS MATERIALIZED (
  SELECT e.ordinal, e.u, e.v, row_number() OVER (PARTITION BY e.ordinal, e.u ORDER BY n.line, e.v) AS r
  FROM edge e JOIN node n ON n.ordinal = e.ordinal AND n.id = e.v),
leads AS MATERIALIZED (
  SELECT ordinal, u, list(v ORDER BY r) AS vs FROM slotted GROUP BY ALL)"""
# Step by step: to the first successor not met, else back along the path.
_WALK = """, walk(ordinal, t, node, path, met) AS (
  SELECT ordinal, 0, 0, [0], [0] FROM kept
  UNION ALL
  SELECT ordinal, t + 1, coalesce(nx, path[len(path) - 1]),
    CASE WHEN nx IS NULL THEN path[1:len(path) - 1] ELSE list_append(path, nx) END,
    CASE WHEN nx IS NULL THEN met ELSE list_append(met, nx) END
  FROM (SELECT w.*, CAST(list_filter(l.vs, lambda x: NOT list_contains(w.met, x))[1] AS INTEGER) AS nx
        FROM walk w LEFT JOIN leads l ON l.ordinal = w.ordinal AND l.u = w.node)
  WHERE nx IS NOT NULL OR len(path) > 1)"""
# Step by step: the hash of seed, graph and step chooses among successors and going back.
_RANDOM = f""", rwalk(ordinal, sample_id, seed, cap, t, node, path, met, rv) AS (
  SELECT k.ordinal, k.sample_id, s.seed, least(200, 4 * z.n), 0, 0, [0], [0], 0 FROM kept k JOIN size z USING (ordinal), {_SEED_ROWS}
  UNION ALL
  SELECT ordinal, sample_id, seed, cap, t + 1, coalesce(nx, path[len(path) - 1]),
    CASE WHEN nx IS NULL THEN path[1:len(path) - 1] ELSE list_append(path, nx) END,
    CASE WHEN nx IS NULL OR list_contains(met, nx) THEN met ELSE list_append(met, nx) END,
    rv + CASE WHEN list_contains(met, nx) THEN 1 ELSE 0 END
  FROM (SELECT *, CAST(vs[((bits * ways) >> 32) + 1] AS INTEGER) AS nx FROM (
    SELECT w.*, l.vs, coalesce(len(l.vs), 0) + CASE WHEN len(w.path) > 1 THEN 1 ELSE 0 END AS ways,
      CAST('0x' || substr(md5(w.seed || ':' || w.sample_id || ':' || w.t), 1, 8) AS BIGINT) AS bits
    FROM rwalk w LEFT JOIN leads l ON l.ordinal = w.ordinal AND l.u = w.node))
  WHERE ways > 0 AND t < cap)"""
# Step by step: the frontier's highest score, then the earlier line, then the smaller id.
_BEST = """, tops AS MATERIALIZED (
  SELECT e.ordinal, e.u, list({'low': -s.score, 'line': n.line, 'id': e.v}) AS vs
  FROM edge e JOIN node n ON n.ordinal = e.ordinal AND n.id = e.v JOIN score s ON s.ordinal = e.ordinal AND s.id = e.v
  GROUP BY ALL),
best(ordinal, t, node, front, met) AS (
  SELECT k.ordinal, 0, 0, (SELECT vs[1:0] FROM tops LIMIT 1), [0] FROM kept k
  UNION ALL
  SELECT ordinal, t + 1, nx.id, list_filter(ahead, lambda x: x.id <> nx.id), list_concat(met, list_transform(new, lambda x: x.id))
  FROM (SELECT *, list_sort(ahead)[1] AS nx FROM (
    SELECT *, list_concat(front, new) AS ahead FROM (
      SELECT b.*, coalesce(list_filter(l.vs, lambda x: NOT list_contains(b.met, x.id)), b.front[1:0]) AS new
      FROM best b LEFT JOIN tops l ON l.ordinal = b.ordinal AND l.u = b.node)))
  WHERE nx IS NOT NULL)"""
_WAVES = """,
wave(ordinal, id, depth, path) USING KEY (ordinal, id) AS (
  SELECT ordinal, 0, 0, '' FROM kept
  UNION
  SELECT w.ordinal, s.v, w.depth + 1, min(w.path || CAST(s.r AS VARCHAR)) FROM wave w
  JOIN slotted s ON s.ordinal = w.ordinal AND s.u = w.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.wave r WHERE r.ordinal = s.ordinal AND r.id = s.v)
  GROUP BY w.ordinal, s.v, w.depth)"""
_PATHS = {"bfs": _WAVES, "dfs": _WALK, "heuristic_first": _BEST, "random_walk": _RANDOM}
_BASE = f"{SQL_FLAT}{SQL_SCORES}{_SLOTTED}"
#: Return of an episode, in decimals.
_RETURN = "(moves * -0.01 + rv * -0.02 + final)"
_MEAN_RETURN = f"round(CAST(sum({_RETURN}) AS DOUBLE) / count(*), 6)"


def _outcomes(name: str, rules: str, mark: str = "") -> str:
    """Outcomes ``ep`` of one order under every declare rule of ``rules(ordinal, id, rule)``."""
    walks = name in _WALKS
    # The node reached with the last step of an order is inspected, but no hit.
    hit = "hit" if walks else "hit AND p < cap"
    seen = (
        f"y.m AS inspected, y.rv FROM ep0{mark} e JOIN vis{mark} y ON y.ordinal = e.ordinal AND y.seed = e.seed AND y.p = e.moves"
        if walks else f"moves + 1 AS inspected, 0 AS rv FROM ep0{mark} e"
    )
    return f""",
vis{mark} AS MATERIALIZED ({_ORDERS[name]}),
fire{mark} AS MATERIALIZED ({rules}),
rules{mark} AS (SELECT DISTINCT rule FROM fire{mark}),
cap{mark} AS (SELECT ordinal, n, least(200, 4 * n) AS cap FROM size),
o{mark} AS (SELECT v.ordinal, v.seed, r.rule, v.id, v.p, c.n, c.cap, f.id IS NOT NULL AND s.kind NOT IN ('ENTRY', 'EXIT') AS fires, l.id IS NOT NULL AS hit
  FROM vis{mark} v CROSS JOIN rules{mark} r JOIN cap{mark} c USING (ordinal) JOIN node s ON s.ordinal = v.ordinal AND s.id = v.id
  LEFT JOIN fire{mark} f ON f.ordinal = v.ordinal AND f.id = v.id AND f.rule = r.rule
  LEFT JOIN label l ON l.ordinal = v.ordinal AND l.id = v.id),
ends{mark} AS (SELECT ordinal, seed, rule, n, cap, count(*) AS len, min(p) FILTER (fires AND p < cap) AS d,
  min(p) FILTER ({hit}) AS h FROM o{mark} GROUP BY ALL),
ep0{mark} AS (SELECT e.*, k.sample_id, coalesce(x.hit, false) AS success,
  coalesce(d, CASE WHEN len > e.cap THEN e.cap ELSE len - 1 END) AS moves,
  CASE WHEN d IS NULL THEN -0.5 WHEN x.hit THEN 1.0 ELSE -0.5 END AS final,
  CASE WHEN d IS NOT NULL THEN CASE WHEN x.hit THEN 'correct' ELSE 'wrong_declare' END WHEN len > e.cap THEN 'timeout' ELSE 'exhausted' END AS end_reason
  FROM ends{mark} e JOIN kept k USING (ordinal)
  LEFT JOIN o{mark} x ON x.ordinal = e.ordinal AND x.seed = e.seed AND x.rule = e.rule AND x.p = e.d),
ep{mark} AS (SELECT e.*, {seen})"""


def _search_cte(name: str, rules: str) -> str:
    return _BASE + _PATHS.get(name, "") + _outcomes(name, rules)


_ORACLE_RULE = "SELECT ordinal, id, 0 AS rule FROM label"


def _threshold_rule(limit: float) -> str:
    return f"SELECT ordinal, id, 0 AS rule FROM score WHERE score >= {limit}"


_GRID_RULE = "SELECT ordinal, id, CAST(t AS DOUBLE) AS rule FROM score, (VALUES " + ", ".join(f"({t})" for t in GRID) + ") g(t) WHERE score >= t UNION ALL SELECT -1, -1, CAST(t AS DOUBLE) FROM (VALUES " + ", ".join(f"({t})" for t in GRID) + ") g(t)"


def _episode_rows(label: str, mark: str = "") -> str:
    return (
        f"SELECT {label} AS method, CAST(seed AS INTEGER) AS seed, 'val' AS split, ep.sample_id AS graph_id, c.project, c.cwe,"
        " CAST(n AS INTEGER) AS num_nodes, CAST((SELECT count(*) FROM label l WHERE l.ordinal = ep.ordinal) AS INTEGER) AS num_vuln,"
        " CAST(coalesce(dist.d, -1) AS INTEGER) AS dist_to_vuln, CAST(cap AS INTEGER) AS max_steps, success,"
        " success AS first_declare_correct, CAST(inspected AS INTEGER) AS nodes_inspected,"
        " CAST(CASE WHEN ep.d IS NULL THEN moves ELSE moves + 1 END AS INTEGER) AS actions_taken,"
        f" round(CAST({_RETURN} AS DOUBLE), 6) AS cumulative_reward,"
        " CAST(CASE WHEN h <= moves THEN h END AS INTEGER) AS first_hit_step, end_reason"
        f" FROM ep{mark} ep JOIN corpus c USING (ordinal) LEFT JOIN dist USING (ordinal)"
    )


def _episode_sql(name: str, rules: str, label: str) -> str:
    return graph_sql(_episode_rows(f"'{label}'"), _search_cte(name, rules))


def _curve_sql(name: str, tail: str = "") -> str:
    return graph_sql(
        f"SELECT '{name}' AS method, 'heuristic' AS scorer, rule AS threshold, round(avg(CAST(success AS INT)), 6) AS success_rate,"
        " round(avg(CAST(d IS NOT NULL AS INT)), 6) AS declared_rate, round(avg(inspected), 6) AS nodes_inspected,"
        f" {_MEAN_RETURN} AS cumulative_reward FROM ep GROUP BY rule{tail}",
        _search_cte(name, _GRID_RULE),
    )


# A back edge leads to a node on the path that its source was reached by.
ORACLE = {
    "back_edges": graph_sql(
        "SELECT DISTINCT k.sample_id, CAST(e.u AS INTEGER) AS u, CAST(e.v AS INTEGER) AS v FROM edge e JOIN kept k USING (ordinal)"
        " JOIN walk w ON w.ordinal = e.ordinal AND w.node = e.u WHERE list_contains(w.path, e.v)",
            SQL_FLAT + _SLOTTED.replace("ORDER BY n.line, e.v", "ORDER BY e.v") + _WALK,
    )
}
ORACLE["structural_features"] = graph_sql(
    "SELECT n.sample_id, n.id,"
    + "".join(f" CAST(n.kind = '{kind}' AS DOUBLE) AS kind_{kind.lower()}," for kind in NODE_KINDS) +
    " CAST(EXISTS (SELECT 1 FROM walk w JOIN edge e ON e.ordinal = w.ordinal AND e.u = w.node WHERE w.ordinal = n.ordinal AND e.v = n.id"
    " AND list_contains(w.path, e.v)) AS DOUBLE) AS loop_header,"
    " round(least((SELECT count(*) FROM edge e WHERE e.ordinal = n.ordinal AND e.v = n.id), 4) / 4, 5) AS in_degree,"
    " round(least((SELECT count(*) FROM edge e WHERE e.ordinal = n.ordinal AND e.u = n.id), 4) / 4, 5) AS out_degree,"
    " round(CAST(CAST(greatest(coalesce(b.depth, -1), 0) / greatest(1, max(b.depth) OVER (PARTITION BY n.ordinal)) AS FLOAT) AS DOUBLE), 5) AS depth,"
    " CAST(n.kind NOT IN ('ENTRY', 'EXIT') AND c.u IS NOT NULL AS DOUBLE) AS in_loop,"
    " round(CAST(CAST(least(n.line / greatest(1, f.num_lines, max(n.line) OVER (PARTITION BY n.ordinal)), 1) AS FLOAT) AS DOUBLE), 5) AS rel_line"
    " FROM node n JOIN fn f USING (ordinal) LEFT JOIN bfs b ON b.ordinal = n.ordinal AND b.id = n.id"
    " LEFT JOIN (SELECT ordinal, u FROM reach WHERE u = v) c ON c.ordinal = n.ordinal AND c.u = n.id",
    SQL_CYCLES + _SLOTTED.replace("ORDER BY n.line, e.v", "ORDER BY e.v") + _WALK,
)
for _name in _ORDERS:
    ORACLE[f"{_name}_episodes"] = _episode_sql(_name, _ORACLE_RULE, _name)
    ORACLE[f"{_name}_heuristic_episodes"] = _episode_sql(
        _name, _threshold_rule(THRESHOLDS[_name]), f"{_name}+heuristic"
    )
    ORACLE[f"{_name}_threshold_curve"] = _curve_sql(_name)
ORACLE["best_line_order_threshold"] = _curve_sql(
    "line_order", " ORDER BY avg(CAST(success AS INT)) DESC, avg(moves + 1), rule LIMIT 1"
)
ORACLE["line_order_by_size"] = graph_sql(
    """SELECT CASE WHEN n <= 20 THEN '<=20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE '>100' END AS size_bucket,
       'line_order' AS method, count(*) AS episodes, round(avg(CAST(success AS INT)), 6) AS localization_accuracy,
       round(avg(CAST(success AS INT)), 6) AS success_rate, round(avg(moves + 1) FILTER (success), 6) AS nodes_inspected_success,
       round(avg(CASE WHEN success THEN moves + 1 ELSE n END), 6) AS nodes_inspected_all,
       round(avg(moves + 1) FILTER (success), 6) AS actions_success,
       round(avg(CASE WHEN success THEN moves + 1 ELSE cap END), 6) AS actions_all,
       round(avg(CASE WHEN success THEN moves + 1 ELSE n END / n), 6) AS normalised_cost,
       """ + _MEAN_RETURN + """ AS cumulative_reward,
       round(avg(moves / dist.d) FILTER (success AND dist.d > 0), 6) AS path_efficiency
       FROM ep LEFT JOIN dist USING (ordinal) GROUP BY 1""",
    _search_cte("line_order", _ORACLE_RULE),
)
_STEPS = """, steps AS (SELECT e.sample_id, e.ordinal, a.p AS t, a.id AS node, 'INSPECT' AS action, b.id AS next_node, -0.01::DOUBLE AS reward
    FROM ep e JOIN vis a ON a.ordinal = e.ordinal JOIN vis b ON b.ordinal = e.ordinal AND b.p = a.p + 1 WHERE b.p <= e.moves
  UNION ALL SELECT e.sample_id, e.ordinal, e.moves, a.id, 'DECLARE', a.id, e.final FROM ep e JOIN vis a ON a.ordinal = e.ordinal AND a.p = e.d)"""
ORACLE["running_return"] = graph_sql(
    "SELECT sample_id AS graph_id, 'line_order' AS method, CAST(t AS INTEGER) AS t, node, action, next_node, round(reward, 6) AS reward,"
    " round(sum(reward) OVER (PARTITION BY ordinal ORDER BY t), 6) AS total FROM steps",
    _search_cte("line_order", _ORACLE_RULE) + _STEPS,
)
ORACLE["step_table"] = graph_sql(
    "SELECT s.sample_id AS graph_id, 'line_order' AS method, CAST(t + 1 AS INTEGER) AS step, a.line, action, b.line AS to_line,"
    " round(reward, 4) AS reward, round(sum(reward) OVER (PARTITION BY s.ordinal ORDER BY t), 4) AS return"
    " FROM steps s JOIN node a ON a.ordinal = s.ordinal AND a.id = s.node JOIN node b ON b.ordinal = s.ordinal AND b.id = s.next_node",
    _search_cte("line_order", _ORACLE_RULE) + _STEPS,
)

# All methods under both rules at once.
_EPISODES = _BASE + "".join(_PATHS.values()) + "".join(
    _outcomes(name, f"SELECT ordinal, id, 0 AS rule FROM label UNION ALL SELECT ordinal, id, 1 FROM score WHERE score >= {THRESHOLDS[name]}", f"_{name}")
    for name in _ORDERS
) + ", eps AS MATERIALIZED (" + " UNION ALL ".join(
    _episode_rows(f"'{name}' || CASE rule WHEN 1 THEN '+heuristic' ELSE '' END", f"_{name}") for name in _ORDERS
) + """), b AS (SELECT *, CASE WHEN success THEN nodes_inspected ELSE num_nodes END AS nodes_all,
  CASE WHEN success THEN actions_taken ELSE max_steps END AS steps_all FROM eps)"""
ORACLE["search_metrics"] = graph_sql(f"SELECT method, {metric_sql()} FROM b GROUP BY method", _EPISODES)
ORACLE["heuristic_methods"] = graph_sql(f"SELECT method, {metric_sql()} FROM b WHERE method LIKE '%+heuristic' GROUP BY method", _EPISODES)
ORACLE["search_end_reasons"] = graph_sql(
    "SELECT method, end_reason, round(count(*) / sum(count(*)) OVER (PARTITION BY method), 6) AS share FROM b GROUP BY method, end_reason", _EPISODES
)
ORACLE["search_across_seeds"] = graph_sql(
    "SELECT method, count(DISTINCT seed) AS seeds, "
    + ", ".join(f"round(avg({n}), 6) AS {n}_mean, round(stddev_pop({n}), 6) AS {n}_std" for n in metrics.METRIC_COLUMNS[1:])
    + " FROM m GROUP BY method",
    _EPISODES + f", m AS (SELECT method, seed, {metric_sql(False)} FROM b GROUP BY method, seed)",
)
_TABLE = _BASE + "".join(_PATHS.values()) + "".join(_outcomes(name, _GRID_RULE, f"_{name}") for name in _ORDERS) + ", curve AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS method, rule, success, d, inspected, moves, rv, final FROM ep_{name}" for name in _ORDERS
) + f"""), tab AS MATERIALIZED (SELECT method, 'heuristic' AS scorer, rule AS threshold, count(*) AS episodes,
  round(avg(CAST(success AS INT)), 6) AS success_rate, round(avg(CAST(d IS NOT NULL AS INT)), 6) AS declared_rate,
  round(avg(inspected), 6) AS nodes_inspected, {_MEAN_RETURN} AS cumulative_reward,
  sum(CAST(success AS INT)) AS wins, sum(inspected) AS seen FROM curve GROUP BY method, rule)"""
ORACLE["all_thresholds"] = graph_sql("SELECT * EXCLUDE (wins, seen) FROM tab", _TABLE)
ORACLE["best_thresholds_by_method"] = graph_sql(
    "SELECT * EXCLUDE (wins, seen) FROM tab QUALIFY row_number() OVER (PARTITION BY method ORDER BY wins DESC, seen, threshold) = 1", _TABLE
)

# Walks that may declare several times: the j-th declaration, at position q, is action q + j.


def _declares(limit: int, rules: str, backtrack: bool = True) -> str:
    """Outcomes ``many`` of depth-first walks with ``limit`` declarations under ``rules(ordinal, id)``."""
    walk = _WALK if backtrack else _WALK.replace("WHERE nx IS NOT NULL OR len(path) > 1)", "WHERE nx IS NOT NULL)")
    return _BASE + walk + f""",
fire AS MATERIALIZED ({rules}),
asked AS MATERIALIZED (
  SELECT ordinal, id, q, row_number() OVER (PARTITION BY ordinal ORDER BY q) - 1 AS j,
    EXISTS (SELECT 1 FROM label l WHERE l.ordinal = x.ordinal AND l.id = x.id) AS hit
  FROM (SELECT w.ordinal, w.node AS id, min(w.t) AS q FROM walk w JOIN fire f ON f.ordinal = w.ordinal AND f.id = w.node
        JOIN node n ON n.ordinal = w.ordinal AND n.id = w.node WHERE n.kind NOT IN ('ENTRY', 'EXIT') GROUP BY ALL) x),
may AS (SELECT a.*, min(j) FILTER (a.hit) OVER (PARTITION BY ordinal) AS first_hit FROM asked a JOIN size z USING (ordinal)
  WHERE j < {limit} AND q + j < least(200, 4 * n)),
made AS MATERIALIZED (SELECT * FROM may WHERE first_hit IS NULL OR j <= first_hit),
sums AS (SELECT ordinal, count(*) AS made, coalesce(bool_or(hit), false) AS success, max(q) AS last, max_by(id, j) AS declared_node, min_by(hit, j) AS first_right,
    string_agg(CAST(id AS VARCHAR), ',' ORDER BY j) AS declared FROM made GROUP BY ordinal),
many0 AS (SELECT k.ordinal, k.sample_id, z.n, least(200, 4 * z.n) AS cap, coalesce(made, 0) AS made, coalesce(success, false) AS success, last, declared_node,
    coalesce(first_right, false) AS first_right, coalesce(declared, '') AS declared,
    (SELECT max(t) FROM walk w WHERE w.ordinal = k.ordinal) AS all_moves
  FROM kept k JOIN size z USING (ordinal) LEFT JOIN sums USING (ordinal)),
many1 AS (SELECT *, NOT success AND made = {limit} AS spent, NOT (success OR made = {limit}) AND all_moves + made >= cap AS over FROM many0),
many AS MATERIALIZED (SELECT m.*, CASE WHEN success OR spent THEN last WHEN over THEN cap - made ELSE all_moves END AS moves FROM many1 m),
result AS MATERIALIZED (SELECT m.*, w.node AS here, len(w.met) AS inspected, len(w.path) - 1 AS depth,
    CAST(moves * -0.01 + (made - CASE WHEN success THEN 1 ELSE 0 END) * -0.5 + CASE WHEN success THEN 1.0 WHEN spent THEN 0.0 ELSE -0.5 END AS DOUBLE) AS cumulative_reward,
    (SELECT min(x.t) FROM walk x JOIN label l ON l.ordinal = x.ordinal AND l.id = x.node WHERE x.ordinal = m.ordinal AND x.t <= m.moves) AS hit_at
  FROM many m JOIN walk w ON w.ordinal = m.ordinal AND w.t = m.moves)"""


def _declare_episodes(label: str, stuck: str) -> str:
    return (
        f"SELECT '{label}' AS method, CAST(0 AS INTEGER) AS seed, 'val' AS split, e.sample_id AS graph_id, c.project, c.cwe,"
        " CAST(n AS INTEGER) AS num_nodes, CAST((SELECT count(*) FROM label l WHERE l.ordinal = e.ordinal) AS INTEGER) AS num_vuln,"
        " CAST(coalesce(dist.d, -1) AS INTEGER) AS dist_to_vuln, CAST(cap AS INTEGER) AS max_steps, success, first_right AS first_declare_correct,"
        " CAST(inspected AS INTEGER) AS nodes_inspected, CAST(moves + made AS INTEGER) AS actions_taken, round(cumulative_reward, 6) AS cumulative_reward,"
        " CAST(hit_at + (SELECT count(*) FROM made m WHERE m.ordinal = e.ordinal AND m.q < hit_at) AS INTEGER) AS first_hit_step,"
        f" CASE WHEN success THEN 'correct' WHEN spent THEN 'wrong_declare' WHEN over THEN 'timeout' {stuck} ELSE 'exhausted' END AS end_reason"
        " FROM result e JOIN corpus c USING (ordinal) LEFT JOIN dist USING (ordinal)"
    )


_THREE = _declares(3, "SELECT ordinal, id FROM score WHERE score >= 0.1")
ORACLE["dfs_three_declares"] = graph_sql(_declare_episodes("dfs+heuristic", ""), _THREE)
# Without going back a walk is stuck where no edge leads on and nothing is left to declare.
ORACLE["dfs_without_backtracking"] = graph_sql(
    _declare_episodes(
        "dfs",
        "WHEN NOT EXISTS (SELECT 1 FROM leads l WHERE l.ordinal = e.ordinal AND l.u = e.here) AND (EXISTS (SELECT 1 FROM node x"
        " WHERE x.ordinal = e.ordinal AND x.id = e.here AND x.kind IN ('ENTRY', 'EXIT')) OR EXISTS (SELECT 1 FROM made m WHERE m.ordinal = e.ordinal AND m.id = e.here))"
        " THEN 'dead_end'",
    ),
    _declares(1, "SELECT ordinal, id FROM label", backtrack=False),
)
_ACTIONS = """, acts AS MATERIALIZED (
  SELECT r.ordinal, r.sample_id, a.t + (SELECT count(*) FROM made m WHERE m.ordinal = r.ordinal AND m.q <= a.t) AS t, a.node,
    CASE WHEN len(b.path) < len(a.path) THEN 'BACKTRACK' ELSE 'MOVE_' || CAST(list_position(l.vs, b.node) - 1 AS VARCHAR) END AS action,
    b.node AS next_node, CAST(-0.01 AS DECIMAL(9, 2)) AS gain
  FROM result r JOIN walk a ON a.ordinal = r.ordinal AND a.t < r.moves JOIN walk b ON b.ordinal = a.ordinal AND b.t = a.t + 1
  LEFT JOIN leads l ON l.ordinal = a.ordinal AND l.u = a.node
  UNION ALL SELECT r.ordinal, r.sample_id, m.q + m.j, m.id, 'DECLARE', m.id, CASE WHEN m.hit THEN 1.0 ELSE -0.5 END FROM result r JOIN made m USING (ordinal)),
charged AS (SELECT a.*, gain + CASE WHEN NOT r.success AND NOT r.spent AND a.t = r.moves + r.made - 1 THEN -0.5 ELSE 0 END AS reward
  FROM acts a JOIN result r USING (ordinal))"""
ORACLE["declared_steps"] = graph_sql(
    "SELECT sample_id AS graph_id, 'dfs+heuristic' AS method, CAST(t AS INTEGER) AS t, node, action, next_node, round(CAST(reward AS DOUBLE), 6) AS reward,"
    " round(CAST(sum(reward) OVER (PARTITION BY ordinal ORDER BY t) AS DOUBLE), 6) AS total FROM charged",
    _THREE + _ACTIONS,
)
# After all steps: the walk's last node, its path back, and every edge it went forward on.
_REPLAY = (
    "SELECT sample_id AS graph_id, CAST(here AS INTEGER) AS current, CAST(inspected AS INTEGER) AS visited, CAST(depth AS INTEGER) AS depth, declared,"
    " CAST((SELECT count(DISTINCT (node, next_node)) FROM charged a WHERE a.ordinal = r.ordinal AND action LIKE 'MOVE%') AS INTEGER) AS edges,"
    " round(CAST(coalesce((SELECT sum(reward) FROM charged a WHERE a.ordinal = r.ordinal), 0) AS DOUBLE), 6) AS running_return, true AS finished FROM result r"
)
ORACLE["replay_three_declares"] = graph_sql(_REPLAY, _THREE + _ACTIONS)
ORACLE["replay_fold"] = graph_sql(_REPLAY, _declares(1, "SELECT ordinal, id FROM label") + _ACTIONS)
# Traces are of seed 0; steps back are what is left of a walk's moves without its forward ones.
_TRACED = ", traced AS (" + " UNION ALL ".join(
    f"SELECT '{name}' || CASE rule WHEN 1 THEN '+heuristic' ELSE '' END AS method, moves, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS declares,"
    + (" moves - (inspected - 1) - rv AS backs" if name in _WALKS else " NULL AS backs")
    + f" FROM ep_{name} WHERE seed = 0 AND (rule = 0{' OR rule = 1' if name == 'bfs' else ''})"
    for name in _ORDERS
) + ")"
ORACLE["trace_checks"] = graph_sql(
    "SELECT method, count(*) AS traces, CAST(0 AS BIGINT) AS broken, CAST(sum(moves + declares) AS BIGINT) AS steps FROM traced GROUP BY method", _EPISODES + _TRACED
)
ORACLE["action_mix"] = graph_sql(
    "SELECT method, CAST(sum(moves + declares) AS BIGINT) AS actions, round(coalesce(sum(moves - backs), 0) / sum(moves + declares), 6) AS move_share,"
    " round(coalesce(sum(backs), 0) / sum(moves + declares), 6) AS backtrack_share, round(sum(declares) / sum(moves + declares), 6) AS declare_share,"
    " round(CASE WHEN method IN ('dfs', 'random_walk') THEN 0 ELSE sum(moves) END / sum(moves + declares), 6) AS inspect_share FROM traced GROUP BY method",
    _EPISODES + _TRACED,
)
