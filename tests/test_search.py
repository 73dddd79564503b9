import numpy as np
import pytest
from conftest import diamond, line, loop, switch, tree
from pyspark.sql import functions as F

from lineflow.config import EnvConfig
from lineflow.operators import metrics, search, traces
from lineflow.operators.features import with_heuristic_score


def orders(graphs, name, **options):
    rows = search.run_evaluation(graphs, [name], episodes=False, **options).collect()
    return {r.sample_id: r for r in rows}


def test_orders_of_the_tree(make_graphs):
    g = make_graphs(tree(vuln=6))
    assert orders(g, "bfs")["tree"].visit_order == [0, 1, 2, 3, 4, 5, 6]
    dfs = orders(g, "dfs")["tree"]
    assert dfs.visit_order == [0, 1, 2, 4, 7, 5, 3, 6]
    assert (dfs.actions_taken, dfs.success, dfs.nodes_inspected) == (12, True, 8)


def test_heuristic_first_order(make_graphs):
    g = make_graphs(
        {"id": "scored", "kinds": ["ENTRY", "BRANCH", "ASSIGN", "ASSIGN", "CALL", "CALL", "EXIT"],
         "edges": [(0, 1), (1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 6)], "vuln": [5],
         "code": ["", "if (x)", "y", "a = b + c", "g(y)", "memcpy(a, b, n)", ""],
         "calls": [[], [], [], [], ["g"], ["memcpy"], []]})
    scored = with_heuristic_score(g)
    assert scored.first().score[5] == pytest.approx(3 / 10.5)
    got = orders(scored, "heuristic_first", threshold=0.99)["scored"]
    assert got.visit_order == [0, 1, 3, 5, 2, 4, 6] and got.end_reason == "exhausted"
    assert got.cumulative_reward == pytest.approx(-0.06 - 0.5)
    found = orders(scored, "heuristic_first", threshold=0.2)["scored"]
    assert (found.success, found.actions_taken, found.declared_node) == (True, 4, 5)


def test_line_order_budget(make_graphs):
    g = make_graphs(line(9, vuln=7))
    whole = orders(g, "line_order")["line9"]
    assert (whole.actions_taken, whole.nodes_inspected, whole.first_hit_step) == (8, 8, 7)
    assert whole.cumulative_reward == pytest.approx(-0.07 + 1)
    # The node reached with the last step is inspected but neither hit nor declared.
    cut = orders(g, "line_order", env=EnvConfig(max_steps_cap=7))["line9"]
    assert (cut.end_reason, cut.actions_taken, cut.nodes_inspected, cut.first_hit_step) == ("timeout", 7, 8, None)
    assert cut.cumulative_reward == pytest.approx(-0.07 - 0.5)


# What each graph's walk with backtracking does up to its declaration, counted by hand:
# success, nodes inspected, actions, return before revisits, declared node.
WALKS = {
    "line3": (True, 4, 4, 0.97, 3),
    "loop": (True, 4, 4, 0.97, 3),
    "diamond": (True, 6, 9, 0.92, 3),
}


def test_depth_first_walks_by_hand(make_graphs):
    got = orders(make_graphs(line(3, vuln=3), loop(), diamond()), "dfs")
    for name, (success, nodes, actions, _, declared) in WALKS.items():
        r = got[name]
        assert (r.success, r.nodes_inspected, r.actions_taken, r.declared_node) == (success, nodes, actions, declared), name
    assert got["line3"].cumulative_reward == pytest.approx(0.97)


def test_refused_evaluations(make_graphs):
    with pytest.raises(search.TestSplitError):
        search.run_evaluation(make_graphs(loop()), ["bfs"], split="test")
    with pytest.raises(ValueError, match="unknown baseline"):
        search.run_evaluation(make_graphs(loop()), ["nope"])
    with pytest.raises(Exception, match="out-degree"):
        search.run_evaluation(make_graphs(switch(8)), ["bfs"]).collect()


def test_random_order_is_fair(make_graphs):
    rows = search.run_evaluation(make_graphs(line(4, vuln=2)), ["random_order"], seeds=range(400))
    places = [r.nodes_inspected for r in rows.collect()]
    assert abs(np.mean(places) - 3.5) < 0.3 and set(places) == {1, 2, 3, 4, 5, 6}


CODE = ["", "if (n > 3)", "memcpy(a, b, n);", "x = y[i] + 1;", "strcpy(d, s);", "return;", "p->q = 0;", "", ""]
CALLS = [[], [], ["memcpy"], [], ["strcpy"], [], [], [], []]


def scored_graphs(make_graphs):
    """Small graphs of every shape, with code that scores differently."""
    specs = []
    for i, make in enumerate((line, loop, diamond, tree, lambda **m: switch(3, **m)) * 4):
        spec = make(vuln=2 + i % 2)
        n = len(spec["kinds"])
        turn = [(k + i) % 9 for k in range(n)]
        specs.append(spec | {"id": f"g{i}", "code": [CODE[k] for k in turn], "calls": [CALLS[k] for k in turn]})
    return with_heuristic_score(make_graphs(*specs))


def test_threshold_curve(make_graphs):
    scored = scored_graphs(make_graphs)
    curve = search.threshold_curve(scored, "line_order", (0.05, 0.2, 0.99)).orderBy("threshold").collect()
    for r in curve:
        one = search.run_evaluation(scored, ["line_order"], threshold=r.threshold)
        m = metrics.compute_metrics(one).first()
        assert r.success_rate == pytest.approx(m.success_rate) and m.method == "line_order+heuristic"
    assert curve[-1].declared_rate == 0.0
    best = search.best_threshold(search.threshold_curve(scored, "line_order", (0.05, 0.2, 0.99))).first()
    assert best.success_rate == max(r.success_rate for r in curve)


def test_threshold_table_is_all_curves(make_graphs):
    scored, grid, seeds = scored_graphs(make_graphs), (0.99, 0.05, 0.2, 0.2, 0.0, 5.0), (0, 1, 2)
    names = ("dfs", "bfs", "line_order", "heuristic_first", "random_walk", "random_order")
    table = {(r.method, r.threshold): r for r in search.threshold_table(scored, names, grid, seeds=seeds).collect()}
    assert len(table) == len(names) * 5
    for name in names:
        for r in search.threshold_curve(scored, name, sorted(set(grid)), seeds=seeds).collect():
            t = table[name, r.threshold]
            for column in ("success_rate", "declared_rate", "nodes_inspected", "cumulative_reward"):
                assert t[column] == pytest.approx(r[column], abs=1e-12), (name, r.threshold, column)
    best = {r.method: r for r in search.best_thresholds(search.threshold_table(scored, names, grid, seeds=seeds)).collect()}
    assert all(best[m].success_rate >= t.success_rate for (m, _), t in table.items())


def test_random_walks_depend_on_seed_graph_and_step_only(make_graphs):
    scored = scored_graphs(make_graphs)
    all_rows = {r.graph_id: r for r in search.run_evaluation(scored, ["random_walk"], seeds=(4,)).collect()}
    some = search.run_evaluation(scored.filter("sample_id IN ('g3', 'g7')"), ["random_walk"], seeds=(4,)).collect()
    assert len(some) == 2 and all(all_rows[r.graph_id] == r for r in some)
    other = {r.graph_id: r for r in search.run_evaluation(scored, ["random_walk"], seeds=(5,)).collect()}
    assert any(all_rows[i].actions_taken != other[i].actions_taken for i in other)


@pytest.mark.parametrize("limit", [2, 3])
def test_traces_with_several_declarations(make_graphs, limit):
    from lineflow.config import EnvConfig

    scored, env = scored_graphs(make_graphs), EnvConfig(max_declares=limit)
    for name in ("dfs", "random_walk"):
        rows = traces.search_traces(scored, name, env=env, threshold=0.05)
        assert rows.filter(traces.trace_problem().isNotNull()).count() == 0
        episodes = {r.graph_id: r for r in search.run_evaluation(scored, [name], env=env, threshold=0.05).collect()}
        declared = 0
        state = {r.graph_id: r for r in traces.replay(rows).collect()}
        for r in rows.collect():
            e, steps = episodes[r.graph_id], r.steps
            assert len(steps) == e.actions_taken and r.outcome["return"] == pytest.approx(e.cumulative_reward)
            assert state[r.graph_id].running_return == pytest.approx(e.cumulative_reward)
            made = [s for s in steps if s.action == "DECLARE"]
            assert len(made) <= limit and len({s.node for s in made}) == len(made)
            assert [s.node for s in made] == state[r.graph_id].declared
            declared = max(declared, len(made))
            if e.success:
                assert steps[-1].action == "DECLARE" and steps[-1].reward == 1.0
        assert declared > 1
    with pytest.raises(ValueError):
        traces.search_traces(scored, "bfs", env=env)


def manual_trace(spark):
    steps = [(0, 0, "MOVE_0", 1, -0.01), (1, 1, "MOVE_0", 2, -0.01), (2, 2, "BACKTRACK", 1, -0.01),
             (3, 1, "MOVE_1", 3, -0.01), (4, 3, "DECLARE", 3, 1.0)]
    from lineflow.schema import TRACE_DDL

    full = [(*s, None, None, None) for s in steps]
    return spark.createDataFrame([("diamond", "manual", 0, full, (True, 3, 0.96, "correct", 4))], TRACE_DDL)


def test_replay(spark, make_graphs):
    t = manual_trace(spark)
    end = traces.replay(t, 99).first()
    assert (end.current, end.stack, end.declared, end.finished) == (3, [0, 1], [3], True)
    assert end.visits == {0: 1, 1: 2, 2: 1, 3: 1} and end.running_return == pytest.approx(0.96)
    assert {(e.u, e.v) for e in end.taken_edges} == {(0, 1), (1, 2), (1, 3)}
    mid = traces.replay(t, 3).first()
    assert (mid.current, mid.stack, mid.finished) == (1, [0], False)
    assert t.select(traces.trace_nodes().alias("n")).first().n == [0, 1, 2, 1, 3, 3]
    table = traces.step_table(t, make_graphs(diamond())).orderBy("step").collect()
    assert [(r.line, r.to_line, r["return"]) for r in table][-1] == (4, 4, 0.96)
    text = t.select(traces.outcome_text(F.lit(6)).alias("x")).first().x
    assert text == ("manual found the vulnerable statement (correct): 5 actions, 4 of 6 nodes inspected, return 0.960")
    dot = traces.cfg_dot(t, make_graphs(diamond()), 99, show_truth=True).first().dot
    assert dot.count("->") == 6 and 'n3 [label="4: s3;", fillcolor="#4caf78", penwidth=2.5, peripheries=2];' in dot
    bad = t.withColumn("steps", F.slice("steps", 2, 3))
    assert bad.select(traces.trace_problem().alias("p")).first().p == "steps not consecutive"


def test_traces_of_searches_replay_to_their_outcome(spark, make_graphs, tmp_path):
    from lineflow.sources import records

    graphs = scored_graphs(make_graphs)
    for name, threshold in (("dfs", None), ("dfs", 0.1), ("bfs", 0.1), ("random_walk", None)):
        rows = traces.search_traces(graphs, name, threshold=threshold)
        state = traces.replay(rows, 10_000).withColumnRenamed("graph_id", "g")
        both = rows.join(state.drop("method"), F.col("graph_id") == F.col("g")).collect()
        assert len(both) == 20
        for r in both:
            assert r.running_return == pytest.approx(r.outcome["return"])
            assert len(r.visits) == r.outcome.nodes_inspected or name == "bfs"
            assert r.current == r.outcome.declared_node or r.outcome.declared_node is None
    records.save_traces(rows, str(tmp_path / "t"))
    assert sorted(records.load_traces(spark, str(tmp_path / "t")).collect()) == sorted(rows.collect())
    assert records.parse_traces(records.trace_json(rows)).count() == 20
