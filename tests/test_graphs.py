import numpy as np
import pytest
from conftest import diamond, line, loop, switch, tree
from pyspark.sql import functions as F

from lineflow.config import BuildConfig
from lineflow.functions import kernels, lexical
from lineflow.operators import build, features, graphs, ranking, rewrite
from lineflow.schema import METHOD_DDL
from lineflow.sources import records


def method(file, nodes, edges, controls=(), stmts=(), line=1, line_end=0):
    return (file, "f", line, line_end, nodes, edges, list(controls), list(stmts))


SOURCE = "int f(int a) {\n  int n;\n  if (a <\n      n)\n    use(a,\n        n);\n  return 0;\n}"


def parse():
    """A header over two lines, a call over two lines, one node without a position."""
    nodes = [
        (1, "METHOD", 1, "f", ""), (2, "METHOD_RETURN", 1, "f", ""),
        (10, "CALL", 3, "<operator>.lessThan", ""), (11, "IDENTIFIER", 4, "n", ""),
        (12, "CALL", 5, "use", ""), (13, "IDENTIFIER", 6, "n", ""),
        (14, "UNKNOWN", -1, "", ""), (15, "RETURN", 7, "", ""),
    ]
    edges = [(1, 10), (10, 11), (11, 12), (11, 14), (12, 13), (13, 14), (14, 15), (15, 2)]
    controls = [("IF", 3, 3, 4)]
    stmts = [("LOCAL", 2, 2), ("CALL", 5, 6), ("RETURN", 7, 7)]
    return nodes, edges, controls, stmts


def test_line_contraction(spark):
    m = method("src/s1.c", *parse(), line_end=8)
    frame = spark.createDataFrame([m], METHOD_DDL)
    picked = build.select_methods(frame).withColumn("func_before", F.lit(SOURCE))
    row = build.line_graphs(picked).first()
    assert [n.kind for n in row.nodes] == ["ENTRY", "BRANCH", "CALL", "RETURN", "EXIT"]
    assert [n.line for n in row.nodes] == [1, 3, 5, 7, 8]
    assert row.nodes[1].code == "if (a < n)" and row.nodes[2].code == "use(a, n);"
    assert row.nodes[2].calls == ["use"] and row.nodes[1].ops == ["<operator>.lessThan"]
    assert [(e.u, e.v) for e in row.edges] == [(0, 1), (1, 2), (1, 3), (2, 3), (3, 4)]
    assert row.coverage == 1.0 and [n.depth for n in row.nodes] == [0, 1, 2, 2, 3]


def test_build_cascade(spark):
    nodes, edges, controls, stmts = parse()
    lost = [e for e in edges if e != (15, 2)]
    methods = [
        method("b/ok.c", nodes, edges, controls, stmts), method("b/ok.cpp", nodes, edges, controls, stmts),
        method("empty.c", nodes[:2], []),
        method("sparse.c", [*nodes[:2], (10, "RETURN", 7, "", "")], [(1, 10), (10, 2)]),
        method("stuck.c", nodes, lost, controls, stmts),
        method("off.c", nodes, edges, controls, stmts),
        method("decl.c", nodes, edges, controls, stmts),
        method("hidden.c", nodes, [(1, 15), (15, 2), (12, 13)], controls, stmts),
    ]
    flaw = [(4, "    use(a,")]
    rows = [("ok", flaw), ("gone", flaw), ("empty", flaw), ("sparse", flaw), ("stuck", flaw),
            ("off", [(4, "use(b,")]), ("decl", [(1, "  int n;")]), ("hidden", flaw)]
    frame = spark.createDataFrame(
        [(i, "p", "c", "CWE-119", SOURCE, [x for x, _ in f], [t for _, t in f]) for i, f in rows],
        "sample_id string, project string, commit_id string, cwe string, func_before string,"
        " flaw_line_indices array<int>, flaw_lines array<string>",
    )
    parsed = spark.createDataFrame(methods, METHOD_DDL)
    got = build.build_candidates(frame, parsed)
    reasons = {r.sample_id: r.reason for r in got.select("sample_id", "reason").collect()}
    assert reasons == {
        "ok": None, "gone": "not_parsed", "empty": "no_statements", "sparse": "low_coverage",
        "stuck": "exit_unreachable", "off": "text_mismatch", "decl": "no_flaw_on_node", "hidden": "flaw_unreachable"}
    assert [r.rows for r in build.build_attrition(got).orderBy("position").collect()] == [8, 7, 6, 4, 1, 1]
    done = build.build_graphs(frame, parsed).collect()
    assert [r.sample_id for r in done] == ["ok"] and done[0].vuln_nodes == [2]
    few = build.build_candidates(frame, parsed, BuildConfig(min_nodes=6)).filter("sample_id = 'ok'").first()
    assert few.reason == "too_few_nodes"


def test_method_choice(spark):
    nodes, edges, controls, stmts = parse()
    rows = [
        method("a.c", nodes[:4], [], line=5), method("a.c", nodes[:3], [], line=1),
        method("a.cpp", nodes[:3], [], line=1), method("b.c", nodes[:3], []), method("b.cpp", nodes, edges),
        method("d.cpp", nodes, edges), method("x/e.h", nodes, edges)]
    got = {r.sample_id: (r.method.file, len(r.method.nodes)) for r in build.select_methods(spark.createDataFrame(rows, METHOD_DDL)).collect()}
    assert got == {"a": ("a.c", 3), "b": ("b.cpp", 8), "d": ("d.cpp", 8)}


def test_dispatch_chain(make_graphs):
    got = rewrite.limit_out_degree(make_graphs(switch(5), diamond()), 3).collect()
    wide = {r.sample_id: r for r in got}["switch5"]
    after = {}
    for e in wide.edges:
        after.setdefault(e.u, set()).add(e.v)
    assert after[1] == {2, 3, 9} and after[9] == {4, 5, 6}
    assert wide.nodes[9].kind == "SWITCH" and wide.nodes[9].depth == 2 and wide.nodes[9].line == 2
    assert len({r.sample_id: r for r in got}["diamond"].nodes) == 6


def test_shapes_against_transitive_closure():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 14))
        pairs = {(int(a), int(b)) for a, b in rng.integers(n, size=(2 * n, 2)) if a != b}
        u, v = [a for a, _ in pairs], [b for _, b in pairs]
        out = kernels.targets(n, u, v)
        reach = np.zeros((n, n), dtype=bool)
        reach[u, v] = True
        for k in range(n):
            reach |= np.outer(reach[:, k], reach[k])
        assert kernels.on_cycles(out) == [bool(reach[i, i]) for i in range(n)]
        depth = kernels.hops(out, [0])
        assert [d >= 0 for d in depth] == [i == 0 or bool(reach[0, i]) for i in range(n)]
        # Without its back edges the part reachable from the start has no cycle left.
        back = set(kernels.closing_edges([sorted(r) for r in out], 0))
        rest = [(a, b) for a, b in pairs if (a, b) not in back and depth[a] >= 0]
        assert not any(kernels.on_cycles(kernels.targets(n, [a for a, _ in rest], [b for _, b in rest])))


def test_validation_and_distances(make_graphs):
    rows = graphs.with_violations(make_graphs(loop(), diamond())).collect()
    assert all(r.violations == [] for r in rows)
    broken = make_graphs(diamond()).withColumns({
        "vuln_nodes": F.array(F.lit(0), F.lit(0)), "back_edges": F.expr("array(named_struct('u', 5, 'v', 0))"),
        "edges": F.expr("concat(edges, array(named_struct('u', 1, 'v', 1)))")})
    assert set(graphs.with_violations(broken).first().violations) == {
        "duplicate_label", "stray_back_edge", "self_loop", "label_on_terminal"}
    with pytest.raises(Exception, match="diamond"):
        graphs.validated(broken).collect()
    assert graphs.distance_to_vulnerable(make_graphs(line(4, 3))).first().distance == [3, 2, 1, 0, 1, 2]
    meta = {r.graph_id: r.dist_to_vuln for r in graphs.graph_metadata(make_graphs(loop(), line(4, 3))).collect()}
    assert meta == {"loop": 3, "line4": 3}
    facts = graphs.graph_statistics(make_graphs(loop(), diamond(), line(3)))
    assert facts["graphs"] == 3 and facts["smallest_k_for_99_percent_of_nodes"] == 2
    assert facts["nodes"]["p50"] == 6.0 and facts["kinds"]["ENTRY"] == 3


def test_label_shuffle_and_renumbering(make_graphs):
    base = make_graphs(tree(), loop(), line(9))
    moved = rewrite.shuffle_labels(base, 3)
    assert all(r.violations == [] for r in graphs.with_violations(moved).collect())
    renamed = rewrite.permute_node_ids(base, 3)
    assert all(r.violations == [] for r in graphs.with_violations(renamed).collect())
    old = {r.graph_id: r.dist_to_vuln for r in graphs.graph_metadata(base).collect()}
    assert old == {r.graph_id: r.dist_to_vuln for r in graphs.graph_metadata(renamed).collect()}
    plain = {(r.sample_id, n.line): tuple(x) for r in features.featurize(base, "L").collect() for n, x in zip(r.nodes, r.x)}
    again = {(r.sample_id, n.line): tuple(x) for r in features.featurize(renamed, "L").collect() for n, x in zip(r.nodes, r.x)}
    assert set(plain) == set(again)
    header = features.TIER_S_NAMES.index("loop_header")
    assert all(a[:header] == again[k][:header] for k, a in plain.items())


CASES = {
    "array_subscript": (["buf[i] = 0;", "(x)[1]"], ["call(i);", "[x]"]),
    "pointer_deref": (["p->len", "*p = 1;", "return *q;"], ["a * b;", "int x;"]),
    "arith_op": (["a + b", "i++", "n -= 1", "x << 2"], ["a = b;", "p->q"]),
    "comparison": (["a < b", "x == y", "n >= 1"], ["p->x", "a = b", "x << 1"]),
    "uses_sizeof": (["sizeof(x)"], ["mysizeof(x)", "sizeof_t"]),
    "has_cast": (["(char *)p", "(unsigned int)n", "(size_t)x"], ["f(int)", "sizeof(int)", "(a) + b"]),
    "pointer_arith": (["*(p + 1)", "*p++", "(a + b)->c", "ptr += 2"], ["a + b", "*p"]),
    "length_like_ident": (["buf_len", "size2", "idx"], ["sizeof(x)", "lens_on"]),
}


def test_lexical_cases(spark):
    rows = [(flag, code, want) for flag, (yes, no) in CASES.items() for codes, want in ((yes, 1.0), (no, 0.0)) for code in codes]
    df = spark.createDataFrame(rows, "flag string, code string, want double")
    none = F.array().cast("array<string>")
    flags = lexical.lexical_flags(F.col("code"), none, none)
    got = F.coalesce(*[F.when(F.col("flag") == name, flags[name]) for name in CASES])
    wrong = df.filter(got != F.col("want")).collect()
    assert wrong == []
    ops = F.array(F.lit("<operator>.addition"))
    one = lexical.lexical_flags(F.lit("buf[i] < 2"), F.array(F.lit("memcpy"), F.lit("<operator>.x")), ops)
    row = spark.range(1).select(*[c.alias(n) for n, c in one.items()]).first()
    assert (row.array_subscript, row.comparison, row.arith_op, row.dangerous_call) == (0.0, 0.0, 1.0, 1.0)
    assert row.token_count == 6 / 40


def test_tiers_and_ranking(make_graphs):
    assert [features.feature_dim(t) for t in "SLE"] == [17, 30, 62]
    with pytest.raises(ValueError, match="unknown feature tier"):
        features.feature_dim("X")
    row = features.featurize(make_graphs(loop()), "L").first()
    assert len(row.x) == 6 and all(len(r) == 30 and all(0 <= v <= 1 for v in r) for r in row.x)
    with pytest.raises(Exception, match="embeddings"):
        features.featurize(make_graphs(loop()), "E").collect()
    got = ranking.chance_top_k(make_graphs(line(4, 2)), (1, 2, 4, 9)).first()
    assert [round(x, 9) for x in got] == [0.25, 0.5, 1.0, 1.0]
    scored = make_graphs(line(4, 2)).withColumn("score", F.expr("array(9D, 0.1D, 0.5D, 0.5D, 0.2D, 9D)"))
    assert tuple(ranking.top_k_accuracy(scored).first()) == (1.0, 1.0, 1.0)


def test_record_files(spark, make_graphs, tmp_path):
    base = make_graphs(loop(), diamond())
    assert records.write_graphs(base, str(tmp_path / "g")) == 2
    back = records.read_graphs(spark, str(tmp_path / "g"))
    assert sorted(back.collect()) == sorted(base.collect())
    (tmp_path / "m.jsonl").write_text(
        '{"file":"a.c","name":"f","line":1,"line_end":3,"nodes":[[124554051584,"METHOD",1,"f",""]],'
        '"edges":[[124554051584,7]],"controls":[["IF",2,2,2]],"stmts":[["LOCAL",2,2]]}\n')
    row = records.load_methods(spark, str(tmp_path)).first()
    assert row.nodes[0].id == 124554051584 and row.controls[0].type == "IF" and row.edges[0].dst == 7
