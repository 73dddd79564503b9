"""The steps that graph and search queries share move no parse, find paths once and skip no match."""

import random
import re
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import diamond, loop, tree
from lineflow import session
from lineflow.functions import kernels
from lineflow.functions import lexical as lx
from lineflow.functions import text
from lineflow.operators import build, features, search
from lineflow.plans import views
from lineflow.schema import METHOD_DDL

SMALL = "/root/testdata/sf0.001"


def test_picked_method_is_the_selected_one(spark):
    rng, rows = random.Random(1), []
    for sample in range(60):
        for suffix in (".c", ".cpp", ".h"):
            for _ in range(rng.randint(0, 3)):
                nodes = [(n, "CALL", 1, "", "") for n in range(rng.randint(0, 4))]
                rows.append((f"src/s{sample}{suffix}", f"m{len(rows)}", rng.choice([1, 2, None]), 9, nodes, [], [], []))
    frame = spark.createDataFrame(rows, METHOD_DDL)
    grouped = build.sample_and_extension(frame).groupBy("sample_id").agg(F.collect_list(F.struct(*frame.columns)).alias("m"))

    def keyed(df):  # several first methods may be equally large
        return sorted((r.sample_id, r.m.file, r.m.line, len(r.m.nodes)) for r in df.collect())

    picked = grouped.select("sample_id", build.picked_method(F.col("m")).alias("m")).filter("m IS NOT NULL")
    assert keyed(picked) == keyed(build.select_methods(frame).withColumnRenamed("method", "m"))


def test_no_parse_is_moved(spark):
    plan = build.graphs_of(views.parsed(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_id" not in plan
    assert plan.count("hashpartitioning(body_hash") <= 1


def test_rules_share_paths(spark, make_graphs):
    scored = features.with_heuristic_score(make_graphs(diamond(), loop(), tree()))
    limits = {name: 0.05 for name in views.SEARCHERS}
    rows = search.narrowed(search.prepared(scored, search.EnvConfig()))
    both = search.run_prepared(rows, views.SEARCHERS, (None, limits), seeds=(0, 1))
    free = search.run_evaluation(scored, views.SEARCHERS, seeds=(0, 1))
    ruled = search.run_evaluation(scored, views.SEARCHERS, seeds=(0, 1), threshold=limits)
    assert sorted(map(str, both.collect())) == sorted(map(str, free.unionByName(ruled).collect()))


def test_cells_and_arrays():
    rows = [[1, 2], None, [], [3]]
    for column in (pa.array(rows, pa.list_(pa.int32())), pa.array([None, *rows], pa.list_(pa.int64())).slice(1),
                   pa.array([[1, None], None], pa.list_(pa.int32())), pa.array([1, None])):
        assert kernels.cells(column) == column.to_pylist()
    assert kernels.arrayed(rows, kernels.INTS).to_pylist() == rows
    assert kernels.arrayed([[(0, 1)], None, []], kernels.EDGES).to_pylist() == [[{"u": 0, "v": 1}], None, []]
    shape = {"depth": [0], "in_loop": [True], "back_edges": [(1, 2)]}
    assert kernels.arrayed([None, shape], kernels.SHAPE).to_pylist() == [None, {**shape, "back_edges": [{"u": 1, "v": 2}]}]
    assert kernels.arrayed([None], kernels.WALK).to_pylist() == [None]


def test_cheap_tests_skip_no_match(spark):
    rng = random.Random(2)
    parts = ["len", "LEN", "sIze", "İdx", "K", "ofſ", "off", "_", "9", "é", "*", "->", "(", ")", "[", "+", "++", "-=", "<", ">", "==",
             "!=", "sizeof", "buf", " ", "x", "int", "return", "/", "%", "num", "Pos", "ı", "sizeof("]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "code string").repartition(4)
    none = F.array().cast("array<string>")
    flags = lx.lexical_flags(F.col("code"), none, none)
    bare = F.replace(F.col("code"), F.lit("sizeof("), F.lit("sizeof#"))
    plain = {"array_subscript": lx.SUBSCRIPT, "pointer_deref": lx.DEREF, "pointer_arith": lx.POINTER_ARITH,
             "arith_op": lx.ARITH, "comparison": lx.COMPARE, "uses_sizeof": lx.SIZEOF}
    same = [flags[n] == F.col("code").rlike(p).cast("double") for n, p in plain.items()]
    same.append(flags["has_cast"] == bare.rlike(lx.CAST).cast("double"))
    found = F.exists(F.regexp_extract_all("code", F.lit(lx.IDENTIFIER), F.lit(1)), lx.is_length_like)
    same.append(flags["length_like_ident"] == found.cast("double"))
    assert rows.select([F.count_if(~s) for s in same]).first() == (0,) * len(same)
    assert rows.filter(found).count() > 100


def test_calls_before_commas(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab,é1 ", k=12)) for _ in range(2000)]
    calls = F.regexp_extract_all("x", F.lit("(?<![A-Za-z])([A-Za-z]++),"), F.lit(1))
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", calls.alias("c")).collect()
    assert all(r.c == re.findall("([A-Za-z]+),", r.x) for r in got)


def test_cycles_cost_no_square():
    size = 4000
    out = [[i - 1] if i else [] for i in range(size)]  # every edge leads back against the order of ids
    begun = time.process_time()
    assert not any(kernels.on_cycles(out))
    out[0] = [size - 1]
    assert all(kernels.on_cycles(out))
    assert kernels.on_cycles([[0, 1], [2], [1], [3, 0], []]) == [True, True, True, True, False]
    assert time.process_time() - begun < 1


def test_rows_of_no_stage_are_dropped_first(spark):
    plan = views.filtered(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    before_join = plan[plan.index("Join LeftOuter"):]
    assert "CWE-119" in before_join and "CWE-125" in before_join


def test_blanks_as_the_patterns_have_them(spark):
    rng = random.Random(4)
    parts = [*text.BLANKS, *"  ab\n*\u200b\u180e\ufeff\u2060"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(5000)] + [chr(c) for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").repartition(4)
    stripped = F.regexp_replace("x", f"^{text.SPACE}+|{text.SPACE}+$", "")
    collapsed = F.trim(F.regexp_replace("x", f"{text.SPACE}+", " "))
    wrong = [F.count_if(text.strip(F.col("x")) != stripped), F.count_if(text.collapse(F.col("x")) != collapsed)]
    assert rows.select(wrong).first() == (0, 0)


def test_shared_tables_go_to_python_in_small_batches(spark):
    @F.pandas_udf("int")
    def together(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x), dtype="int32")

    before = spark.conf.get(session.BATCH_KEY)
    rows = session.written_once(spark, "small-batches", lambda: spark.range(0, 2500, 1, 1).select(together("id").alias("n")))
    assert rows.count() == 2500
    assert rows.agg(F.max("n")).first()[0] <= session.WIDE_ROWS
    assert spark.conf.get(session.BATCH_KEY) == before
