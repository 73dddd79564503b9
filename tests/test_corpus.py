import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lineflow.config import FilterConfig
from lineflow.functions import text
from lineflow.operators import attrition, eda
from lineflow.operators.positions import medians, positioned, running_totals
from lineflow.sources import corpus, files


def col_values(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_cwe_and_flaw_fields(spark):
    assert col_values(spark, ["CWE-119", "119", "119.0", "CWE-0125", "none", None], text.normalise_cwe) == [
        "CWE-119", "CWE-119", "CWE-119", "CWE-125", "", ""]
    assert col_values(spark, ["1,2, 5", "[3, 4]", "-1", "", None], text.parse_flaw_line_indices) == [
        [1, 2, 5], [3, 4], [1], [], []]
    assert col_values(spark, ["a;/~/b;", "x", "", None], text.parse_flaw_lines) == [["a;", "b;"], ["x"], [], []]


def test_comments_match_regular_expressions(spark):
    rng = random.Random(5)
    parts = ["/*", "*/", "//", "\n", " ", "a", "{", "}", ";", "é", "\t", " ", "* "]
    codes = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]
    codes += ["int a; /* x\ny */ int b; // c\n}", "a /* b */ c\n/* d", '"http://x"']

    def plain(code):
        kept = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), code, flags=re.S)
        return re.sub(r"//[^\n]*", "", kept)

    assert col_values(spark, codes, text.strip_comments) == [plain(c) for c in codes]
    masks = [[not re.match(r"^[\s{}();]*$", x) for x in plain(c).split("\n")] for c in codes]
    assert col_values(spark, codes, text.code_line_mask) == masks
    bodies = [re.sub(r"\s+", " ", plain(c)).strip() for c in codes]
    assert col_values(spark, codes, text.normalise_body) == bodies
    singles = ["// x", " * doc", "*", "*/", "};", "x = 1;", "  /* y */", "{ a"]
    assert col_values(spark, singles, text.is_trivial_line) == [True, True, True, True, True, False, True, False]


BODY = "int f() {\n a = 1;\n %s\n b = 2;\n}"


def cascade_rows():
    good = BODY % "bad();"
    rows = [
        ("ok", "CWE-119", 1, good, BODY % "good();"),
        ("not vulnerable", "CWE-119", 0, BODY % "q();", BODY % "r();"),
        ("other cwe", "CWE-79", 1, BODY % "s();", BODY % "t();"),
        ("no change", "CWE-125", 1, BODY % "u();", BODY % "u();"),
        ("comment only", "CWE-125", 1, BODY % "// v", BODY % "// w"),
        ("short", "CWE-119", 1, "int f() {\n x();\n}", "int f() {\n}"),
        ("copy", "CWE-125", 1, good.replace(" b = 2;", "  b  = 2;  // same").replace("  =", " ="), BODY % "z();"),
        ("second", "125", 1, BODY % "other();", BODY % "fixed();"),
    ]
    return [(i, *r) for i, r in enumerate(rows)]


def test_filter_cascade(spark):
    raw = spark.createDataFrame(
        cascade_rows(), "ordinal long, project string, `CWE ID` string, vul int, func_before string, func_after string"
    ).withColumn("commit_id", F.col("project"))
    frame = corpus.canonicalise(raw)
    steps = [r.rows for r in attrition.attrition(frame).orderBy("position").collect()]
    assert steps == [8, 7, 6, 5, 4, 3, 2]
    kept = attrition.filter_corpus(frame).orderBy("ordinal").collect()
    assert [r.project for r in kept] == ["ok", "second"]
    assert kept[0].flaw_lines == [" bad();"] and kept[0].flaw_line_indices == [2]
    by_cwe = {(r.cwe, r.step): r.rows for r in attrition.attrition_by_cwe(frame, ["CWE-119", "CWE-125"]).collect()}
    assert by_cwe["CWE-119", "selected_cwes"] == 2 and by_cwe["CWE-119", "deduplicated"] == 1
    assert by_cwe["CWE-125", "selected_cwes"] == 4 and by_cwe["CWE-125", "deduplicated"] == 2
    counts = {r.cwe: r.functions for r in eda.vulnerable_cwe_counts(frame).collect()}
    assert counts == {"CWE-119": 2, "CWE-79": 1, "CWE-125": 4}


def test_column_resolution():
    assert corpus.resolve_columns(["project", "commit_id", "CWE ID", "target", "processed_func", "func_after"])["vul"] == "target"
    with pytest.raises(corpus.CorpusFormatError, match="func_after"):
        corpus.resolve_columns(["project", "commit_id", "cwe", "vul", "func_before"])
    with pytest.raises(corpus.CorpusFormatError, match="commit_id"):
        corpus.resolve_columns(["project", "cwe", "vul", "func_before", "func_after"])


def test_loading_releases(spark, tmp_path):
    rows = [(f"p{i}", f"c{i}", "CWE-119", "1" if i % 2 else "x", f"int f{i}() {{\n\"a,b\"\n}}", "") for i in range(7)]
    ddl = "project string, commit_id string, `CWE ID` string, target string, processed_func string, func_after string"
    df = spark.createDataFrame(rows, ddl).coalesce(1)
    df.write.csv(str(tmp_path / "r.csv"), header=True, quote='"', escape='"')
    one = corpus.load_corpus(spark, str(tmp_path / "r.csv")).orderBy("ordinal").collect()
    assert [r.sample_id for r in one] == [f"bigvul_{i:06d}" for i in range(7)]
    assert [r.vul for r in one] == [i % 2 for i in range(7)] and one[3].func_before == rows[3][4]
    folder = tmp_path / "parts"
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(folder / f"p{i}"))
    merged = corpus.load_corpus(spark, str(folder / "*"))
    assert sorted((r.ordinal, r.project) for r in merged.select("ordinal", "project").collect()) == [
        (i, f"p{i}") for i in range(7)]
    back = corpus.convert_to_parquet(spark, str(folder / "*"), str(tmp_path / "canon"))
    assert back.count() == 7 and {"sample_id", "flaw_lines", "ordinal"} <= set(back.columns)
    with pytest.raises(corpus.CorpusFormatError):
        corpus.load_corpus(spark, str(tmp_path / "missing"))


def test_source_files(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"s{i}", f"a{i}\r\nb\rc") for i in range(5)], "ordinal long, sample_id string, func_before string")
    listed = files.write_sources(frame, str(tmp_path / "out"), batch_size=2).orderBy("sample_id").collect()
    assert [r.batch for r in listed] == ["batch_0000", "batch_0000", "batch_0001", "batch_0001", "batch_0002"]
    assert (tmp_path / "out" / "batch_0002" / "s4.cpp").read_bytes() == b"a4\nb\nc\n"
    assert os.path.exists(tmp_path / "out" / listed[1].path)
    with pytest.raises(ValueError, match="unique"):
        files.write_sources(frame.unionByName(frame), str(tmp_path / "again"))


def test_positions_and_running_totals(spark):
    rng = random.Random(1)
    ordinals = rng.sample(range(10_000), 700)
    df = spark.createDataFrame([(o,) for o in ordinals], "ordinal long")
    got = {r.ordinal: r.p for r in positioned(df, "ordinal", "p", width=97).collect()}
    assert got == {o: i for i, o in enumerate(sorted(ordinals))}
    values = [(g, float(v)) for g in "ab" for v in rng.choices(range(60), k=301)]
    vals = spark.createDataFrame(values, "g string, v double")
    counts = vals.groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in running_totals(counts, "v", ["n"], ["g"], bucket_rows=17).collect():
        mine = [v for g, v in values if g == r.g]
        assert (r.n_before, r.n_all) == (sum(v < r.v for v in mine), len(mine))
    import statistics

    assert {r.g: r["median"] for r in medians(counts, "v", ["g"]).collect()} == {
        g: statistics.median(v for h, v in values if h == g) for g in "ab"}


def test_join_with_hot_keys(spark):
    from lineflow.operators.positions import join_lookup

    rows = [("hot", i) for i in range(500)] + [(f"k{i % 300}", i) for i in range(600)] + [(None, 1), ("lone", 2)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(300)], "k string, v string")
    plain = left.join(right, "k", "left")
    assert sorted(map(str, join_lookup(left, right, "k").collect())) == sorted(map(str, plain.collect()))
    assert join_lookup(left, right, "k", "inner").count() == 1100


def test_broken_labels_and_long_digit_runs(spark):
    from lineflow.functions import text
    from lineflow.sources.corpus import canonicalise

    assert spark.sql("SELECT '2,99999999999,x7' AS v").select(
        text.parse_flaw_line_indices(F.col("v")).alias("i")).first().i == [2, 2**31 - 1, 7]
    for value in ("'nan'", "double('NaN')", "'1e300'", "''", "NULL"):
        raw = spark.sql(
            f"SELECT 0L AS ordinal, 'p' AS project, 'c' AS commit_id, 'CWE-1' AS `CWE ID`, {value} AS vul, 'f' AS func_before, 'f' AS func_after")
        assert canonicalise(raw, "ordinal").first().vul == 0
