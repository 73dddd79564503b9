"""Quoted CSV in parallel against the reader that takes a file whole."""

import csv
import random

import pytest

from lineflow.sources import quoted
from lineflow.sources.corpus import load_corpus

PARTS = ["a", "b", " ", ",", '"', '"', "\n", "\r\n", "\n\n", "é", "x" * 40, "\\", "'", "#", ""]


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def put(path, rows, end, blanks=True):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["id", "a b", 'q"x\ny'])
        for i, row in enumerate(rows):
            writer.writerow([i, *row])
            if blanks and i % 50 == 0:
                out.write(end)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_tasks(spark, tmp_path, small_blocks, end):
    rng = random.Random(end)
    rows = [["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 8))) for _ in range(2)] for _ in range(400)]
    rows[200][0] = '"\n,' * 2000  # a record over several blocks
    path = str(tmp_path / "one.csv")
    put(path, rows, end)
    want = [tuple(r) for r in spark.read.csv(path, **quoted.OPTIONS).collect()]
    got = quoted.read_csv(spark, path)
    assert quoted._lines(spark, path).rdd.getNumPartitions() > 20
    assert got.columns == ["id", "a b", 'q"x\ny', "ordinal"]
    rows = [tuple(r) for r in got.orderBy("ordinal").collect()]
    assert [r[:-1] for r in rows] == want and [r[-1] for r in rows] == list(range(len(want)))


def test_a_folder_of_files_and_files_without_rows(spark, tmp_path, small_blocks):
    folder = tmp_path / "all.csv"
    folder.mkdir()
    for name, rows in (("a", [["1", "x\ny"]] * 30), ("b", []), ("c", [["2", ""]] * 3)):
        put(folder / f"{name}.csv", rows, "\n")
    got = [tuple(r) for r in quoted.read_csv(spark, str(folder)).orderBy("ordinal").collect()]
    assert [r[1] for r in got] == ["1"] * 30 + ["2"] * 3
    assert got[0][2] == "x\ny" and got[-1][2] is None and [r[3] for r in got] == list(range(33))


def test_release_from_csv(spark, tmp_path, small_blocks):
    path = str(tmp_path / "release.csv")
    body = 'int f() {\n  puts("a, b");\n}\n'
    with open(path, "w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(["", "project", "commit_id", "CWE ID", "vul", "func_before", "func_after"])
        for i in range(60):
            writer.writerow([i, "p", f"c{i}", "CWE-119", i % 2, body, body.replace("a", "z")])
    rows = load_corpus(spark, path).orderBy("ordinal").collect()
    assert [r.commit_id for r in rows] == [f"c{i}" for i in range(60)]
    assert rows[3].sample_id == "bigvul_000003" and rows[3].vul == 1
    assert all(r.func_before == body.replace("\r\n", "\n") for r in rows)
