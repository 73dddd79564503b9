"""Named files: staged by task attempt, committed once, nothing stray."""

import os
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lineflow.sources import files, folder

ROW = "folder string, name string, text string"


def found(path):
    return {str(p.relative_to(path)): p.read_text() for p in Path(path).rglob("*") if p.is_file()}


def test_files_are_written_and_folders_replaced(spark, tmp_path):
    rows = [(f"f{i % 3}", f"{i}.txt", f"text é {i}\r\n") for i in range(30)]
    folder.write_files(spark.createDataFrame(rows, ROW), f"file://{tmp_path}/out")
    want = {f"{f}/{n}": t for f, n, t in rows}
    got = {k: (tmp_path / "out" / k).read_bytes().decode() for k in found(tmp_path / "out")}
    assert got == want and sorted(os.listdir(tmp_path / "out")) == ["f0", "f1", "f2"]
    folder.write_files(spark.createDataFrame([("f1", "new.txt", "x")], ROW), f"{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out" / "f1")) == ["new.txt"]
    assert len(os.listdir(tmp_path / "out" / "f0")) == 10
    folder.write_files(spark.createDataFrame([], ROW), f"{tmp_path}/out")
    assert len(found(tmp_path / "out")) == 21


def test_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(20).select(
        F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("folder"), F.col("id").cast("string").alias("name"),
        F.when(F.col("id") == 13, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x")).cast("string").alias("text"),
    )
    with pytest.raises(Exception, match="broken row"):
        folder.write_files(rows, f"{tmp_path}/out")
    assert found(tmp_path) == {}


def test_only_committed_attempts_are_moved(tmp_path, monkeypatch):
    """A retried and a speculative attempt wrote the same rows: one of each task is committed."""
    writer = folder.FolderWriter(str(tmp_path / "out"), uuid.uuid4().hex)
    messages = []

    class Context:
        def __init__(self, partition, attempt):
            self.pair = partition, attempt

        def partitionId(self):
            return self.pair[0]

        def taskAttemptId(self):
            return self.pair[1]

    for partition, attempt, text in ((0, 1, "first try"), (0, 5, "second try"), (1, 2, "b"), (1, 6, "b again")):
        monkeypatch.setattr(folder.TaskContext, "get", staticmethod(lambda c=Context(partition, attempt): c))
        messages.append(writer.write(iter([{"folder": f"f{partition}", "name": "a.txt", "text": text}])))
    assert len(found(tmp_path)) == 4
    writer.commit([messages[1], messages[2]])
    assert found(tmp_path / "out") == {"f0/a.txt": "second try", "f1/a.txt": "b"}
    with pytest.raises(ValueError):
        writer.commit([messages[1], messages[1]])


def test_sources_round_trip(spark, tmp_path):
    rows = [(f"s{i}", i, f"int f{i}();\r\n}}" + "\n" * (i % 2)) for i in range(23)]
    frame = spark.createDataFrame(rows, "sample_id string, ordinal long, func_before string")
    listed = files.write_sources(frame, f"{tmp_path}/src", batch_size=5)
    assert {r.batch for r in listed.collect()} == {f"batch_{i:04d}" for i in range(5)}
    back = files.read_sources(spark, f"{tmp_path}/src").collect()
    assert len(back) == 46 and {r.extension for r in back} == {".c", ".cpp"}
    want = {s: t.replace("\r\n", "\n").rstrip("\n") + "\n" for s, _, t in rows}
    assert all(r.text == want[r.sample_id] for r in back)
    assert not [p for p in Path(tmp_path, "src").rglob("*") if folder.STAGING in str(p)]


def test_sources_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([(f"s{i}", i, f"int f{i}();") for i in range(40)], "sample_id string, ordinal long, text string")
    kept = rows.withColumnRenamed("text", "func_before").filter(counted("func_before") != "")
    listed = files.write_sources(kept, f"{tmp_path}/src", batch_size=5)
    assert seen.value == 40 and listed.count() == 40
    assert {r.sample_id: r.batch for r in listed.collect()} == {f"s{i}": f"batch_{i // 5:04d}" for i in range(40)}


def test_sources_are_read_by_folder(spark, tmp_path):
    """400 small files in 40 folders are two tasks' work."""
    rows = [(f"batch_{i // 5:04d}", f"s{i}", f"a\r\nb é {i}\n") for i in range(200)]
    folder.write_files(spark.createDataFrame(rows, ROW), f"{tmp_path}/src", (".c", ".cpp"))
    (tmp_path / "src" / "batch_0000" / ".hidden.c").write_text("x")
    (tmp_path / "src" / "batch_0000" / "empty.c").write_text("")
    (tmp_path / "src" / "other").mkdir()
    (tmp_path / "src" / "other" / "s.c").write_text("x")
    back = files.read_sources(spark, f"file://{tmp_path}/src")
    assert back.rdd.getNumPartitions() == 2
    want = [(s, b, e, t) for b, s, t in rows for e in (".c", ".cpp")]
    assert sorted(map(tuple, back.collect())) == sorted(want)
    with pytest.raises(Exception, match="no folder"):
        files.read_sources(spark, f"{tmp_path}/src/other").collect()


def test_long_texts_are_handed_on_in_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "BATCH_BYTES", 10)
    (tmp_path / "f").mkdir()
    for i in range(5):
        (tmp_path / "f" / f"{i}.c").write_bytes(b"\xff" + b"x" * 6)
    reader = folder.FolderReader(str(tmp_path), "*")
    got = [batch for part in reader.partitions() for batch in reader.read(part)]
    assert [b.num_rows for b in got] == [2, 2, 1] and got[0].schema.names == ["folder", "name", "text"]
    assert sorted(n for b in got for n in b.column("name").to_pylist()) == [f"{i}.c" for i in range(5)]
