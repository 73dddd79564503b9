"""Quoted CSV read in parallel: one large file is cut into as many tasks as it has blocks.

A reader that allows line breaks inside quotes has to know, at the start of a block, whether it
stands inside a quoted field. Quotes are doubled inside such a field, so that is the parity of
all quotes before: every block counts its own, and an exclusive-or over the blocks before gives
the parity at its start. From there every line knows whether it begins a record. Lines of a block
are put together where they were read; only the lines at the head of a block that end a record
begun before it move, to the block of that beginning.

The result is the one of Spark's reader with ``multiLine``, for files whose quotes stand only
around fields or doubled inside them. As there, a file whose first line ends in ``\\r\\n`` has that
for a line end everywhere, and it reads as ``\\n`` inside a field. Blank lines between records are
skipped, and every file starts with a header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.operators.positions import small_or_plain

OPTIONS = {"quote": '"', "escape": '"', "header": "true", "multiLine": "true"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, odd): every line in the order of its block."""
    read = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", (quotes % 2).alias("odd"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record): every record of every file as text, numbered from 0 in each file."""
    lines = _lines(spark, path)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row a block.
    starts = small_or_plain(
        lines.groupBy("file", "block").agg(
            (F.sum("odd") % 2).alias("parity"), F.min_by(F.endswith("value", F.lit("\r")), "at").alias("crlf")
        ).select(
            "file", "block", (F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2).alias("inside"),
            F.first("crlf").over(Window.partitionBy("file").orderBy("block")).alias("crlf"),
        )
    )
    here = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("odd").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = (F.col("inside") + before) % 2 == 0
    bare = F.when(F.col("crlf"), F.regexp_replace("value", "\r\\z", "")).otherwise(F.col("value"))
    marked = lines.join(starts, ["file", "block"]).withColumn("value", bare).withColumn("begins", begins)
    kept = marked.filter(~(F.col("begins") & (F.col("value") == "")))
    numbered = kept.withColumn("r", F.count_if("begins").over(here))
    parts = numbered.groupBy("file", "block", "r").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("at", "value")))["value"], "\n").alias("part")
    )
    blocks = small_or_plain(parts.groupBy("file", "block").agg(F.max("r").alias("n"))).select(
        "file", "block", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"),
        # The block of the record that is still open at the start of this one.
        F.last(F.when(F.col("n") > 0, F.col("block")), ignorenulls=True).over(earlier).alias("owner"),
    )
    placed = parts.join(blocks, ["file", "block"])
    heads = placed.filter("r = 0").groupBy("file", "owner").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "part")))["part"], "\n").alias("rest")
    )
    owned = placed.filter("r > 0").join(heads.withColumnRenamed("owner", "block"), ["file", "block"], "left")
    text = F.when((F.col("r") == F.col("n")) & F.col("rest").isNotNull(), F.concat_ws("\n", "part", "rest")).otherwise(F.col("part"))
    return owned.select("file", (F.col("skip") + F.col("r") - 1).alias("number"), text.alias("record"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files at ``path`` with the names of their header, all strings, and
    ``ordinal``, their position over all files taken in name order."""
    names = spark.read.csv(path, **OPTIONS).columns  # reads the header only
    rows = records(spark, path)
    data = rows.filter("number > 0")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file.
    files = small_or_plain(data.groupBy("file").agg(F.count(F.lit(1)).alias("n"))).select(
        "file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip")
    )
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    options = {k: v for k, v in OPTIONS.items() if k != "header"}
    parsed = data.join(files, "file").select(
        F.from_csv("record", schema, options).alias("row"), (F.col("skip") + F.col("number") - 1).alias("ordinal")
    )
    return parsed.select(*[F.col(f"row.c{i}").alias(name) for i, name in enumerate(names)], "ordinal")
