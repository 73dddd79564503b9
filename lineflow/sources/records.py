"""Readers and writers of graph records, parser exports, episodes and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow import schema


def _edges(pairs):
    return F.transform(
        F.coalesce(pairs, F.array().cast("array<array<int>>")),
        lambda e: F.struct(F.get(e, F.lit(0)).alias("u"), F.get(e, F.lit(1)).alias("v")),
    )


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Graph records from JSON lines; a malformed line fails the read. Text fields, edge sets
    and features a record leaves out become empty."""
    raw = spark.read.schema(schema.GRAPH_JSON_DDL).json(str(path), mode="FAILFAST")
    empty = {"source_lines": "array<string>", "vuln_nodes": "array<int>"}
    columns = {
        **{name: F.coalesce(F.col(name), F.lit("")) for name in ("project", "commit_id", "cwe")},
        **{name: F.coalesce(F.col(name), F.array().cast(kind)) for name, kind in empty.items()},
        "edges": _edges(F.col("edges")),
        "back_edges": _edges(F.col("back_edges")),
        "features": F.coalesce(
            F.col("features"), F.create_map().cast("map<string,array<array<double>>>")
        ),
    }
    return raw.withColumns(columns).select(*schema.GRAPH_COLUMNS)


def json_form(graphs: DataFrame) -> DataFrame:
    """Records with edges as two-element arrays, as they are written."""
    pairs = {
        name: F.transform(F.col(name), lambda e: F.array(e["u"], e["v"]))
        for name in ("edges", "back_edges")
    }
    return graphs.select(*schema.GRAPH_COLUMNS).withColumns(pairs)


def write_graphs(graphs: DataFrame, path: str) -> int:
    """Write JSON lines and return the number of records, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation("written")
    json_form(graphs).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(str(path))
    return seen.get["rows"]


def graph_json(graphs: DataFrame) -> DataFrame:
    """``sample_id`` and the compact JSON text of every record."""
    return json_form(graphs).select("sample_id", F.to_json(F.struct(*schema.GRAPH_COLUMNS)).alias("json"))


def load_methods(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Parser exports (JSON lines with mixed-type tuples) in the method columns."""
    raw = (
        spark.read.schema(schema.METHOD_JSON_DDL)
        .option("pathGlobFilter", pattern).json(str(path), mode="FAILFAST")
    )

    def cell(row, i, kind):
        return F.get(row, F.lit(i)).cast(kind)

    def tuples(column, fields):
        return F.transform(
            column, lambda row: F.struct(*[cell(row, i, kind).alias(name) for i, (name, kind) in enumerate(fields)])
        )

    return raw.select(
        "file", "name", "line", "line_end",
        tuples("nodes", [("id", "bigint"), ("label", "string"), ("line", "int"), ("name", "string"), ("code", "string")]).alias("nodes"),
        tuples("edges", [("src", "bigint"), ("dst", "bigint")]).alias("edges"),
        tuples("controls", [("type", "string"), ("line", "int"), ("first", "int"), ("last", "int")]).alias("controls"),
        tuples("stmts", [("label", "string"), ("first", "int"), ("last", "int")]).alias("stmts"),
    )


def save_results(episodes: DataFrame, path: str) -> str:
    episodes.write.mode("overwrite").parquet(str(path))
    return path


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(str(path))


def save_traces(traces: DataFrame, path: str) -> None:
    """One folder of JSON lines per method."""
    traces.withColumn("_method", F.col("method")).write.mode("overwrite").partitionBy("_method").json(str(path))


def load_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TRACE_DDL).json(str(path), mode="FAILFAST").select(
        "graph_id", "method", "start_node", "steps", "outcome"
    )


def trace_json(traces: DataFrame) -> DataFrame:
    return traces.select(
        "graph_id", "method",
        F.to_json(F.struct("graph_id", "method", "start_node", "steps", "outcome")).alias("json"),
    )


def parse_traces(texts: DataFrame, column: str = "json") -> DataFrame:
    parsed = F.from_json(column, schema.TRACE_DDL, {"mode": "FAILFAST"})
    return texts.select(parsed.alias("_t")).select("_t.*")

