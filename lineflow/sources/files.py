"""Source-file emission, release lookups and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.operators.positions import positioned
from lineflow.session import written
from lineflow.sources.corpus import with_ordinals
from lineflow.sources.folder import read_files, write_files

# --- Fixed values -----------------------------------------------------------------------
BATCH_SIZE = 500
BATCH_FORMAT = "batch_%04d"
EXTENSIONS = (".c", ".cpp")
MESSAGE_CHARS = 700
ARM_COLUMNS = (
    "success_rate", "localization_accuracy", "train_success", "nodes_inspected_success",
    "actions_success", "cumulative_reward",
)
# ----------------------------------------------------------------------------------------


def with_batches(df: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add ``batch`` and ``path``: consecutive functions share directories of ``batch_size``."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    at = positioned(df, "ordinal", "_position")
    return (
        at.withColumn("batch", F.format_string(BATCH_FORMAT, F.floor(F.col("_position") / batch_size)))
        .withColumn("path", F.concat("batch", F.lit("/"), "sample_id", F.lit(EXTENSIONS[0])))
        .drop("_position")
    )


def manifest(df: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    return with_batches(df, batch_size).select("sample_id", "batch", "path")


def write_sources(df: DataFrame, out_dir: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Write every function as ``.c`` and ``.cpp`` under ``out_dir``, an address of a store that
    executors and driver share, plus ``manifest.csv``; returns the manifest. Batches appear
    whole, after all of them are written."""
    # Worked out once; places are found without the bodies.
    kept = written(df.select("sample_id", "ordinal", "func_before"))
    repeated = kept.groupBy("sample_id").count().filter("count > 1").limit(1)
    if not repeated.isEmpty():
        raise ValueError("sample_id values must be unique")
    placed = written(manifest(kept, batch_size))
    body = F.regexp_replace("func_before", "\r\n?", "\n")
    body = F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
    places = placed.select(F.col("sample_id").alias("name"), F.col("batch").alias("folder"))
    # Names pack so well that their file looks small enough to broadcast when its rows are not.
    files = kept.join(places.hint("merge"), F.col("sample_id").eqNullSafe(F.col("name")))
    write_files(files.select("folder", "name", body.alias("text")), out_dir, EXTENSIONS)
    listed = f"{out_dir.rstrip('/')}/manifest.csv"
    placed.write.mode("overwrite").csv(listed, header=True)
    return df.sparkSession.read.csv(listed, header=True)


def read_sources(spark: SparkSession, out_dir: str) -> DataFrame:
    """(sample_id, batch, extension, text) of every source file under ``out_dir``, an address as
    for ``write_sources``."""
    def part(i):
        return F.regexp_extract("name", r"(.+)(\.[a-z]+)$", i)

    return read_files(spark, out_dir.rstrip("/"), "batch_*").select(
        part(1).alias("sample_id"), F.col("folder").alias("batch"), part(2).alias("extension"), "text"
    )


def load_background(spark: SparkSession, raw_dir: str, filtered: DataFrame) -> DataFrame:
    """CVE and commit facts of every filtered function, found by its row position in the raw
    files; empty where the raw row says nothing."""
    raw = with_ordinals(
        spark.read.parquet(raw_dir).select("`CVE ID`", "`CVE Page`", "commit_message", "codeLink")
    )
    return attach_background(filtered, raw)


def attach_background(filtered: DataFrame, raw: DataFrame) -> DataFrame:
    def known(name):
        return F.coalesce(F.col(f"`{name}`"), F.lit(""))

    facts = raw.select(
        "ordinal",
        known("CVE ID").alias("cve"),
        known("CVE Page").alias("cve_url"),
        known("codeLink").alias("commit_url"),
        F.substring(F.trim(known("commit_message")), 1, MESSAGE_CHARS).alias("commit_message"),
    )
    position = F.regexp_extract("sample_id", r"_([0-9]+)$", 1).cast("long")
    joined = filtered.select(
        "sample_id", F.col("func_before").alias("before"), F.col("func_after").alias("after"),
        position.alias("ordinal"),
    ).join(facts, "ordinal", "left")
    return joined.drop("ordinal").na.fill("", ["cve", "cve_url", "commit_url", "commit_message"])


def load_runs(spark: SparkSession, group_dir: str) -> DataFrame:
    """One row per ``<arm>/seed*/metrics.json`` under ``group_dir``."""
    return spark.read.json(f"{group_dir}/*/seed*/metrics.json", multiLine=True)


def collect_runs(runs: DataFrame) -> DataFrame:
    """Mean metrics per arm over its seeds, best success first."""
    return (
        runs.groupBy("arm")
        .agg(
            F.count_distinct("seed").alias("seeds"),
            F.stddev_pop("success_rate").alias("success_std"),
            *[F.avg(c).alias(c) for c in ARM_COLUMNS],
        )
        .select("arm", "seeds", "success_rate", "success_std", *ARM_COLUMNS[1:])
        .orderBy(F.desc("success_rate"))
    )
