"""Reading any known release of a function corpus into the canonical columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.functions import text
from lineflow.operators.positions import BROADCAST_ROWS
from lineflow.schema import CANONICAL_COLUMNS
from lineflow.sources import quoted

# --- Fixed values: the names a canonical column goes by in known releases ----------------
COLUMN_ALIASES = {
    "project": ("project",),
    "commit_id": ("commit_id",),
    "cwe": ("CWE ID", "cwe_id", "cwe"),
    "vul": ("vul", "target"),
    "func_before": ("func_before", "processed_func"),
    "func_after": ("func_after",),
    "flaw_lines": ("flaw_line", "flaw_lines"),
    "flaw_line_indices": ("flaw_line_index", "flaw_line_indices"),
}
REQUIRED = ("project", "commit_id", "cwe", "vul", "func_before")
ID_FORMAT = "bigvul_%06d"
# ----------------------------------------------------------------------------------------


class CorpusFormatError(ValueError):
    """The file lacks columns without which no canonical frame can be built."""


def resolve_columns(available: Iterable[str]) -> dict[str, str]:
    """Canonical name -> the column of ``available`` that provides it."""
    have = list(available)
    mapping: dict[str, str] = {}
    for name, aliases in COLUMN_ALIASES.items():
        hits = [alias for alias in aliases if alias in have]
        if hits:
            mapping[name] = hits[0]
    problems = [
        f"{name} (looked for: {', '.join(COLUMN_ALIASES[name])})"
        for name in REQUIRED
        if name not in mapping
    ]
    # A release must say which lines are flawed, or let the fix tell.
    if "func_after" not in mapping and not {"flaw_lines", "flaw_line_indices"} <= set(mapping):
        problems.append("func_after (or flaw_line and flaw_line_index)")
    if problems:
        raise CorpusFormatError(
            f"missing required columns: {'; '.join(problems)}."
            f" Columns found: {', '.join(sorted(have))}"
        )
    return mapping


def canonicalise(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Project a release frame to the canonical columns; ``ordinal`` is the row position."""
    mapping = resolve_columns(c for c in raw.columns if c != ordinal)
    kinds = dict(raw.dtypes)

    def source(name):
        return F.col(f"`{mapping[name]}`")

    def string(name):
        return F.coalesce(source(name).cast("string"), F.lit(""))

    listed = "flaw_lines" in mapping and "flaw_line_indices" in mapping
    none_s, none_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    return raw.select(
        F.format_string(ID_FORMAT, F.col(ordinal)).alias("sample_id"),
        string("project").alias("project"),
        string("commit_id").alias("commit_id"),
        text.normalise_cwe(source("cwe")).alias("cwe"),
        F.coalesce(
            F.nanvl(source("vul").try_cast("double"), F.lit(0.0)).try_cast("int"), F.lit(0)
        ).alias("vul"),
        string("func_before").alias("func_before"),
        (string("func_after") if "func_after" in mapping else F.lit("")).alias("func_after"),
        (
            text.parse_flaw_lines(source("flaw_lines"), kinds[mapping["flaw_lines"]])
            if listed else none_s
        ).alias("flaw_lines"),
        (
            text.parse_flaw_line_indices(
                source("flaw_line_indices"), kinds[mapping["flaw_line_indices"]]
            )
            if listed else none_i
        ).alias("flaw_line_indices"),
        F.col(ordinal).alias("ordinal"),
    )


def with_ordinals(df: DataFrame) -> DataFrame:
    """Add ``ordinal``, the row's position over all Parquet files taken in name order.

    Rows know their index within the file, so only one count per file is ever gathered; the rows
    themselves are not sorted or shuffled.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip")
    )
    if len(df.inputFiles()) <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, "_file").withColumn("ordinal", F.col("_skip") + F.col("_at")).drop("_file", "_at", "_skip")


def is_csv(path: str) -> bool:
    return str(path).lower().endswith(".csv")


def read_release(spark: SparkSession, path: str) -> DataFrame:
    """The raw release at ``path``, a Parquet file or directory of them, or CSV, read in as many
    tasks as it has blocks (a folder of CSV files has to end in ``.csv`` too). CSV rows come with
    their ``ordinal``."""
    if is_csv(path):
        return quoted.read_csv(spark, str(path))
    try:
        return spark.read.parquet(str(path))
    except AnalysisException as error:
        raise CorpusFormatError(f"{path}: no Parquet files found") from error


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Canonical columns plus ``ordinal`` from any known release at ``path``."""
    raw = read_release(spark, path)
    known = [c for c in raw.columns if not (is_csv(path) and c == "ordinal")]
    canonical = set(CANONICAL_COLUMNS) <= set(known) and not is_csv(path)
    wanted = CANONICAL_COLUMNS if canonical else sorted(set(resolve_columns(known).values()))
    pruned = raw.select(*[f"`{name}`" for name in wanted], *(["ordinal"] if is_csv(path) else []))
    rows = pruned if is_csv(path) else with_ordinals(pruned)
    if not canonical:
        return canonicalise(rows)
    if str(path).lower().endswith(".parquet"):
        return rows
    return rows.withColumn("sample_id", F.format_string(ID_FORMAT, F.col("ordinal")))


def convert_to_parquet(spark: SparkSession, source: str, destination: str) -> DataFrame:
    """Write the canonical frame of ``source`` as Parquet and return it read back."""
    load_corpus(spark, source).select(*CANONICAL_COLUMNS).write.mode("overwrite").parquet(
        str(destination)
    )
    return load_corpus(spark, destination)
