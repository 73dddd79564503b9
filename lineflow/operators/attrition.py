"""The filter cascade over a canonical corpus and its stage-by-stage row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.config import FilterConfig
from lineflow.functions import text
from lineflow.functions.graph import settled
from lineflow.operators import linediff

STAGES = (
    "loaded", "vulnerable", "selected_cwes", "has_flaw_lines", "has_code_flaw_lines",
    "line_count", "deduplicated",
)


def code_flaw_indices(mask: Column, indices: Column) -> Column:
    """The indices in range whose line carries code; ``mask`` is the code-line mask."""
    return F.filter(
        indices, lambda i: (i >= 0) & (i < F.size(mask)) & F.coalesce(F.get(mask, i), F.lit(False))
    )


def staged(df: DataFrame, config: FilterConfig, derive: bool = True) -> DataFrame:
    """Add ``level``, the last stage (0 = loaded .. 5 = line_count) the row survives, and the
    columns later stages need: code-only ``flaw_line_indices``, ``num_lines``, ``body_hash``.

    Every stage is a flag on the row, so the whole cascade is one pass with no shuffle but for
    the diffs of functions that list no flaw lines, which are found by ``ordinal``.
    ``derive=False`` skips the diff for corpora known to list their flaw lines.
    """
    vulnerable = F.col("vul") == 1
    selected = vulnerable & F.col("cwe").isin(list(config.cwes))
    given = F.col("flaw_line_indices")
    listed = F.array_sort(F.array_distinct(given))
    none = F.array().cast("array<int>")
    if derive:
        wanted = selected & (F.size(given) == 0) & (F.col("func_after") != "")
        derived = linediff.changed_lines(df.filter(wanted), "ordinal", F.col("func_before"), F.col("func_after"))
        flawed = df.join(linediff.small_enough(derived), "ordinal", "left").withColumn(
            "_flaws",
            F.when(F.size(given) > 0, listed).otherwise(F.coalesce(F.col("changed"), none)),
        ).drop("changed")
    else:
        flawed = df.withColumn("_flaws", listed)
    flawed = flawed.withColumn("_selected", F.coalesce(selected, F.lit(False)))
    wanted = F.col("_selected") & (F.size("_flaws") > 0)
    reached = flawed.withColumn(
        "_mask", settled(F.when(wanted, text.code_line_mask(F.col("func_before"))))
    ).withColumn(
        "flaw_line_indices",
        F.coalesce(code_flaw_indices(F.col("_mask"), F.col("_flaws")), none),
    ).withColumn("num_lines", text.num_lines(F.col("func_before")))
    level = (
        F.when(~F.coalesce(vulnerable, F.lit(False)), 0)
        .when(~F.col("_selected"), 1)
        .when(F.size("_flaws") == 0, 2)
        .when(F.size("flaw_line_indices") == 0, 3)
        .when(~F.col("num_lines").between(config.min_lines, config.max_lines), 4)
        .otherwise(5)
    )
    return (
        reached.withColumn("level", level)
        .withColumn("body_hash", F.when(F.col("level") == 5, text.body_hash(F.col("func_before"))))
        .drop("_flaws", "_selected", "_mask")
    )


def filter_corpus(
    df: DataFrame, config: FilterConfig | None = None, derive: bool = True
) -> DataFrame:
    """Usable functions: the survivors of every stage, the first row of each body kept.

    "First" is the smallest ``ordinal``. The pick is an aggregate, so copies collapse before
    the shuffle and a body with very many copies costs no more than any other.
    """
    config = config or FilterConfig()
    # Told by two plain columns, so nothing is worked out for rows that leave at these stages.
    chosen = df.filter((F.col("vul") == 1) & F.col("cwe").isin(list(config.cwes)))
    survivors = staged(chosen, config, derive).filter("level = 5").drop("level")
    kept = [c for c in survivors.columns if c not in ("body_hash", "flaw_lines")]
    first = survivors.groupBy("body_hash").agg(
        F.min_by(F.struct(*kept), F.col("ordinal")).alias("row")
    )
    rows = first.select("row.*", "body_hash").withColumn(
        "_lines", settled(text.lines_of(F.col("func_before")))
    )
    texts = F.transform("flaw_line_indices", lambda i: F.get(F.col("_lines"), i))
    return rows.withColumn("flaw_lines", texts).drop("_lines")


def _stage_counts(df: DataFrame, by: list[str]) -> DataFrame:
    # Bodies are pre-aggregated, so rows that never reach the dedupe stage (hash NULL) shrink
    # to one partial row per task before anything moves.
    per_body = df.groupBy(*by, "body_hash").agg(
        *[F.count_if(F.col("level") >= i).alias(f"s{i}") for i in range(6)]
    )
    counts = per_body.groupBy(*by).agg(
        *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"s{i}") for i in range(6)],
        F.count("body_hash").alias("s6"),
    )
    steps = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("step"), F.col(f"s{i}").cast("long").alias("rows"))
            for i, name in enumerate(STAGES)
        ]
    )
    return counts.select(*by, F.inline(steps))


def attrition(df: DataFrame, config: FilterConfig | None = None, derive: bool = True) -> DataFrame:
    """Rows surviving each stage: ``position, step, rows``."""
    stages = staged(df, config or FilterConfig(), derive)
    return _stage_counts(stages.select("level", "body_hash"), [])


def attrition_by_cwe(
    df: DataFrame, cwes: Sequence[str], config: FilterConfig | None = None, derive: bool = True
) -> DataFrame:
    """The same counts with each CWE filtered on its own, from one pass over the corpus.

    Long form (``cwe, position, step, rows``); bodies are deduplicated within their CWE.
    """
    base = config or FilterConfig()
    alone = FilterConfig(list(cwes), base.min_lines, base.max_lines)
    stages = staged(df.filter(F.col("cwe").isin(list(cwes))), alone, derive)
    long = _stage_counts(stages.select("cwe", "level", "body_hash"), ["cwe"])
    return long.filter("position >= 2")


def attrition_matrix(long: DataFrame, cwes: Sequence[str]) -> DataFrame:
    """``attrition_by_cwe`` with one column per CWE."""
    return long.groupBy("position", "step").pivot("cwe", list(cwes)).agg(F.first("rows")).na.fill(0)
