"""Document quality rules: one table of thresholds, compiled into one Spark projection.

Each rule bounds one measure of a text. ``measured`` adds the counts, ``verdict`` compiles the
table into one boolean Column; everything is built-in functions and nothing is shuffled.

Defined results: a NULL or blank text has no words, all counts 0, and is not kept. Repeated
rows are judged alike, each on its own; an empty table gives an empty table. The cost of a
text is n log n in its words, so very long texts stay affordable. Windows of three words are
compared by a 64-bit hash: in a text of a million windows the odds of one false repeat are
below 1 in 10 million.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.functions.graph import settled

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SHOUTED = r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$"

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "for", "it", "as", "was", "with", "be", "by",
    "on", "not", "are", "this", "at", "from", "or", "an",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im",
    "dem", "nicht", "ein", "eine",
    "de", "la", "le", "et", "les", "un", "une", "du", "que", "est", "pour", "qui", "dans",
    "par", "sur", "pas", "au",
    "el", "en", "y", "los", "se", "del", "las", "por", "con", "no", "para", "su", "al", "lo",
)


class Rule(NamedTuple):
    """``low <= measure <= high``; a missing bound or an undefined measure never fails."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Fixed part of every verdict: too few words, or more than half of them in repeated windows.
BASE_MIN_WORDS = 50
BASE_REPEAT_PERCENT = 50

#: The method's thresholds: word counts, shares of words, shares of lines.
RULES = (
    Rule("n_words", 50, 10_000_000),
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("repeat_word_share", None, 0.5),
    Rule("dup_line_share", None, 0.4),
    Rule("stop_word_share", 0.04, None),
    Rule("shouted_word_share", None, 0.5),
)

#: Each measure as numerator and denominator among the counts.
MEASURES = {
    "n_words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "stop_word_share": ("n_stop_words", "n_words"),
    "shouted_word_share": ("n_shouted_words", "n_words"),
}
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_stop_words", "n_shouted_words",
)


def _repeat_words(words: str, pairs: str) -> Column:
    """Words inside 3-word windows that occur twice or more, from windows sorted by hash."""

    def same(a: Column, i: Column) -> Column:
        return F.coalesce(F.get(F.col(pairs), i)["h"] == a["h"], F.lit(False))

    repeated = F.filter(F.col(pairs), lambda a, i: same(a, i - 1) | same(a, i + 1))
    starts = F.array_sort(F.transform(repeated, lambda a: a["i"]))
    # Each window covers its three words, less what the next repeated window covers as well.
    last = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
    return F.aggregate(
        starts,
        last,
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at")
        ),
        lambda acc: acc["n"],
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``_quality`` of ``COUNTS`` (longs)."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    with_words = docs.withColumn("_q_words", settled(words)).withColumn(
        "_q_lines",
        settled(F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))),
    )
    w = F.col("_q_words")
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    )
    with_hashes = with_words.withColumn("_q_hashes", settled(hashes))
    # Only texts with a repeat are sorted.
    pairs = F.when(
        F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes"),
        F.array_sort(
            F.transform("_q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        ),
    )
    with_pairs = with_hashes.withColumn("_q_pairs", settled(pairs))
    lowered = F.split(F.lower(F.array_join("_q_words", " ")), " ")
    stops = F.size(F.filter(lowered, lambda x: x.isin(*STOP_WORDS)))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOL)),
        "n_lines": F.size("_q_lines"),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": F.coalesce(_repeat_words("_q_words", "_q_pairs"), F.lit(0)),
        "n_stop_words": stops,
        "n_shouted_words": F.size(F.filter(w, lambda x: x.rlike(SHOUTED))),
    }
    struct = F.struct(*[c.cast("long").alias(name) for name, c in counts.items()])
    return with_pairs.withColumn("_quality", settled(struct)).drop(
        "_q_words", "_q_lines", "_q_hashes", "_q_pairs"
    )


def base_failed(counts: str = "_quality") -> Column:
    n, r = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < BASE_MIN_WORDS) | (100 * r > BASE_REPEAT_PERCENT * n)


def verdict(rules: tuple[Rule, ...] = RULES, counts: str = "_quality") -> Column:
    """The threshold table as one boolean Column: true if every rule holds."""
    kept = ~base_failed(counts)
    for rule in rules:
        top, bottom = MEASURES[rule.measure]
        value = F.col(f"{counts}.{top}").cast("double")
        if bottom is not None:
            value = F.try_divide(value, F.col(f"{counts}.{bottom}").cast("double"))
        if rule.low is not None:
            kept = kept & F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            kept = kept & F.coalesce(value <= rule.high, F.lit(True))
    return kept


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table as a SQL condition over columns named like the counts."""
    parts = [f"NOT (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words)"]
    for rule in rules:
        top, bottom = MEASURES[rule.measure]
        value = f"CAST({top} AS DOUBLE)"
        if bottom is not None:
            value = f"({value} / nullif(CAST({bottom} AS DOUBLE), 0))"
        if rule.low is not None:
            parts.append(f"coalesce({value} >= {float(rule.low)!r}, true)")
        if rule.high is not None:
            parts.append(f"coalesce({value} <= {float(rule.high)!r}, true)")
    return " AND ".join(parts)


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``_quality``: the counts, ``base_failed`` and ``kept``."""
    counted = measured(docs, text)
    return counted.withColumn(
        "_quality",
        F.struct(
            *[F.col(f"_quality.{name}").alias(name) for name in COUNTS],
            base_failed().alias("base_failed"),
            verdict(rules).alias("kept"),
        ),
    )


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged."""
    return quality(docs, text, rules).filter("_quality.kept").drop("_quality")
