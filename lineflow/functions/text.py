"""Source-text functions as Columns: comments, code lines, body hashes, release fields.

Character classes are spelled out so that words and blanks mean the same as for Unicode
strings everywhere: ``\\w`` and ``\\s`` alone are ASCII-only in Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
# The same blanks one by one, and blanks that are not one space already.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_ONE_SPACE = rf"(?![!-~])(?: {SPACE}+|[\t-\r\x1c-\x1f\x85\p{{Z}}&&[^ ]]{SPACE}*)"
BLOCK_COMMENT = r"(?s)(/\*.*?\*/)"
LINE_COMMENT = r"//[^\n]*"
TRIVIAL_LINE = r"^[\t-\r\x1c-\x20\x85\p{Z}{}();]*$"
FLAW_LINE_SEPARATOR = "/~/"
# ----------------------------------------------------------------------------------------


def lines_of(code: Column) -> Column:
    return F.split(code, "\n", -1)


def num_lines(code: Column) -> Column:
    return (F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit(""))) + 1).cast("int")


def strip(text: Column) -> Column:
    """Drop blanks of any kind from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def squash(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NOT_ONE_SPACE, " "))


def strip_comments(code: Column) -> Column:
    """Remove comments, keeping every line break a block comment spans."""
    between = F.split(code, BLOCK_COMMENT, -1)
    breaks = F.transform(
        F.regexp_extract_all(code, F.lit(BLOCK_COMMENT), F.lit(1)),
        lambda c: F.regexp_replace(c, r"[^\n]+", ""),
    )
    without_blocks = F.array_join(
        F.zip_with(between, breaks, lambda text, gap: F.concat(text, F.coalesce(gap, F.lit("")))), ""
    )
    # Most functions carry no block comment: skip the split for them.
    kept = F.when(F.contains(code, F.lit("/*")), without_blocks).otherwise(code)
    return F.when(F.contains(kept, F.lit("//")), F.regexp_replace(kept, LINE_COMMENT, "")).otherwise(kept)


def is_trivial_line(line: Column) -> Column:
    bare = strip(line)
    comment_like = bare.startswith("//") | bare.startswith("/*") | bare.startswith("*/")
    bullet = (bare == "*") | bare.startswith("* ")
    return comment_like | bullet | strip_comments(line).rlike(TRIVIAL_LINE)


def code_line_mask(code: Column) -> Column:
    """One boolean per line: does it carry code once comments are gone?"""
    return F.transform(lines_of(strip_comments(code)), lambda line: ~line.rlike(TRIVIAL_LINE))


def normalise_body(code: Column) -> Column:
    return collapse(strip_comments(code))


def body_hash(code: Column) -> Column:
    return F.sha1(F.encode(normalise_body(code), "UTF-8"))


def normalise_cwe(value: Column) -> Column:
    digits = F.regexp_extract(value.cast("string"), r"([0-9]+)", 1)
    number = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return F.when(value.isNull() | (digits == ""), F.lit("")).otherwise(
        F.concat(F.lit("CWE-"), number)
    )


def parse_flaw_lines(value: Column, kind: str = "string") -> Column:
    """Flaw-line texts from a release column: a list as is, text split at the separator."""
    none = F.array().cast("array<string>")
    if kind.startswith("array"):
        return F.coalesce(value.cast("array<string>"), none)
    if kind != "string":
        return none
    parts = F.split(value, FLAW_LINE_SEPARATOR, -1)
    return F.when(value.isNull() | (value == ""), none).otherwise(parts)


def parse_flaw_line_indices(value: Column, kind: str = "string") -> Column:
    """Line indices from a release column; in text every digit run counts, signs do not. A run
    beyond the integers becomes the largest one, so that the range filter drops it later."""
    none = F.array().cast("array<int>")
    if kind.startswith("array"):
        return F.coalesce(value.cast("array<int>"), none)
    if kind != "string":
        return F.when(value.isNull() | F.isnan(value.cast("double")), none).otherwise(
            F.array(value.cast("int"))
        )
    runs = F.regexp_extract_all(value, F.lit(r"([0-9]+)"), F.lit(1))
    most = F.lit(2**31 - 1)
    return F.coalesce(F.transform(runs, lambda run: F.coalesce(run.try_cast("int"), most)), none)


def escape_label(text: Column) -> Column:
    """Backslash-escape backslashes and double quotes."""
    return F.replace(
        F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')
    )
