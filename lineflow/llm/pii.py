"""Personal data in texts: patterns propose spans, validators confirm, context adjusts scores.

Built-in functions only, and no shuffle. Positions come without a user function: ``split``
gives the text between matches and ``regexp_extract_all`` the matches, so a span's start is
the running total of their lengths. Totals are built in chunks, so a text with very many
matches costs little more than linear time. Patterns use possessive runs and only start where
a run starts; no text, however long, makes them backtrack over and over.

Kinds email, ip, card and phone are always reported once their validator confirms them;
iban and ssn are reported from a score of ``MIN_SCORE``. A span's score is its kind's prior,
more if a checksum holds, more if a context word stands within ``CONTEXT_CHARS`` before it.

Defined results: a NULL or empty text has no spans. Positions count code points, end
exclusive. Spans of different kinds may overlap; masking replaces an overlapping run once, by
the kind that starts first. Repeated rows are searched alike; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.functions.graph import settled

CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
CHECKSUM_BONUS = 0.2
MIN_SCORE = 0.6
CHUNK = 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _every_part_fits(ip: Column) -> Column:
    def fits(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(ip, r"\."), fits)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod_97(iban: Column) -> Column:
    """Whether an account number, letters as two digits, leaves 1 when divided by 97."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), add) == 1


def _is_card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))


def _is_iban(match: Column) -> Column:
    length = F.length(F.replace(match, F.lit(" "), F.lit("")))
    return F.when(length.between(15, 34), mod_97(match)).otherwise(F.lit(False))


class Kind(NamedTuple):
    name: str
    pattern: str
    mark: str | None
    valid: Callable[[Column], Column]
    prior: float
    checksum: bool
    base: bool
    context: str


#: In the order in which spans with the same start are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", lambda m: F.lit(True), 0.7, False, True, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         ".", _every_part_fits, 0.5, False, True, "ip|host|server|address|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++",
         None, _is_card, 0.5, True, True, "card|visa|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         "+", lambda m: F.length(_digits(m)).between(10, 15), 0.6, False, True,
         "tel|phone|call|mobil|fax"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
         None, _is_iban, 0.5, True, False, "iban|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
         "-", lambda m: ~m.rlike("^(?:000|666|9)|-00-|0000$"), 0.4, False, False,
         "ssn|social security"),
)


def _totals(lengths: str) -> Column:
    """Exclusive running totals of the int array column ``lengths``, in two levels."""
    values = F.col(lengths)
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)),
    )
    none = F.array().cast("array<int>")

    def inside(chunk: Column, base: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(none.alias("out"), base.alias("at")),
            lambda acc, x: F.struct(
                F.array_append(acc["out"], acc["at"]).alias("out"), (acc["at"] + x).alias("at")
            ),
        )

    def outside(acc: Column, chunk: Column) -> Column:
        return F.transform(
            F.array(inside(chunk, acc["at"])),
            lambda done: F.struct(
                F.array_append(acc["out"], done["out"]).alias("out"), done["at"].alias("at")
            ),
        )[0]

    start = F.struct(F.array().cast("array<array<int>>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(chunks, start, outside, lambda acc: F.flatten(acc["out"]))


def _spans(rank: int, kind: Kind, min_score: float) -> Column:
    """The confirmed spans of one kind, NULL if its pattern matched nowhere."""
    matches, before, totals = (F.col(f"_{x}_{kind.name}") for x in "mbt")
    known = kind.prior + (CHECKSUM_BONUS if kind.checksum else 0)

    def span(match: Column, i: Column) -> Column:
        start = F.get(totals, 2 * i + 1)
        near = F.lower(F.substring(F.get(before, i), -CONTEXT_CHARS, CONTEXT_CHARS))
        score = F.when(near.rlike(kind.context), min(1.0, known + CONTEXT_BONUS)).otherwise(known)
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"),
            (start + F.length(match)).alias("end"), F.lit(kind.name).alias("kind"),
            score.alias("score"), match.alias("match"),
        )

    kept = F.filter(F.transform(matches, span), lambda s: kind.valid(s["match"]))
    if not kind.base:
        kept = F.filter(kept, lambda s: s["score"] >= min_score)
    return F.when(F.size(totals) > 0, kept)


def find(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with ``_pii``: an array of (start, rank, end, kind, score), in span order."""
    body = F.coalesce(F.col(text), F.lit(""))
    names = [kind.name for kind in KINDS]
    matches, before = {}, {}
    for kind in KINDS:
        found = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))
        if kind.mark is not None:
            found = F.when(body.contains(kind.mark), found)
        matches[f"_m_{kind.name}"] = settled(found)
        parts = F.split(body, kind.pattern, -1)
        before[f"_b_{kind.name}"] = settled(F.when(F.size(f"_m_{kind.name}") > 0, parts))
    df = docs.withColumns(matches).withColumns(before)
    df = df.withColumns({
        # A span starts after the text before it and all earlier texts and matches.
        f"_l_{n}": settled(F.flatten(F.zip_with(
            F.slice(F.col(f"_b_{n}"), F.lit(1), F.size(f"_m_{n}")), F.col(f"_m_{n}"),
            lambda b, m: F.array(F.length(b), F.length(m)),
        )))
        for n in names
    })
    df = df.withColumns({
        f"_t_{n}": settled(F.when(F.size(f"_l_{n}") > 0, _totals(f"_l_{n}"))) for n in names
    })
    spans = [_spans(rank, kind, min_score) for rank, kind in enumerate(KINDS)]
    kind_of = "struct<start:int,rank:int,end:int,kind:string,score:double,match:string>"
    none = F.array().cast(f"array<{kind_of}>")
    all_spans = F.array_sort(F.concat(*[F.coalesce(s, none) for s in spans]))
    slim = F.transform(
        all_spans,
        lambda s: F.struct(*[s[n].alias(n) for n in ("start", "rank", "end", "kind", "score")]),
    )
    return df.withColumn("_pii", settled(slim)).drop(
        *[f"_{x}_{n}" for x in "mblt" for n in names]
    )


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*[k.name for k in KINDS if k.base]))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        parts = F.when(s["start"] >= acc["at"], F.array(gap, mark)).otherwise(
            F.array().cast("array<string>")
        )
        return F.struct(
            F.concat(acc["out"], parts).alias("out"), F.greatest(acc["at"], s["end"]).alias("at")
        )

    done = F.aggregate(
        spans, start, add,
        lambda acc: F.concat(
            F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))
        ),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; NULL stays NULL."""
    return find(docs, text).withColumn(text, masked(F.col(text), F.col("_pii"))).drop("_pii")
