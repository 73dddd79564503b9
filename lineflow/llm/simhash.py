"""SimHash near-duplicates, found through pivot distance tables.

Every fingerprint's Hamming distances to the ``PIVOTS`` are computed once. Fingerprints within
``MAX_BITS`` of each other differ by at most ``MAX_BITS`` in every distance, so a pair whose
largest coordinate difference is greater is discarded without looking at the fingerprints.
The pivots are zero and sixteen masks of four bits: from the distances to zero and to a mask
follows how many bits are set under the mask, and these sixteen numbers form a cell. A changed
bit moves a fingerprint to an adjacent cell, so two fingerprints within two bits meet in a
cell at most one step from both. Each distinct fingerprint is sent to its cell and the
adjacent ones; only fingerprints that meet are compared, first by their distance tables, then
exactly. No pair list leaves a cell: it reports a spanning forest of the links it verified.

A cell with more than ``CELL_ROWS`` fingerprints is not compared in one task. Its members are
sent on to the cells of the 64 single-bit pivots instead, where two fingerprints meet exactly
if they are within two bits, and no cell can hold more than 65 of them.

Components come from contraction: each round every vertex joins its neighbour with the
smallest random draw, which at least halves the graph on average. Every round is written to
the shared folder, so lost executors cost one step.

Defined results: NULL, empty and blank texts have fingerprint zero and link like any other.
Rows without an id take part, but never name a component; a component of such rows only has
a NULL id. Repeated rows share their component.

The fingerprints take 3 words and link within two bits. Texts that are alike by a given share
of their shingles differ in far more of 64 bits; a ``Similar`` rule links those instead, by
the shingles themselves (``nearcopies``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lineflow.llm import nearcopies
from lineflow.session import written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
PIVOTS = (0, *(((1 << WIDTH) - 1) << (WIDTH * i) for i in range(SEGMENTS)))
CELL_ROWS = 2048
BLOCK = 1 << 16


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text's word shingles, repeats included."""
    # Bytes methods lower and split by ASCII only.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        octets = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints as signed longs, bit for bit."""
    for texts in batches:
        yield pd.Series(np.array([simhash(t) for t in texts], dtype="u8").view("i8"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_distances(fp: Column) -> list[Column]:
    """Hamming distances to the pivots."""
    return [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))) for p in PIVOTS]


def cells(fp: Column) -> Column:
    """A fingerprint's own cell and the adjacent ones: bits per mask, four bits each."""
    zero, *masks = pivot_distances(fp)
    own = F.lit(0).cast("long")
    for i, mask in enumerate(masks):
        # distance to zero less distance to the mask: twice the bits under it, less its width
        under = F.shiftright(zero - mask + WIDTH, 1).cast("long") + 1
        own = own + F.shiftleft(under, 4 * i)
    steps = [1 << (4 * i) for i in range(SEGMENTS)]
    return F.transform(F.array(own), lambda c: F.array(c, *[c + s for s in steps], *[c - s for s in steps]))[0]


def _distance_table(fps: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ np.uint64(p)) for p in PIVOTS], axis=1).astype(np.int8)


def verified(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps`` (unsigned, distinct)."""
    table = _distance_table(fps)
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(fps) - 1):
        rest = np.flatnonzero(np.abs(table[i + 1 :] - table[i]).max(1) <= MAX_BITS) + i + 1
        for j in rest[np.bitwise_count(fps[rest] ^ fps[i]) <= MAX_BITS]:
            a, b = root(i), root(int(j))
            if a != b:
                parent[b] = a
                links.append((i, int(j)))
    return links


def _compare(limit: int):
    """Links within each run of equal cells; members of overfull cells come out unlinked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, dtype="u8")
        cell, overfull = None, False

        def flush(fps: np.ndarray) -> list[tuple[int, int]]:
            fps = np.unique(fps)
            return [(fps[i], fps[j]) for i, j in verified(fps)] if len(fps) > 1 else []

        for batch in batches:
            keys = batch["cell"].to_numpy()
            fps = batch["fp"].to_numpy().view("u8")
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            ends = np.r_[cuts[1:], len(keys)] if len(keys) else []
            found, spilled = [], []
            for k, (lo, hi) in enumerate(zip(cuts, ends, strict=True)):
                part = fps[lo:hi]
                if cell is not None and keys[lo] == cell:
                    part = part if overfull else np.concatenate((held, part))
                elif cell is not None and not overfull:
                    found += flush(held)
                    overfull = False
                else:
                    overfull = False
                cell = keys[lo]
                if overfull or len(part) > limit:
                    overfull = True
                    spilled.append(part)
                    held = part[:0]
                elif k < len(cuts) - 1:
                    if len(part) > 1:
                        found += flush(part)
                    held = part[:0]
                else:
                    held = part
            a = np.array([x for x, _ in found], dtype="u8").view("i8")
            b = np.array([y for _, y in found], dtype="u8").view("i8")
            alone = np.concatenate(spilled).view("i8") if spilled else a[:0]
            yield pd.DataFrame({
                "a": np.concatenate((a, alone)),
                "b": pd.array([*b, *[None] * len(alone)], dtype="Int64"),
            })
        if not overfull:
            last = flush(held)
            yield pd.DataFrame({
                "a": np.array([x for x, _ in last], dtype="u8").view("i8"),
                "b": pd.array(np.array([y for _, y in last], dtype="u8").view("i8"), dtype="Int64"),
            })

    return run


def links(fps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints ``fp`` within ``MAX_BITS``."""
    sent = fps.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    met = written(
        sent.repartition("cell").sortWithinPartitions("cell")
        .mapInPandas(_compare(cell_rows), "a long, b long")
    )
    near = met.filter("b IS NOT NULL")
    rest = met.filter("b IS NULL").select("a").distinct()
    bits = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    fine = (
        rest.select("a", F.explode(F.transform(bits, lambda p: F.col("a").bitwiseXOR(p))).alias("cell"))
        .groupBy("cell").agg(F.min("a").alias("b"), F.collect_set("a").alias("all"))
        .filter(F.size("all") > 1)
        .select(F.explode("all").alias("a"), "b")
    )
    both = near.unionByName(fine).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the links ``(a, b)``; roots are equal when connected."""
    edges = written(edges)
    labels = written(
        edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct()
        .withColumn("root", F.col("v"))
    )
    step = 0
    while not edges.isEmpty():
        step += 1
        ends = edges.select(F.col("a").alias("v"), F.col("b").alias("w"))
        ends = ends.union(edges.select(F.col("b"), F.col("a")))
        draw = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)), F.col(c).alias("at"))  # noqa: B023, E731
        moves = written(
            ends.groupBy("v").agg(F.min(draw("w")).alias("w"))
            .select("v", F.least("w", draw("v"))["at"].alias("to"))
        )
        edges = written(
            edges.join(moves.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
            .join(moves.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        labels = written(
            labels.join(moves.withColumnRenamed("v", "root"), "root", "left")
            .select("v", F.coalesce("to", "root").alias("root"))
        )
    return labels


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", cell_rows: int = CELL_ROWS,
    rule: nearcopies.Similar | None = None,
) -> DataFrame:
    """(id, fp, group, component_id) per row: the fingerprint, the fingerprint that stands for
    its component, and the component's smallest id. With a ``rule``, ``fp`` is the hash of the
    shingle set and links follow the rule."""
    if rule is None:
        prints = written(docs.select(F.col(id), fingerprint(F.col(text)).alias("fp")))
        distinct = prints.groupBy("fp").agg(F.min(id).alias("first"))
        linked_by = links(distinct, cell_rows)
    else:
        sketched = docs.select(
            F.col(id), nearcopies.sketch(F.col(text), rule.size).alias("_s"), F.xxhash64(text).alias("mark")
        )
        prints = written(sketched.select(F.col(id), "_s.*", "mark"))
        distinct = prints.groupBy("fp").agg(F.min(id).alias("first"))
        sketches = written(prints.groupBy("fp").agg(
            F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
            F.min("mark").alias("mark"),
        ))
        linked_by = nearcopies.links(docs, text, sketches, rule, components)
    roots = components(linked_by).withColumnRenamed("v", "fp")
    linked = written(distinct.join(roots, "fp").select("fp", "root", "first"))
    firsts = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(firsts, "root").select("fp", "root", "component_id")
    # Written, so that the join below has a plain shuffle on both sides and a fingerprint with
    # very many copies can be split over tasks.
    facts = written(distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("group"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"),
    ))
    return prints.join(facts, "fp").select(id, "fp", "group", "component_id")


def one_of_each(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rule: nearcopies.Similar | None = None
) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id."""
    found = written(near_duplicates(docs, id, text, rule=rule))
    own = fingerprint(F.col(text)) if rule is None else nearcopies.key(F.col(text), rule.size)
    heads = found.filter(F.col(id) == F.col("component_id")).groupBy(id).agg(
        F.count(F.lit(1)).alias("_heads")
    )
    single = docs.join(heads.filter("_heads = 1").select(id), id, "left_semi")
    # Ids that head several rows, and rows without id, are told apart by their fingerprints.
    odd = docs.join(heads.filter("_heads > 1").select(id), id, "left_semi").unionByName(
        docs.filter(F.col(id).isNull())
    )
    groups = found.filter(F.col(id).eqNullSafe(F.col("component_id"))).select(
        F.col(id).alias("_id"), F.col("fp").alias("_fp"), F.col("group").alias("_group")
    ).distinct()
    odd = odd.withColumn("_print", own).join(
        groups, (F.col("_fp") == F.col("_print")) & F.col("_id").eqNullSafe(F.col(id))
    )
    return single.select(docs.columns).unionByName(
        odd.dropDuplicates(["_group"]).select(docs.columns)
    )


def spelled(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
