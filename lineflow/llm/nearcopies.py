"""Links between texts whose word shingles are alike: Jaccard similarity of at least ``least``.

A text is the set of its distinct shingles of ``size`` words, each a 64-bit hash; equal sets
are one vertex. Candidates come from MinHash: ``BANDS`` keys of ``ROWS`` minima each. Two sets
of similarity 0.8 miss each other in all bands in about 6 of 100,000 cases, of 0.85 in fewer
than 1 of 10 million. Sets that share a key form a group; equal groups of several bands count
once. No link is taken from a band: the shingle sets of every pair are compared exactly.

Texts with a common passage share keys without being alike, so pairs are sieved before any set
moves: a byte of each of ``MINIMA`` minima travels along, and two sets are a pair only if at least
``SIEVE`` of these bytes agree, which two of similarity 0.8 miss in 1 of 100,000 cases. A group
first links every member to a leader that agrees with it in ``LIKELY`` bytes. Where that leaves
the group in several parts, every member tries the likeliest member of another part; where parts
remain, members with a possible partner in another part meet once more, with their sets, and are
compared in place, each pair in the first of the groups that hold both. So what moves are members,
never pairs in number of a group's square; the comparisons of sieved pairs remain. A group of
more than ``PART_ROWS`` members, or ``PART_SHINGLES`` shingles, is cut into parts, and every two
parts meet in a task of their own, so nothing that is held together grows with a group.

Sets are made anew where they are compared, from the texts that are wanted only: a table of bits,
set by the hashes of those texts and of bounded size, goes to the texts, and what it lets pass by
chance is dropped by an exact join. So texts that no group wants are neither cut nor moved.

Defined results: NULL, empty and blank texts have the empty set and equal each other only. A
text of fewer than ``size`` words has one shingle, all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.llm.memory import give_back, lean
from lineflow.session import written

BANDS = 32
ROWS = 6
SEED = 42
PART = 1 << 9
#: Hash functions in all; the first BANDS * ROWS of them make the keys.
MINIMA = 384
#: Bytes of minima that agree in a pair worth comparing, and in a likely link.
SIEVE = 274
LIKELY = 304
PART_ROWS = 2048
PART_SHINGLES = 1 << 22
ROWS_AT_ONCE = 512
#: Wanted texts for each word of 64 bits that is sent to all texts, and the most words there are:
#: beyond 8 million wanted texts more others pass by chance.
WANTED_A_WORD = 4
MOST_WORDS = 1 << 21


class Similar(NamedTuple):
    """The link rule: shingles of ``size`` words, similarity of at least ``least``."""

    size: int = 5
    least: float = 0.8


_DRAWS = np.random.default_rng(SEED)
_ODD = _DRAWS.integers(0, 1 << 31, (MINIMA, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _DRAWS.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(w, SEED) for w in words], dtype="<u8")
    n = max(len(words) - size + 1, 1)
    out = np.zeros(n, dtype="<u8")
    for i in range(min(size, len(words))):
        out = _mixed(out + hashes[i : i + n])
    return np.unique(out)


def set_key(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED)


def minima(grams: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set that is not empty."""
    low = np.full(MINIMA, ~np.uint32(0))
    # The upper halves of the hashes are mixed as well as the whole.
    halves = (grams >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(halves), PART):
        low = np.minimum(low, (halves[i : i + PART] * _ODD + _ADD).min(1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key per band of the minima."""
    out = np.arange(BANDS, dtype=np.uint64)
    for row in low[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS).T:
        out = _mixed(out + row)
    return out.view("<i8")


def key(text: Column, size: int) -> Column:
    """The hash of a text's shingle set, as a signed long."""

    @F.pandas_udf("long")
    def keyed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([set_key(shingles(t, size)) for t in texts], dtype="u8").view("i8"))

    return keyed(text)


def sketch(text: Column, size: int) -> Column:
    """Struct of the set's hash ``fp``, its size ``n``, its band keys ``bands`` and a byte of each
    of its minima ``sig``; the empty set has no bands."""

    @F.pandas_udf("fp long, n int, bands array<long>, sig binary")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        for texts in batches:
            fps, sizes, bands, sigs = [], [], [], []
            for text in texts:
                grams = shingles(text, size)
                low = minima(grams) if len(grams) else np.zeros(0, dtype=np.uint32)
                fps.append(set_key(grams))
                sizes.append(len(grams))
                bands.append(band_keys(low) if len(grams) else np.zeros(0, dtype="<i8"))
                sigs.append((low & np.uint32(0xFF)).astype(np.uint8).tobytes())
            yield pd.DataFrame({
                "fp": np.array(fps, dtype="u8").view("i8"), "n": np.array(sizes, dtype="i4"),
                "bands": pd.Series(bands, dtype=object), "sig": pd.Series(sigs, dtype=object),
            })
            del texts, bands, sigs
            give_back()

    return sketched(text)


def _agreeing(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many bytes every row of ``sigs`` agrees with ``one``."""
    return np.count_nonzero(sigs == one, axis=1)


def likely_links(sigs: np.ndarray) -> list[tuple[int, int]]:
    """(leader, member) for every member that likely is alike a leader before it; those that have
    none become leaders."""
    out, leaders, held = [], [0], sigs[:1]
    for i in range(1, len(sigs)):
        agree = _agreeing(held, sigs[i])
        j = int(agree.argmax())
        if agree[j] >= LIKELY:
            out.append((leaders[j], i))
        else:
            leaders.append(i)
            held = sigs[leaders]
    return out


CELL = ["band", "low", "high"]
MEMBER = "band long, low int, high int, fp long, n int, sig binary, bands binary, at int, root long, part int"


class Cell(NamedTuple):
    """The members of a part of a group, or of two parts, of which then only pairs across count."""

    n: np.ndarray
    fp: np.ndarray
    root: np.ndarray
    part: np.ndarray
    at: np.ndarray
    sigs: np.ndarray
    bands: np.ndarray
    sets: np.ndarray

    def met(self, i: int, least: float) -> np.ndarray:
        """Members behind ``i`` that count with it, have another root and fit in size."""
        later = slice(i + 1, None)
        # Sets of similarity s differ in size by a factor of at most s.
        fits = (self.root[later] != self.root[i]) & (self.n[later] * least <= self.n[i] + 1e-6)
        fits &= self.n[i] * least <= self.n[later] + 1e-6
        if self.part.min() != self.part.max():
            fits &= self.part[later] != self.part[i]
        return i + 1 + np.flatnonzero(fits)

    def possible(self, i: int, least: float) -> np.ndarray:
        """Members behind ``i`` that may be alike it and share no band before this cell's."""
        others = self.met(i, least)
        others = others[_agreeing(self.sigs[others], self.sigs[i]) >= SIEVE]
        at = self.at[0]
        return others[~(self.bands[others, :at] == self.bands[i, :at]).any(1)]


def _cell(frame: pd.DataFrame) -> Cell:
    """All rows of a frame; what it has no columns for is empty."""

    def table(name: str, kind: str, width: int) -> np.ndarray:
        joined = b"".join(frame[name]) if name in frame else bytes(len(frame) * width * np.dtype(kind).itemsize)
        return np.frombuffer(joined, dtype=kind).reshape(len(frame), width)

    sets = frame["grams"].to_numpy() if "grams" in frame else np.zeros(len(frame), dtype=object)
    return Cell(
        *(frame[c].to_numpy(dtype=np.int64) for c in ("n", "fp", "root", "part", "at")),
        table("sig", "u1", MINIMA), table("bands", "<i8", BANDS), sets,
    )


def _by_cell(of_cell: Callable[[Cell], np.ndarray], members: bool = False) -> Callable[[Iterator], Iterator]:
    """Batches whose cells come one after the other: the links of the pairs that ``of_cell`` finds
    in every cell, or the ``members`` that it marks."""

    def of_frame(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        whole = _cell(frame)
        cells = [Cell(*(x[a:b] for x in whole)) for a, b in zip(cuts, cuts[1:], strict=False)]
        found = [of_cell(cell) for cell in cells]
        if members:
            return frame[np.concatenate(found)]
        pairs = np.concatenate([cell.fp[at] for cell, at in zip(cells, found, strict=True)])
        return pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            frame = batch if held is None else pd.concat((held, batch), ignore_index=True)
            if not len(frame):
                continue
            keys = frame[CELL].to_numpy(dtype=np.int64)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            if len(cuts) > 1:
                yield of_frame(frame.iloc[: cuts[-1]], cuts)
            held = frame.iloc[cuts[-1] :]
        if held is not None:
            yield of_frame(held, np.array([0, len(held)]))

    return run


def _pairs(found: list[tuple[int, int]]) -> np.ndarray:
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def _led(cell: Cell) -> np.ndarray:
    """Pairs of members and likely leaders."""
    return _pairs(likely_links(cell.sigs))


def _likeliest(least: float) -> Callable[[Cell], np.ndarray]:
    """For every member the likeliest one behind it that has another root, if any is likely."""

    def of_cell(cell: Cell) -> np.ndarray:
        found = []
        if cell.root.min() != cell.root.max():
            for i in range(len(cell.fp) - 1):
                others = cell.met(i, least)
                if len(others):
                    agree = _agreeing(cell.sigs[others], cell.sigs[i])
                    if agree.max() >= LIKELY:
                        found.append((i, others[agree.argmax()]))
        return _pairs(found)

    return of_cell


def _undecided(least: float) -> Callable[[Cell], np.ndarray]:
    """Which members have a possible partner."""

    def of_cell(cell: Cell) -> np.ndarray:
        wanted = np.zeros(len(cell.fp), dtype=bool)
        if cell.root.min() != cell.root.max():
            for i in range(len(cell.fp) - 1):
                others = cell.possible(i, least)
                wanted[others] = True
                wanted[i] |= len(others) > 0
        return wanted

    return of_cell


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= least * (len(x) + len(y) - same) - 1e-9


def _compared(least: float) -> Callable[[Cell], np.ndarray]:
    """Pairs that connect the alike sets; what earlier ones connect is not compared."""

    def of_cell(cell: Cell) -> np.ndarray:
        found, root = [], cell.root.copy()
        cell = cell._replace(root=root)
        sets = [np.frombuffer(x, "<u8") for x in cell.sets]
        for i in range(len(root) - 1):
            for j in cell.possible(i, least):
                if root[i] != root[j] and _alike(sets[i], sets[j], least):
                    found.append((i, j))
                    root[root == root[j]] = root[i]
        return _pairs(found)

    return of_cell


def possibly_wanted(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """The ``text`` of all rows whose hash is a ``mark`` of ``wanted``, and of few others."""
    words = max(1, min(MOST_WORDS, wanted.count() // WANTED_A_WORD))

    def place(mark: Column) -> list[Column]:
        bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(_mark, 58) AS INT))")
        return [F.pmod(mark, F.lit(words)).alias("_word"), bit.alias("_bit")]

    masks = wanted.select(F.col("mark").alias("_mark")).select(*place(F.col("_mark"))).groupBy("_word").agg(
        F.bit_or("_bit").alias("_bits")
    )
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("_mark"))
    placed = rows.select("text", *place(F.col("_mark"))).join(F.broadcast(masks), "_word")
    return placed.filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select("text")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        give_back()
        for a, b in batches:
            out = []
            for x, y in zip(a, b, strict=True):
                out.append(_alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), least))
            yield pd.Series(out, dtype=bool)
            del a, b
            give_back()

    one = sets.select(F.col("fp").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("fp").alias("b"), F.col("grams").alias("y"))
    return written(pairs.join(one, "a").join(two, "b").filter(alike("x", "y")).select("a", "b"))


def groups_of(distinct: DataFrame) -> DataFrame:
    """(band, at, size, shingles, fp, n, sig): the members of every group of two or more sets that
    share a key, the ``at``-th of their bands; of groups with the same members the first is kept."""
    sent = distinct.select("fp", "n", F.posexplode("bands").alias("at", "band"))
    mark = F.xxhash64("fp")
    sizes = sent.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("at").alias("at"),
        F.bit_xor(mark).alias("xor"), F.sum(mark.cast("decimal(20,0)")).alias("sum"),
    ).filter("size > 1")
    kept = sizes.groupBy("size", "xor", "sum").agg(F.min(F.struct("at", "band", "shingles")).alias("k")).select("k.*", "size")
    return sent.select("fp", "band").join(kept, "band").join(distinct.select("fp", "n", "sig"), "fp")


def _cells(members: DataFrame, across: bool) -> DataFrame:
    """``members`` with their cells of at most two parts of a group: ``across`` every two parts of
    a group meet, else each stays alone."""
    parts = F.ceil(F.greatest(F.col("size") / PART_ROWS, F.col("shingles") / PART_SHINGLES)).cast("int")
    dealt = members.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "fp"), parts).cast("int"))
    met = F.sequence(F.lit(0), parts - 1) if across else F.array("part")
    return dealt.withColumn("other", F.explode(met)).withColumns(
        {"low": F.least("part", "other"), "high": F.greatest("part", "other")}
    ).drop("other", "size", "shingles")


def _together(cells: DataFrame) -> DataFrame:
    """The rows of a cell follow each other."""
    return cells.repartition(*CELL).sortWithinPartitions(*CELL, "fp")


def _open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their ``root``, of the groups that hold more than one."""
    rooted = groups.join(labels.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    return rooted.join(several.select("band"), "band", "left_semi")


def links(
    docs: DataFrame, text: str, distinct: DataFrame, rule: Similar,
    components: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Links (a, b) that connect all alike sets; ``distinct`` has (fp, n, bands, sig) of each, and
    ``mark``, the hash of one of its texts."""
    groups = written(groups_of(distinct))

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                sets = [shingles(t, rule.size) for t in batch["text"].iloc[at : at + ROWS_AT_ONCE]]
                yield pd.DataFrame({
                    "fp": np.array([set_key(s) for s in sets], dtype="u8").view("i8"),
                    "grams": [s.tobytes() for s in sets],
                })

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = written(wanted.join(distinct.select("fp", "mark"), "fp"))
        made = possibly_wanted(docs, text, wanted).mapInPandas(lean(gathered), "fp long, grams binary")
        # Copies collapse before anything moves.
        once = made.groupBy("fp").agg(F.first("grams").alias("grams"))
        return written(once.join(wanted, "fp", "left_semi"))

    def tried(cells: DataFrame, pairs_of: Callable) -> DataFrame:
        pairs = written(_together(cells).mapInPandas(lean(_by_cell(pairs_of)), "a long, b long").distinct())
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        return _verified(pairs, sets_of(wanted), rule.least)

    found = tried(_cells(groups.withColumn("root", F.col("fp")), False), _led)
    left = _open(groups, components(found))
    found = written(found.unionByName(tried(_cells(left, True), _likeliest(rule.least))).distinct())
    # Keys as bytes, which are read without a list in between.
    keyed = distinct.select("fp", _as_bytes(F.col("bands")).alias("bands"))
    left = _cells(_open(groups, components(found)).join(keyed, "fp"), True)
    names = [part.split()[0] for part in MEMBER.split(", ")]
    rows = written(_together(left.select(names)).mapInPandas(lean(_by_cell(_undecided(rule.least), True)), MEMBER))
    sets = sets_of(rows.select("fp").distinct())
    compared = _together(rows.join(sets, "fp")).mapInPandas(lean(_by_cell(_compared(rule.least))), "a long, b long")
    return written(found.unionByName(compared).distinct())


def _as_bytes(keys: Column) -> Column:
    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return column.map(lambda x: np.asarray(x, dtype="<i8").tobytes())

    return packed(keys)
