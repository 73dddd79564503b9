"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``CAPACITY`` tokens; full pieces are sequences of their
own. The others are dealt by hash into shards of about ``SHARD_ITEMS``, and every shard is
packed by ``ISLANDS`` islands, each in its own task. An island starts from best-fit packings
of shuffled orders and evolves them: crossover injects whole well-filled bins of one parent
into another, drops the bins that would hold an item twice, and best-fits the displaced items.
After each epoch an island's elite also moves to the next island. A shard whose elite needs no
more bins than its tokens demand is finished at once, and at the end each shard keeps its best
packing. Only lengths travel between islands, never texts.

Defined results: NULL and empty texts are documents of the end token alone. Repeated rows are
documents of their own, each packed. Without rows the result is empty. A long text is held as
one id array while it is cut.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineflow.llm import tokens
from lineflow.llm.memory import lean
from lineflow.session import written

CAPACITY = 4096
END = 1
SHARD_ITEMS = 4000
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 12
WELL_FILLED = 0.99
#: Documents encoded together.
TOGETHER = 256


def _cut(names: pd.Series, coded: list[bytes], last: bytes, capacity: int) -> pd.DataFrame:
    rows = []
    for name, ids in zip(names, coded, strict=True):
        ids += last
        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            rows.append((name, piece, at // 4, len(part) // 4, zlib.crc32(part)))
    out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
    return out.astype({"id": names.dtype})


def pieces(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text",
    end: int = END, capacity: int = CAPACITY,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids, end token included."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(tokenizer, tokens.BARE)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                part = batch.iloc[at : at + TOGETHER]
                coded = encode(["" if t is None else t for t in part["text"]])
                yield _cut(part["id"], coded, last, capacity)

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return source.mapInPandas(
        lean(_nullable_ids(cut)), "id long, piece int, start long, length long, ids_crc32 long"
    ).withColumnRenamed("id", id)


def _nullable_ids(work):
    """``work`` over batches whose ids are nullable integers, not floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return work(b.assign(id=b["id"].astype("Int64")) for b in batches)

    return run


class Packing:
    """Bins as lists of items, with their free space."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def place(self, items: list[int]) -> Packing:
        """Best fit: each item goes where the least space remains."""
        order = sorted((space, b) for b, space in enumerate(self.free) if space)
        for item in items:
            size = self.lengths[item]
            at = bisect_left(order, (size, -1))
            if at < len(order):
                space, b = order.pop(at)
                self.bins[b].append(item)
            else:
                space, b = self.capacity, len(self.bins)
                self.bins.append([item])
                self.free.append(space)
            self.free[b] = space - size
            if space > size:
                insort(order, (space - size, b))
        return self

    def fitness(self) -> float:
        fill = 1 - np.array(self.free, dtype=float) / self.capacity
        return float((fill**2).mean()) - len(self.bins)

    def genes(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), dtype="<i4")
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def from_genes(genes: np.ndarray, lengths: list[int], capacity: int) -> Packing:
    out = Packing(lengths, capacity)
    order = np.argsort(genes, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(genes[order]) != 0])
    out.bins = [part.tolist() for part in np.split(order, cuts[1:])]
    out.free = [capacity - sum(lengths[i] for i in items) for items in out.bins]
    return out


def crossover(mother: Packing, father: Packing, rng: np.random.Generator) -> Packing:
    """``mother`` with a choice of the well-filled bins of ``father``."""
    limit = (1 - WELL_FILLED) * father.capacity
    good = [b for b, space in enumerate(father.free) if space <= limit]
    good = [b for b, take in zip(good, rng.random(len(good)) < 0.5, strict=True) if take]
    taken = {item for b in good for item in father.bins[b]}
    child = Packing(mother.lengths, mother.capacity)
    displaced = []
    for b, items in enumerate(mother.bins):
        if taken.isdisjoint(items):
            child.bins.append(list(items))
            child.free.append(mother.free[b])
        else:
            displaced += [item for item in items if item not in taken]
    for b in good:
        child.bins.append(list(father.bins[b]))
        child.free.append(father.free[b])
    # The emptiest bins are opened again, so that the displaced items meet others.
    worst = sorted(range(len(child.bins)), key=lambda b: -child.free[b])[: max(1, len(child.bins) // 50)]
    for b in sorted(worst, reverse=True):
        displaced += child.bins.pop(b)
        child.free.pop(b)
    displaced.sort(key=lambda i: -child.lengths[i])
    return child.place(displaced)


def evolve(
    lengths: list[int], elites: list[np.ndarray], seed: int, capacity: int = CAPACITY,
    population: int = POPULATION, generations: int = GENERATIONS,
) -> Packing:
    """The best packing an island finds; items come in falling order of length."""
    demand = math.ceil(sum(lengths) / capacity)
    rng = np.random.default_rng(seed)
    packings = [from_genes(g, lengths, capacity) for g in elites]
    if not packings:
        packings.append(Packing(lengths, capacity).place(list(range(len(lengths)))))
    best = max(packings, key=Packing.fitness)
    if len(best.bins) <= demand:
        return best
    sizes = np.array(lengths)
    while len(packings) < population:
        order = np.argsort(-sizes * (1 + 0.2 * rng.random(len(sizes))), kind="stable")
        packings.append(Packing(lengths, capacity).place(order.tolist()))
    for _ in range(generations):
        packings.sort(key=Packing.fitness, reverse=True)
        if len(packings[0].bins) <= demand:
            break
        mother, father = (packings[i] for i in rng.permutation(len(packings))[:2])
        packings[-1] = crossover(mother, father, rng)
    return max(packings, key=Packing.fitness)


def _lengths(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values(["length", "item"], ascending=[False, True])


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(item, sequence_id, offset) for rows (item, length); items are distinct longs."""
    count = items.filter(F.col("length") < capacity).count()
    shards = max(1, math.ceil(count / shard_items))
    full = items.filter(F.col("length") >= capacity).select(
        "item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    small = items.filter(F.col("length") < capacity).select(
        "item", F.col("length").cast("int").alias("length"),
        F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"),
    )
    spread = small.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))

    def first(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return again(key, part, None)

    def again(key: tuple, part: pd.DataFrame, elites: pd.DataFrame | None) -> pd.DataFrame:
        lengths = _lengths(part)["length"].tolist()
        if not lengths:
            return pd.DataFrame({"shard": [], "island": [], "bins": [], "genes": []})
        shard, island = int(key[0]), int(key[1])
        known = [] if elites is None else [
            np.frombuffer(g, dtype="<i4") for g in elites.sort_values("came_from")["genes"]
        ]
        best = evolve(lengths, known, 1000 * shard + 10 * island + (elites is not None), capacity)
        return pd.DataFrame({
            "shard": [shard], "island": [island], "bins": [len(best.bins)],
            "genes": [best.genes().tobytes()],
        })

    state = "shard int, island int, bins int, genes binary"
    elites = written(spread.groupBy("shard", "island").applyInPandas(first, state))
    for _ in range(EPOCHS - 1):
        moved = elites.withColumn("came_from", F.col("island")).withColumn(
            "island", F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS))))
        )
        elites = written(
            spread.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island"))
            .applyInPandas(again, state)
        )
    best = elites.groupBy("shard").agg(F.min_by("genes", F.struct("bins", "island")).alias("genes"))

    def assign(key: tuple, part: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        part = _lengths(part)
        if part.empty:
            return pd.DataFrame({"item": [], "sequence_id": [], "offset": []})
        bins = np.frombuffer(chosen["genes"].iloc[0], dtype="<i4")
        lengths = part["length"].groupby(bins)
        return pd.DataFrame({
            "item": part["item"].to_numpy(),
            "sequence_id": (int(key[0]) << 32) + bins.astype(np.int64),
            "offset": (lengths.cumsum() - part["length"]).to_numpy(dtype=np.int64),
        })

    packed = small.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(
        assign, "item long, sequence_id long, offset long"
    )
    return full.unionByName(packed)


def packed_documents(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text",
    end: int = END, capacity: int = CAPACITY,
) -> DataFrame:
    """Every piece of every document with its place: sequence and offset."""
    cut = written(
        pieces(docs, tokenizer, id, text, end, capacity)
        .withColumn("item", F.monotonically_increasing_id())
    )
    places = pack(cut.select("item", "length"), capacity)
    return cut.join(places, "item").drop("item")
