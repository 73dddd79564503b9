"""Token ids in binary files with Elias-Fano document boundaries.

The format is a Parquet folder; Spark writes it to any store and commits it as a whole. One
row is a segment: some consecutive documents with their concatenated ids as little-endian
unsigned 16-bit integers (32-bit if the vocabulary is larger), and where each document ends.
The ends are Elias-Fano coded: the low bits of each end are packed, the high bits are unary in
a bit vector, about 2 + log2(ids / documents) bits per document in all. ``select`` finds a
document's end from a sample of the vector's ones, without a table of offsets.

Segments belong to shards in ascending order of document ids: a shard is a range partition,
sorted. Where a shard begins follows from the shards' totals, which are as few as the
partitions, so reading a document's place needs no pass over earlier ids.

Defined results: a NULL or empty text is a document of the end id alone. Rows without an id
come first. Repeated ids are kept, next to each other. An empty table gives an empty folder. A
text longer than a segment gets a segment of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineflow.llm import tokens
from lineflow.llm.memory import lean
from lineflow.session import shared_folder

END = 0
SEGMENT_IDS = 1 << 20
SAMPLE = 256

SCHEMA = (
    "shard int, segment int, before long, n_ids long, doc_ids array<bigint>, width int,"
    " low_bits int, low binary, high binary, samples binary, ids binary"
)


class Boundaries:
    """An Elias-Fano coded non-decreasing sequence."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.count, self.low_bits = count, low_bits
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> Boundaries:
        count = len(values)
        universe = int(values[-1]) if count else 0
        low_bits = max(0, int(universe // max(count, 1)).bit_length() - 1)
        values = values.astype(np.int64)
        shifts = np.arange(low_bits)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).reshape(-1), bitorder="little")
        ones = (values >> low_bits) + np.arange(count)
        vector = np.zeros(int(ones[-1]) + 1 if count else 0, dtype=np.uint8)
        vector[ones] = 1
        high = np.packbits(vector, bitorder="little")
        return cls(count, low_bits, low.tobytes(), high.tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.int64)
        bits = at[:, None] * self.low_bits + np.arange(self.low_bits)
        return ((self.low[bits >> 3] >> (bits & 7)) & 1).astype(np.int64) @ (
            np.int64(1) << np.arange(self.low_bits)
        )

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled one before it."""
        at, seen = int(self.samples[i // SAMPLE]), i - i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        while seen + word.bit_count() <= i:
            seen += word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(i - seen):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        return ((position - i) << self.low_bits) | int(self._lows(np.array([i]))[0])

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        order = np.arange(self.count)
        return ((ones - order) << self.low_bits) | self._lows(order)


def write(
    docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text",
    end: int = END, segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every document and write the format to ``path``, in ascending id order."""
    vocabulary = tokens.tokenizer(tokenizer).get_vocab_size()
    width = 2 if max(vocabulary, end + 1) <= 1 << 16 else 4

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(tokenizer, tokens.SPACED)
        last = np.array([end], dtype="<u4").tobytes()
        shard = TaskContext.get().partitionId()
        number, before = 0, 0
        names: list = []
        chunks: list[bytes] = []
        ends: list[int] = []

        def close() -> pd.DataFrame:
            nonlocal number, before
            b = Boundaries.encode(np.array(ends, dtype=np.int64))
            ids = np.frombuffer(b"".join(chunks), dtype="<u4").astype(f"<u{width}")
            row = (
                shard, number, before, ends[-1], list(names), width, b.low_bits,
                b.low.tobytes(), b.high.tobytes(), b.samples.tobytes(), ids.tobytes(),
            )
            number, before = number + 1, before + ends[-1]
            names.clear(), chunks.clear(), ends.clear()
            return pd.DataFrame([row], columns=[part.split()[0] for part in SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                coded = encode(["" if t is None else t for t in part["text"]])
                for name, ids in zip(part["id"].astype("Int64"), coded, strict=True):
                    size = len(ids) // 4 + 1
                    if ends and ends[-1] + size > segment_ids:
                        yield close()
                    names.append(None if name is pd.NA else int(name))
                    chunks.append(ids + last)
                    ends.append((ends[-1] if ends else 0) + size)
        if ends:
            yield close()

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = source.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first()
    )
    ordered.mapInPandas(lean(segments), SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files at ``path``; the
    ids themselves only if wanted, as they are what costs to hand on."""
    wanted = ids
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if wanted else "")
    stored = spark.read.schema(SCHEMA).parquet(path)
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard, so the running total and the broadcast are as small as the file list.
    bases = stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")
    )
    placed = stored.join(F.broadcast(bases), "shard")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                names = [None if pd.isna(n) else int(n) for n in row.doc_ids]
                known = Boundaries(len(names), row.low_bits, row.low, row.high, row.samples)
                ends = known.values()
                starts = np.r_[0, ends[:-1]]
                ids = np.frombuffer(row.ids, dtype=f"<u{row.width}").astype("<u4")
                parts = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                found = pd.DataFrame({
                    "doc_id": pd.array(names, dtype="Int64"),
                    "start": row.base + row.before + starts, "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(p) for p in parts],
                })
                yield found.assign(ids=parts) if wanted else found

    return placed.mapInPandas(lean(documents), columns)


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lineflow-tokens/{uuid.uuid4().hex}"
