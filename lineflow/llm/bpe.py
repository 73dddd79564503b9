"""Byte-level BPE over a whole corpus, every distinct word encoded once.

Texts are split into pre-tokens; a document is its words by position. Consecutive documents
form blocks, and a block sends each of its distinct words once, packed by the part of the
vocabulary that the word's hash chooses. So a frequent word is counted in before anything is
shuffled, and there are as many rows as blocks times parts. A part gathers its words from all
blocks, encodes each distinct one once and answers every block with the ids of the words it
sent, in the same order. The answers are joined back to the block, where the documents, as
positions of word numbers, are put together again. Decoding looks every id up in the table of
token bytes, which is as large as the vocabulary.

Words and positions come from the same scan, evaluated once for each. A block's name is a hash
of what it holds; should the two evaluations ever see other documents in other order, the names
differ and the job fails rather than mixing them up. ``docs`` must therefore be a table or
another reproducible frame.

Defined results: NULL and empty texts have no ids. Repeated rows are encoded like any other;
rows without an id keep their place. An empty table gives an empty result. A block ends after
``BLOCK_CHARS`` code points, so a longer text is a block of its own, held whole in one task.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import regex
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineflow.llm.tokens import once_per_process

BLOCK_CHARS = 6_000_000
BLOCK_DOCS = 100_000


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, made once per process."""
    return once_per_process(
        f"encoding {path} {pattern}",
        lambda: tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}
        ),
    )


def _by_id(known: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(known.values()) + 1)
    for token, number in known.items():
        table[number] = token
    return table


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id, by id; one entry per token of the vocabulary."""
    return once_per_process(f"bytes {path}", lambda: _by_id(ranks(path)))


def squeezed(numbers: list[int]) -> bytes:
    """Word numbers as compressed byte planes: the high bytes are nearly all zero."""
    octets = np.array(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(octets.T.tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def packed(items: list[bytes]) -> bytes:
    """Byte strings behind their lengths, compressed."""
    sizes = np.fromiter(map(len, items), dtype="<u4", count=len(items))
    return zlib.compress(struct.pack("<I", len(items)) + sizes.tobytes() + b"".join(items), 1)


def unpacked(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n = struct.unpack_from("<I", data)[0]
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


class _Block:
    """Consecutive documents as positions of word numbers, in order of first occurrence."""

    def __init__(self, keep: bool) -> None:
        self.keep = keep
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.names: list = []
        self.positions: list[bytes] = []
        self.chars = 0
        self.digest = xxhash.xxh64()

    def add(self, name: object, text: str, words: list[str]) -> None:
        numbers = list(map(self.numbers.__getitem__, words))
        self.chars += len(text)
        self.digest.update(f"{name}\0{len(text)}\0".encode())
        self.digest.update(text.encode("utf-8", "replace"))
        self.names.append(name)
        if self.keep:
            self.positions.append(squeezed(numbers))

    def parts(self, parts: int) -> np.ndarray:
        """The vocabulary part of every word, by word number."""
        hashes = (zlib.crc32(word.encode("utf-8")) for word in self.numbers)
        return np.fromiter(hashes, dtype=np.int64, count=len(self.numbers)) % parts

    @property
    def name(self) -> int:
        value = self.digest.intdigest()
        return value - (1 << 64) if value >> 63 else value


def _blocks(batches: Iterator[pd.DataFrame], pattern: str, keep: bool) -> Iterator[_Block]:
    find = regex.compile(pattern).findall
    block = _Block(keep)
    for batch in batches:
        for name, text in zip(batch["id"].astype("Int64"), batch["text"], strict=True):
            text = text or ""
            block.add(name, text, find(text))
            if block.chars >= BLOCK_CHARS or len(block.names) >= BLOCK_DOCS:
                yield block
                block = _Block(keep)
    if block.names:
        yield block


def encode(
    docs: DataFrame, rank_file: str, pattern: str, id: str = "doc_id", text: str = "text",
    back: bool = False,
) -> DataFrame:
    """(id, ids) of every document: its ids as little-endian unsigned 32-bit integers. With
    ``back`` also ``bytes``, decoded from the ids in the same task."""
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, pattern, keep=False):
            known = list(block.numbers)
            part = block.parts(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            rows = [
                (block.name, p, packed([known[i].encode() for i in order[a:b]]))
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b
            ]
            yield pd.DataFrame(rows, columns=["block", "part", "words"])

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, pattern, keep=True):
            yield pd.DataFrame({
                "block": block.name, "at": range(-1, len(block.names)),
                "id": pd.array([None, *block.names], dtype="Int64"),
                "positions": [squeezed(block.parts(parts)), *block.positions],
            })

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoding(rank_file, pattern)
        part, known = None, {}
        for batch in batches:
            for row in batch.itertuples():
                if row.part != part:
                    part, known = row.part, {}
                sent = unpacked(row.words)
                for word in set(sent).difference(known):
                    known[word] = np.array(model.encode_ordinary(word.decode()), dtype="<u4").tobytes()
                yield pd.DataFrame({
                    "block": [row.block], "part": [row.part],
                    "ids": [packed([known[word] for word in sent])],
                })

    def together(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("at")
        # Blocks that hold the same documents share a name, and everything else.
        docs, heads = docs[docs["at"] >= 0], docs[docs["at"] < 0]
        part = unsqueezed(heads["positions"].iloc[0])
        ids = [x for answer in answers.drop_duplicates("part").sort_values("part")["ids"] for x in unpacked(answer)]
        if len(ids) != len(part):
            raise RuntimeError("the documents changed between two scans; write them first")
        table = np.empty(len(part), dtype=object)
        table[np.argsort(part, kind="stable")] = ids
        table = table.tolist()
        out = pd.DataFrame({
            "id": docs["id"].astype("Int64"),
            "ids": [
                b"".join(map(table.__getitem__, unsqueezed(p).tolist())) for p in docs["positions"]
            ],
        })
        if back:
            out["bytes"] = decoder(rank_file)(out["ids"])
        return out

    by_part = (
        source.mapInPandas(words, "block long, part int, words binary")
        .repartition("part").sortWithinPartitions("part")
        .mapInPandas(encoded, "block long, part int, ids binary")
    )
    by_doc = source.mapInPandas(positions, "block long, at int, id long, positions binary")
    joined = by_doc.groupBy("block").cogroup(by_part.groupBy("block"))
    layout = "id long, ids binary" + ", bytes binary" * back
    return joined.applyInPandas(together, layout).withColumnRenamed("id", id)


def decoder(rank_file: str) -> Callable[[pd.Series], pd.Series]:
    """A function from encoded ids to their bytes, by lookup in the table of token bytes."""
    table = token_bytes(rank_file)

    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([
            None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist()))
            for x in ids
        ], dtype=object, index=ids.index)

    return decode


def decoded(ids: Column, rank_file: str) -> Column:
    """The bytes of encoded ids, by lookup in the table of token bytes; NULL stays NULL."""

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from map(decoder(rank_file), batches)

    return decode(ids)
