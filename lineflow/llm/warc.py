"""WARC archives as seekable Zstandard bundles.

A bundle is one file. Its records are grouped into frames that decompress on their own; then
come a skippable frame that says, for every record, in which frame and where in it the record
lies, and the seek table of the Zstandard seekable format: the sizes of all frames before it,
their number and a closing magic number. So a reader finds the seek table at the end of the
file, the record map in front of it, and decompresses only the frames that it needs; a reader
that knows nothing of this sees one Zstandard stream of WARC records.

Spark's text writer puts a bundle into each file and commits all files together, to any store:
a row is the bundle without its last four bytes, and the line separator is those four bytes.
Spark's reader of whole files reads them back.

Pages with equal payloads share one: the page with the largest id is written as a response, the
others as revisits that name it. Payloads are compared by digest and length. Only the digests
that occur twice or more are gathered, in a table that is broadcast up to a counted size; beyond
it only the few digests that can hold many pages each are, and pages join the rest by digest.

Defined results: a NULL payload is an empty one. A NULL id ranks below all others and stays NULL.
Rows that repeat an id together with its payload are the same page, and all responses if it is
the largest. A NULL address leaves out the header; white space and control characters in an
address are percent-encoded. An empty table gives an empty folder. A record longer than a frame
has a frame of its own, one longer than a bundle a bundle of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.operators.positions import BROADCAST_ROWS, HOT_SHARE
from lineflow.session import shared_folder, written

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
LEVEL = 3

# --- Fixed values: WARC 1.1 and the Zstandard seekable format ------------------------------
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE = 0x184D2A5D
SEEK_TABLE = 0x184D2A5E
SEEK_END = bytes.fromhex("b1ea928f")
# --------------------------------------------------------------------------------------------

NAME = "urn:x-page"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_NAMED = re.compile(rf"<{NAME}:(-?[0-9]*):([A-Z2-7]{{32}})>")


class Place(NamedTuple):
    """Where a record lies: its frame, and its bytes in the decompressed frame."""

    record_id: str
    frame: int
    start: int
    length: int


def spelled(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_name(page: int | None, digest: str) -> str:
    return f"<{NAME}:{'' if page is None else page}:{digest}>"


def page_of(record_id: str) -> int | None:
    number = _NAMED.fullmatch(record_id).group(1)
    return int(number) if number else None


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in [*headers, ("Content-Length", str(len(block)))]]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(
    page: int | None, url: str | None, payload: bytes | None, size: int, digest: str,
    refers_to: int | None, revisit: bool, date: str,
) -> tuple[str, bytes]:
    """The record of one page and its name. A revisit has the response's HTTP header only."""
    name = record_name(page, digest)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_name(refers_to, digest))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    return name, _record(headers, http.encode() + (b"" if revisit else payload))


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, body = block.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines), body


def parsed(record: bytes) -> dict:
    """What a page's record says; a response's payload is measured and digested anew."""
    headers, rest = _headers(record)
    length = int(headers["Content-Length"])
    if not record.startswith(VERSION) or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {headers.get('WARC-Record-ID')}")
    http, payload = _headers(rest[:length])
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = kind == "revisit"
    if not revisit and (len(payload) != int(http["Content-Length"]) or spelled(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"the payload is not the one recorded: {headers['WARC-Record-ID']}")
    return {
        "record_id": headers["WARC-Record-ID"], "page_id": page_of(headers["WARC-Record-ID"]),
        "url": headers.get("WARC-Target-URI"), "record_type": kind,
        "payload_bytes": int(http["Content-Length"]), "payload_digest": digest,
        "refers_to": page_of(headers["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


class Bundle:
    """A bundle being written."""

    def __init__(self, frame_bytes: int, level: int, date: str) -> None:
        self.frame_bytes = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.places: list[Place] = []
        self.open: list[bytes] = []
        self.filled = self.total = 0
        named = f"<urn:uuid:{uuid.uuid4()}>"
        about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", named), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        self._put(_record(about, b"format: WARC File Format 1.1\r\n"))

    def _put(self, record: bytes) -> None:
        self.open.append(record)
        self.filled += len(record)
        self.total += len(record)

    def _close_frame(self) -> None:
        if self.open:
            self._append(self.packer.compress(b"".join(self.open)), self.filled)
            self.open, self.filled = [], 0

    def _append(self, frame: bytes, size: int) -> None:
        self.frames.append(frame)
        self.sizes.append((len(frame), size))

    def add(self, name: str, record: bytes) -> None:
        if self.filled + len(record) > self.frame_bytes:
            self._close_frame()
        self.places.append(Place(name, len(self.frames), self.filled, len(record)))
        self._put(record)

    def closed(self) -> bytes:
        self._close_frame()
        lines = "\n".join("\t".join(map(str, place)) for place in self.places)
        known = self.packer.compress(lines.encode())
        self._append(struct.pack("<II", SKIPPABLE, len(known)) + known, 0)
        table = b"".join(struct.pack("<II", *pair) for pair in self.sizes)
        table += struct.pack("<IB", len(self.sizes), 0) + SEEK_END
        return b"".join(self.frames) + struct.pack("<II", SEEK_TABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, from the footer of a bundle."""
    if bundle[-4:] != SEEK_END:
        raise ValueError("no seek table")
    count, _ = struct.unpack_from("<IB", bundle, len(bundle) - 9)
    begin = len(bundle) - 9 - 8 * count
    magic, size = struct.unpack_from("<II", bundle, begin - 8)
    if magic != SEEK_TABLE or size != 8 * count + 9:
        raise ValueError("a broken seek table")
    out, at = [], 0
    for packed, size in struct.iter_unpack("<II", bundle[begin : begin + 8 * count]):
        out.append((at, packed, size))
        at += packed
    return out


def places(bundle: bytes) -> list[Place]:
    """Where every page's record lies, from the last frame before the seek table."""
    at, packed, _ = seek_table(bundle)[-1]
    magic, size = struct.unpack_from("<II", bundle, at)
    if magic != SKIPPABLE or size != packed - 8:
        raise ValueError("no record map")
    lines = zstandard.ZstdDecompressor().decompress(bundle[at + 8 : at + packed]).decode()
    rows = (line.split("\t") for line in lines.split("\n")) if lines else ()
    return [Place(name, int(frame), int(start), int(length)) for name, frame, start, length in rows]


def frame(bundle: bytes, at: tuple[int, int, int]) -> bytes:
    """One frame, decompressed."""
    return zstandard.ZstdDecompressor().decompress(bundle[at[0] : at[0] + at[1]], max_output_size=at[2])


def records(bundle: bytes, wanted: list[Place]) -> Iterator[list[bytes]]:
    """The records at ``wanted``, one list a frame; other frames are not decompressed."""
    table = seek_table(bundle)
    by_frame: dict[int, list[Place]] = {}
    for place in wanted:
        by_frame.setdefault(place.frame, []).append(place)
    for number, here in sorted(by_frame.items()):
        data = frame(bundle, table[number])
        yield [data[p.start : p.start + p.length] for p in here]


def with_responses(
    pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html",
    least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(id, url, payload, size, digest, refers_to, revisit) of every page; revisits lose their
    payload. Pages with equal payloads of at least ``least_bytes`` bytes share a response."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    shared = written(
        rows.filter(F.col("size") >= least_bytes).groupBy("digest", "size")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).filter("n > 1")
    )
    distinct, of_these = shared.agg(F.count(F.lit(1)), F.sum("n")).first()

    def known(some: DataFrame, mark: str = "") -> DataFrame:
        return some.select(
            F.col("digest").alias(f"d{mark}"), F.col("size").alias(f"s{mark}"),
            F.lit(True).alias(f"met{mark}"), F.col("last").alias(f"last{mark}"),
        )

    def same(key: str, mark: str = "") -> Column:
        return (F.col(key) == F.col(f"d{mark}")) & (F.col("size") == F.col(f"s{mark}"))

    if distinct <= broadcast_rows:
        joined = rows.join(F.broadcast(known(shared)), same("digest"), "left")
    else:
        # Fewer than HOT_SHARE payloads can each have more than that share of these pages.
        hot = F.col("n") * HOT_SHARE > of_these
        near = rows.join(F.broadcast(known(shared.filter(hot))), same("digest"), "left")
        # Their pages join nothing any more, and spread by a hash of their own.
        near = near.withColumn(
            "by", F.when(F.col("met"), F.concat(F.lit("-"), F.xxhash64("id", "url"))).otherwise(F.col("digest"))
        )
        joined = near.join(known(shared.filter(~hot), "2"), same("by", "2"), "left").withColumns(
            {"met": F.coalesce("met", "met2"), "last": F.coalesce("last", "last2")}
        )
    revisit = F.coalesce(F.col("met"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("last"))
    return joined.select(
        "id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest",
        F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"),
    )


def write(
    pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html",
    least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Write a record of every page into bundles under ``path``."""

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle = None
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["id"].astype("Int64")]
            refers = [None if pd.isna(x) else int(x) for x in batch["refers_to"].astype("Int64")]
            for page, to, row in zip(ids, refers, batch.itertuples(), strict=True):
                bundle = bundle or Bundle(frame_bytes, level, date)
                bundle.add(*page_record(
                    page, row.url if isinstance(row.url, str) else None, row.payload, row.size, spelled(bytes.fromhex(row.digest)), to, row.revisit, date,
                ))
                if bundle.total >= bundle_bytes:
                    yield pd.DataFrame({"bundle": [bundle.closed()[: -len(SEEK_END)]]})
                    bundle = None
        if bundle is not None:
            yield pd.DataFrame({"bundle": [bundle.closed()[: -len(SEEK_END)]]})

    rows = with_responses(pages, id, url, payload, least_bytes, broadcast_rows)
    made = rows.mapInPandas(bundles, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    # One row a file. The separator's bytes are written as they are.
    made.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option(
        "lineSep", SEEK_END.decode("latin-1")
    ).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


RECORD = (
    "record_id string, page_id long, url string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to long, payload binary"
)


def _frames(bundle: bytes, wanted: list[Place]) -> Iterator[pd.DataFrame]:
    for found in records(bundle, wanted):
        out = pd.DataFrame([parsed(r) for r in found])
        out["page_id"] = pd.array(out["page_id"], dtype="Int64")
        out["refers_to"] = pd.array(out["refers_to"], dtype="Int64")
        yield out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every page's record in the bundles at ``path``, by their own record maps."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle in batch["content"]:
                yield from _frames(bundle, places(bundle))

    return _files(spark, path).select("content").mapInPandas(parse, RECORD)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, file, frame, start, length) of every page's record; no record is
    decompressed."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, bundle in zip(batch["file"], batch["content"], strict=True):
                out = pd.DataFrame(places(bundle), columns=Place._fields)
                out["page_id"] = pd.array([page_of(r) for r in out["record_id"]], dtype="Int64")
                out["file"] = name
                yield out

    return _files(spark, path).mapInPandas(
        parse, "record_id string, page_id long, file string, frame int, start long, length long"
    )


def lookup(spark: SparkSession, path: str, known: DataFrame, ids: DataFrame, id: str = "page_id") -> DataFrame:
    """The records of the pages in ``ids``, through ``known`` (from :func:`index`, which may be
    stored): only their files are opened and only their frames decompressed."""
    asked = ids.select(F.col(id).cast("long").alias("page_id")).distinct()
    hits = known.join(asked, "page_id", "left_semi")
    # At most the records of one bundle come together.
    wanted = hits.groupBy("file").agg(
        F.collect_list(F.struct("record_id", "frame", "start", "length")).alias("places")
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle, here in zip(batch["content"], batch["places"], strict=True):
                yield from _frames(bundle, [Place(p["record_id"], p["frame"], p["start"], p["length"]) for p in here])

    return _files(spark, path).join(wanted, "file").select("content", "places").mapInPandas(parse, RECORD)


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lineflow-warc/{uuid.uuid4().hex}"
