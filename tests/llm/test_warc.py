"""WARC bundles: round trips, frames, record maps, and who revisits whom."""

import base64
import hashlib
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from lineflow.llm import warc

PAGES = "page_id long, url string, html string, digest string, size int, met boolean, last long, n int, bundle binary"
LONG = "long text " * 40_000


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, False, 2, 3, b"y") for i, u, h in rows], PAGES)


ROWS = [
    (1, "http://a.org/1", "<p>one</p>"), (2, "http://a.org/2", "<p>two</p>"), (3, "http://a.org/3", "<p>one</p>"),
    (4, None, None), (5, "", ""), (6, "http://a.org/x y\r\nEvil: 1", "é\r\n\r\nWARC/1.1\r\n"), (7, "http://l", LONG),
    (8, "http://l/again", LONG), (3, "http://a.org/3b", "<p>one</p>"), (2, "http://a.org/2", "<p>other</p>"),
    (None, "http://none", "<p>two</p>"), (None, "http://none", "<p>alone</p>"), (-9, "http://m", "<p>one</p>"),
]


def expected(rows, least=0):
    last = {}
    for i, _, h in rows:
        h = (h or "").encode()
        last.setdefault(h, []).append(i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        known = [x for x in last[h] if x is not None]
        top = max(known) if known else None
        again = len(last[h]) > 1 and i != top and len(h) >= least
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def got(rows):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)


@pytest.mark.parametrize("least,broadcast,frame_bytes,bundle_bytes", [(0, 1000, 1 << 18, 1 << 26), (5, 0, 600, 900)])
def test_round_trip(spark, tmp_path, least, broadcast, frame_bytes, bundle_bytes):
    path = f"file://{tmp_path}/w"
    pages = frame(spark, ROWS * 1).repartition(2)
    warc.write(pages, path, least_bytes=least, broadcast_rows=broadcast, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    back = warc.read(spark, path).collect()
    assert got(back) == expected(ROWS, least)
    payloads = {(r.page_id, r.payload_digest): bytes(r.payload) for r in back if r.record_type == "response"}
    for i, _, h in ROWS:
        digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        if (i, digest) in payloads:
            assert payloads[i, digest] == (h or "").encode()
    assert {r.url for r in back if r.page_id == 6} == {"http://a.org/x%20y%0D%0AEvil:%201"}
    assert {r.url for r in back if r.page_id == 4} == {None}

    # The files are plain Zstandard streams of records, and their frames stand alone.
    files = sorted(Path(tmp_path, "w").glob("part-*"))
    places = 0
    for file in files:
        bundle = file.read_bytes()
        table = warc.seek_table(bundle)
        whole = zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read()
        assert whole == b"".join(warc.frame(bundle, at) for at in table if at[2])
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        places += len(warc.places(bundle))
    assert places == len(ROWS)
    if bundle_bytes == 900:
        assert len(files) > 5

    known = warc.index(spark, path)
    assert known.count() == len(ROWS)
    asked = spark.createDataFrame([(3,), (7,), (99,)], "page_id long")
    found = warc.lookup(spark, path, known, asked).collect()
    assert got(found) == [r for r in expected(ROWS, least) if r[0] in (3, 7)]


def test_only_wanted_frames_are_read():
    bundle = warc.Bundle(100, 3, "2020-01-01T00:00:00Z")
    for i in range(20):
        body = b"body %d" % i * 10
        digest = warc.spelled(hashlib.sha1(body).digest())
        bundle.add(*warc.page_record(i, "u", body, len(body), digest, None, False, "d"))
    data = bundle.closed()
    places, table = warc.places(data), warc.seek_table(data)
    at = table[places[7].frame]
    # Everything but one frame, the record map and the seek table may be lost.
    kept = bytearray(len(data))
    kept[at[0] : at[0] + at[1]] = data[at[0] : at[0] + at[1]]
    (record,) = next(warc.records(bytes(kept[: table[-1][0]]) + data[table[-1][0] :], [places[7]]))
    assert warc.parsed(record)["page_id"] == 7
    with pytest.raises(ValueError):
        warc.parsed(record.replace(b"body 7", b"body 8"))
    with pytest.raises(ValueError):
        warc.seek_table(data[:-1])


def test_hot_payload_and_empty_table(spark, tmp_path):
    none = f"file://{tmp_path}/none"
    warc.write(frame(spark, []), none)
    assert warc.read(spark, none).count() == 0 and warc.index(spark, none).count() == 0
    rows = [(i, f"u{i}", "same" if i % 3 == 0 else f"pair {i // 6}") for i in range(1200)]
    pages = frame(spark, rows)
    for limit in (10_000, 3):
        marked = warc.with_responses(pages, broadcast_rows=limit)
        seen = {(r.id, r.revisit, r.refers_to) for r in marked.collect()}
        assert seen == {(r[0], r[3] == "revisit", r[4]) for r in expected(rows)}
    assert marked.filter("revisit AND payload IS NOT NULL").count() == 0
    assert marked.filter(F.col("payload").isNull() & ~F.col("revisit")).count() == 0
