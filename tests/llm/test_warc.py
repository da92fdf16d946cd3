"""Web archives: an exact round trip, files other tools can read, hand-made records."""

from __future__ import annotations

import gzip
import hashlib
from collections import Counter

import pytest

from velomart.llm import warc
from velomart.llm.common import read_blobs

BIG = "<p>é payload\r\n\r\nWARC/1.1</p>" * 60
ROWS = [
    (1, "http://a.example/x?y=1", BIG, "x"), (5, "http://b.example/ä b\r\nX: y", BIG, "x"), (3, None, BIG, "x"), (None, "http://c.example", BIG, "x"),
    (7, "", "small", "x"), (8, "u", "small", "x"), (9, "u", None, "x"), (10, "u", "", "x"), (7, "", "small", "x"), (5, "other", BIG, "x"),
    (11, "http://[bad", "z" * 70_000, "x"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, type string")


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    path = warc.write_archives(frame(spark, ROWS))
    got = warc.captures(spark, path, payloads=True).collect()
    expected = Counter()
    for page_id, url, text, _ in ROWS:
        payload = (text or "").encode()
        revisit = text == BIG and page_id != 5
        expected[page_id, url, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None, None if revisit else payload] += 1
    assert expected == Counter(
        (r.metadata.page_id, r.metadata.url, r.capture.payload_bytes, r.capture.payload_digest, r.capture.type, r.refers_to_page,
         None if r.capture.payload is None else bytes(r.capture.payload)) for r in got
    )
    assert all(r.request.request.startswith("GET ") for r in got)
    files = [bytes(r.blob) for r in read_blobs(spark, path).collect()]
    assert len(files) > 1
    whole = b"".join(gzip.decompress(f) for f in files)  # zero padding is allowed after the members
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == 3 * len(ROWS)


def test_hand_made_records(spark, tmp_path):
    path = str(tmp_path / "one")
    good = warc.transaction(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    alone = warc.transaction(2, "v", b"other", hashlib.sha1(b"other").hexdigest(), None)[1]
    warc.write_blobs(spark.createDataFrame([(bytearray(b"".join([*good[::-1], alone])),)], "blob binary"), path)
    got = {r.capture.uri: r for r in warc.captures(spark, path).collect()}
    assert got["u"].metadata.page_id == 1
    assert got["v"].metadata is None and got["v"].request is None
    wrong = str(tmp_path / "wrong")
    bad = warc.transaction(3, "w", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    warc.write_blobs(spark.createDataFrame([(bytearray(b"".join(bad)),)], "blob binary"), wrong)
    with pytest.raises(Exception, match="not the one stated"):
        warc.read_records(spark, wrong).collect()


def test_members_and_empty_table(spark):
    parts = [b"x" * 200_000, b"", b"tail"]
    content = b"".join(gzip.compress(p) for p in parts)
    assert list(warc.members(content + b"\0", 1000)) == parts
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(content[:-3]))
    assert warc.described(frame(spark, [])).count() == 0
