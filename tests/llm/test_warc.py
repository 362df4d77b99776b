"""WARC archives: what is written comes back, by offset."""

import gzip
import hashlib
import io
import json
import random

import pytest

import __spark_entry__ as contract
from lakestrata.llm import warc


def brute(rows):
    largest = {}
    for page, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            largest.setdefault(data, []).append(page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        first = max((p for p in largest.get(data, []) if p is not None), default=None)
        again = first is not None and (page is None or page < first)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def own(spark, rows):
    df = spark.createDataFrame([(p, f"http://x.example/ä b/{p}\r\n" if p else None, h, 1) for p, h in rows], "page_id long, url string, html string, size int")
    found = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("archive", [64 << 20, 4000])
def test_random(spark, archive, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive)
    monkeypatch.setattr(warc, "PIECE", 700)
    rnd = random.Random(1)
    texts = ["x" * 999, "y" * 1000, "ü" * 500, "", "\r\n\r\nWARC/1.1\r\n\r\n" * 80, "z" * 200_000]
    rows = [(i % 60, rnd.choice([*texts, "p" * rnd.randint(0, 3000)])) for i in range(90)]
    rows += [(None, "y" * 1000), (None, None), (77, None)]
    assert own(spark, rows) == brute(rows)


def test_empty(spark):
    assert own(spark, []) == []


def test_members(spark, folder):
    rows = [(i, f"http://a.example/{i}", "text " * 500 + str(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    whole = warc.write(df, folder)
    done = warc.normalise(whole, folder).collect()
    assert sum(r.records for r in done) == 9
    for r in done:
        data = open(r.path, "rb").read()
        lines = [json.loads(line) for line in open(r["index"])]
        assert [line["offset"] for line in lines] == [sum(x["length"] for x in lines[:i]) for i in range(len(lines))]
        assert len(data) == sum(x["length"] for x in lines)
        for line in lines:
            member = gzip.decompress(data[line["offset"] : line["offset"] + line["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and line["id"].encode() in member
    contents = sorted(gzip.decompress(open(r.path, "rb").read()) for r in done)
    assert contents == sorted(gzip.decompress(open(r.path, "rb").read()) for r in whole.collect())


def test_damage():
    data = warc._record(1, None, b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None)
    whole = gzip.compress(data)
    assert b"".join(warc.inflated(io.BytesIO(whole + whole), 5)) == data + data
    with pytest.raises(ValueError, match="early"):
        list(warc.inflated(io.BytesIO(whole[:-9])))
    with pytest.raises(ValueError, match="ends in"):
        [list(c) for _, c in warc.records(iter([data[:-2]]))]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = contract.queries()["op9_warc"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
