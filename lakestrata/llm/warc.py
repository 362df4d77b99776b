"""WARC archives: written as one gzip stream a file, normalised to one member a record, read by offset.

Many crawlers compress a whole archive as a single gzip stream, in which no record can be reached without inflating
all before it. The normaliser inflates such a file once, in pieces, and writes each record as its own gzip member next
to a sidecar index with a line per record: offset, length, type and id.

Files go to the folder the cluster shares, by pyarrow's file systems (local and mounted folders, S3, GCS, HDFS with
its client library). Every task attempt writes names of its own and only files that a finished attempt reports are
used, so lost executors leave no trace in the result.

Records of equal payloads of ``least`` bytes or more: the one with the largest id is a response, the others are
revisits that refer to it (null ids are smallest; rows that repeat the largest id are responses too). Null payloads
are empty. Null addresses are left out of the record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakestrata.llm.frames import inputs, small_batches, stored
from lakestrata.session import scratch_dir

ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
ID = "urn:x-row:"


def _file_system(uri: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(uri)


def _create(uri: str):
    system, path = _file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def record_id(id, digest: str) -> str:
    return f"<{ID}{'' if id is None else quote(str(id), safe='')}:{digest}>"


def row_id(record: str) -> str | None:
    """The row's id, as text, in a record id."""
    return unquote(record[len(ID) + 1 :].rsplit(":", 1)[0]) or None


def _record(id, url: str | None, payload: bytes, size: int, digest: str, original) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = {
        "WARC-Type": "response" if original is None else "revisit",
        "WARC-Record-ID": record_id(id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type": "application/http; msgtype=response",
    }
    if original is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(original, digest)
        payload = b""
    head["Content-Length"] = str(len(http) + len(payload))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + http + payload + END


def with_originals(pages: DataFrame, id: str, url: str, payload: str, least: int) -> DataFrame:
    """The rows with ``digest``, ``size`` and, for what is to be a revisit, ``original``."""
    rows = inputs(pages, id=id, url=url, payload=payload)
    rows = rows.withColumn("payload", F.coalesce("payload", F.lit("")).cast("binary"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    groups = rows.filter(F.col("size") >= least).groupBy(F.col("digest").alias("of"))
    largest = groups.agg(F.max("id").alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = rows.join(largest, rows.digest == largest.of, "left").drop("of")
    earlier = F.col("id").isNull() | (F.col("id") < F.col("original"))
    return found.withColumn("original", F.when(earlier, F.col("original")))


def write(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000
) -> DataFrame:
    """Write archives, each one gzip stream; their paths and numbers of records (stored)."""
    small_batches(pages.sparkSession)
    rows = with_originals(pages, id, url, payload, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if out is None:
                    path = f"{folder}/whole/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, gzip, size, count = _create(path), zlib.compressobj(6, wbits=31), 0, 0
                data = _record(row["id"], row["url"], row["payload"], row["size"], row["digest"], row["original"])
                out.write(gzip.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.write(gzip.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})
        if out is not None:
            out.write(gzip.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return stored(rows.mapInArrow(run, "path string, records long"))


def inflated(stream, piece: int = PIECE) -> Iterator[bytes]:
    """A gzip file's content in pieces, whether it is one member or many."""
    gzip = zlib.decompressobj(wbits=31)
    while data := stream.read(piece):
        while data:
            if gzip.eof:
                gzip = zlib.decompressobj(wbits=31)
            if more := gzip.decompress(data, piece):
                yield more
            data = gzip.unconsumed_tail or gzip.unused_data
    if not gzip.eof:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers of each record and its content, head, block and end, in pieces that must be taken before the next."""
    buffer = bytearray()

    def fill() -> bool:
        more = next(pieces, b"")
        buffer.extend(more)
        return bool(more)

    while True:
        while (at := buffer.find(END)) < 0:
            if not fill():
                if buffer:
                    raise ValueError("the archive ends in a record's head")
                return
        lines = buffer[:at].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record head: {lines[0][:40]}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        left = at + len(END) + int(head["content-length"]) + len(END)

        def content(left: int = left) -> Iterator[bytes]:
            while left:
                if not buffer and not fill():
                    raise ValueError("the archive ends in a record")
                part = bytes(buffer[:left])
                del buffer[:left]
                left -= len(part)
                yield part

        yield head, content()


def normalise(archives: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Rewrite every archive with a member for each record; rows (stored): path, sidecar index, records."""
    spread = inputs(archives, path=path)
    spread = spread.repartition(max(1, spread.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                system, at = _file_system(source)
                target = f"{folder}/members/{at.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                offset = count = 0
                with system.open_input_stream(at, compression=None) as stream, _create(target) as out, _create(f"{target}.idx") as index:
                    for head, content in records(inflated(stream)):
                        gzip, size = zlib.compressobj(6, wbits=31), 0
                        for part in content:
                            size += out.write(gzip.compress(part))
                        size += out.write(gzip.flush())
                        line = {"offset": offset, "length": size, "type": head["warc-type"], "id": head["warc-record-id"]}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, count = offset + size, count + 1
                yield pa.RecordBatch.from_pydict({"path": [target], "index": [f"{target}.idx"], "records": [count]})

    return stored(spread.mapInArrow(run, "path string, index string, records long"))


def members(archive: str, index: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Head and block of every record that the index names, each reached by its own offset."""
    system, at = _file_system(archive)
    lines_of, lines_at = _file_system(index)
    with system.open_input_file(at) as data, lines_of.open_input_stream(lines_at, compression=None) as lines:
        rest = b""
        while more := lines.read(PIECE):
            *whole, rest = (rest + more).split(b"\n")
            for line in map(json.loads, whole):
                data.seek(line["offset"])
                content = zlib.decompress(data.read(line["length"]), wbits=31)
                head, parts = next(records(iter([content])))
                block = b"".join(parts)[content.index(END) + len(END) : -len(END)]
                yield head, block


def read(archives: DataFrame, kind: str = "bigint", path: str = "path", index: str = "index") -> DataFrame:
    """Rows of normalised archives: id, url, type, digest, size, payload, refers_to.

    A response whose payload does not have the digest its head states is an error.
    """
    rows = inputs(archives, path=path, index=index)
    names = ["id", "url", "record_type", "payload_digest", "payload_bytes", "payload", "refers_to"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0
        for batch in batches:
            for archive, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for head, block in members(archive, lines):
                    http, _, payload = block.partition(END)
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    stated = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n"))}
                    if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{archive}: {head['warc-record-id']} does not have its digest")
                    refers = head.get("warc-refers-to")
                    url = head.get("warc-target-uri")
                    full = len(payload) if head["warc-type"] == "response" else int(stated["content-length"])
                    kept.append((row_id(head["warc-record-id"]), url, head["warc-type"], digest, full, payload, refers and row_id(refers)))
                    size += len(payload)
                    if size >= PIECE or len(kept) >= 1000:
                        yield _rows(kept, names, kinds)
                        kept, size = [], 0
        if kept:
            yield _rows(kept, names, kinds)

    schema = "id string, url string, record_type string, payload_digest string, payload_bytes long, payload binary, refers_to string"
    found = rows.mapInArrow(run, schema)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("id", "refers_to")})


def _rows(kept: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write, normalise and read back: a row for each page with what its record says."""
    folder = f"{scratch_dir(pages.sparkSession)}/warc"
    kind = inputs(pages, id=id).schema["id"].dataType.simpleString()
    return read(normalise(write(pages, folder, id, url, payload), folder), kind).withColumnRenamed("id", id)


