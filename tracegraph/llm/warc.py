"""WARC archives: pages written as whole-file gzip, then normalised to one member per record with a sidecar offset index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.shared import cut, scratch, small, tidy

#: Bytes before compression after which a writer starts its next archive.
ARCHIVE_BYTES = 64 << 20

#: Bytes read or inflated at a time.
STEP = 1 << 18

STAMP = "2020-01-01T00:00:00Z"

GZIP = 16 + zlib.MAX_WBITS

INDEX = "archive string, offset long, length long, record_id string, record_type string, page_id long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of page ``refers_to`` (HTTP head only); page id and payload length are extension fields."""
    sha1 = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, sha1)}", f"WARC-Date: {STAMP}"]
    head += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Names (lower case) and values of a record's head."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Inflated:
    """Reads one inflated stream over a gzip file of any number of members, ``STEP`` bytes at a time."""

    def __init__(self, source: BinaryIO):
        self.source, self.inflate, self.buffer, self.over = source, zlib.decompressobj(GZIP), bytearray(), False
        self.rest = b""

    def more(self) -> bool:
        """Adds inflated bytes to the buffer; False at the end."""
        while not self.over:
            data = self.rest or self.source.read(STEP)
            self.rest = b""
            if not data:
                self.over = True
                break
            out = self.inflate.decompress(data, STEP)
            self.rest = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(GZIP)
            if out:
                self.buffer += out
                return True
        return False

    def head(self) -> bytes | None:
        """The next record's head without its blank line; None at the end."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends within a record's head")
                return None
        out = bytes(self.buffer[:end])
        del self.buffer[: end + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in parts."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends within a record")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part


def put_in_place(filesystem: fs.FileSystem, trial: str, name: str) -> None:
    """Gives a whole file its name; one that an earlier attempt of the task left goes first, as not every store moves onto a name in use."""
    if filesystem.get_file_info(name).type != fs.FileType.NotFound:
        filesystem.delete_file(name)
    filesystem.move(trial, name)


def normalise(filesystem: fs.FileSystem, path: str, to: str) -> list[tuple]:
    """Inflates ``path`` once and writes every record as a gzip member of its own to ``to``, with ``to``.idx.json beside it.

    A record passes through in parts, so memory doesn't grow with records or archives. Both files appear under their names
    only when they are whole; a task that runs again writes the same files again. Returns index rows without the archive.
    """
    rows, at, trial = [], 0, f"{to}.{uuid.uuid4().hex}"
    with filesystem.open_input_stream(path, compression=None) as source, filesystem.open_output_stream(trial, compression=None) as sink:
        stream = Inflated(source)
        while (head := stream.head()) is not None:
            of, pack, size = fields(head), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0

            def put(data: bytes) -> int:
                sink.write(data)
                return len(data)

            size += put(pack.compress(head + b"\r\n\r\n"))
            for part in stream.take(int(of["content-length"]) + 4):
                size += put(pack.compress(part))
            size += put(pack.flush())
            page = of.get("x-page-id")
            rows.append((at, size, of["warc-record-id"], of["warc-type"], int(page) if page is not None else None))
            at += size
    names = ("offset", "length", "record_id", "record_type", "page_id")
    with filesystem.open_output_stream(f"{trial}.idx", compression=None) as sink:
        for r in rows:
            sink.write(json.dumps(dict(zip(names, r, strict=True))).encode() + b"\n")
    put_in_place(filesystem, f"{trial}.idx", f"{to}.idx.json")
    put_in_place(filesystem, trial, to)
    return rows


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes one record per page to archives in ``folder``, each a single gzip stream; one row per archive: archive, records.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id becomes the response and the
    others revisit it. The groups are counted by digest with partial aggregation, and only digests that occur more than once are
    joined back, so payloads are not shuffled while those digests are few enough to send to every executor.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    again = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null").select("sha1", "kept")
    rows = rows.join(small(cut(again)), "sha1", "left").select("page_id", "url", "html", F.expr("if(page_id = kept, null, kept)").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        part, number, done = TaskContext.get().partitionId(), 0, []
        sink = pack = trial = name = None
        size = count = 0

        def close() -> None:
            sink.write(pack.flush())
            sink.close()
            put_in_place(filesystem, trial, name)
            done.append((f"{folder}/{name.rpartition('/')[2]}", count))

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, refers = (batch.column(k)[i].as_py() for k in range(4))
                if sink is None:
                    name = f"{root}/part-{part:06d}-{number:04d}.mono.warc.gz"
                    trial = f"{name}.{uuid.uuid4().hex}"
                    sink, pack, size, count = filesystem.open_output_stream(trial, compression=None), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0, 0
                data = record(page, url, html.encode(), refers)
                sink.write(pack.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    sink, number = None, number + 1
        if sink is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return cut(rows.mapInArrow(tidy(run), "archive string, records long"))


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Rewrites each archive (column archive) with one gzip member per record; returns the index, one row per record.

    Each archive is one task's work, and archives are bounded by ``ARCHIVE_BYTES`` and one record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                filesystem, path = fs.FileSystem.from_uri(uri)
                to = uri.replace(".mono.warc.gz", "") + ".warc.gz"
                rows = normalise(filesystem, path, fs.FileSystem.from_uri(to)[1])
                cols = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([to] * len(rows), pa.string()), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [x.split()[0] for x in INDEX.split(", ")])

    spread = max(1, min(archives.count(), 100_000))
    return cut(archives.select("archive").repartition(spread).mapInArrow(tidy(run), INDEX))


def read_archives(index: DataFrame) -> DataFrame:
    """Reads each record of the index by its offset: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    The payload of a revisit is null. A response whose payload does not have the digest of its head raises an error.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            out: list[tuple] = []
            for uri, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if uri != name:
                    filesystem, path = fs.FileSystem.from_uri(uri)
                    name, source = uri, filesystem.open_input_file(path)
                data = zlib.decompress(source.read_at(length, offset), GZIP)
                head, _, block = data.partition(b"\r\n\r\n")
                of = fields(head)
                want, page, refers = of["warc-payload-digest"].removeprefix("sha1:"), of.get("x-page-id"), of.get("x-refers-to-page-id")
                payload = None
                if of["warc-type"] == "response":
                    payload = block[: int(of["content-length"])].partition(b"\r\n\r\n")[2]
                    if digest(payload) != want:
                        raise ValueError(f"{uri} at {offset}: the payload does not have its digest")
                size = len(payload) if payload is not None else int(of["x-payload-length"])
                out.append((int(page) if page is not None else None, size, want, of["warc-type"], int(refers) if refers is not None else None, payload))
                if sum(len(x[5] or b"") for x in out[-64:]) > STEP * 16 or len(out) >= 512:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return index.select("archive", "offset", "length").mapInArrow(tidy(run), schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html), normalises the archives and reads them back by their index.

    Null html: empty payload. A null page_id is smaller than any other; a group that has only null ids, and rows that repeat the
    response's page_id, are all responses. Null url: empty target. Null rows are kept; an empty table gives no rows. Archives and
    their ``.idx.json`` sidecars stay in ``folder`` (by default a new one in the shared folder). Other columns are ignored.
    """
    folder = folder or scratch(pages.sparkSession)
    return read_archives(normalise_archives(write_archives(pages, folder, min_bytes)))


def op6(spark, sf_dir: str) -> DataFrame:
    """``archive_round_trip`` over all pages, without the payloads; null ids, urls and html and repeated rows as there."""
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("payload")


#: Payload digests in base32 follow from the sha1 in hex by bits; everything else is a grouping.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS kept FROM p GROUP BY h),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
        (SELECT sum(((strpos('0123456789abcdef', substr(h, 1 + (5 * g.i + j.j) // 4, 1)) - 1) >> (3 - (5 * g.i + j.j) % 4) & 1) << (4 - j.j)) FROM range(5) j(j))::INTEGER, 1), '' ORDER BY g.i) AS code
      FROM (SELECT DISTINCT h FROM p), range(32) g(i) GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, code AS payload_digest,
       CASE WHEN page_id = kept OR kept IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM p JOIN k USING (h) JOIN d USING (h)
"""
