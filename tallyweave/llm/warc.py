"""WARC archives as chunked record tables.

Payloads travel as rows of (record, chunk number, chunk), of at most
``CHUNK_BYTES`` each, from the scan straight into a task's own segment file:
digests grow from chunk to chunk, and no payload goes through a shuffle.  What
is shuffled is an index row per record.  It decides which records are revisits;
then every segment is copied, record by record and piece by piece, into a gzip
member each of an archive.  Readers parse an archive from a bounded buffer and
give chunk rows with a digest that grows in the same way.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.shared import bounded_batches, new_path, written

CHUNK_BYTES = 1 << 18
#: Bytes that are read from a file at a time.
PIECE_BYTES = 1 << 16
#: Equal payloads of fewer bytes are stored as often as they come.
LEAST_SHARED = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16
SEGMENT_LEVEL, ARCHIVE_LEVEL = 1, 4
INDEX = "task int, segment string, number bigint, offset bigint, page_id bigint, url string, payload_bytes bigint, digest string"
CHUNKS = "page_id bigint, record_type string, refers_to bigint, target_uri string, payload_bytes bigint, stated_digest string, chunk_no int, chunk_bytes bigint, running_sha256 string, last boolean"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def chunk_table(pages: DataFrame, id_col: str, url_col: str, html_col: str, chunk_bytes: int) -> DataFrame:
    """(page_id, url, payload_bytes, chunk_no, chunk, last): a row per chunk of each page, consecutive and in order.

    An empty payload has one empty chunk; the url stands with the first chunk.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    url = F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"\s", "%20")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    rows = rows.withColumn("chunks", F.greatest(F.ceil(F.col("payload_bytes") / chunk_bytes), F.lit(1)).cast("int"))
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    chunk = F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")
    return rows.select("page_id", F.when(F.col("chunk_no") == 0, F.col("url")).alias("url"), "payload_bytes", "chunk_no", chunk.alias("chunk"), (F.col("chunk_no") == F.col("chunks") - 1).alias("last"))


def write_segments(chunks: DataFrame, folder: str) -> DataFrame:
    """The index of the segments: a row per record, whose payload stands compressed in its task's file.

    A task writes under a name of its own attempt, so lost and repeated
    attempts leave files that no index names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        task, own = TaskContext.get().partitionId(), None
        out = digest = pack = None
        at = start = number = 0
        page_id = url = None
        for batch in batches:
            if out is None:
                system.create_dir(base)
                own = f"segment-{task:05d}-{uuid.uuid4().hex}"
                out = system.open_output_stream(f"{base}/{own}")
            columns, rows = [batch.column(i) for i in range(4)], []
            chunk, last = batch.column(4), batch.column(5)
            for i in range(batch.num_rows):
                if columns[3][i].as_py() == 0:
                    page_id, url = columns[0][i].as_py(), columns[1][i].as_py()
                    start, digest, pack = at, hashlib.sha256(), zlib.compressobj(SEGMENT_LEVEL)
                part = chunk[i].as_buffer()
                digest.update(part)
                at += out.write(pack.compress(part))
                if last[i].as_py():
                    at += out.write(pack.flush())
                    rows.append((task, own, number, start, page_id, url, columns[2][i].as_py(), digest.hexdigest()))
                    number += 1
            if rows:
                yield _batch(rows, INDEX)
        if out is not None:
            out.close()

    return written(chunks.mapInArrow(run, INDEX), "index")


def decided(index: DataFrame) -> DataFrame:
    """The index with ``refers_to``: the response's page_id of a record that is a revisit, else null."""
    shared = index.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    # Salted: the records of a hot payload spread over many tasks; they are small, as payloads stay where they are.
    shared = shared.select("digest", "response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = index.withColumn("salt", F.pmod(F.xxhash64("task", "number"), F.lit(SALTS)).cast("int")).join(shared, ["digest", "salt"], "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select(*index.columns, refers.alias("refers_to"))


def unpacked(source, offset: int) -> Iterator[bytes]:
    """The payload that starts at ``offset`` of a segment, in pieces of at most ``PIECE_BYTES``."""
    source.seek(offset)
    unzip, raw = zlib.decompressobj(), b""
    while not unzip.eof:
        raw = raw or source.read(PIECE_BYTES)
        if not raw:
            raise ValueError("a segment ends inside a payload")
        yield unzip.decompress(raw, PIECE_BYTES)
        raw = unzip.unconsumed_tail


def record_head(page_id: int | None, url: str | None, payload_bytes: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """Record header and HTTP header; the block's length counts the HTTP header and a response's payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {url}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else payload_bytes)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk_bytes: int = CHUNK_BYTES, date: str = DATE) -> DataFrame:
    """Write an archive per task, a gzip member per record, into ``folder`` (a URI that executors share); returns the written manifest (task, path, records, bytes).

    Segments are removed once all archives are written.
    """
    bounded_batches(pages.sparkSession)
    segments = f"{folder.rstrip('/')}/segments-{uuid.uuid4().hex}"
    index = write_segments(chunk_table(pages, id_col, url_col, html_col, chunk_bytes), segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        store = fs.FileSystem.from_uri(segments)[1]
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        records = size = 0
        out = source = opened = None
        for batch in batches:
            out = out or system.open_output_stream(f"{base}/{name}", compression=None)
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True):
                task, segment, _, offset, page_id, url, payload_bytes, digest, refers_to = row
                pack = zlib.compressobj(ARCHIVE_LEVEL, zlib.DEFLATED, 31)
                size += out.write(pack.compress(record_head(page_id, url, payload_bytes, digest, refers_to, date)))
                if refers_to is None:
                    if opened != segment:
                        source, opened = system.open_input_file(f"{store}/{segment}"), segment
                    for piece in unpacked(source, offset):
                        size += out.write(pack.compress(piece))
                size += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                records += 1
        if out is not None:
            out.close()
            yield _batch([(task, f"{folder.rstrip('/')}/{os.path.basename(name)}", records, size)], "task int, path string, records bigint, bytes bigint")

    tasks = (index.agg(F.max("task")).first()[0] or 0) + 1
    plan = decided(index).repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "number")
    manifest = written(plan.mapInArrow(run, "task int, path string, records bigint, bytes bigint"), "manifest")
    system, store = fs.FileSystem.from_uri(segments)
    if system.get_file_info(store).type == fs.FileType.Directory:
        system.delete_dir(store)
    return manifest


class Record(NamedTuple):
    """Header fields of a record; names in lower case."""

    head: dict[str, str]
    payload_bytes: int
    block_left: int


class ArchiveReader:
    """Records of one archive, a gzip member each, from a bounded buffer: after ``next_record`` come its chunks.

    Only a header is held whole, whatever its length.
    """

    def __init__(self, stream, chunk_bytes: int):
        self.stream, self.chunk_bytes, self.raw = stream, chunk_bytes, b""
        self.unzip, self.buffer = None, bytearray()

    def _more(self) -> bytes:
        """The next piece of the record; empty at its end."""
        while not self.unzip.eof:
            self.raw = self.raw or self.stream.read(PIECE_BYTES)
            if not self.raw:
                raise ValueError("the archive ends inside a record")
            out = self.unzip.decompress(self.raw, PIECE_BYTES)
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if out:
                return out
        return b""

    def _until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            more = self._more()
            if not more:
                raise ValueError("a header does not end")
            self.buffer += more
        head = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return head

    def _take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            more = self._more()
            if not more:
                raise ValueError("a record is shorter than its header says")
            self.buffer += more
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def next_record(self) -> Record | None:
        self.raw = self.raw or self.stream.read(PIECE_BYTES)
        if not self.raw:
            return None
        self.unzip = zlib.decompressobj(31)
        fields = [x.partition(": ") for x in self._until(b"\r\n\r\n").decode().split("\r\n")[1:]]
        head = {k.lower(): v for k, _, v in fields}
        http = self._until(b"\r\n\r\n") + b"\r\n\r\n"
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return Record(head, length, int(head["content-length"]) - len(http))

    def chunks(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces, then the record's end; at least one piece."""
        left = n
        while True:
            part = self._take(min(left, self.chunk_bytes))
            left -= len(part)
            yield part
            if not left:
                break
        if self._take(4) != b"\r\n\r\n" or self._more():
            raise ValueError("a record does not end where its header says")


def _number(urn: str | None) -> int | None:
    value = urn.rpartition(":")[2].rstrip(">") if urn else "null"
    return None if value == "null" else int(value)


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives in ``manifest`` (task, path): sizes and running digests, a task per archive.

    ``running_sha256`` covers the record's payload up to and including the
    chunk; a revisit has one chunk without bytes and its stated digest.  A
    payload that doesn't have its stated digest fails the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, own = fs.FileSystem.from_uri(path)
                with system.open_input_stream(own, compression=None) as stream:
                    reader = ArchiveReader(stream, chunk_bytes)
                    while (record := reader.next_record()) is not None:
                        kind, stated = record.head["warc-type"], record.head["warc-payload-digest"].partition(":")[2]
                        digest, left = hashlib.sha256(), record.block_left
                        for k, part in enumerate(reader.chunks(left)):
                            digest.update(part)
                            left -= len(part)
                            so_far = stated if kind == "revisit" else digest.hexdigest()
                            if not left and so_far != stated:
                                raise ValueError(f"{path}: a payload has another digest than {stated}")
                            rows.append((_number(record.head["warc-record-id"]), kind, _number(record.head.get("warc-refers-to")), record.head.get("warc-target-uri"), record.payload_bytes, stated, k, len(part), so_far, not left))
                            if len(rows) >= 2000:
                                yield _batch(rows, CHUNKS)
                                rows = []
        if rows:
            yield _batch(rows, CHUNKS)

    tasks = (manifest.agg(F.max("task")).first()[0] or 0) + 1
    return manifest.repartitionById(tasks, F.col("task")).select("path").mapInArrow(run, CHUNKS)


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): what reading the written archives gives, a row per page.

    A null html is an empty payload.  Of equal payloads of at least 100 bytes
    the one of least page_id is a response and the others revisit it; rows
    that repeat that page_id are responses too, as are all if every id is
    null; a null id otherwise revisits.  Shorter equal payloads are responses.
    Null urls have no target field; white space in urls is written as %20.
    Other columns are ignored; an empty table gives no rows.
    """
    manifest = write_archives(pages, folder or new_path(spark, "archives"), **options)
    last = read_chunks(manifest, options.get("chunk_bytes", CHUNK_BYTES)).where("last")
    return last.select("page_id", "payload_bytes", F.col("running_sha256").alias("payload_digest"), "record_type", "refers_to")
