"""WARC archives as a chunked record table.

A record travels as rows (record id, chunk number, bytes), never as one value:
the writer streams chunk rows into the open record, and the reader hands chunk
rows out while it carries the payload's running SHA-1, so neither holds more
than a chunk of an oversized payload. Every record is a gzip member of its own
and has an identifier of its own, also where page ids repeat or are null. Of equal
payloads of at least `MIN_REVISIT` bytes one is a response record and the others are
revisit records that refer to it and have no payload. The reader goes by the
standard headers, so it reads archives of other writers too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers, from_files, materialise, shared_dir
from .files import committed, open_fs

CHUNK = 1 << 16
MIN_REVISIT = 1000
#: Bytes of chunks that the reader hands on at once.
HANDED = 4 << 20
DATE = "2024-01-01T00:00:00Z"
#: A header line beyond this is taken for damage.
MOST_LINE = 1 << 20
#: Records of these types are handed on; others (warcinfo, request, metadata, ...) are read past.
PAYLOADS = ("response", "revisit", "resource", "conversion")
CHUNK_SCHEMA = (
    "record_id string, chunk int, last boolean, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, refers_to_record string, target_uri string, data binary"
)


def _identified(pages: DataFrame) -> tuple[DataFrame, Column]:
    """The rows, and an identifier for each that is the same in every scan: a UUID made of the
    file and the place in it. Rows that come from no file are written to one first."""
    pages = from_files(pages)
    spot = F.sha1(F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")))
    part = lambda at, n: F.substring(spot, at, n)
    return pages, F.concat(F.lit("urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12)))


def chunk_table(pages: DataFrame, *, key: str = "page_id", body: str = "html", url: str = "url", chunk: int = CHUNK) -> DataFrame:
    """One row per chunk: record_id, chunk, chunks, page_id, url, payload_bytes, digest, refers_to, refers_to_record, data.

    Chunks of a record follow one another in one task. Null payloads are empty (one chunk of no
    bytes). Of equal payloads of MIN_REVISIT bytes or more, the records with the largest
    page_id are responses (repeated rows each) and the others revisits, which refer to one of them; a
    null page_id is smaller than any, and rows that have no other stay responses. Groups are found by
    aggregating digests and written. Their join with the payloads broadcasts them within Spark's size
    limit; beyond it payloads are shuffled, a large group is split by the adaptive skew join, and
    smaller payloads, which have no group, are dealt by their own identifiers.
    """
    payload = F.coalesce(pages[body].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), payload.alias("payload"))
    rows, record = _identified(rows)
    rows = rows.select("*", record.alias("record_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"))
    # Beside SHA-1, which the records state, a second hash tells payloads apart.
    same = F.when(F.col("payload_bytes") >= MIN_REVISIT, F.sha2("payload", 256)).otherwise(F.col("record_id"))
    rows = rows.select("*", same.alias("same"))
    large = rows.filter(F.col("payload_bytes") >= MIN_REVISIT).select("same", "page_id", "record_id")
    groups = large.groupBy("same").agg(F.max(F.struct("page_id", "record_id")).alias("best"), F.count(F.lit(1)).alias("copies"))
    groups = groups.filter("copies > 1 and best.page_id is not null").select(F.col("same").alias("same_"), F.col("best.page_id").alias("best"), F.col("best.record_id").alias("best_record"))
    rows = rows.join(materialise(groups, "equal-payloads"), F.col("same") == F.col("same_"), "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    rows = rows.withColumn("refers_to", F.when(revisit, F.col("best"))).withColumn("refers_to_record", F.when(revisit, F.col("best_record")))
    stored = F.when(F.col("refers_to").isNull(), F.expr(f"greatest(1, (payload_bytes + {chunk - 1}) div {chunk})")).otherwise(F.lit(1))
    rows = rows.withColumn("chunks", stored.cast("int"))
    about = ["record_id", "chunks", "page_id", "url", "payload_bytes", "digest", "refers_to", "refers_to_record"]
    rows = rows.select(*about, "payload", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    data = F.when(F.col("refers_to").isNull(), F.expr(f"substring(payload, chunk * {chunk} + 1, {chunk})")).otherwise(F.lit(b""))
    return rows.select("record_id", "chunk", *about[1:], data.alias("data"))


def header_block(record_id, page_id, url, payload_bytes, digest, refers_to, refers_to_record) -> tuple[bytes, bytes]:
    """(WARC header, HTTP header that begins the record's block). The X- headers are for page ids alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = len(http) + (payload_bytes if refers_to is None else 0)
    clean = "".join(c for c in url or "" if c.isprintable())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {block}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines[4:4] = [f"WARC-Refers-To: <{refers_to_record}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines.append(f"X-Refers-To-Page-Id: {refers_to}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


class RecordWriter:
    """Streams chunk rows into gzip members, one per record."""

    def __init__(self, out):
        self.out, self.records, self._zip = out, 0, None

    def add(self, record_id, chunk, chunks, page_id, url, payload_bytes, digest, refers_to, refers_to_record, data: bytes) -> None:
        if chunk == 0:
            if self._zip is not None:
                raise ValueError("a record is incomplete")
            self._zip, self._next, self._id = zlib.compressobj(1, zlib.DEFLATED, 31), 0, record_id
            for part in header_block(record_id, page_id, url, payload_bytes, digest, refers_to, refers_to_record):
                self.out.write(self._zip.compress(part))
        if chunk != self._next or record_id != self._id:
            raise ValueError("chunks are out of order")
        self._next += 1
        self.out.write(self._zip.compress(data))
        if chunk == chunks - 1:
            self.out.write(self._zip.compress(b"\r\n\r\n") + self._zip.flush())
            self._zip, self.records = None, self.records + 1


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part = None, TaskContext.get().partitionId()
        with _lazily(folder, f"part-{part:06d}.warc.gz") as opened:
            for batch in batches:
                for i in range(batch.num_rows):
                    writer = writer or RecordWriter(opened())
                    writer.add(*[c[i].as_py() for c in batch.columns])
        if writer is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "records": [writer.records]})

    return run


class _lazily:
    """A committed file that is opened with its first record, so empty tasks leave none."""

    def __init__(self, folder: str, name: str):
        self._context, self._stream = committed(folder, name), None

    def __enter__(self):
        return self._open

    def _open(self):
        if self._stream is None:
            self._stream = self._context.__enter__()[0]
        return self._stream

    def __exit__(self, *error):
        if self._stream is not None:
            return self._context.__exit__(*error)


def write(chunks: DataFrame, folder: str) -> list[int]:
    """Write a chunk table, one archive a task; returns the parts written (one number a file)."""
    ensure_workers(chunks.sparkSession)
    done = chunks.mapInArrow(_write(folder), "part long, records long")
    return sorted(r.part for r in done.collect())


class _Bytes:
    """Bytes of a stream, or of all its gzip members, read forward in bounded pieces."""

    def __init__(self, stream, piece: int = CHUNK):
        self.stream, self.piece, self.buffer, self._zip = stream, piece, b"", None
        self._raw = stream.read(piece)
        self._plain = not self._raw.startswith(b"\x1f\x8b")

    def _more(self) -> bool:
        """Add some bytes to the buffer; False at the end of the file."""
        while True:
            if not self._raw:
                self._raw = self.stream.read(self.piece)
                if not self._raw:
                    if self._zip is not None:
                        raise ValueError("the archive ends inside a record")
                    return False
            if self._plain:
                out, self._raw = self._raw, b""
            else:
                if self._zip is None:
                    self._zip = zlib.decompressobj(31)
                try:
                    out = self._zip.decompress(self._raw, self.piece)
                except zlib.error as e:
                    raise ValueError(f"damaged compression: {e}") from None
                self._raw = self._zip.unconsumed_tail
                if self._zip.eof:
                    self._raw, self._zip = self._zip.unused_data, None
            if out:
                self.buffer += out
                return True

    def line(self, most: int = MOST_LINE) -> bytes | None:
        """The next line with its end, or as many bytes as a block has left (`most`); None at the end of the file."""
        while (at := self.buffer.find(b"\n", 0, most)) < 0 and len(self.buffer) < most:
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends inside a line")
                return None
        if at < 0 and most >= MOST_LINE:
            raise ValueError("a line has no end")
        end = at + 1 if at >= 0 else most
        out, self.buffer = self.buffer[:end], self.buffer[end:]
        return out

    def some(self, most: int) -> bytes:
        """At least one byte and at most `most`."""
        if not self.buffer and not self._more():
            raise ValueError("the archive ends inside a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def skip(self, n: int) -> None:
        while n:
            n -= len(self.some(n))


def _header(source: _Bytes, most: int) -> tuple[dict[str, str], int]:
    """(fields in lower case, bytes read) up to an empty line, or to `most` bytes."""
    head, size, name = {}, 0, ""
    while size < most:
        line = source.line(min(MOST_LINE, most - size))
        if line is None:
            raise ValueError("the archive ends inside a header")
        size += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and name:
            head[name] = f"{head[name]} {text.strip()}".strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        head[name] = value.strip()
    return head, size


def stated_digest(text: str) -> tuple[str, str]:
    """(algorithm, lower-case hex) of `algorithm:value` in base 16 or 32; empty where it is neither."""
    kind, _, value = text.partition(":")
    kind, value = kind.lower().replace("-", ""), value.strip()
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return kind, ""
    width = hashlib.new(kind).digest_size
    if re.fullmatch(r"[0-9A-Fa-f]+", value) and len(value) == 2 * width:
        return kind, value.lower()
    try:
        raw = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return kind, ""
    return kind, raw.hex() if len(raw) == width else ""


def read_chunks(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows as in CHUNK_SCHEMA from one archive, compressed or not; the digest of a row covers the payload up to it.

    Records are known by WARC-Type and WARC-Record-ID. The payload of an HTTP record is what follows
    its HTTP header, of any other the whole block. A payload that lacks the digest its header states (SHA and MD5 in
    base 16 or 32; a transfer coding is not undone, and then nothing is tested) or the length raises
    ValueError, as does damage; a missing digest is not tested. A revisit is one row with the SHA-1
    its header states, and the payload length of its HTTP header (null where there is none). Page ids
    are null where the archive has none. Records of other types are read past.
    """
    source = _Bytes(stream)
    while (line := source.line()) is not None:
        if not line.strip():
            continue  # more empty lines than the standard has
        if not line.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        head, _ = _header(source, 1 << 24)
        kind, block = head.get("warc-type", "").lower(), int(head.get("content-length", "0"))
        if kind not in PAYLOADS:
            source.skip(block)
        else:
            record = head.get("warc-record-id", "").strip("<>")
            page_id = int(head["x-page-id"]) if head.get("x-page-id") else None
            uri = head.get("warc-target-uri", "").strip("<>")
            http, size = _header(source, block) if head.get("content-type", "").lower().startswith("application/http") else ({}, 0)
            length, (algorithm, digest) = block - size, stated_digest(head.get("warc-payload-digest", ""))
            stated = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
            if kind == "revisit":
                source.skip(length)
                to = int(head["x-refers-to-page-id"]) if head.get("x-refers-to-page-id") else None
                yield record, 0, True, page_id, stated, digest if digest and algorithm == "sha1" else None, kind, to, head.get("warc-refers-to", "").strip("<>") or None, uri, b""
            else:
                coded = http.get("transfer-encoding", "identity").lower() != "identity"
                if stated is not None and stated != length and not coded and "warc-truncated" not in head:
                    raise ValueError("a payload has another length than its header says")
                sha, seen, n = hashlib.sha1(), 0, 0
                other = hashlib.new(algorithm) if digest and algorithm != "sha1" else sha
                while True:
                    data = source.exactly(min(chunk, length - seen))
                    sha.update(data)
                    if other is not sha:
                        other.update(data)
                    seen += len(data)
                    last = seen == length
                    if last and digest and not coded and other.hexdigest() != digest:
                        raise ValueError("a payload has another digest than its header says")
                    yield record, n, last, page_id, seen, sha.copy().hexdigest(), kind, None, None, uri, data
                    n += 1
                    if last:
                        break
        if source.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its header says")


def _read(chunk: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch["file"].to_pylist():
                fs, path = open_fs(file)
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 18) as stream:
                    rows, size = [], 0
                    for row in read_chunks(stream, chunk):
                        rows.append(row if with_data else (*row[:-1], None))
                        size += 256 + (len(row[-1]) if with_data else 0)
                        if size >= HANDED:
                            yield chunk_batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield chunk_batch(rows)

    return run


def chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [field.split(" ")[0] for field in CHUNK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read(spark, files: list[str], *, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows (CHUNK_SCHEMA) of archives of any writer, named by URI, one task an archive.

    payload_bytes and payload_digest of a row cover the payload up to and with that chunk;
    the row whose `last` is true has those of the whole payload.
    """
    ensure_workers(spark)
    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return named.mapInArrow(_read(chunk, with_data), CHUNK_SCHEMA)


def round_trip(pages: DataFrame, *, chunk: int = CHUNK, with_data: bool = False) -> DataFrame:
    """Write all pages to new archives in shared storage and read them back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    parts = write(chunk_table(pages, chunk=chunk), folder)
    return read(spark, [f"{folder}/part-{p:06d}.warc.gz" for p in parts], chunk=chunk, with_data=with_data)
