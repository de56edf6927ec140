"""Length-delimited binary records of token ids, with a separate offset index.

Record: length (u64), masked CRC-32 of those eight bytes (u32), payload, masked
CRC-32 of the payload (u32); little-endian throughout. Payload: id width in
bytes (u8), 1 if the document has an id (u8), document id (i64), number of token
ids (u32), and the ids as one Zstandard frame. Index: for each record its
offset in the data file and its document's start among the file's ids (u64 each).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers, release, shared_dir
from .files import committed, open_fs
from .tokens import encoder, slices

_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_META = struct.Struct("<BBqI")
_SPOT = struct.Struct("<QQ")
ROWS_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Records that a reader hands on at once.
BATCH = 2048


def masked(data: bytes) -> int:
    """CRC-32, rotated and offset so that a checksum of data holding checksums stays sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _TAIL.pack(masked(length)) + payload + _TAIL.pack(masked(payload))


def index_entry(offset: int, start: int) -> bytes:
    return _SPOT.pack(offset, start)


def pack_ids(doc_id: int | None, ids: np.ndarray, compressor) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return _META.pack(width, doc_id is not None, doc_id or 0, len(ids)) + compressor.compress(ids.astype(f"<u{width}").tobytes())


def unpack_ids(payload: bytes, expander) -> tuple[int | None, np.ndarray]:
    width, known, doc_id, n = _META.unpack_from(payload)
    ids = np.frombuffer(expander.decompress(payload[_META.size :], max_output_size=max(1, n * width)), f"<u{width}")
    if len(ids) != n:
        raise ValueError("a record holds other ids than its header says")
    return doc_id if known else None, ids.astype(np.uint32)


def read_frame(stream) -> bytes | None:
    """The next payload, or None at the end; a damaged record raises ValueError."""
    head = stream.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or masked(head[:8]) != _HEAD.unpack(head)[1]:
        raise ValueError("damaged record length")
    length = _HEAD.unpack(head)[0]
    payload, tail = stream.read(length), stream.read(_TAIL.size)
    if len(payload) != length or len(tail) < _TAIL.size or masked(payload) != _TAIL.unpack(tail)[0]:
        raise ValueError("damaged record")
    return payload


def _write(folder: str, tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc, packer = encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=1)
        part = TaskContext.get().partitionId()
        at = start = records = 0
        with committed(folder, f"part-{part:06d}.rec", f"part-{part:06d}.idx") as (data, index):
            for batch in _chain(first, batches):
                for a, b in slices(batch["text"]):
                    ids, lens = enc.encode(batch["text"].slice(a, b - a))
                    ends = np.cumsum(lens)
                    for doc_id, end, n in zip(batch["doc_id"].slice(a, b - a).to_pylist(), ends.tolist(), lens.tolist()):
                        record = frame(pack_ids(doc_id, ids[end - n : end], packer))
                        data.write(record)
                        index.write(index_entry(at, start))
                        at, start, records = at + len(record), start + n, records + 1
        release()
        yield pa.RecordBatch.from_pydict({"part": [part], "records": [records], "tokens": [start]})

    return run


def _chain(first, rest):
    yield first
    yield from rest


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int | None = 2) -> list[tuple[int, int, int]]:
    """Write all documents in ascending doc_id order (null first, ties by a hash of the text); return
    (part, records, ids) for each file, in order. One entry a file goes to the driver.

    The texts are dealt out by ranges of (doc_id, hash of the text, row) and each task
    encodes and writes its range; the row number splits one row that repeats often. Null text
    counts as empty; repeated rows are records of their own; an empty table writes no file;
    other columns play no part.
    """
    ensure_workers(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    # The hash splits a doc_id that many rows share, the row number equal rows, whose order means nothing.
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    done = dealt.select("doc_id", "text").mapInArrow(_write(folder, tokenizer, end_id), "part long, records long, tokens long")
    return sorted((r.part, r.records, r.tokens) for r in done.collect())


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expander = zstandard.ZstdDecompressor()
        fs, path = open_fs(folder)
        for batch in batches:
            for part, start in zip(batch["part"].to_pylist(), batch["start"].to_pylist()):
                rows: list[tuple] = []
                with fs.open_input_stream(f"{path}/part-{part:06d}.rec", buffer_size=1 << 20) as stream:
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = unpack_ids(payload, expander)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                        start += len(ids)
                        if len(rows) == BATCH:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def read_digests(spark, folder: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """One row per record of the files in `folder`: doc_id, start, n_tokens, ids_crc32.

    Each file is read by one task, a record at a time, and every checksum is tested.
    """
    ensure_workers(spark)
    at, rows = 0, []
    for part, _, tokens in parts:
        rows.append((part, at))
        at += tokens
    files = spark.createDataFrame(rows, "part long, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(_read(folder), ROWS_SCHEMA)


class RecordFile:
    """Random access to one data file through its index, for shuffled reads."""

    def __init__(self, folder: str, part: int):
        import zstandard

        self._fs, path = open_fs(folder)
        with self._fs.open_input_stream(f"{path}/part-{part:06d}.idx") as f:
            self.spots = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
        self._file = self._fs.open_input_file(f"{path}/part-{part:06d}.rec")
        self._expander = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.spots)

    def __getitem__(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """(doc_id, start among the file's ids, ids) of record i."""
        self._file.seek(int(self.spots[i, 0]))
        doc_id, ids = unpack_ids(read_frame(self._file), self._expander)
        return doc_id, int(self.spots[i, 1]), ids

    def shuffled(self, seed: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for i in np.random.default_rng(seed).permutation(len(self)):
            yield self[int(i)]


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int | None = 2) -> DataFrame:
    """Write all documents to new files in shared storage and read them back."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "records")
    return read_digests(spark, folder, write(docs, folder, tokenizer, end_id=end_id))
