"""Packing by power-of-two decomposition.

A document of n tokens is cut into n // max_len pieces of max_len tokens and
one piece for each bit set in the rest, longest first. Each piece is a sequence
of its own, so no sequence crosses documents and none needs padding; sequences
of one length form a bucket and are batched together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ensure_workers, release
from .tokens import encoder, slices

#: Token ids handed on at once.
BATCH_IDS = 1 << 23
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut_lengths(tokens: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(length of each piece, document of each piece) for documents of these token counts."""
    top = max_len.bit_length() - 1
    sizes = 1 << np.arange(top, -1, -1)
    counts = (tokens[:, None] // sizes) & 1
    counts[:, 0] = tokens // max_len
    lengths = np.repeat(np.tile(sizes, len(tokens)), counts.ravel())
    return lengths, np.repeat(np.arange(len(tokens)), counts.sum(1))


def _pieces(path: str, end_id: int, max_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        part = TaskContext.get().partitionId()
        made, width = 0, max(1, BATCH_IDS // max_len)
        for batch in batches:
            for at, to in slices(batch["text"]):
                ids, lens = enc.encode(batch["text"].slice(at, to - at))
                lengths, doc = cut_lengths(lens, max_len)
                stops = np.cumsum(lengths)
                doc_at = np.cumsum(lens) - lens
                for a in range(0, len(lengths), width):
                    b = min(len(lengths), a + width)
                    base = int(stops[a] - lengths[a])
                    cuts = np.concatenate([[0], stops[a:b] - base])
                    n = b - a
                    bucket = np.log2(lengths[a:b]).astype(np.int64)
                    seq = (bucket << 57) | (part << 33) | np.arange(made, made + n)
                    made += n
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["doc_id"].take(pa.array(doc[a:b] + at)),
                            pa.array(stops[a:b] - lengths[a:b] - doc_at[doc[a:b]]),
                            pa.array(lengths[a:b].astype(np.int64)),
                            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(ids[base : int(stops[b - 1])].astype("<u4", copy=False).tobytes())]),
                            pa.array(lens[doc[a:b]]),
                            pa.array(seq),
                            pa.array(np.zeros(n, np.int64)),
                        ],
                        names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                    )
        release()

    return run


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, max_len: int = 4096) -> DataFrame:
    """Pieces of all documents (columns doc_id, text; others are left aside).

    `ids` holds little-endian unsigned 32-bit ids. `sequence_id` has the bucket
    (log2 of the length) in bits 57 and up, then the task, then a counter, so
    numbering needs no pass over all rows; it repeats for the same input files.
    A null or empty text is the end id alone. A null doc_id stays null, and a
    repeated row gives its own sequences. An empty table gives no row.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    ensure_workers(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, max_len), SCHEMA)


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Write sequences into one folder for each length, ready for batches of equal length."""
    pieces.write.partitionBy("length").parquet(folder)
