"""Token-id output in patched frame-of-reference blocks.

A store is a table of segments in ascending doc_id order.  One segment holds the ids of
some consecutive documents as little-endian bytes:

    header    magic "PFR1", ids, blocks, exceptions (uint32 each)
    index     per block: minimum (uint32), start in the packed part (uint32),
              first exception (uint32), width in bits (uint8)
    packed    per block of 128 ids: (id - minimum) modulo 2**width, bit-packed
    patches   exception places in their block (uint8), then their high parts (uint32)

A block's width is the percentile-chosen bit length of its differences from the minimum;
the high parts of longer ones are patched in from the exception list.  The block index
gives the start of any block, so an id range is read without unpacking what is before.

Results for odd input: a null text is an empty one (just its end id); a null doc_id sorts
first; rows with the same doc_id follow each other in text order, each with its own start;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, partitions, scratch_path
from gymlake.llm.tokens import END_ID, default_vocabulary, encoder, text_batches

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 17
MAGIC = b"PFR1"


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def encode_ids(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One segment."""
    ids = np.ascontiguousarray(ids, "<u4")
    n, nb = len(ids), -(-len(ids) // BLOCK)
    head = MAGIC + np.array([n, nb], "<u4").tobytes()
    if not n:
        return head + np.zeros(1, "<u4").tobytes()
    padded = np.empty(nb * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1]
    rows = padded.reshape(nb, BLOCK)
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    bits = _bit_length(diff)
    rank = min(BLOCK - 1, int(BLOCK * percentile / 100))
    width = np.partition(bits, rank, axis=1)[:, rank]
    block, place = np.nonzero(bits > width[:, None])
    high = (diff[block, place].astype(np.uint64) >> width[block].astype(np.uint64)).astype("<u4")
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(size)])
    packed = np.zeros(start[-1], np.uint8)
    for w in np.unique(width):
        if w:
            these = np.flatnonzero(width == w)
            bit = np.unpackbits(diff[these].astype(">u4").view(np.uint8).reshape(len(these), BLOCK, 4), axis=2)
            body = np.packbits(bit[:, :, 32 - int(w):].reshape(len(these), -1), axis=1)
            packed[start[these][:, None] + np.arange(body.shape[1])] = body
    first = np.searchsorted(block, np.arange(nb))
    return b"".join([head, np.array([len(block)], "<u4").tobytes(), low.astype("<u4").tobytes(),
                     start[:-1].astype("<u4").tobytes(), first.astype("<u4").tobytes(), width.tobytes(),
                     packed.tobytes(), place.astype(np.uint8).tobytes(), high.tobytes()])


def decode_ids(segment: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids [begin, end) of a segment; only the blocks that hold them are unpacked."""
    if segment[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, nb, ne = (int(x) for x in np.frombuffer(segment, "<u4", 3, 4))
    end = n if end is None else min(end, n)
    if begin >= end:
        return np.zeros(0, np.uint32)
    at = 16
    low = np.frombuffer(segment, "<u4", nb, at)
    start = np.frombuffer(segment, "<u4", nb, at + 4 * nb).astype(np.int64)
    first = np.append(np.frombuffer(segment, "<u4", nb, at + 8 * nb), ne).astype(np.int64)
    width = np.frombuffer(segment, np.uint8, nb, at + 12 * nb)
    at += 13 * nb
    size = int(start[-1]) + int(width[-1]) * (BLOCK // 8)
    packed = np.frombuffer(segment, np.uint8, size, at)
    place = np.frombuffer(segment, np.uint8, ne, at + size)
    high = np.frombuffer(segment, "<u4", ne, at + size + ne)
    b0, b1 = begin // BLOCK, -(-end // BLOCK)
    out = np.zeros((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width[b0:b1]):
        if w:
            these = b0 + np.flatnonzero(width[b0:b1] == w)
            body = packed[start[these][:, None] + np.arange(int(w) * (BLOCK // 8))]
            bit = np.zeros((len(these), BLOCK, 32), np.uint8)
            bit[:, :, 32 - int(w):] = np.unpackbits(body, axis=1).reshape(len(these), BLOCK, int(w))
            out[these - b0] = np.packbits(bit, axis=2).reshape(len(these), BLOCK * 4).view(">u4")
    e0, e1 = int(first[b0]), int(first[b1])
    owner = np.repeat(np.arange(b0, b1), np.diff(first[b0:b1 + 1]))
    out[owner - b0, place[e0:e1]] |= high[e0:e1] << width[owner].astype(np.uint32)
    out += low[b0:b1][:, None]
    return out.reshape(-1)[begin - b0 * BLOCK:end - b0 * BLOCK]


_SEGMENTS = "file int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, body binary"
_SCHEMA = pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("body", pa.binary())])


def _writer(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        file, segment, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal segment, first, docs, held, size
            ids = np.frombuffer(b"".join(held), "<u4")
            row = pa.record_batch([[file], [segment], [first], [len(ids)], [docs], [[len(h) // 4 for h in held]],
                                   [encode_ids(ids)]], schema=_SCHEMA)
            segment, first, docs, held, size = segment + 1, first + len(ids), [], [], 0
            return row

        end = np.array([END_ID], "<u4").tobytes()
        enc = encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in text_batches(texts, 1 << 20):
                for doc, body in zip(ids[i:j], enc.encode(texts[i:j])):
                    docs.append(doc)
                    held.append(body + end)
                    size += len(body) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
        if docs:
            yield flush()
        enc.forget()
    return run


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the store; one file per range of doc_ids."""
    vocabulary = vocabulary or default_vocabulary()
    bounded_batches(docs.sparkSession)
    ordered = (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
               .repartitionByRange(partitions(docs.sparkSession), F.asc_nulls_first("doc_id"))
               .sortWithinPartitions(F.asc_nulls_first("doc_id"), "text"))
    ordered.mapInArrow(_writer(vocabulary), _SEGMENTS).write.parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_ids(row["body"])
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"] + row["first"], pa.int64()),
                 pa.array(row["lengths"], pa.int64()),
                 pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts, ends)], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_store(segments: DataFrame) -> DataFrame:
    """Per document of a store: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, all from the decoded segments."""
    # one row per file of the store: as many as the write had partitions
    files = (segments.groupBy("file").agg(F.sum("n_ids").alias("n"))
             .select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)),
                                        F.lit(0)).alias("base")))
    return (segments.join(F.broadcast(files), "file")
            .select("doc_ids", "lengths", "body", "first", "base")
            .mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_store(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the store of ``docs`` to the shared folder and read it back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-store")
    write_store(docs, path, vocabulary)
    return read_store(spark.read.schema(_SEGMENTS).parquet(path))
