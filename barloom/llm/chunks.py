"""Deal documents into bounded chunks, and ask questions of hash shards.

A chunk is a group of documents of about CHUNK_BYTES of text, chosen by a hash of doc_id and text, that one task holds as arrays.
What a chunk must learn about the corpus it asks as packed arrays, one row per (chunk, shard): equal keys from all
chunks meet in one shard, which answers in the same order. A key that is frequent in a chunk is asked once there, so the keys of a shard are
fewer than the words of a chunk, and there are fewer shards than chunks; both stay bounded as the input grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 16 << 20


def count_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // chunk_bytes))


def count_shards(chunks: int, chunks_each: int) -> int:
    """As many shards as chunks while there are few, then one for so many chunks, so that rows between them stay few."""
    return max(min(chunks, 64), -(-chunks // chunks_each))


def in_chunks(docs: DataFrame, chunks: int) -> DataFrame:
    """chunk, doc_id, text. Rows of one doc_id, or of none, are spread by their texts."""
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def in_packed_chunks(docs: DataFrame, chunks: int) -> DataFrame:
    """in_chunks() with the documents of one chunk and batch together in a row, compressed: chunk, doc_ids, sizes, data.

    Where texts would be shuffled beside much else, this takes half the space.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
            rows = [batch.take(pa.array(order[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
            texts = [r.column("text").cast(pa.binary()).fill_null(b"").to_pylist() for r in rows]
            columns = [
                pa.array([r.column("chunk")[0].as_py() for r in rows], pa.int32()),
                pa.array([r.column("doc_id").to_pylist() for r in rows], pa.list_(pa.int64())),
                pa.array([list(map(len, t)) for t in texts], pa.list_(pa.int64())),
                pa.array([squeeze(b"".join(t)) for t in texts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_ids", "sizes", "data"])

    return in_chunks(docs, chunks).mapInArrow(pack, "chunk int, doc_ids array<long>, sizes array<long>, data binary")


def open_chunk(table: pa.Table) -> pa.Table:
    """doc_id and text (bytes) of the rows of one packed chunk."""
    expand = zstandard.ZstdDecompressor().decompress
    ids = pa.array([i for x in table.column("doc_ids") for i in x.as_py()], pa.int64())
    sizes = [n for x in table.column("sizes") for n in x.as_py()]
    data = b"".join(expand(x.as_buffer(), max_output_size=max(1, sum(n.as_py()))) for x, n in zip(table.column("data"), table.column("sizes")))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.table({"doc_id": ids, "text": texts})


def in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that does not depend on how they arrived."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def shard_order(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that groups keys by shard, and each shard's first place in it (shards + 1 places)."""
    shard = (keys >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def packed(*columns: list) -> list[pa.Array]:
    """Arrow binary columns of lists of numpy arrays."""
    return [pa.array([x.tobytes() for x in c], pa.binary()) for c in columns]


def plane_bytes(x: np.ndarray) -> bytes:
    """Whole numbers with all their first bytes together, then all second ones: small numbers compress to little."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def packed_planes(*columns: list) -> list[pa.Array]:
    return [pa.array([plane_bytes(x) for x in c], pa.binary()) for c in columns]


def unpack_planes(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(size, -1).T).view(kind).reshape(-1) for x in column]


def unpack(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]
