"""Ranked search over a bit-sliced index of impacts.

The index is made of blocks of at most BLOCK_DOCS documents. A row of it is a term of a block: the places of the documents that hold it, and for each bit of their impacts one bitmap over these documents, a slice.
The impact of a term in a document is (1000000000 tf) div (1000 tf + 12 m), at most 10**6 (20 slices); m grows with the document's length. A search works on 64 documents at a time: the slices of a term
become words of 64 documents, of which only those with a bit are kept; they are multiplied by the term's weight by shifts and additions, and added to the accumulators of all items that hold the term by bitwise carry arithmetic (a full adder over slices). The k best
documents of an item are then found from the most significant slice down: a candidate that has the bit beats all that lack it, as long as no more than k do. No score is put together but those of the k found.

Terms are the runs of characters other than ASCII ones that are neither letters nor digits, with A-Z in lower case; they are compared by their bytes. All arithmetic is exact in integers, but for the logarithm in
a term's weight, floor(1000 ln((2N+2)/(2df+1))).

Defined results: null text has no terms; documents without terms are never found and count in no statistic; repeated rows of documents are ranked each (after score and doc_id, which may be null and then come last, in an order
of places in the index); repeated or null item_id: each row of items is an item with its own ranks; items without terms, or whose terms no document holds, have no rows; an empty table gives no rows; other columns are not read.

Scale: two maps over the texts; no text is shuffled. A block is a stretch of an input partition, bounded by documents and by bytes of text (one longer document is a block of its own). The rows of terms that items ask for are joined to the items' terms
and meet by block and by chunk of items, whose work is bounded by both; a block answers with k documents an item, which are cut to k
within tasks before they are shuffled. The number of rows of a common term is that of blocks, and Spark divides such a key of the join among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import Words, runs
from .storage import materialize, scope

BLOCK_DOCS, BLOCK_BYTES = 8192, 8 << 20
#: Items whose terms meet a block in one task, and those whose accumulators are held at once.
CHUNK_ITEMS, BATCH_ITEMS = 4096, 128
TOP = 20
#: Slices of an impact.
BITS = (10**6).bit_length()
_TERM_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_INDEX = "block long, term string, docs binary, slices binary, doc_ids array<long>"
_ONE = np.uint64(1)


def terms_of(texts: pa.Array) -> tuple[Words, np.ndarray, pa.Array]:
    """The words of some texts, for each the number of its term, and the terms."""
    words = Words(texts, lower=True, is_word=_TERM_BYTE)
    data = np.ascontiguousarray(words.data[_TERM_BYTE[words.data]])
    offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int64)
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return words, spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64), spelled.dictionary.cast(pa.large_string())


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Words(batch.column("text"), is_word=_TERM_BYTE).counts
            yield pa.RecordBatch.from_pydict({"n": [int((counts > 0).sum())], "l": [int(counts.sum())]})

    total = docs.select("text").mapInArrow(count, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return total.n or 0, total.l or 0


def _blocks(batches: Iterator[pa.RecordBatch], docs: int, size: int) -> Iterator[pa.Table]:
    """Stretches of the rows, each of at most so many rows and bytes of text, or one row."""
    held, rows, used = [], 0, 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).tolist()
        start = 0
        for at, n in enumerate(lengths):
            if rows and (rows == docs or used + n > size):
                yield pa.Table.from_batches([*held, batch.slice(start, at - start)])
                held, rows, used, start = [], 0, 0, at
            rows, used = rows + 1, used + n
        held.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(held)


def pack_slices(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the values' bits for groups of these sizes, least bit first, as bytes, and where each group's begin (one more than groups)."""
    offsets = np.concatenate([[0], np.cumsum((sizes * BITS + 7) // 8)])
    place = np.repeat(offsets[:-1] * 8, sizes) + runs(sizes)
    width = np.repeat(sizes, sizes)
    bits = np.zeros(offsets[-1] * 8, np.uint8)
    for s in range(BITS):
        bits[place + s * width] = (values >> s) & 1
    return np.packbits(bits), offsets


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))]).cast(pa.binary())


def index_block(table: pa.Table, n: int, total: int) -> tuple[list[int | None], pa.Array, pa.Array, pa.Array]:
    """doc_ids in the order of their places in a block, its terms, and for each the places and the slices; n documents with total terms make the corpus."""
    table = table.take(pa.compute.sort_indices(table.column("doc_id"), null_placement="at_end"))
    words, term, spelled = terms_of(table.column("text"))
    lengths = words.counts.astype(np.int64)
    m = 75 + (25 * lengths * n) // max(total, 1)
    found, tf = np.unique(term * table.num_rows + np.repeat(np.arange(table.num_rows), lengths), return_counts=True)
    term, doc = np.divmod(found, max(table.num_rows, 1))
    sizes = np.bincount(term, minlength=len(spelled))
    slices, offsets = pack_slices((10**9 * tf) // (1000 * tf + 12 * m[doc]), sizes)
    places = np.concatenate([[0], np.cumsum(sizes)]) * 2
    return table.column("doc_id").to_pylist(), spelled.cast(pa.string()), _binary(doc.astype("<u2"), places), _binary(slices, offsets)


def build(docs: DataFrame, n: int, total: int, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of docs (doc_id, text), written once: a row for each term of a block, and one without a term with the block's doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for table in _blocks(batches, min(block_docs, 1 << 16), block_bytes):
            doc_ids, terms, places, slices = index_block(table, n, total)
            rows = len(terms)
            none = lambda kind: pa.nulls(1, kind)
            columns = [
                pa.array([block] * (rows + 1), pa.int64()),
                pa.concat_arrays([terms, none(pa.string())]),
                pa.concat_arrays([places, none(pa.binary())]),
                pa.concat_arrays([slices, none(pa.binary())]),
                pa.concat_arrays([pa.nulls(rows, pa.list_(pa.int64())), pa.array([doc_ids], pa.list_(pa.int64()))]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "term", "docs", "slices", "doc_ids"])
            block += 1

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX))


def _item_terms(items: DataFrame) -> DataFrame:
    """item (a number of the row), term, repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, term, spelled = terms_of(batch.column("text"))
            found, repeats = np.unique(np.repeat(np.arange(batch.num_rows), words.counts) * max(len(spelled), 1) + term, return_counts=True)
            row, term = np.divmod(found, max(len(spelled), 1))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), spelled.cast(pa.string()).take(pa.array(term)), pa.array(repeats.astype(np.int32))], names=["item", "term", "repeats"])

    return items.select("item", "text").mapInArrow(run, "item long, term string, repeats int")


class Slices:
    """Numbers of documents as bitmaps of their bits: planes[b, i] holds bit b of the 64 documents of word at[i]; a term's words are those between two bounds."""

    def __init__(self, docs: list[bytes], slices: list[bytes]):
        doc = np.frombuffer(b"".join(docs), "<u2").astype(np.int64)
        sizes = np.array([len(x) // 2 for x in docs], np.int64)
        bits = np.unpackbits(np.frombuffer(b"".join(slices), np.uint8))
        place = np.repeat(np.concatenate([[0], np.cumsum((sizes * BITS + 7) // 8)[:-1]]) * 8, sizes) + runs(sizes)
        width = np.repeat(sizes, sizes)
        term = np.repeat(np.arange(len(sizes)), sizes)
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc >> 6, prepend=-1) != 0))
        self.at = doc[first] >> 6
        self.bounds = np.searchsorted(term[first], np.arange(len(sizes) + 1))
        bit = (doc & 63).astype(np.uint64)
        self.planes = np.zeros((BITS, len(first)), np.uint64)
        for b in range(BITS):
            if len(first):
                self.planes[b] = np.bitwise_or.reduceat(bits[place + b * width].astype(np.uint64) << bit, first)

    def times(self, weights: np.ndarray) -> None:
        """Multiply every term's numbers by its weight, by one shifted addition for each bit of the weights."""
        weight = np.repeat(weights.astype(np.uint64), np.diff(self.bounds))
        top = int(weights.max()).bit_length() if len(weights) else 0
        product = np.zeros((BITS + top, len(self.at)), np.uint64)
        for b in range(top):
            chosen = np.flatnonzero((weight >> np.uint64(b)) & _ONE)
            add(product, chosen, self.planes[:, chosen], b)
        self.planes = product


def add(sums: np.ndarray, at: np.ndarray, planes: np.ndarray, shift: int = 0) -> None:
    """Add the numbers of planes, shifted left, to the columns at (none twice) of sums: a full adder from the least slice up."""
    carry = np.zeros(len(at), np.uint64)
    for b in range(shift, len(sums)):
        more = b - shift < len(planes)
        if not more and not carry.any():
            return
        a = sums[b, at]
        x = planes[b - shift] if more else np.uint64(0)
        half = a ^ x
        sums[b, at] = half ^ carry
        carry = (a & x) | (half & carry)


def best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sums[bit, item, word], for each item the documents with its k largest numbers above 0 (the first of equal ones): item and document, in no order."""
    sure = np.zeros(sums.shape[1:], np.uint64)
    open_ = np.bitwise_or.reduce(sums, axis=0)
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    for b in reversed(range(len(sums))):
        with_bit = open_ & sums[b]
        many = (count(sure | with_bit) > k)[:, None]
        # too many have the bit: only they stay in question; else they are among the best, and the others stay in question
        sure = np.where(many, sure, sure | with_bit)
        open_ = np.where(many, with_bit, open_ & ~sums[b])
    left = k - count(sure)
    item, doc = np.nonzero(np.unpackbits(sure.view(np.uint8), axis=1, bitorder="little"))
    tied_item, tied_doc = np.nonzero(np.unpackbits(open_.view(np.uint8), axis=1, bitorder="little"))
    first = runs(np.bincount(tied_item, minlength=len(left))) < left[tied_item]
    return np.concatenate([item, tied_item[first]]), np.concatenate([doc, tied_doc[first]])


def search_block(docs: list[bytes], slices: list[bytes], weights: np.ndarray, askers: list[list[tuple[int, int]]], k: int, batch_items: int = BATCH_ITEMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, place and score of the k best documents of a block for each item; of every term its places, slices, weight and the items that hold it with their repeats."""
    index = Slices(docs, slices)
    index.times(weights)
    term = np.repeat(np.arange(len(askers)), [len(x) for x in askers])
    item, repeats = np.array([x for y in askers for x in y], np.int64).reshape(-1, 2).T
    order = np.argsort(item, kind="stable")
    item, repeats, term = item[order], repeats[order], term[order]
    names, item = np.unique(item, return_inverse=True)
    # no score is above the sum of the weights, with repeats, times the largest impact
    most = int(np.bincount(item, weights=(repeats * weights[term]).astype(float)).max(initial=0)) + 1
    n_bits = (most * 10**6).bit_length()
    words = int(index.at.max(initial=0)) + 1
    found = [], [], []
    for start in range(0, len(names), batch_items):
        a, b = np.searchsorted(item, [start, start + batch_items])
        who, what, often = item[a:b] - start, term[a:b], repeats[a:b]
        n_items = min(batch_items, len(names) - start)
        sums = np.zeros((n_bits, n_items * words), np.uint64)
        turn = runs(np.bincount(who, minlength=n_items))
        # in a turn every item adds one of its terms, once for each bit of its repeats
        for t in range(int(turn.max(initial=-1)) + 1):
            mine = np.flatnonzero(turn == t)
            for bit in range(int(often[mine].max()).bit_length()):
                now = mine[(often[mine] >> bit) & 1 == 1]
                lo, n = index.bounds[what[now]], np.diff(index.bounds)[what[now]]
                column = np.repeat(lo, n) + runs(n)
                add(sums, np.repeat(who[now] * words, n) + index.at[column], index.planes[:, column], bit)
        which, doc = best(sums.reshape(n_bits, n_items, words), k)
        score = np.zeros(len(which), np.int64)
        for b in range(n_bits):
            score |= ((sums[b, which * words + (doc >> 6)] >> (doc & 63).astype(np.uint64)) & _ONE).astype(np.int64) << b
        for kept, x in zip(found, (names[which + start], doc, score)):
            kept.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def search(index: DataFrame, items: DataFrame, n: int, k: int = TOP, chunk_items: int = CHUNK_ITEMS, batch_items: int = BATCH_ITEMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item (item_id, text) in an index of n documents with terms."""
    rows = materialize(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    asked = materialize(_item_terms(rows))
    wanted = index.filter("term is not null").join(asked.select("term").distinct(), "term")
    df = wanted.groupBy("term").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    chunks = max(1, -(-rows.count() // chunk_items))
    chunk = F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int")
    per_chunk = asked.groupBy("term", chunk.alias("chunk")).agg(F.collect_list(F.struct("item", F.col("repeats").cast("long").alias("repeats"))).alias("askers"))
    terms = materialize(per_chunk.join(df.select("term", weight.alias("weight")), "term").filter("weight > 0"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        askers = [[(a["item"], a["repeats"]) for a in x] for x in group.askers]
        item, place, score = search_block(group.docs.tolist(), group.slices.tolist(), group.weight.to_numpy(np.int64), askers, k, batch_items)
        return pd.DataFrame({"block": key[0], "item": item, "place": place.astype(np.int32), "score": score})

    met = index.filter("term is not null").select("block", "term", "docs", "slices").join(terms, "term")
    hits = met.groupBy("block", "chunk").applyInPandas(run, "block long, item long, place int, score long")
    ids = index.filter("term is null").select(F.col("block").alias("of_block"), "doc_ids")
    hits = hits.join(ids, F.col("block") == F.col("of_block")).select("item", "score", F.get("doc_ids", F.col("place")).alias("doc_id"), "block", "place")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "block", "place")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of each item: statistics, index and search in one."""
    with scope(docs.sparkSession) as kept:
        n, total = statistics(docs)
        ranked = materialize(search(build(docs, n, total), items, n, k))
        kept.append(ranked)
    return ranked


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
held AS (SELECT r, doc_id, n, unnest(terms) AS term FROM sized),
tfs AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM held GROUP BY ALL),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
item_words AS (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark),
asked AS (SELECT i, item_id, term, count(*)::BIGINT AS qtf FROM item_words GROUP BY ALL),
weighed AS (SELECT i, item_id, term, qtf * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN dfs USING (term), total),
scored AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score FROM weighed JOIN tfs USING (term), total GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
