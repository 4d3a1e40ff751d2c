"""Pack documents into training windows with lexically related ones.

A document's tokens are its byte-level BPE ids and one end id. Whole windows of a document are sequences of their own; what is left at its
end, always less than a window, is its tail. Tails are routed into shards of bounded size by their weightiest BM25 terms: they are put in order
by their weightiest term, where more than a shard's tails share that, by a bucket of the next weightiest, and last by a hash; terms that lead
the same tails lie next to each other (single-linkage clusters of the pairs of leading terms); a shard is a stretch of this order. Tails about the same thing thus meet in one shard or a few, at any size of the corpus. Each shard holds a BM25 inverted index over
its tails' token ids, with document frequencies counted over the whole corpus. In turn the first unused tail opens a window as its
seed; the index ranks the unused tails by BM25 for the seed's QUERY_TERMS weightiest terms, and the window is filled greedily
with those that still fit. When none fits, the best unused one is cut, so that the window is full; its rest stays in use as a tail.
Only the last window of a shard may be short, and it is cut down to a power of two and a rest if that saves padding.

The ids are those of the tokenizer file for the `tokenizers` library, strings of its special tokens included. They are made by tiktoken from the rank file of the same vocabulary,
which is several times faster; the tests compare both, and a text that tiktoken can't take goes to `tokenizers`.

Defined results: null text is empty text, whose one token is the end id; repeated rows are packed each; an empty table gives an empty table;
other columns are not read.

Scale: one map over the texts, which writes tails (16 bits an id) and the finished whole windows; only tails are shuffled. A shard is one
task's work and is bounded by SHARD_TAILS tails (a few more by the chance of the hash, and all tails of rows that are equal), each shorter than a window. Collected are two counts per
vocabulary entry and its NEXT_TERMS commonest companions, and a few counts per shard.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, scope

WINDOW = 2048
END = 1
SHARD_TAILS = 1500
QUERY_TERMS = 12
K1, B = 1.2, 0.75
#: Pairs of each leading term that order the terms.
NEXT_TERMS = 8
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_MADE = f"kind int, {_PIECES}, ids binary, terms array<int>, counts array<long>"
_TAIL, _WHOLE, _TERMS = range(3)
_SHARDS_FROM = 1 << 62


@lru_cache(maxsize=2)
def _encoder(json_path: str, rank_path: str, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
    slow = Tokenizer.from_file(json_path)
    # the file's special tokens are found in a text, as the tokenizers library does
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> Sequence[int]:
        try:
            # without a list of Python numbers; strings of special tokens count where the text has one
            return fast.encode_to_numpy(text, allowed_special="all" if any(t in text for t in special) else set(), disallowed_special=())
        except BaseException as e:  # a panic of its pattern matcher is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow.encode(text, add_special_tokens=False).ids

    return encode, slow.get_vocab_size()


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, json_path: str, rank_path: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """Rows of three kinds: tails with their ids, pieces that are whole windows, and documents per token id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = _encoder(json_path, rank_path, pattern)
        kind = np.uint16 if size <= 1 << 16 else np.uint32
        seen = np.zeros(size, np.int64)
        sequence = TaskContext.get().partitionId() << 36
        names = [c.split()[0] for c in _MADE.split(", ")]
        kinds = [pa.int32(), *[pa.int64()] * 7, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                part, rows = whole.slice(a, 512), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    found = encode(text.as_py() or "")
                    n = len(found) + 1
                    ids = np.empty(n, kind)
                    ids[:-1], ids[-1] = found, END
                    # once for each id, as places that repeat are written once
                    seen[ids] += 1
                    for start in range(0, n - window + 1, window):
                        rows.append((_WHOLE, doc_id, start, window, _crc(ids[start : start + window]), n, sequence, 0, None, None, None))
                        sequence += 1
                    start = n - n % window
                    if start < n:
                        rows.append((_TAIL, doc_id, start, n - start, None, n, None, None, ids[start:].tobytes(), None, None))
                yield batch_of(rows)
        terms = np.flatnonzero(seen)
        yield batch_of([(_TERMS, *[None] * 8, terms.tolist(), seen[terms].tolist())])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MADE)


def leading_terms(tail: np.ndarray, idf: np.ndarray, mean_length: float) -> tuple[int, int]:
    """The two terms of a tail with the largest BM25 weights (twice the same if it has one)."""
    terms, counts = np.unique(tail, return_counts=True)
    weights = idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(tail) / mean_length))
    first = int(weights.argmax())
    if len(terms) == 1:
        return int(terms[0]), int(terms[0])
    weights[first] = -np.inf
    return int(terms[first]), int(terms[weights.argmax()])


def cluster_order(pairs: list[tuple[int, int, int]], tails_of: dict[int, int]) -> dict[int, int]:
    """Places of the first terms, those that lead the same tails next to each other; pairs: first term, second term, tails."""
    together: dict[tuple[int, int], int] = {}
    for a, b, n in pairs:
        if a != b and b in tails_of:
            key = (min(a, b), max(a, b))
            together[key] = together.get(key, 0) + n
    groups = {t: [t] for t in sorted(tails_of)}
    for a, b in sorted(together, key=lambda p: (-together[p] / (tails_of[p[0]] * tails_of[p[1]]) ** 0.5, p)):
        x, y = groups[a], groups[b]
        if x is not y:
            big, small = (x, y) if len(x) >= len(y) else (y, x)
            big.extend(small)
            for t in small:
                groups[t] = big
    order: dict[int, int] = {}
    for t in groups:
        if t not in order:
            for u in groups[t]:
                order[u] = len(order)
    return order


class Route:
    """Where tails lie in the order by leading terms, from the numbers of tails of each first term and of each bucket of a crowded one."""

    def __init__(self, tails_of: dict[int, int], shard_tails: int):
        #: buckets of the first terms that more than a shard's tails share
        self.buckets = {t: 2 * -(-n // shard_tails) for t, n in tails_of.items() if n > shard_tails}
        self.tails_of, self.shard_tails = tails_of, shard_tails
        self.spans: dict[tuple[int, int], tuple[int, int]] = {}

    def bucket(self, first: int, second: int) -> int:
        return second % self.buckets.get(first, 1)

    def place(self, crowded: dict[tuple[int, int], int], order: dict[int, int]) -> None:
        sizes = {(t, 0): n for t, n in self.tails_of.items() if t not in self.buckets} | crowded
        at = 0
        for key in sorted(sizes, key=lambda k: (order[k[0]], k[1])):
            self.spans[key] = (at, sizes[key])
            at += sizes[key]

    def shard(self, first: int, second: int, salt: int) -> int:
        """salt: a hash below 2**31 that spreads a bucket over its stretch."""
        at, n = self.spans[first, self.bucket(first, second)]
        return (at + (salt * n >> 31)) // self.shard_tails


class Index:
    """BM25 inverted index of a shard's tails."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n = self.n = len(tails)
        lengths = np.array(list(map(len, tails)))
        keys = np.concatenate(tails).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        # terms by turn, and of each the tails by turn
        keys, counts = np.unique(keys.astype(np.int32) if len(idf) * n < 2**31 else keys, return_counts=True)
        term, self.tails = np.divmod(keys, n)
        part = counts + K1 * (1 - B + B * lengths[self.tails] / mean_length)
        self.weights = idf[term] * counts * (K1 + 1) / part
        self.terms, self.firsts = np.unique(term, return_index=True)
        self.firsts = np.append(self.firsts, len(term))
        place = np.repeat(np.arange(len(self.terms)), np.diff(self.firsts))
        # each tail's weightiest terms
        order = np.lexsort((place, -self.weights, self.tails))
        owner = self.tails[order]
        rank = np.arange(len(order)) - np.searchsorted(owner, np.arange(n))[owner]
        top = order[rank < QUERY_TERMS]
        self.query, self.query_firsts = place[top], np.searchsorted(self.tails[top], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every tail for the seed's weightiest terms."""
        terms = self.query[self.query_firsts[seed] : self.query_firsts[seed + 1]]
        spans = [slice(self.firsts[t], self.firsts[t + 1]) for t in terms]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.tails[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)


def fill(lengths: np.ndarray, ranked, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (tail, start, length); ranked(seed): scores of all tails for a seed.

    Every token of every tail is in exactly one piece, and all windows but the last are full.
    """
    left, start = lengths.astype(np.int64).copy(), np.zeros(len(lengths), np.int64)
    out: list[list[tuple[int, int, int]]] = []
    first = 0
    while True:
        while first < len(left) and not left[first]:
            first += 1
        if first == len(left):
            return out
        room, pieces = window, []

        def put(tail: int, size: int) -> None:
            nonlocal room
            pieces.append((tail, int(start[tail]), size))
            start[tail] += size
            left[tail] -= size
            room -= size

        seed = first
        put(seed, int(min(left[seed], room)))
        unused = np.flatnonzero(left)
        if room and len(unused):
            order = unused[np.argsort(-ranked(seed)[unused], kind="stable")]
            # in order of rank, whatever still fits
            at = 0
            while room and at < len(order):
                fits = np.flatnonzero(left[order[at:]] <= room)
                if not len(fits):
                    break
                at += int(fits[0])
                put(int(order[at]), int(left[order[at]]))
                at += 1
            if room:
                rest = order[left[order] > 0]
                if len(rest):
                    put(int(rest[0]), room)
        out.append(pieces)


def _power_cut(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """The last, short window as sequences of lengths that are powers of two, which are not padded."""
    out = []
    while pieces:
        size = 1 << (sum(p[2] for p in pieces).bit_length() - 1)
        taken, rest = [], []
        for tail, start, length in pieces:
            now = min(length, size)
            if now:
                taken.append((tail, start, now))
            if length > now:
                rest.append((tail, start + now, length - now))
            size -= now
        out.append(taken)
        pieces = rest
    return out


def pack(docs: DataFrame, json_path: str, rank_path: str, pattern: str, window: int = WINDOW, shard_tails: int = SHARD_TAILS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset in the sequence."""
    made = materialize(tokenized(docs, json_path, rank_path, pattern, window))
    per_term = made.filter(F.col("kind") == _TERMS).select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n")).toArrow()
    tails = made.filter(F.col("kind") == _TAIL)
    total, tokens = tails.agg(F.count("*"), F.sum("length")).first()
    size = 1 + max(per_term.column("terms").to_pylist(), default=0)
    seen = np.zeros(size)
    seen[per_term.column("terms").to_numpy()] = per_term.column("n").to_numpy()
    every = max(1.0, seen[END] if size > END else 1.0)
    idf = np.log1p((every - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    mean_length = (tokens or 1) / max(1, total)

    def leads(batch: pa.RecordBatch) -> list[tuple[int, int]]:
        lengths, found = batch.column("length").to_pylist(), []
        for x, n in zip(batch.column("ids"), lengths):
            data = x.as_buffer()
            found.append(leading_terms(np.frombuffer(data, np.uint16 if data.size == 2 * n else np.uint32), idf, mean_length))
        return found

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(leads(batch), np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["first", "second"])

    with scope(made.sparkSession):
        # a row for each pair of leading terms, of which there are fewer than tails
        leading = materialize(tails.select("length", "ids").mapInArrow(lead, "first int, second int").groupBy("first", "second").agg(F.count("*").alias("n")))
        route = Route({r["first"]: r["n"] for r in leading.groupBy("first").agg(F.sum("n").alias("n")).collect()}, shard_tails)
        ranked = Window.partitionBy("first").orderBy(F.desc("n"), "second")
        pairs = leading.filter("first <> second").withColumn("rank", F.row_number().over(ranked))
        pairs = pairs.filter(F.col("rank") <= NEXT_TERMS).select("first", "second", "n").toArrow()
        order = cluster_order(list(zip(*(pairs.column(c).to_pylist() for c in ("first", "second", "n")))), route.tails_of)
        crowded = {}
        if route.buckets:
            buckets = made.sparkSession.createDataFrame(list(route.buckets.items()), "c_first int, buckets int")
            parts = leading.join(F.broadcast(buckets), F.col("first") == F.col("c_first")).groupBy("first", (F.col("second") % F.col("buckets")).alias("bucket"))
            crowded = {(r["first"], r["bucket"]): r["n"] for r in parts.agg(F.sum("n").alias("n")).collect()}
        route.place(crowded, order)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [route.shard(a, b, s) for (a, b), s in zip(leads(batch), batch.column("salt").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *batch.columns[1:]], names=["shard", *batch.schema.names[1:]])

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "ids")])
        shard = table.column("shard")[0].as_py()
        column = table.column("ids").combine_chunks()
        lengths = table.column("length").to_numpy()
        width = len(column[0].as_buffer()) // int(lengths[0])
        ids = [np.frombuffer(x.as_buffer(), np.uint16 if width == 2 else np.uint32) for x in column]
        index = Index(ids, idf, mean_length)
        windows = fill(lengths, index.scores, window)
        last = windows.pop()
        windows += _power_cut(last, window)
        rows = [(tail, start, n, _crc(ids[tail][start : start + n]), k) for k, pieces in enumerate(windows) for tail, start, n in pieces]
        tail, start, n, crc, k = (np.array(x, np.int64) for x in zip(*rows))
        # within its sequence a piece starts where the ones before it end
        before = np.cumsum(n) - n
        offset = before - before[np.searchsorted(k, k)]
        of = lambda c: table.column(c).to_numpy(zero_copy_only=False)[tail]
        columns = [table.column("doc_id").take(pa.array(tail)), *map(pa.array, (of("start") + start, n, crc, of("doc_tokens"), _SHARDS_FROM + (shard << 32) + k, offset))]
        return pa.Table.from_arrays(columns, names=[c.split()[0] for c in _PIECES.split(", ")])

    salt = F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(1 << 31)).alias("salt")
    dealt = tails.select(salt, "doc_id", "start", "length", "doc_tokens", "ids").mapInArrow(deal, "shard int, doc_id long, start long, length long, doc_tokens long, ids binary")
    packed = dealt.groupBy("shard").applyInArrow(pack_shard, _PIECES)
    whole = made.filter(F.col("kind") == _WHOLE).select(*[c.split()[0] for c in _PIECES.split(", ")])
    return whole.unionByName(packed)


def pack_public(docs: DataFrame) -> DataFrame:
    """pack() with the public byte-level BPE of 50,257 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9(spark, sf_dir: str) -> DataFrame:
    return pack_public(spark.read.parquet(f"{sf_dir}/documents.parquet"))
