"""Language-model scores by a bigram Katz backoff model of the corpus.

Tokens are the words of a text with A-Z lower-cased, then one end token; the first token's context is the start of the text. Counts r <= CUT are
discounted by Good-Turing (d_r from the counts of counts), larger ones are kept. A seen bigram has probability d_r * r / c(context);
an unseen one backs off to weight(context) * P(word), where the weight makes the context's probabilities sum to one exactly:
what the seen words leave, divided by the unigram probability of the unseen ones. Unigrams are discounted in the same way, and
what they leave is the probability of the one class of unknown words. Where a discount can't be estimated (a count of counts is
zero, or d_r is not between 0 and 1) d_r is (r - 0.5) / r; where a context's counts leave nothing, 1 is added to its total.

Defined results: null text is empty text, whose one token is the end; repeated rows are counted and scored each; documents with a null
doc_id are learned from; an empty table gives an empty table; other columns are not read.

Scale: one pass counts unigrams. Then documents are dealt into bounded chunks (one shuffle of the text), and a chunk asks shards about its distinct
words and bigrams, in packed arrays: unigram counts first, then bigram counts and backoff weights. The bigrams of a context share a
shard, but a context with many tokens is spread over shards in proportion. Chunks evaluate their own tokens, so nothing is
gathered but per-shard arrays; only nine numbers come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, mix
from .chunks import count_chunks, in_order, in_packed_chunks, open_chunk, packed, packed_planes, shard_order, unpack, unpack_planes
from .storage import materialize

#: Counts up to this one are discounted.
CUT = 5
CHUNK_BYTES = 8 << 20
END, START = np.uint64(0x454E44), np.uint64(0x5354415254)
_COUNTS = "key int, words binary, counts binary, tokens long, types long, counted array<long>"
_ASK = "key int, peer int, words binary"
_ASK_PAIRS = "key int, peer int, contexts binary, sizes binary, words binary, counts binary, ids binary, totals binary"
_MESSAGE = "kind int, key int, peer int, a binary, b binary, c binary, d binary, counted array<long>"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_UNIGRAMS, _PAIRS, _CONTEXTS, _COUNTED, _WEIGHTS = range(5)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def discounts(counted: np.ndarray) -> np.ndarray:
    """d_0 .. d_CUT (d_0 unused) from the numbers of n-grams counted once, twice, .. CUT + 1 times."""
    n = np.concatenate([[0.0], np.asarray(counted, np.float64)])
    out = np.ones(CUT + 1)
    rest = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= CUT, d[np.minimum(counts, CUT)], 1.0)


@dataclass(frozen=True)
class Unigrams:
    """What is known of the training tokens as a whole."""

    tokens: int
    types: int
    d: np.ndarray
    total: float
    unknown: float
    #: Above the number of every training word.
    numbers: int

    @classmethod
    def of(cls, tokens: int, types: int, counted: np.ndarray, numbers: int | None = None) -> Unigrams:
        d, r = discounts(counted), np.arange(1, CUT + 1)
        lost = float((np.asarray(counted[:CUT]) * r * (1 - d[1:])).sum())
        total = tokens if lost > 0 else tokens + 1
        return cls(tokens, types, d, float(total), (lost if lost > 0 else 1.0) / total, types if numbers is None else numbers)

    @property
    def id_kind(self):
        """Whole numbers that hold the number of any training word."""
        return np.uint32 if self.numbers <= 1 << 32 else np.uint64

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.total, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def _lists(column: pa.ChunkedArray) -> list:
    return column.to_pylist()


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return ranked[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def _counted(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()


def unigram_table(docs: DataFrame, shards: int) -> DataFrame:
    """One row per shard: sorted hashes of its training words, their counts, and their sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = np.array([not held_out(i) for i in batch.column("doc_id").to_pylist()], bool)
            words = Words(batch.column("text"), lower=True)
            keys, counts = np.unique(words.hashes()[np.repeat(train, words.counts)], return_counts=True)
            keys, counts = np.append(keys, END), np.append(counts, train.sum())
            order, firsts = shard_order(keys, shards)
            asked = np.flatnonzero(np.diff(firsts)).astype(np.int32)
            cut = packed(*([x[order[firsts[k] : firsts[k + 1]]] for k in asked] for x in (keys, counts.astype(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(asked), *cut], names=["key", "words", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = _sums(np.concatenate(unpack(table.column("words"), np.uint64)), np.concatenate(unpack(table.column("counts"), np.int64)))
        keys, counts = keys[counts > 0], counts[counts > 0]
        return pa.Table.from_arrays(
            [table.column("key").slice(0, 1), *packed([keys], [counts]), pa.array([int(counts.sum())]), pa.array([len(keys)]), pa.array([_counted(counts)], pa.list_(pa.int64()))],
            names=["key", "words", "counts", "tokens", "types", "counted"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "key int, words binary, counts binary")
    return rows.groupBy("key").applyInArrow(merge, _COUNTS)


class _Chunk:
    """A chunk's tokens as places in its sorted distinct words."""

    def __init__(self, table: pa.Table, shards: int):
        self.number, self.shards = table.column("chunk")[0].as_py(), shards
        table = in_order(open_chunk(table))
        self.doc_ids = table.column("doc_id")
        self.held = np.array([held_out(i) for i in self.doc_ids.to_pylist()], bool)
        words = Words(table.column("text"), lower=True)
        hashes, docs = words.hashes(), len(self.held)
        #: First token of each document, and the number of tokens.
        self.bounds = words.bounds + np.arange(docs + 1)
        self.lengths = np.diff(self.bounds)
        ends = np.zeros(self.bounds[-1], bool)
        ends[self.bounds[1:] - 1] = True
        tokens = np.full(len(ends), END)
        tokens[~ends] = hashes
        self.words, place = np.unique(np.append(tokens, [END, START]), return_inverse=True)
        self.end, self.start = place[-2], place[-1]
        place = place[:-2].astype(np.int64)
        contexts = np.full(len(place), self.start)
        contexts[1:] = place[:-1]
        contexts[self.bounds[:-1]] = self.start
        self.tokens = place
        pairs = contexts * len(self.words) + place
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        train = np.repeat(~self.held, self.lengths)
        self.pair_counts = np.bincount(self.pair_of[train], minlength=len(self.pairs))
        self.contexts, self.followers = np.divmod(self.pairs, len(self.words))

    def word_shards(self) -> tuple[np.ndarray, np.ndarray]:
        return shard_order(self.words, self.shards)

    def pair_shards(self, totals: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the pairs by shard: a context's own one and, the more tokens follow it, the more after that."""
        spread = 1 + self.context_totals(totals) * self.shards // max(1, tokens)
        near = (self.words >> np.uint64(20)) % np.uint64(self.shards)
        further = self.words[self.followers] % spread[self.contexts].astype(np.uint64)
        shard = (near[self.contexts] + further) % np.uint64(self.shards)
        # a pair with an unknown word is in no training text
        known = np.flatnonzero((self.context_totals(totals)[self.contexts] > 0) & (totals[self.followers] > 0))
        order = known[np.argsort(shard[known], kind="stable")]
        return order, np.searchsorted(shard[order], np.arange(self.shards + 1))

    def context_totals(self, totals: np.ndarray) -> np.ndarray:
        """How often each word is a context: a text starts as often as one ends."""
        out = totals.copy()
        out[self.start] = totals[self.end]
        return out


def _ask_words(table: pa.Table, shards: int) -> pa.Table:
    held = _Chunk(table, shards)
    order, firsts = held.word_shards()
    asked = np.flatnonzero(np.diff(firsts)).astype(np.int32)
    cut = packed([held.words[order[firsts[k] : firsts[k + 1]]] for k in asked])
    return pa.Table.from_arrays([pa.array(asked), pa.array(np.full(len(asked), held.number, np.int32)), *cut], names=["key", "peer", "words"])


def _message(kind: int, keys, peers, a=None, b=None, c=None, d=None, counted=None) -> pa.Table:
    n = len(keys)
    pack = lambda x: (packed_planes if len(x) and x[0].dtype == np.int64 and x[0].ndim == 1 else packed)(x)[0]
    blobs = [pack(x) if x is not None else pa.nulls(n, pa.binary()) for x in (a, b, c, d)]
    listed = pa.array(counted, pa.list_(pa.int64())) if counted is not None else pa.nulls(n, pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(keys, pa.int32()), pa.array(peers, pa.int32()), *blobs, listed], names=["kind", "key", "peer", "a", "b", "c", "d", "counted"])


def _of_kind(messages: pa.Table, kind: int) -> pa.Table:
    return messages.filter(pc.equal(messages.column("kind"), kind))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in sorted_keys, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _word_answers(asks: pa.Table, counts: pa.Table, shards: int) -> pa.Table:
    """Counts and numbers of the words that a shard is asked about; numbers of different shards differ in their rest by shards."""
    known = unpack(counts.column("words"), np.uint64)[0] if len(counts) else np.zeros(0, np.uint64)
    totals = unpack(counts.column("counts"), np.int64)[0] if len(counts) else np.zeros(0, np.int64)
    shard = counts.column("key")[0].as_py() if len(counts) else 0
    found, ids = [], []
    for words in unpack(asks.column("words"), np.uint64):
        at, there = _find(known, words)
        found.append(np.where(there, totals[at], 0) if len(known) else np.zeros(len(words), np.int64))
        ids.append(np.where(there, at * shards + shard, 0))
    return _message(_UNIGRAMS, _lists(asks.column("peer")), _lists(asks.column("key")), a=found, b=ids)


def _answered(messages: pa.Table, kind: int, size: int, order: np.ndarray, firsts: np.ndarray, **columns) -> list[np.ndarray]:
    """The answers of all shards to what was asked in this order, out of size things; 0 for what was not asked."""
    rows = _of_kind(messages, kind)
    out = [np.zeros(size, k) for k in columns.values()]
    shards = _lists(rows.column("peer"))
    for x, (name, k) in zip(out, columns.items()):
        for shard, values in zip(shards, (unpack_planes if k is np.int64 else unpack)(rows.column(name), k)):
            x[order[firsts[shard] : firsts[shard + 1]]] = values
    return out


def _ask_pairs(table: pa.Table, messages: pa.Table, shards: int, known: Unigrams) -> pa.Table:
    held = _Chunk(table, shards)
    totals, ids = _answered(messages, _UNIGRAMS, len(held.words), *held.word_shards(), a=np.int64, b=np.int64)
    order, firsts = held.pair_shards(totals, known.tokens)
    ids = ids.astype(known.id_kind)
    asked = np.flatnonzero(np.diff(firsts)).astype(np.int32)
    columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for k in asked:
        own = order[firsts[k] : firsts[k + 1]]
        contexts, sizes = np.unique(held.contexts[own], return_counts=True)
        # a word of many pairs is told once
        words, at = np.unique(held.followers[own], return_inverse=True)
        for c, x in zip(columns, (held.words[contexts], sizes.astype(np.int32), at.astype(np.int32), held.pair_counts[own].astype(np.int32), ids[words], totals[words])):
            c.append(x)
    cells = [*packed(columns[0]), *packed_planes(*columns[1:4]), *packed(columns[4]), *packed_planes(columns[5])]
    return pa.Table.from_arrays([pa.array(asked), pa.array(np.full(len(asked), held.number, np.int32)), *cells], names=["key", "peer", "contexts", "sizes", "words", "counts", "ids", "totals"])


def _pair_answers(table: pa.Table, shards: int, known: Unigrams) -> pa.Table:
    """Counts of the pairs asked about, sums of each context over its seen words, and counts of counts."""
    kinds = {"contexts": np.uint64, "sizes": np.int32, "words": np.int32, "counts": np.int32, "ids": known.id_kind, "totals": np.int64}
    parts = {k: (unpack if k in ("contexts", "ids") else unpack_planes)(table.column(k), v) for k, v in kinds.items()}
    sizes = list(map(len, parts["words"]))
    for k in ("totals", "ids"):
        parts[k] = [x[at] for x, at in zip(parts[k], parts["words"])]
    parts["words"] = parts.pop("ids")
    every = {k: np.concatenate(v) for k, v in parts.items()}
    contexts, words = np.repeat(every["contexts"], every["sizes"]), every["words"]
    order = np.argsort(mix(contexts * np.uint64(3) + mix(words.astype(np.uint64))), kind="stable")
    ctx, word = contexts[order], words[order]
    first = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1])]))
    counts = np.add.reduceat(every["counts"][order].astype(np.int64), first)
    back = np.empty(len(order), np.int64)
    back[order] = np.repeat(counts, np.diff(np.append(first, len(order))))
    answers = _message(_PAIRS, _lists(table.column("peer")), _lists(table.column("key")), a=[x.astype(np.int64) for x in np.split(back, np.cumsum(sizes)[:-1])])
    seen = counts > 0
    counts, chance, (names, at) = counts[seen], known.probability(every["totals"][order][first][seen]), np.unique(ctx[first][seen], return_inverse=True)
    few = np.stack([np.bincount(at[counts == r], minlength=len(names)) for r in range(1, CUT + 1)], 1).astype(np.int64)
    sums, chances = np.bincount(at, counts, len(names)), np.bincount(at, chance, len(names))
    to, firsts = shard_order(names, shards)
    sent = np.flatnonzero(np.diff(firsts))
    cut = lambda x: [x[to[firsts[k] : firsts[k + 1]]] for k in sent]
    stats = _message(_CONTEXTS, sent.tolist(), [0] * len(sent), a=cut(names), b=cut(few), c=cut(sums.astype(np.float64)), d=cut(chances))
    return pa.concat_tables([answers, stats, _message(_COUNTED, [0], [0], counted=[_counted(counts)])])


def _weight_answers(asks: pa.Table, messages: pa.Table) -> pa.Table:
    """For every word that a chunk asks about: its total as a context (with what is added to it), and its backoff weight."""
    d = discounts(np.array(_of_kind(messages, _COUNTED).column("counted")[0].as_py()))
    stats = _of_kind(messages, _CONTEXTS)
    names = np.concatenate([np.zeros(0, np.uint64), *unpack(stats.column("a"), np.uint64)])
    few = np.concatenate([np.zeros((0, CUT), np.int64), *(x.reshape(-1, CUT) for x in unpack(stats.column("b"), np.int64))])
    sums, chances = (np.concatenate([np.zeros(0), *unpack(stats.column(c), np.float64)]) for c in "cd")
    # the parts of a context that was spread
    names, at = np.unique(names, return_inverse=True)
    few = np.stack([np.bincount(at, few[:, r], len(names)) for r in range(CUT)], 1) if len(names) else np.zeros((0, CUT))
    sums, chances = np.bincount(at, sums, len(names)), np.bincount(at, chances, len(names))
    lost = (few * np.arange(1, CUT + 1) * (1 - d[1:])).sum(1)
    total = np.where(lost > 0, sums, sums + 1)
    weight = np.where(lost > 0, lost, 1.0) / total / np.maximum(1 - chances, 1e-300)
    out: tuple[list, list] = ([], [])
    for words in unpack(asks.column("words"), np.uint64):
        where, there = _find(names, words)
        out[0].append(np.where(there, total[where], 0.0) if len(names) else np.zeros(len(words)))
        out[1].append(np.where(there, weight[where], 1.0) if len(names) else np.ones(len(words)))
    return _message(_WEIGHTS, _lists(asks.column("peer")), _lists(asks.column("key")), a=out[0], b=out[1])


def _evaluate(table: pa.Table, messages: pa.Table, shards: int, known: Unigrams) -> pa.Table:
    if not len(table):
        # a chunk that got no documents, only what everyone is told
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    held = _Chunk(table, shards)
    (totals,) = _answered(messages, _UNIGRAMS, len(held.words), *held.word_shards(), a=np.int64)
    (counts,) = _answered(messages, _PAIRS, len(held.pairs), *held.pair_shards(totals, known.tokens), a=np.int64)
    sums, weights = _answered(messages, _WEIGHTS, len(held.words), *held.word_shards(), a=np.float64, b=np.float64)
    d = discounts(np.array(_of_kind(messages, _COUNTED).column("counted")[0].as_py()))
    chance = known.probability(totals)
    seen = discounted(counts, d) / np.maximum(sums[held.contexts], 1)
    log = np.log10(np.where(counts > 0, seen, weights[held.contexts] * chance[held.followers]))
    total = lambda x: np.add.reduceat(x, held.bounds[:-1])
    token_totals = totals[held.tokens]
    columns = [pa.array(held.held), pa.array(held.lengths), pa.array(total((token_totals > 0).astype(np.int64))), pa.array(total(known.base(token_totals))), pa.array(total(log[held.pair_of]))]
    return pa.Table.from_arrays([held.doc_ids, *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every row."""
    chunks = shards = count_chunks(docs, chunk_bytes)
    unigrams = materialize(unigram_table(docs, shards))
    sums = unigrams.agg(F.sum("tokens"), F.sum("types"), F.max("types"), *[F.sum(F.get("counted", F.lit(r))) for r in range(CUT + 1)]).first()
    known = Unigrams.of(sums[0] or 0, sums[1] or 0, np.array([x or 0 for x in sums[3:]]), (sums[2] or 0) * shards)
    by_chunk = in_packed_chunks(docs, chunks).groupBy("chunk")
    asks = by_chunk.applyInArrow(lambda t: _ask_words(t, shards), _ASK)
    word_answers = asks.groupBy("key").cogroup(unigrams.select("key", "words", "counts").groupBy("key")).applyInArrow(lambda a, c: _word_answers(a, c, shards), _MESSAGE)
    pair_asks = by_chunk.cogroup(word_answers.groupBy("key")).applyInArrow(lambda t, m: _ask_pairs(t, m, shards, known), _ASK_PAIRS)
    merged = pair_asks.groupBy("key").applyInArrow(lambda t: _pair_answers(t, shards, known), _MESSAGE)
    # counts of counts are summed over shards and sent to every shard and chunk
    counted = merged.filter(F.col("kind") == _COUNTED).agg(F.array(*[F.coalesce(F.sum(F.get("counted", F.lit(r))), F.lit(0)) for r in range(CUT + 1)]).alias("counted"))
    empty = [F.lit(None).cast("binary").alias(c) for c in "abcd"]
    everyone = counted.select(F.lit(_COUNTED).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("key"), F.lit(0).alias("peer"), *empty, "counted")
    contexts = merged.filter(F.col("kind") == _CONTEXTS).unionByName(everyone)
    weights = asks.groupBy("key").cogroup(contexts.groupBy("key")).applyInArrow(_weight_answers, _MESSAGE)
    messages = word_answers.unionByName(merged.filter(F.col("kind") == _PAIRS)).unionByName(weights).unionByName(everyone)
    rows = by_chunk.cogroup(messages.groupBy("key")).applyInArrow(lambda t, m: _evaluate(t, m, shards, known), _SCORES)
    return rows.withColumn("train_tokens", F.lit(known.tokens).cast("long"))


def op3(spark, sf_dir: str) -> DataFrame:
    rows = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
