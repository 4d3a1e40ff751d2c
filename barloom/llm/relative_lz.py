"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the whole corpus: its blocks are the chunks that documents are dealt into, and a place in it is a block and the number of a word in
it. Every block is indexed by anchors of ANCHOR words at places chosen by their content: of every WINDOW - ANCHOR + 1 consecutive starts the one with the least
hash, so that equal passages have equal anchors and a passage of WINDOW words holds an anchor's start. Around anchors that occur more than
once a document is parsed greedily from left to right: a factor starts at the first word whose next WINDOW words also start at another place of the reference,
and is extended word by word as long as the next WINDOW words are those at the next place there (the first place that has them, as a passage of many places
stands for itself once). At the word where they are not, the factor's boundary, the windows that straddle
it are checked, too: each may recur at yet another place, and then begins the next factor, which overlaps the one before. The words of all
factors, each at least WINDOW long, are the duplicate spans.

Passages are compared by two polynomial hashes, 96 bits in all, over the words' 64-bit hashes.

Defined results: null text has no words; texts of fewer than WINDOW words lose nothing; repeated rows are texts of their
own, so each makes the other a duplicate; an empty table gives an empty table; other columns are not read.

Scale: texts are shuffled once into bounded chunks. A shuffle then carries one hash per anchor (about a tenth of the words),
another one hash per start near repeated anchors; answers are the starts that recur, each with one place of the reference. A chunk asks about each of its
different anchors and passages once, and finds those that recur within itself alone, so a passage of very many documents sends its shard one
hash per chunk, not one per occurrence. No key's occurrences are paired with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, mix, window_hashes
from .chunks import count_chunks, count_shards, in_chunks, in_order, packed, shard_order, unpack

#: Words of a passage that counts as repeated, and of an anchor.
WINDOW = 35
ANCHOR = 18
CHUNK_BYTES = 12 << 20
#: Chunks whose keys a shard holds, where there are many.
SHARD_CHUNKS = 8
_ASK_ANCHORS = "shard int, chunk int, keys binary"
_ANCHORS = "chunk int, shard int, bits binary, n int"
_ASK_PASSAGES = "shard int, chunk int, keys binary, more binary, at binary, known binary, places binary"
_PASSAGES = "chunk int, shard int, at binary, places binary"
_SPANS = "doc_id long, n_words long, n_removed long, factors array<struct<start:long,stop:long,block:long,at:long>>, kept string"
#: Bits of a place in the reference that number the word in its block.
_WORD_BITS = 32


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Sorted positions that hold the first least value of some run of width values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # the least of each run, by doubling; equal values keep the first position
    at, size = np.arange(len(values)), 1
    while size * 2 <= width:
        a, b = at[: len(at) - size], at[size:]
        at, size = np.where(values[b] < values[a], b, a), size * 2
    a, b = at[:n], at[width - size : width - size + n]
    least = np.where(values[b] < values[a], b, a)
    return np.unique(least)


class _Chunk:
    """A chunk's words, and what can be asked about them."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.table = in_order(table)
        self.words = Words(self.table.column("text"))
        self.window, self.anchor = window, anchor
        self.hashes = self.words.hashes()
        bounds = self.words.bounds
        #: Whether a passage that starts at a word ends within the same document.
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(self.words))
        self.fits = left >= window

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors."""
        keys = window_hashes(self.hashes, self.anchor)
        span = self.window - self.anchor + 1
        found = [a + _least_of(keys[a : b - self.anchor + 1], span) for a, b in zip(self.words.bounds[:-1].tolist(), self.words.bounds[1:].tolist()) if b - a >= self.window]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        return at, keys[at]

    def starts(self, anchors: np.ndarray) -> np.ndarray:
        """Positions of passages that hold one of the anchors."""
        near = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(near, np.maximum(anchors - (self.window - self.anchor), 0), 1)
        np.add.at(near, anchors + 1, -1)
        return np.flatnonzero((np.cumsum(near)[:-1] > 0) & self.fits)

    def passages(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = window_hashes(self.hashes, self.window)[starts]
        more = window_hashes(self.hashes ^ np.uint64(0x9E3779B97F4A7C15), self.window)[starts]
        return keys, (mix(more + keys) >> np.uint64(32)).astype(np.uint32)


def _chunk_of(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each different row of keys, and for every row which of them it equals."""
    order = np.lexsort(keys)
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for x in keys:
        fresh[1:] |= x[order[1:]] != x[order[:-1]]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return order[fresh], of


def _questions(chunk: int, shards: int, keys: np.ndarray, **more: np.ndarray) -> pa.Table:
    """One row for each shard that any of the keys falls in, with its keys and what goes with them."""
    order, firsts = shard_order(keys, shards)
    asked = np.flatnonzero(np.diff(firsts)).astype(np.int32)
    columns = {"keys": keys} | more
    cut = packed(*([x[order[firsts[k] : firsts[k + 1]]] for k in asked] for x in columns.values()))
    return pa.Table.from_arrays([pa.array(asked), pa.array(np.full(len(asked), chunk, np.int32)), *cut], names=["shard", "chunk", *columns])


def _repeated(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of keys comes more than once."""
    order = np.lexsort(keys)
    equal = np.ones(max(len(order) - 1, 0), bool)
    for x in keys:
        ranked = x[order]
        equal &= ranked[1:] == ranked[:-1]
    again = np.zeros(len(order), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    return again


def _anchor_answers(table: pa.Table) -> pa.Table:
    """For every anchor that a shard was asked about, whether an equal one was."""
    keys = unpack(table.column("keys"), np.uint64)
    again = np.split(_repeated(np.concatenate(keys)), np.cumsum(list(map(len, keys)))[:-1])
    return pa.Table.from_arrays([table.column("chunk"), table.column("shard"), *packed([np.packbits(x) for x in again]), pa.array(list(map(len, keys)), pa.int32())], names=["chunk", "shard", "bits", "n"])


def _passage_answers(table: pa.Table) -> pa.Table:
    """The starts of passages that a shard was asked about by more than one chunk, each with a place of another chunk, and what each chunk knew."""
    keys, more, at, known, places = (unpack(table.column(c), k) for c, k in (("keys", np.uint64), ("more", np.uint32), ("at", np.int32), ("known", np.int32), ("places", np.int64)))
    sizes = list(map(len, keys))
    asked = np.concatenate(at).astype(np.int64)
    chunk = np.repeat(table.column("chunk").to_numpy().astype(np.int64), sizes)
    # of equal passages, the one of the lowest chunk first; it gets the next one's place, all others get its
    order = np.lexsort((chunk, np.concatenate(more), np.concatenate(keys)))
    ranked = [np.concatenate(x)[order] for x in (more, keys)]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ranked[0][1:] != ranked[0][:-1]) | (ranked[1][1:] != ranked[1][:-1])
    firsts = np.flatnonzero(fresh)
    counts = np.diff(np.append(firsts, len(order)))
    other = np.repeat(firsts, counts)
    other[firsts[counts > 1]] += 1
    place = np.empty(len(order), np.int64)
    place[order] = ((chunk << _WORD_BITS) | np.where(asked < 0, ~asked, asked))[order[other]]
    again = np.empty(len(order), bool)
    # a negative start is that of a passage whose starts its chunk knows already
    again[order] = np.repeat(counts > 1, counts) & (asked[order] >= 0)
    cuts = np.cumsum(sizes)[:-1]
    told = [(np.concatenate([x[y], z]), np.concatenate([p[y], q])) for x, y, p, z, q in zip(at, np.split(again, cuts), np.split(place, cuts), known, places)]
    found = [k for k, (x, _) in enumerate(told) if len(x)]
    rows = pa.array(found, pa.int64())
    return pa.Table.from_arrays([table.column("chunk").take(rows), table.column("shard").take(rows), *packed([told[k][0] for k in found], [told[k][1] for k in found])], names=["chunk", "shard", "at", "places"])


def _flags(keys: np.ndarray, answers: pa.Table, shards: int) -> np.ndarray:
    """The answers about a chunk's anchors, in the order of the anchors."""
    order, firsts = shard_order(keys, shards)
    out = np.zeros(len(keys), bool)
    for shard, bits, n in zip(answers.column("shard").to_pylist(), unpack(answers.column("bits"), np.uint8), answers.column("n").to_pylist()):
        out[order[firsts[shard] : firsts[shard + 1]]] = np.unpackbits(bits, count=n).astype(bool)
    return out


def factors(starts: np.ndarray, places: np.ndarray, bounds: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Greedy factors (start, stop, place) of each document, counted in its words; starts: words whose passages recur, sorted, and where they do.

    A factor goes on while the next word's passage recurs at the next place. A word at which it does not is the boundary, where the next factor starts.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    if len(starts):
        breaks = np.flatnonzero((np.diff(starts) != 1) | (np.diff(places) != 1)) + 1
        firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks - 1, [len(starts) - 1]])
        home = np.searchsorted(bounds, starts[firsts], "right") - 1
        for k, a, b, place in zip(home.tolist(), (starts[firsts] - bounds[home]).tolist(), (starts[lasts] - bounds[home]).tolist(), places[firsts].tolist()):
            out[k].append((a, b + window, place))
    return out


def _kept(text: str | None, spans: list[tuple[int, int, int]]) -> tuple[int, int, bytes]:
    """Number of words, of words in spans, and the other words joined by one space."""
    # bytes split at just the separators of arrays.Words
    words = (text or "").encode().split()
    n = len(words)
    if spans:
        rest, at = [], 0
        for a, b, _ in spans:
            rest += words[at:a]
            at = max(at, b)
        words = rest + words[at:]
    return n, n - len(words), b" ".join(words)


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, factors (start and stop in words, with the block and the word in it that it repeats) and kept (the words in none, joined by one space) of every row."""
    if not 1 <= anchor <= window or window < 2:
        raise ValueError("an anchor must fit in the window, which has two words at least")
    chunks = count_chunks(docs, chunk_bytes)
    shards = count_shards(chunks, SHARD_CHUNKS)
    dealt = in_chunks(docs, chunks)

    def index(table: pa.Table) -> pa.Table:
        held = _Chunk(table, window, anchor)
        return _questions(_chunk_of(table), shards, np.unique(held.anchors()[1]))

    def look(table: pa.Table, answers: pa.Table) -> pa.Table:
        held = _Chunk(table, window, anchor)
        at, keys = held.anchors()
        keys, of, counts = np.unique(keys, return_inverse=True, return_counts=True)
        starts = held.starts(at[(_flags(keys, answers, shards) | (counts > 1))[of]])
        keys, more = held.passages(starts)
        first, of = _distinct(more, keys)
        again = np.bincount(of, minlength=len(first)) > 1
        asked = _questions(_chunk_of(table), shards, keys[first], more=more[first], at=np.where(again, ~starts[first], starts[first]).astype(np.int32))
        # what recurs within the chunk goes along with its first question: the first place, and for that one the second
        own = np.flatnonzero(again[of])
        other = first[of[own]]
        second = np.zeros(len(first), np.int64)
        late = own[own != other]
        second[of[late[::-1]]] = late[::-1]
        other = np.where(own == other, second[of[own]], other)
        known, places = starts[own].astype(np.int32), (np.int64(_chunk_of(table)) << _WORD_BITS) | starts[other].astype(np.int64)
        fill = lambda x: packed([x, *[x[:0]] * len(asked)][: len(asked)])[0]
        return asked.append_column("known", fill(known)).append_column("places", fill(places))

    def parse(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        texts = table.column("text")
        starts = np.concatenate([np.zeros(0, np.int32), *unpack(answers.column("at"), np.int32)]).astype(np.int64)
        places = np.concatenate([np.zeros(0, np.int64), *unpack(answers.column("places"), np.int64)])
        order = np.argsort(starts)
        spans = factors(starts[order], places[order], Words(texts).bounds, window) if len(starts) else [[]] * len(table)
        parts = [_kept(t.as_py(), s) for t, s in zip(texts, spans)]
        n, gone, kept = zip(*parts)
        listed = [[{"start": a, "stop": b, "block": p >> _WORD_BITS, "at": p & ((1 << _WORD_BITS) - 1)} for a, b, p in s] for s in spans]
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "stop", "block", "at")]))
        columns = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(listed, kind), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays([table.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "factors", "kept"])

    by_chunk = dealt.groupBy("chunk")
    anchors = by_chunk.applyInArrow(index, _ASK_ANCHORS).groupBy("shard").applyInArrow(_anchor_answers, _ANCHORS)
    asked = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(look, _ASK_PASSAGES)
    passages = asked.groupBy("shard").applyInArrow(_passage_answers, _PASSAGES)
    return by_chunk.cogroup(passages.groupBy("chunk")).applyInArrow(parse, _SPANS)


def op8(spark, sf_dir: str) -> DataFrame:
    rows = duplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM docs),
passages AS (
  SELECT rid, unnest(list_transform(range(1, len(ws) - 33), lambda i: {'at': i, 'passage': sha256(array_to_string(ws[i:i + 34], ' '))}), recursive := true) FROM docs WHERE len(ws) >= 35),
repeated AS (SELECT passage FROM passages GROUP BY passage HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range("at", "at" + 35)) AS pos FROM passages JOIN repeated USING (passage)),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""
