"""Align the tokens of two tokenizers and count which tokens stand for which.

Both token sequences of a text are intervals of its bytes. Tokenizer B's, sorted as they are, make a static interval index: two bisections per A token (the first B token that ends after its start, the first
that starts at or after its end) stab it and give the stretch of B tokens that the A token overlaps. A gap between two A tokens that no B token spans, so that their stretches share none, is a group boundary.
Groups are thus the least runs of A and B tokens that cover the same bytes; every A token of a group is linked to every B token of it.

Tokenizer A is the byte-level BPE over a space and the text (strings of special tokens are plain text), made by tiktoken from the rank file of the same vocabulary; a text that tiktoken can't take goes to the
`tokenizers` library. Tokenizer B is the SentencePiece file over the text, to which it adds that space. The joined bytes of both must be those of the space and the text.

A pair (A id, B id) counts the documents of the whole corpus that have it linked; a pair is best if no other pair of its A id counts more (ties are all best).

Defined results: texts that are null, empty, or of which either tokenizer's bytes differ (such as texts with U+2581) have no tokens: zeros and an empty groups_sha256; repeated rows each give a row and are counted each; rows of
equal or null doc_id are separate documents; an empty table gives an empty table; other columns are not read.

Scale: one map over the texts, tokenized once, which writes for every chunk (a stretch of an input partition of about CHUNK_BYTES) its documents' links by number of pair and, once, each pair of the chunk with its number of documents.
Pairs are counted from these sums, so a pair of all documents is a row per chunk; the counts go back by a join on the pair and meet their chunk in a cogroup, one chunk at a time. No group but a chunk is held by a task. A group in which the tokenizers agree on no boundary for long
is taken apart into its distinct ids with their repeats, and pairs are listed PAIRS_AT_ONCE at a time, so memory follows the distinct pairs, not the product of the group's lengths.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import runs
from .chunks import plane_bytes
from .storage import materialize, scope

CHUNK_BYTES, CHUNK_DOCS = 4 << 20, 4096
#: Bytes of text that are aligned at once, and pairs that are listed at once.
PART_BYTES, PAIRS_AT_ONCE = 1 << 18, 1 << 21
#: Pairs of documents, 12 bytes each, of a row: rows of megabytes fragment the executors' heap.
ROW_PAIRS = 1 << 15
#: Groups of more pairs of occurrences are taken apart by their distinct ids.
PLAIN_GROUP = 4096
_MADE = "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, pairs_of array<int>, places binary, times binary, pairs array<long>, held array<int>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_B_BITS = np.int64(32)


class Tokenizers:
    """Both tokenizers: ids of texts, and each id's bytes."""

    def __init__(self, json_path: str, rank_path: str, pattern: str, model_path: str):
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.model = b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        piece = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = {i: piece(i) for i in range(b.get_piece_size())}
        size = lambda of: np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64)
        self.a_size, self.b_size = size(self.a_bytes), size(self.b_bytes)

    @cached_property
    def slow(self):
        """Loaded where a text needs it."""
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(self.json_path)
        slow.encode_special_tokens = True
        return slow

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # a panic of its pattern matcher is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """A and B ids of every text; both empty where their bytes are not those of a space and the text."""
        a = [self.encode_a(" " + t) if t else [] for t in texts]
        b = self.model.encode(texts, num_threads=1) if texts else []
        spelled = lambda ids, of: b"".join(map(of.get, ids))
        good = lambda t, x, y: t and spelled(x, self.a_bytes) == (want := b" " + t.encode()) == spelled(y, self.b_bytes)
        return [(x, y) if good(t, x, y) else ([], []) for t, x, y in zip(texts, a, b)]


@lru_cache(maxsize=2)
def _tokenizers(*paths: str) -> Tokenizers:
    return Tokenizers(*paths)


def group_bounds(a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of two sequences of tokens that cover the same bytes begin, in each, and their ends."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    first = np.searchsorted(b_end, a_end - a_size, "right")
    last = np.searchsorted(b_end - b_size, a_end, "left")
    # the stretches of two neighbours share no B token
    starts = np.flatnonzero(np.concatenate([[True], first[1:] >= last[:-1]])) if len(a_size) else np.zeros(0, np.int64)
    return np.append(starts, len(a_size)), np.append(first[starts], len(b_size))


def spell_groups(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, docs: np.ndarray) -> list[bytes]:
    """The groups in decimal, `a1,a2|b1;a3|b2,b3`, of each document; docs: each document's first group, and their number."""
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    total = len(a) + len(b)
    a_place, b_place = np.arange(len(a)) + np.repeat(b_at[:-1], n_a), np.arange(len(b)) + np.repeat(a_at[1:], n_b)
    ids, after = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[a_place], ids[b_place] = a, b
    group_end = a_at[1:] + b_at[1:]
    after[group_end - n_b - 1], after[group_end - 1] = ord("|"), ord(";")
    digits = np.searchsorted(10 ** np.arange(1, 8), ids, "right") + 1
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if total else 0, np.uint8)
    out[ends - 1] = after
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        out[ends[has] - 2 - k] = ord("0") + ids[has] // 10**k % 10
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], group_end])[docs]]
    # without the last semicolon
    return [out[x : y - 1].tobytes() if y > x else b"" for x, y in zip(cuts[:-1], cuts[1:])]


def distinct_pairs(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, doc_of: np.ndarray, at_once: int = PAIRS_AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair (A id << 32 | B id) and occurrences of every linked pair of a document; doc_of: the document of each group."""
    docs, pairs, times = [], [], []

    def keep(doc, pair, n):
        order = np.lexsort((pair, doc))
        doc, pair, n = doc[order], pair[order], n[order]
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
        docs.append(doc[new]), pairs.append(pair[new]), times.append(np.add.reduceat(n, new) if len(new) else n)

    def listed(tokens, repeats, group):
        """Pairs of some A tokens (with their repeats) with all plain B tokens of their groups."""
        n = b_at[group + 1] - b_at[group]
        done = 0
        while done < len(tokens):
            upto = done + max(1, int(np.searchsorted(np.cumsum(n[done:]), at_once, "right")))
            t, g, m = tokens[done:upto], group[done:upto], n[done:upto]
            partner = np.repeat(b_at[g], m) + runs(m)
            keep(np.repeat(doc_of[g], m), np.repeat(t.astype(np.int64) << _B_BITS, m) | b[partner], np.repeat(repeats[done:upto], m))
            done = upto

    product = np.diff(a_at) * np.diff(b_at)
    of_a = np.repeat(np.arange(len(product)), np.diff(a_at))
    plain = product[of_a] <= PLAIN_GROUP
    listed(a[plain], np.ones(int(plain.sum()), np.int64), of_a[plain])
    for g in np.flatnonzero(product > PLAIN_GROUP).tolist():
        x, x_times = np.unique(a[a_at[g] : a_at[g + 1]], return_counts=True)
        y, y_times = np.unique(b[b_at[g] : b_at[g + 1]], return_counts=True)
        step = max(1, at_once // len(y))
        for s in range(0, len(x), step):
            pair = ((x[s : s + step].astype(np.int64) << _B_BITS)[:, None] | y[None, :]).ravel()
            keep(np.full(len(pair), doc_of[g]), pair, (x_times[s : s + step, None] * y_times[None, :]).ravel())
    if len(docs) > 1:
        parts = [np.concatenate(x) for x in (docs, pairs, times)]
        docs, pairs, times = [], [], []
        keep(*parts)
    return (docs[0], pairs[0], times[0]) if docs else (np.zeros(0, np.int64),) * 3


def align(tokens: list[tuple[list[int], list[int]]], a_size: np.ndarray, b_size: np.ndarray) -> dict[str, np.ndarray | list]:
    """Of some documents' tokens: n_a, n_b, n_groups, n_links and sha of each, and doc, pair and times of their distinct linked pairs."""
    n_a, n_b = (np.array([len(x[k]) for x in tokens], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for x in tokens for i in x[k]), np.int64) for k in (0, 1))
    a_at, b_at = group_bounds(a_size[a], b_size[b])
    # documents begin with a group, as their tokens cover the same bytes
    docs = np.searchsorted(a_at[:-1], np.concatenate([[0], np.cumsum(n_a)]))
    doc_of = np.repeat(np.arange(len(tokens)), np.diff(docs))
    links = np.concatenate([[0], np.cumsum(np.diff(a_at) * np.diff(b_at))])
    sha = [hashlib.sha256(s).hexdigest() if s else "" for s in spell_groups(a, b, a_at, b_at, docs)]
    doc, pair, times = distinct_pairs(a, b, a_at, b_at, doc_of)
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(docs), "n_links": np.diff(links[docs]), "sha": sha, "doc": doc, "pair": pair, "times": times}


def _stretches(batches: Iterator[pa.RecordBatch], docs: int, size: int) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of at most so many rows, whose texts take about size bytes."""
    ids, texts, used = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            if texts and (len(texts) == docs or used + len(text) > size):
                yield ids, texts
                ids, texts, used = [], [], 0
            ids.append(doc_id), texts.append(text)
            used += len(text)
    if texts:
        yield ids, texts


def linked(docs: DataFrame, *paths: str, chunk_docs: int = CHUNK_DOCS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of each chunk of documents: what align() tells of some of them, with pairs by their number among the chunk's. The first row also has the chunk's pairs with the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tokenizers(*paths)
        chunk = TaskContext.get().partitionId() << 32
        for ids, texts in _stretches(batches, chunk_docs, chunk_bytes):
            parts, start, used = [], 0, 0
            for end, text in enumerate(texts, 1):
                used += len(text)
                if used >= PART_BYTES or end == len(texts):
                    parts.append(align(known.encode(texts[start:end]), known.a_size, known.b_size))
                    start, used = end, 0
            whole = lambda name: np.concatenate([p[name] for p in parts])  # noqa: E731,B023
            pairs, place, held = np.unique(whole("pair"), return_inverse=True, return_counts=True)
            pairs_of = np.concatenate([np.bincount(p["doc"], minlength=len(p["n_a"])) for p in parts])
            places, times, sha = place.astype(np.int32), whole("times"), [t for p in parts for t in p["sha"]]
            told = {c: whole(c) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"pairs_of": pairs_of.astype(np.int32)}
            ends = np.concatenate([[0], np.cumsum(pairs_of)])
            cuts = [0, *(np.flatnonzero(np.diff(ends[:-1] // ROW_PAIRS)) + 1).tolist(), len(ids)]
            none = np.zeros(0, np.int64)
            for x, y in zip(cuts[:-1], cuts[1:]):
                row = {"chunk": chunk, "doc_ids": ids[x:y], "sha": sha[x:y]} | {c: v[x:y] for c, v in told.items()}
                row |= {"places": plane_bytes(places[ends[x] : ends[y]]), "times": plane_bytes(times[ends[x] : ends[y]]), "pairs": none if x else pairs, "held": none if x else held.astype(np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in _KINDS.items()], names=list(_KINDS))
            chunk += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MADE)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_KINDS = {n: pa.list_(_ARROW[k[6:-1]]) if k.startswith("array") else _ARROW[k] for n, k in (c.split() for c in _MADE.split(", "))}


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, count (documents that have it linked) and best (whether no pair of its A id counts more)."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.held").cast("long").alias("held"))
    counts = materialize(each.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a_id", F.shiftright("pair", 32).cast("int")))
    most = counts.groupBy(F.col("a_id").alias("of_id")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("a_id") == F.col("of_id")).select("pair", "a_id", "count", (F.col("count") == F.col("most")).alias("best"))


def _unplane(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def scored(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """The contract's row of every document of the chunks, with what the pairs count. A chunk goes to Python alone, with its pairs as rows beside it."""
    wanted = chunks.select(F.col("chunk").alias("of_chunk"), F.explode("pairs").alias("pair"))
    told = wanted.join(counts.select("pair", "count", "best"), "pair")

    def of(rows: pa.Table, told: pa.Table) -> pa.Table:
        count_of, best_of, pair_of = (told.column(c).to_numpy() for c in ("count", "best", "pair"))
        # one row has them all, in order
        pairs = rows.column("pairs").combine_chunks().flatten().to_numpy()
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = np.searchsorted(pairs, pair_of)
        count[at], best[at] = count_of, best_of
        tables = []
        for k in range(rows.num_rows):
            cell = lambda name: rows.column(name)[k]  # noqa: E731,B023
            array = lambda name: cell(name).values.to_numpy(zero_copy_only=False)  # noqa: E731,B023
            pairs_of = array("pairs_of")
            places, times = _unplane(cell("places").as_py(), np.int32), _unplane(cell("times").as_py(), np.int64)
            ends = np.concatenate([[0], np.cumsum(pairs_of)])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(times * x[places])])[ends])  # noqa: E731,B023
            columns = [cell("doc_ids").values, *[array(c) for c in ("n_a", "n_b", "n_groups", "n_links")], total(best), total(count), cell("sha").values]
            tables.append(pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[c.split()[0] for c in _RESULT.split(", ")]))
        return pa.concat_tables(tables)

    return chunks.drop("held").groupBy("chunk").cogroup(told.groupBy("of_chunk")).applyInArrow(of, _RESULT)


def aligned(docs: DataFrame, *paths: str) -> DataFrame:
    """The contract's row of every document; paths: A's tokenizer file, its rank file, its pattern, and B's model."""
    with scope(docs.sparkSession) as kept:
        chunks = materialize(linked(docs, *paths))
        result = materialize(scored(chunks, materialize(pair_counts(chunks))))
        kept.append(result)
    return result


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("piece_bpe_32k.model"))
