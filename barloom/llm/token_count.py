"""Count the tokens of a unigram tokenizer without making them.

An Aho-Corasick automaton of the vocabulary reads the distinct words of a batch once and enumerates every vocabulary piece
at every place. Over these a Viterbi pass carries, for each place, the best score of a segmentation up to it and the number of
its pieces; no segmentation is kept.

Tokenizer: a word is preceded by the mark U+2581 and segmented on its own; white space only separates words. Tie rule: of equal scores
the one whose last piece starts first wins. A character that is a piece by itself has no unknown node; any other has one, with
the least score of the vocabulary less UNKNOWN_PENALTY, and counts as one token for each of its UTF-8 bytes (byte fallback).

Defined results: null or blank text has no tokens and score 0; repeated rows each give a row; an empty table gives an empty
table; other columns are not read.

Scale: one map over the texts, nothing is shuffled. Each distinct word of a batch is segmented once; a bounded memory of
words already seen by a Python worker saves further work and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .arrays import Words

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers.
REMEMBERED = 1_000_000
_BREAK = "\n"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Normal pieces of a SentencePiece file with their scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i))


class Counter:
    """Best score and number of tokens of words."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and _BREAK not in piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.seen: dict[int, tuple[float, int]] = {}

    def __call__(self, words: list[str]) -> list[tuple[float, int]]:
        """Score and tokens of each of some words, none of which is empty or holds a line break."""
        text = _BREAK.join(MARK + w for w in words)
        # at a place: the best score of the word's segmentations up to it, and its pieces
        score, count = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        found = self.automaton.iter(text)
        match = next(found, None)
        out, unknown = [], self.unknown
        # pieces end in order of place, the longest first, so that the first of equal scores starts first
        for end, char in enumerate(text):
            if char == _BREAK:
                out.append((score[end], count[end]))
                continue
            best, pieces, single = None, 0, False
            while match is not None and match[0] == end:
                length, value = match[1]
                start = end + 1 - length
                value += score[start]
                if best is None or value > best:
                    best, pieces = value, count[start] + 1
                single |= length == 1
                match = next(found, None)
            if not single:
                value = score[end] + unknown
                if best is None or value > best:
                    best, pieces = value, count[end] + len(char.encode())
            score[end + 1], count[end + 1] = best, pieces
        if words:
            out.append((score[-1], count[-1]))
        return out

    def lookup(self, words: Words, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and tokens of the words at first, whose hashes these are."""
        new = [k for k, h in enumerate(hashes.tolist()) if h not in self.seen]
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = range(len(hashes))
        texts = [words.bytes_of(first[k]).decode() for k in new]
        fresh = {}
        for a in range(0, len(texts), 4096):
            fresh |= zip(hashes[list(new[a : a + 4096])].tolist(), self(texts[a : a + 4096]))
        self.seen |= fresh
        both = [self.seen[h] for h in hashes.tolist()]
        return np.array([s for s, _ in both], np.float64), np.array([n for _, n in both], np.int64)


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens and score (sum of the words' best scores) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            words = Words(batch.column("text"))
            hashes, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
            scores, counts = counter.lookup(words, hashes, first)
            total = np.concatenate([[0], np.cumsum(counts[inverse])])
            score = [float(scores[inverse[a:b]].sum()) for a, b in zip(words.bounds[:-1], words.bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts), pa.array(total[words.bounds[1:]] - total[words.bounds[:-1]]), pa.array(score, pa.float64())], names=["doc_id", "n_words", "n_tokens", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, score double")


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
