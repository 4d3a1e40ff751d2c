import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from barloom.llm import relative_lz
from barloom.llm.arrays import Words, window_hashes


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    passage = [[word() for _ in range(rng.randint(3, 40))] for _ in range(8)]
    rows = [(1000, None), (1001, ""), (1002, "a \t b\n"), (1003, "same " * 400), (1004, " ".join(word() for _ in range(5000)))]
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passage) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    return [*rows, rows[10], (2000, rows[12][1]), (None, rows[13][1])]


def plain(rows, window):
    """Removed words by a count of all passages."""
    words = [(t or "").replace("\t", " ").replace("\n", " ").split(" ") for _, t in rows]
    words = [[w for w in x if w] for x in words]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for k in range(p, p + window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize(("window", "block", "size"), [(35, 18, 1 << 30), (35, 18, 4000), (7, 3, 6000), (2, 1, 10_000)])
def test_against_brute_force(spark, window, block, size):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    got = relative_lz.duplicate_spans(docs, window, block, size).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == plain(rows, window)
    # the blocks of the reference: the words of each chunk
    chunks = relative_lz.in_chunks(docs, relative_lz.count_chunks(docs, size)).toArrow()
    reference = {}
    for k in set(chunks.column("chunk").to_pylist()):
        words = Words(relative_lz.in_order(chunks.filter(pc.equal(chunks.column("chunk"), k))).column("text"))
        reference[k] = [words.bytes_of(i) for i in range(len(words))]
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    for r in got:
        assert r.n_removed == len({k for f in r.factors for k in range(f.start, f.stop)})
        at = 0
        for f in r.factors:
            assert f.stop - f.start >= window and f.start >= at
            at = f.start + 1
            assert any(reference[f.block][f.at : f.at + f.stop - f.start] == (t or "").encode().split()[f.start : f.stop] for t in texts[r.doc_id])
    # a passage of three documents is one factor, not one for each window
    assert max(f.stop - f.start for r in got for f in r.factors) > window


def test_factors_end_where_the_reference_does():
    starts, places = np.array([3, 4, 5, 6, 20, 21]), np.array([100, 101, 900, 901, 7, 8])
    assert relative_lz.factors(starts, places, np.array([0, 15, 40]), 5) == [[(3, 9, 100), (5, 11, 900)], [(5, 11, 7)]]


def test_empty_table(spark):
    assert relative_lz.duplicate_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_and_hashes():
    texts = ["", None, "a", " b c\x0b d", "e", "long" * 300_000 + " x", "a"]
    words = Words(pa.array(texts))
    plain_words = [w for t in texts for w in (t or "").encode().split()]
    assert [words.bytes_of(i) for i in range(len(words))] == plain_words
    assert words.counts.tolist() == [len((t or "").encode().split()) for t in texts]
    by_hash = {}
    for h, w in zip(words.hashes().tolist(), plain_words):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(plain_words))
    values = np.tile(np.arange(1, 6, dtype=np.uint64), 50)
    keys = window_hashes(values, 7)
    assert len(keys) == 244 and len(set(keys.tolist())) == 5 and (keys[:5] == keys[5:10]).all()
