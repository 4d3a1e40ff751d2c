import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import impact_index as ix

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    """item row, rank, doc_id and score of the k best, by dictionaries."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "a1", "é", "日本", "x-y", "ß", *[f"w{i}" for i in range(80)]]
    weights = [40, 10, 5, 5, 3, 5, 1, *[80 // (i + 1) + 1 for i in range(80)]]
    texts = [" ,".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 60]))) for _ in range(n)]
    texts[::17] = texts[1::17][: len(texts[::17])]
    return texts


def ranked(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, block string, term int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item int")
    n, total = ix.statistics(d)
    sizes = {c: kw.pop(c) for c in ("block_docs", "block_bytes") if c in kw}
    return sorted(map(tuple, ix.search(ix.build(d, n, total, **sizes), q, n, **kw).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"block_docs": 7, "chunk_items": 2, "batch_items": 1}, {"block_bytes": 300, "k": 3}, {"block_docs": 100, "batch_items": 3, "k": 1}])
def test_against_dictionaries(spark, how):
    docs = list(enumerate(corpus(1, 400)))
    items = list(enumerate([*corpus(2, 12), "the the the the the w1 w1", "nowhere", "", None]))
    got = ranked(spark, docs, items, **how)
    assert got == sorted(plain(docs, items, how.get("k", 20)), key=str)
    assert len({r[0] for r in got}) >= 8


def test_odd_rows(spark):
    texts = corpus(3, 150)
    docs = [(i % 5 if i % 3 else None, t) for i, t in enumerate(texts)] + [(9, None), (9, ""), (9, "-- ,"), (10, "w3 " * 50_000), *[(11, "w7 w8")] * 300]
    items = [(1, "w7 the"), (1, "w7 the"), (None, "w3 é"), (2, "ß 日本"), (3, "w7 w8")]
    got = ranked(spark, docs, items, block_docs=64)
    assert Counter(got) == Counter(plain(docs, items))
    assert sum(r[0] == 3 and r[2] == 11 for r in got) > 1


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None)], items) == []
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    # ln(4 / 3) of one document
    assert [tuple(r) for r in ix.rank(d, q).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 12 * 100)))]


def test_slices_round_trip_and_carry():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 200, 64, 3])
    docs = [np.sort(rng.choice(500, n, replace=False)).astype("<u2") for n in sizes]
    values = rng.integers(0, 10**6 + 1, sizes.sum())
    data, at = ix.pack_slices(values, sizes)
    index = ix.Slices([d.tobytes() for d in docs], [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])])
    weights = np.array([1, 23_456, 7, 0])
    index.times(weights)
    sums = np.zeros((50, 8), np.uint64)
    for t in range(4):
        lo, hi = index.bounds[t : t + 2]
        for shift in (0, 2):
            ix.add(sums, index.at[lo:hi], index.planes[:, lo:hi], shift)
    want = np.zeros(512, np.int64)
    for d, w, v in zip(docs, weights, np.split(values, np.cumsum(sizes)[:-1])):
        want[d] += 5 * w * v
    got = sum(np.unpackbits(p.view(np.uint8), bitorder="little").astype(np.int64) << b for b, p in enumerate(sums))
    assert (got == want).all() and want.max() > 10**10


@pytest.mark.parametrize("k", [1, 5, 64, 400])
def test_best_takes_the_first_of_equal_numbers(k):
    rng = np.random.default_rng(k)
    numbers = rng.choice([0, 0, 1, 2, 3, 1000, 1001], (6, 320))
    numbers[0] = 0
    numbers[1] = 7
    sums = np.stack([np.packbits((numbers >> b) & 1, axis=1, bitorder="little").view(np.uint64) for b in range(10)])
    item, doc = ix.best(sums, k)
    for i in range(6):
        want = [d for d in np.argsort(-numbers[i], kind="stable")[:k] if numbers[i][d]]
        assert sorted(doc[item == i]) == sorted(want)
