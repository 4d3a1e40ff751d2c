import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barloom.llm import katz


def corpus(n=160, hot=False):
    rng = random.Random(4)
    vocabulary = ["the", "Of", "é", *("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(120))]
    weights = [60 if hot else 10, 8, 6, *(1 / (k + 1) for k in range(120))]
    rows = [(i, rng.choice([" ", "\n "]).join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, " \t"), (5, rows[5][1]), (n + 2, "the " * 3000), (n + 3, "unseen words Here")]


def good_turing(counts):
    n = Counter(counts)
    rest = 6 * n[6] / n[1] if n[1] else 1
    out = {}
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return lambda r: r * out.get(r, 1.0)


class Plain:
    """The model in dictionaries."""

    def __init__(self, texts):
        self.one, two = Counter(), defaultdict(Counter)
        for words in texts:
            for a, b in zip([None, *words], [*words, "\n"]):
                self.one[b] += 1
                two[a][b] += 1
        self.n, self.two = sum(self.one.values()), two
        d1, self.d2 = good_turing(self.one.values()), good_turing([c for x in two.values() for c in x.values()])
        left = self.n - sum(map(d1, self.one.values()))
        total, left = (self.n, left) if left > 1e-12 else (self.n + 1, 1)
        self.chance, self.unknown = {w: d1(c) / total for w, c in self.one.items()}, left / total
        self.weight, self.total = {}, {}
        for a, x in two.items():
            c = sum(x.values())
            left = c - sum(map(self.d2, x.values()))
            c, left = (c, left) if left > 1e-12 else (c + 1, 1)
            self.total[a], self.weight[a] = c, left / c / (1 - sum(self.chance[w] for w in x))

    def p(self, a, b):
        if self.two.get(a, {}).get(b):
            return self.d2(self.two[a][b]) / self.total[a]
        return self.weight.get(a, 1.0) * self.chance.get(b, self.unknown)


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in text.encode().split()]


@pytest.mark.parametrize(("size", "hot"), [(1 << 30, False), (1500, False), (2500, True)])
def test_against_dictionaries(spark, size, hot):
    rows = corpus(hot=hot)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    model = Plain([words_of(t) for i, t in rows if not held(i)])
    texts = dict(rows)
    got = katz.score(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int"), size).collect()
    assert len(got) == len(rows)
    for r in got:
        words = words_of(texts[r.doc_id])
        tokens = [*words, "\n"]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(tokens), model.n)
        assert r.n_known == sum(w in model.one for w in tokens)
        base = sum(math.log10((model.one[w] + 0.1) / (model.n + 0.1 * (len(model.one) + 1))) for w in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(model.p(a, b)) for a, b in zip([None, *words], tokens)), rel_tol=1e-9, abs_tol=1e-12)


def test_plain_model_sums_to_one():
    model = Plain([words_of(t) for _, t in corpus()])
    for a in [*model.two, "not a context"]:
        assert math.isclose(sum(model.p(a, w) for w in [*model.one, "unknown"]), 1, rel_tol=1e-9)


def test_discounts_fall_back():
    assert np.allclose(katz.discounts(np.zeros(6))[1:], [(r - 0.5) / r for r in range(1, 6)])


def test_empty_tables_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert katz.score(spark.createDataFrame([], schema)).count() == 0
    got = katz.score(spark.createDataFrame([(None, "a b"), (None, None)], schema)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3] and not any(r.held_out for r in got)
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert [r.score for r in katz.score(spark.createDataFrame([(only_held, "a b")], schema)).collect()] == [0.0]
