import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import resemblance

from .test_simhash import reach


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def planted(rng):
    """Texts with copies at many similarities, boilerplate that all share, and a crowd of copies of one text."""
    word = lambda: "w" + str(rng.randrange(3000))
    line = " ".join(word() for _ in range(25))
    texts = [None, "", " \n", "one", "One", "two words", "two  WORDS"]
    for k in range(60):
        words = [word() for _ in range(rng.choice([6, 12, 40, 120, 300]))]
        texts.append(" ".join(words) + (f" {line}" if k % 3 else ""))
        for _ in range(rng.choice([1, 2, 3]) if k else 60):
            new = list(words)
            for at in rng.sample(range(len(new)), rng.randrange(0, max(1, len(new) // 30) + 1)):
                new[at] = word()
            texts.append(" ".join(new) + (f" {line}" if k % 3 else ""))
    return texts


@pytest.mark.parametrize(("sample", "frequent", "crowd"), [(10_000, 4, 100), (0, 10**9, 100), (0, 10**9, 1)])
def test_stage_keeps_one_of_every_similar_group(spark, monkeypatch, sample, frequent, crowd):
    monkeypatch.setattr(resemblance, "CROWD_BLOCK", 20)
    if crowd == 1:
        # components in parts, homes of few, and no list sent to all
        for name, value in (("PART_NODES", 7), ("HOME_NODES", 10), ("SENT_NODES", 0)):
            monkeypatch.setattr(resemblance, name, value)
    texts = dict(enumerate(planted(random.Random(3)), 5))
    sets = {i: plain_set(t) for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    near = [p for p in pairs if sets[p[0]] != sets[p[1]]]
    assert sum(1 for a, b in near if 0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.9) > 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    low = reach(sets, pairs)
    assert sorted(r.doc_id for r in resemblance.keep_one(docs, sample, frequent, crowd).collect()) == sorted(set(low.values()))


def test_stage_drops_planted_pairs(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = ["v" + str(rng.randrange(10**6)) for _ in range(204)]
        cut = 1 + k % 22
        # cut changed words at the end: similarities from 0.8 to 0.99
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-cut] + ["x" + str(rng.randrange(10**6)) for _ in range(cut)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {2 * k for k in range(40)}


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (2, "A b"), (2, "A b")], "doc_id long, text string")
    assert sorted(map(str, [r.doc_id for r in resemblance.keep_one(docs).collect()])) == ["1", "None", "None"]
    assert resemblance.keep_one(docs.filter(F.lit(False))).count() == 0


def test_sample_grows_with_the_table(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("v" + str(rng.randrange(10**6)) for _ in range(n))
    line = words(20)
    docs = spark.createDataFrame([(i, words(8) + (" " + line if i % 10 == 0 else "")) for i in range(3200)], "doc_id long, text string")
    # of a line in 320 documents a sample of 10 rows would see one
    found = resemblance._frequent(docs, 10, 4)
    assert set(resemblance.shingle_set(line).tolist()) <= set(found.tolist()) and len(found) < 40


@pytest.mark.parametrize("rectangle", [1, 9, 4096])
@pytest.mark.parametrize("same", [True, False])
def test_shared_tokens_of_a_crowd(monkeypatch, rectangle, same):
    monkeypatch.setattr(resemblance, "RECTANGLE", rectangle)
    monkeypatch.setattr(resemblance, "LISTED", 50)
    rng = random.Random(rectangle)
    made = lambda n: [sorted(rng.sample(range(60), rng.randrange(12))) for _ in range(n)]
    a = made(30)
    b = a if same else made(23)
    column = lambda x: pa.chunked_array([pa.array(x[:10], pa.list_(pa.int64())), pa.array(x[10:], pa.list_(pa.int64()))])
    shared, earlier = resemblance._shared([column(a), column(b)], 30, same)
    other = ~np.eye(30, dtype=bool) if same else np.ones((30, 23), bool)
    both = [[set(x) & set(y) for y in b] for x in a]
    assert (shared == [[len(z) for z in row] for row in both])[other].all()
    assert (earlier == [[any(t < 30 for t in z) for z in row] for row in both])[other].all()
