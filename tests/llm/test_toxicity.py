import random
import zlib

import numpy as np
import pyarrow as pa

from barloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = toxicity.op1(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    checked = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in checked]) > 0.9


def labelled(n=200):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(rng.randint(1, 200))) for _ in range(n)]
    toxic = np.arange(n) % 2
    return [t + f", Vile{rng.choice('xyz')}! " + t if y else t for t, y in zip(texts, toxic)], toxic


def test_scores_do_not_depend_on_batching_and_handle_odd_texts():
    texts, toxic = labelled()
    model = toxicity.fit(texts, toxic, ["en"] * 100 + ["fr"] * 100)
    assert set(model.thresholds) <= {"en", "fr"}
    odd = [None, "", " \n", "!!! ...", "x" * 100_000, "vilez " + "word " * 60_000, *texts]
    together = model.scores(pa.array(odd))
    alone = np.array([model.scores(pa.array([t], pa.string()))[0] for t in odd])
    assert np.allclose(together, alone, atol=1e-5)
    assert np.isfinite(together).all() and together[0] == together[1] == together[2]
    assert ((model.scores(pa.array(texts)) >= 0.5) == toxic).mean() > 0.97


def test_pool_against_plain_loops():
    texts, toxic = labelled(12)
    model = toxicity.fit(texts * 3, np.tile(toxic, 3), [None] * 36)
    features = toxicity.Features(pa.array(texts))
    pooled = model.pool(features.ids, features.firsts, features.lasts)
    for d, (a, b) in enumerate(zip(features.firsts, features.lasts)):
        vectors = model.embeddings[features.ids[a : b + 2]].sum(1)
        for i, w in enumerate(toxicity.WIDTHS):
            part = slice(i * toxicity.FILTERS, (i + 1) * toxicity.FILTERS)
            values = [np.concatenate(vectors[r : r + w]) @ model.filters[i] + model.biases[part] for r in range(b - a)]
            assert np.allclose(pooled[d, part], np.maximum(np.max(values, 0), 0), atol=1e-4)


def test_one_class_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en", 5), (2, None, None, 5), (2, None, None, 5)], "doc_id long, text string, lang string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)] + [(1, None)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.0] * 3
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, one)).collect()} <= {0.0, 1.0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0
    assert toxicity.keep_clean(docs, none).columns == docs.columns
    assert toxicity.keep_clean(docs, none).count() == 3


def test_thresholds_come_from_rows_that_training_never_saw(monkeypatch):
    texts, toxic = labelled(100)
    seen = []
    start = toxicity._start
    monkeypatch.setattr(toxicity, "_start", lambda features, labels, rows, rng: seen.append(rows) or start(features, labels, rows, rng))
    toxicity.fit(texts, toxic, [None] * 100)
    assert not set(seen[0].tolist()) & {k for k in range(100) if k % 5 == 4}


def test_gradients_against_finite_differences():
    texts, toxic = labelled(30)
    features = toxicity.Features(pa.array(texts))
    rows = np.arange(30)
    model = toxicity._start(features, toxic, rows, np.random.default_rng(0))

    def loss(m, bias=0.0):
        logit = (m.pool(*features.take(rows)).astype(np.float64) @ m.weights.astype(np.float64)) + bias
        return np.mean(np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - logit * toxic)

    grads, touched, sums = toxicity.gradients(model, features, rows, toxic, np.float32(0))
    def check(array, at, grad, step=1e-3):
        kept = array[at]
        array[at] = kept + step
        up = loss(model)
        array[at] = kept - step
        down = loss(model)
        array[at] = kept
        assert abs((up - down) / (2 * step) - grad) < 2e-3 + 0.05 * abs(grad)

    rng = np.random.default_rng(1)
    for k, f in enumerate(model.filters):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in f.shape)
            check(f, at, grads[1 + k][at])
    for j in rng.integers(0, len(model.weights), 5):
        check(model.weights, j, grads[-2][j])
    for j in rng.integers(0, len(touched), 8):
        if touched[j] != toxicity.BUCKETS:
            check(model.embeddings, (touched[j], 3), sums[j, 3])


def test_training_adds_to_the_starting_weights(monkeypatch):
    """Toxic is here what has two harmless words next to each other, which no single word shows."""
    rng = random.Random(5)
    words = ["".join(rng.choices("ghijk", k=6)) for _ in range(60)]
    texts, toxic = [], np.arange(600) % 2
    for y in toxic:
        t = [rng.choice(words) for _ in range(20)]
        at = rng.randrange(15)
        t[at : at + 2] = ["blue", "stone"] if y else ["stone", "blue"]
        texts.append(" ".join(t))
    right = lambda m: ((m.scores(pa.array(texts)) >= 0.5) == toxic).mean()
    trained = right(toxicity.fit(texts, toxic, [None] * 600))
    monkeypatch.setattr(toxicity, "STEPS", 0)
    assert trained > right(toxicity.fit(texts, toxic, [None] * 600)) + 0.2


def test_filter_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", "en", "x", "y", "z"), (None, None, None, "x", "y", "z")], "doc_id long, text string, lang string, _id string, _key string, `a.b` string")
    got = toxicity.keep_clean(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert got.columns == docs.columns and got.count() == 2


def test_every_labelled_row_takes_part_in_shards(spark, monkeypatch):
    texts, toxic = labelled(300)
    monkeypatch.setattr(toxicity, "STEPS", 40)
    # what only the row of the largest id shows counts too
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, "unseen " * 3])], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate([*toxic, 1])], "doc_id long, toxic int")
    rows = toxicity.examples(docs, labels).collect()
    assert {r.doc_id for r in rows} == {i for i in range(301) if zlib.crc32(str(i).encode()) % 5}
    assert sorted(map(str, toxicity.examples(docs, labels, 10).collect())) == sorted(map(str, rows))
    one, two = (toxicity.train(d, labels, shard_rows=60) for d in (docs, docs.repartition(5)))
    assert np.array_equal(toxicity._flat(one), toxicity._flat(two)) and one.shift == two.shift and one.thresholds == two.thresholds
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert ((one.scores(pa.array([texts[i] for i in out])) >= 0.5) == toxic[out]).mean() > 0.95


def test_best_cuts_against_one_array(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(np.round(rng.normal(y), 2)), y) for g, n in (("a", 200), ("b", 30), ("c", 1)) for y in rng.integers(0, 2, n).tolist()]
    got = {r.name: (r.n, r.toxic, r.cut) for r in toxicity.best_cuts(spark.createDataFrame(rows, "name string, value double, label int")).collect()}
    for g in ("a", "b", "c"):
        values, label = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        assert got[g] == (len(label), label.sum(), toxicity.best_cut(values, label)), g
