"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hashed features: the word (lower case A-Z, ASCII punctuation
at its ends removed) and its first 4, 5 and 6 bytes, so that unseen forms of a seen stem are recognised. Filters of
widths 1, 2 and 3 run over the word vectors; each is max-pooled over the whole text, and a logistic layer turns the pooled values
into a logit. Training is mini-batch Adam through the positions of the maxima. The embeddings' first coordinate starts as the
bounded deviation of a feature's count in toxic texts from what is expected, the rest at random.

Thresholds: on a part of the labelled rows that took no part in the gradient steps the logit at which decisions are most often right is
found, overall and by language. Scores are shifted so that the overall threshold is 0.5; `threshold` is the language's own (the overall
one where a language has too few rows), and `toxic` the decision by it. Label, language, source and doc_id are no inputs of a score.

Defined results: null, blank and empty texts get the score of a text without words; repeated rows each give a row; an empty table
gives an empty table; without labelled rows of both classes every score is the share of toxic labels (0 if there are none); null labels are not used,
and of several labels of one document the highest counts; other columns are not read.

Scale: every labelled row that is not held out takes part. They are dealt by a hash of doc_id into shards of about SHARD rows, one task each, and the counts that the embeddings
start from are summed over all. In each of ROUNDS rounds every shard takes its part of STEPS gradient steps from the same arrays, and the changes of all shards are averaged by Spark, bucket by bucket, in
fixed point, so that their order doesn't matter. Thresholds are exact over all rows that set them, from running counts in two levels. The driver sees arrays of fixed size (about 9 MB) only, and one row a language. Scoring
is one map over the whole texts, in tiles of bounded size, with the fitted arrays broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.blocks import previous, runnings

from .arrays import Words
from .storage import materialize, scope

#: Labelled rows of a shard, about (a fifth of them sets the thresholds), and how often the shards' arrays are averaged.
SHARD = 5000
ROUNDS = 2
#: Rows of labels up to which their ids are sent to all tasks; beyond, texts are shuffled to them.
MOST_SENT = 2_000_000
BUCKETS = 1 << 17
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
#: Gradient steps, and rows in each.
STEPS = 256
BATCH = 64
RATE = 0.01
#: Share of the rate at which embeddings move.
SLOW = 0.1
#: Rows of a language that are needed for a threshold of its own.
LEAST_ROWS = 40
_PAD = 2 * (max(WIDTHS) - 1)
_TILE = 1 << 13
#: Rows that are scored together.
_ROWS = 1024
_SEED = 7
#: Changes of arrays are summed as multiples of 1 / _UNIT.
_UNIT = 1 << 24
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


class Features:
    """The hashed features of a batch of texts as rows of a matrix, each text followed by _PAD rows of no words.

    A text's own rows are its words and the first half of the padding: what a filter sees from them is only its own text.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        words = Words(texts, lower=True)
        starts, ends = words.starts.copy(), words.ends.copy()
        for _ in range(3):
            starts += _PUNCTUATION[words.data[starts]] & (starts < ends - 1) if len(words) else 0
            ends -= _PUNCTUATION[words.data[ends - 1]] & (starts < ends - 1) if len(words) else 0
        words.starts, words.ends = starts, ends
        head = lambda n: lambda s, e: (s, np.minimum(s + n, e))
        kinds = words.hashes(lambda s, e: (s, e), head(4), head(5), head(6))
        docs = len(words.bounds) - 1
        self.firsts = words.bounds[:-1] + _PAD * np.arange(docs)
        self.lasts = words.bounds[1:] + _PAD * np.arange(docs) + _PAD // 2
        row = np.arange(len(words)) + _PAD * np.repeat(np.arange(docs), words.counts)
        # the last bucket is that of padding, whose embedding is zero
        self.ids = np.full((len(words) + _PAD * docs + _PAD, len(kinds)), BUCKETS, np.int32)
        for k, x in enumerate(kinds):
            self.ids[row, k] = (x + np.uint64(k * 0x9E3779B9)) % np.uint64(BUCKETS)

    def take(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, firsts and lasts of some texts."""
        lengths = self.lasts[docs] - self.firsts[docs] + _PAD // 2
        ends = np.cumsum(lengths)
        rows = np.concatenate([np.arange(self.firsts[d], self.firsts[d] + n) for d, n in zip(docs, lengths)])
        ids = np.concatenate([self.ids[rows], np.full((_PAD, self.ids.shape[1]), BUCKETS, np.int32)])
        return ids, ends - lengths, ends - _PAD // 2


@dataclass
class Model:
    embeddings: np.ndarray
    #: For each width, (width * SIZE, FILTERS).
    filters: list[np.ndarray]
    biases: np.ndarray
    weights: np.ndarray
    intercept: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def pool(self, ids: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, where: bool = False):
        """Largest value of every filter in every text; with where, also the row that has it."""
        docs, wide = len(firsts), max(WIDTHS)
        out = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32)
        at = np.zeros(out.shape, np.int64) if where else None
        # every tap of every filter in one product
        taps = np.concatenate([f[k * SIZE : (k + 1) * SIZE] for w, f in zip(WIDTHS, self.filters) for k in range(w)], axis=1)
        edges = np.stack([firsts, lasts], 1).reshape(-1)
        end = int(lasts[-1]) if docs else 0
        for a in range(0, end, _TILE):
            b = min(a + _TILE, end)
            vectors = self.embeddings[ids[a : b + wide - 1]].sum(1)
            product, seen, column = vectors @ taps, np.empty((b - a, out.shape[1]), np.float32), 0
            for i, w in enumerate(WIDTHS):
                part = seen[:, i * FILTERS : (i + 1) * FILTERS]
                part[:] = self.biases[i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    part += product[k : k + b - a, column : column + FILTERS]
                    column += FILTERS
            # pieces between edges; every other one lies in a text
            k0, k1 = np.searchsorted(edges, a, "right"), np.searchsorted(edges, b, "left")
            cuts, piece = np.concatenate([[a], edges[k0:k1]]), np.arange(k0 - 1, k1)
            full = np.diff(np.concatenate([cuts, [b]])) > 0
            cuts, piece = cuts[full], piece[full]
            if not len(cuts):
                continue
            best = np.maximum.reduceat(seen, cuts - a, axis=0)
            for j in np.flatnonzero(piece % 2 == 0):
                d = piece[j] // 2
                if where:
                    stop = cuts[j + 1] if j + 1 < len(cuts) else b
                    spot = seen[cuts[j] - a : stop - a].argmax(0)
                    more = best[j] > out[d]
                    at[d][more] = cuts[j] + spot[more]
                np.maximum(out[d], best[j], out=out[d])
        return (out, at) if where else out

    def logits(self, features: Features) -> np.ndarray:
        return self.pool(features.ids, features.firsts, features.lasts) @ self.weights + self.intercept - self.shift

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(Features(texts)).astype(np.float64), -30, 30)))


def _counts(features: Features, toxic: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """In how many of texts, by label, each bucket has a feature of each kind."""
    counts = np.zeros((2, BUCKETS + 1))
    if not len(texts):
        return counts
    own = np.repeat(texts, features.lasts[texts] - features.firsts[texts])
    rows = np.concatenate([np.arange(features.firsts[d], features.lasts[d]) for d in texts])
    for k in range(features.ids.shape[1]):
        # in how many texts, not how often
        pairs = np.unique(own * (BUCKETS + 1) + features.ids[rows, k])
        np.add.at(counts, (toxic[pairs // (BUCKETS + 1)], pairs % (BUCKETS + 1)), 1)
    return counts


def _start(features: Features, toxic: np.ndarray, texts: np.ndarray, rng: np.random.Generator) -> Model:
    """The untrained model of texts."""
    return _untrained(_counts(features, toxic, texts), toxic[texts].mean(), rng)


def _untrained(counts: np.ndarray, share: float, rng: np.random.Generator) -> Model:
    """The untrained model; how far each feature's count in toxic texts, whose share is given, is from the expected is its first coordinate."""
    expected = counts.sum(0) * share
    deviation = (counts[1] - expected) / np.sqrt(expected + 1)
    embeddings = rng.normal(0, 0.05, (BUCKETS + 1, SIZE)).astype(np.float32)
    embeddings[:, 0] = np.tanh(deviation / 6)
    embeddings[BUCKETS] = 0
    filters = [rng.normal(0, 0.1, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, :4] = 1
    width = len(WIDTHS) * FILTERS
    return Model(embeddings, filters, np.zeros(width, np.float32), rng.normal(0, 0.1, width).astype(np.float32), 0.0)


def gradients(model: Model, features: Features, batch: np.ndarray, toxic: np.ndarray, intercept: np.float32) -> tuple[list, np.ndarray, np.ndarray]:
    """Gradients of the mean log loss of a batch: of filters, biases, weights and intercept (the first place is the embeddings'), and those of the buckets touched."""
    ids, firsts, lasts = features.take(batch)
    pooled, at = model.pool(ids, firsts, lasts, where=True)
    logit = pooled @ model.weights + intercept
    error = ((1 / (1 + np.exp(-logit)) - toxic[batch]) / len(batch)).astype(np.float32)
    # only the rows of the maxima, where the maximum is over zero, take part
    flow = error[:, None] * model.weights * (pooled > 0)
    grads = [None, *(np.zeros_like(f) for f in model.filters), flow.sum(0), error @ pooled, np.array([error.sum()], np.float32)]
    touched, moved = [], []
    for i, w in enumerate(WIDTHS):
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        for k in range(w):
            seen = ids[at[:, part] + k]
            grads[1 + i][k * SIZE : (k + 1) * SIZE] = np.einsum("dfs,df->sf", model.embeddings[seen].sum(2), flow[:, part])
            back = flow[:, part, None] * model.filters[i][k * SIZE : (k + 1) * SIZE].T[None]
            touched.append(seen.reshape(-1))
            moved.append(np.repeat(back.reshape(-1, SIZE), seen.shape[2], axis=0))
    buckets, place = np.unique(np.concatenate(touched), return_inverse=True)
    sums = np.zeros((len(buckets), SIZE), np.float32)
    np.add.at(sums, place, np.concatenate(moved))
    sums[buckets == BUCKETS] = 0
    return grads, buckets, sums


def _train(model: Model, features: Features, toxic: np.ndarray, rows: np.ndarray, rng: np.random.Generator, steps: int) -> Model:
    """model after some gradient steps, its arrays changed in place."""
    shapes = [model.embeddings, *model.filters, model.biases, model.weights, np.array([model.intercept], np.float32)]
    first, second = [np.zeros_like(x) for x in shapes], [np.zeros_like(x) for x in shapes]
    step = 0
    while step < steps:
        order = rng.permutation(rows)
        for a in range(0, len(order), BATCH):
            step += 1
            grads, buckets, sums = gradients(model, features, order[a : a + BATCH], toxic, shapes[-1][0])
            for k, (x, m, v) in enumerate(zip(shapes, first, second)):
                here, g = (buckets, sums) if k == 0 else (slice(None), grads[k])
                m[here] = 0.9 * m[here] + 0.1 * g
                v[here] = 0.999 * v[here] + 0.001 * g * g
                x[here] -= (RATE * SLOW if k == 0 else RATE) * (m[here] / (1 - 0.9**step)) / (np.sqrt(v[here] / (1 - 0.999**step)) + 1e-7)
    model.intercept = float(shapes[-1][0])
    return model


def best_cut(values: np.ndarray, toxic: np.ndarray) -> float:
    """The cut at which decisions are most often right; of equally good ones the middle of the widest gap."""
    order = np.argsort(values, kind="stable")
    ranked, label = values[order], toxic[order]
    right = np.concatenate([[0], np.cumsum(1 - label)]) + label.sum() - np.concatenate([[0], np.cumsum(label)])
    padded = np.concatenate([[ranked[0] - 1], ranked, [ranked[-1] + 1]])
    gap = np.diff(padded)
    right[gap <= 0] = -1
    good = np.flatnonzero(right == right.max())
    k = good[np.argmax(gap[good])]
    return float((padded[k] + padded[k + 1]) / 2)


def fit(texts: list[str | None], toxic: np.ndarray, langs: list[str | None]) -> Model:
    """Fit the classifier and its thresholds; every fifth row, as given, sets thresholds only."""
    toxic = np.asarray(toxic, np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros((0, 0)), [], np.zeros(0), np.zeros(0), 0.0, constant=float(toxic.mean()) if len(toxic) else 0.0)
    rng = np.random.default_rng(_SEED)
    features = Features(pa.array(texts, pa.string()))
    held = np.arange(len(toxic)) % 5 == 4
    if len(set(toxic[held].tolist())) < 2:
        held[:] = True
    rows = np.flatnonzero(~held) if not held.all() else np.arange(len(toxic))
    model = _train(_start(features, toxic, rows, rng), features, toxic, rows, rng, STEPS)
    logits, names = model.logits(features).astype(np.float64), np.array([str(x) for x in langs], object)
    model.shift = best_cut(logits[held], toxic[held])
    for lang in sorted(set(names[held])):
        own = held & (names == lang)
        if own.sum() >= LEAST_ROWS and len(set(toxic[own].tolist())) == 2:
            model.thresholds[lang] = float(1 / (1 + np.exp(model.shift - best_cut(logits[own], toxic[own]))))
    return model


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def examples(docs: DataFrame, labels: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """doc_id, text, lang, label and sets (whether it sets thresholds) of every labelled document that is not held out; of several rows of one the smallest."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out())
    marked = marked.withColumnRenamed("doc_id", "_id")
    # so few ids go to all tasks, so that texts without labels are not moved
    if labels.limit(most_sent + 1).count() <= most_sent:
        marked = F.broadcast(marked)
    found = docs.select("doc_id", "text", "lang").join(marked, F.col("doc_id") == F.col("_id"))
    rows = found.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row"), F.min("label").alias("label"))
    return rows.select("doc_id", "row.text", F.coalesce("row.lang", F.lit("None")).alias("lang"), "label", (F.pmod(F.xxhash64("doc_id", F.lit(_SEED)), F.lit(5)) == 4).alias("sets"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS + 1))
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            part = batch.slice(a, _ROWS)
            counts += _counts(Features(part.column("text")), part.column("label").to_numpy().astype(np.int64), np.arange(part.num_rows))
    held = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (held, counts[0, held], counts[1, held])], names=["bucket", "clean", "toxic"])


def _flat(model: Model) -> np.ndarray:
    """All arrays of a model in rows of SIZE numbers, its embeddings first."""
    rest = np.concatenate([*(f.reshape(-1) for f in model.filters), model.biases, model.weights, [model.intercept]]).astype(np.float32)
    return np.concatenate([model.embeddings, np.pad(rest, (0, -len(rest) % SIZE)).reshape(-1, SIZE)])


def _unflat(rows: np.ndarray) -> Model:
    rest = rows[BUCKETS + 1 :].reshape(-1)
    cuts = np.cumsum([w * SIZE * FILTERS for w in WIDTHS] + [len(WIDTHS) * FILTERS] * 2)
    *filters, biases, weights, last = np.split(rest.copy(), cuts)
    return Model(rows[: BUCKETS + 1].copy(), [f.reshape(-1, FILTERS) for f in filters], biases, weights, float(last[0]))


_CHANGES = [f"v{i}" for i in range(SIZE)]


def _averaged(rows: DataFrame, model: Model, steps: int, turn: int) -> Model:
    """The model after some steps in every shard of rows (doc_id, text, label, shard), its arrays the means over the shards."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        before = _flat(shared.value)
        # a second round goes through the rows in another order
        rng = np.random.default_rng([_SEED, turn])
        toxic = table.column("label").to_numpy().astype(np.int64)
        made = _train(_unflat(before), Features(table.column("text")), toxic, np.arange(len(toxic)), rng, steps)
        change = np.rint((_flat(made) - before).astype(np.float64) * _UNIT).astype(np.int64)
        moved = np.flatnonzero(change.any(1))
        # one row more, which counts the shard
        columns = [np.append(moved, len(change)), *(np.append(change[moved, i], 1) for i in range(SIZE))]
        return pa.table([pa.array(c) for c in columns], names=["slot", *_CHANGES])

    changes = rows.groupBy("shard").applyInArrow(work, ", ".join(f"{c} long" for c in ["slot", *_CHANGES]))
    sums = changes.groupBy(F.col("slot").cast("int").alias("slot")).agg(*[(F.sum(c) / _UNIT).cast("float").alias(c) for c in _CHANGES]).toArrow()
    shared.destroy()
    flat = _flat(model)
    slot = sums.column("slot").to_numpy()
    held = slot < len(flat)
    for i, c in enumerate(_CHANGES):
        total = sums.column(c).to_numpy()
        flat[slot[held], i] += total[held] / np.rint(total[~held][0] * _UNIT).astype(np.float32)
    return _unflat(flat)


def best_cuts(rows: DataFrame) -> DataFrame:
    """best_cut() of every group: name, n, toxic (rows with label 1) and cut, from rows of name, value and label."""
    sums = rows.groupBy("name").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"), F.max("value").alias("_top"))
    per = rows.groupBy("name", "value").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
    bucket = F.floor(F.col("value") * 16)
    per = previous(per, "before", F.col("value"), "name", bucket, "value")
    per = runnings(per, {"_ones": (F.col("ones"), "sum"), "_zeros": (F.col("zeros"), "sum")}, "name", bucket, "value")
    per = per.join(sums.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"))
    # a cut before each value, and one after the last
    low = F.coalesce(F.col("before"), F.col("value") - 1)
    cut = lambda zeros, ones, a, b: F.struct((zeros + F.col("toxic") - ones).alias("right"), (b - a).alias("gap"), (-(a + b) / 2).alias("down"))
    first = cut(F.col("_zeros") - F.col("zeros"), F.col("_ones") - F.col("ones"), low, F.col("value"))
    last = F.when(F.col("value") == F.col("_top"), cut(F.col("_zeros"), F.col("_ones"), F.col("value"), F.col("value") + 1))
    return per.groupBy("name", "n", "toxic").agg(F.max(F.greatest(first, last)).alias("best")).select("name", "n", "toxic", (-F.col("best.down")).alias("cut"))


def train(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD, rounds: int = ROUNDS) -> Model:
    """The classifier and its thresholds, fitted on all examples()."""
    spark = docs.sparkSession
    with scope(spark):
        rows = materialize(examples(docs, labels))
        sizes = {(r["sets"], r["label"]): r["n"] for r in rows.groupBy("sets", "label").agg(F.count("*").alias("n")).collect()}
        n = sum(sizes.values())
        if len({label for _, label in sizes}) < 2:
            return fit([], np.array([label for _, label in sizes][:1], np.int64), [])
        if {label for sets, label in sizes if sets} == {0, 1}:
            taught, judged = rows.filter("not sets"), rows.filter("sets")
            sizes = {k: m for k, m in sizes.items() if not k[0]}
        else:
            taught = judged = rows
        texts = sum(sizes.values())
        if not texts:
            taught, texts = rows, n
        counts = np.zeros((2, BUCKETS + 1))
        found = taught.select("text", "label").mapInArrow(_counted, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
        for k, c in enumerate(("clean", "toxic")):
            counts[k, found.column("bucket").to_numpy()] = found.column(c).to_numpy()
        model = _untrained(counts, sum(m for (_, label), m in sizes.items() if label) / texts, np.random.default_rng(_SEED))
        shards = -(-n // shard_rows)
        dealt = taught.select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))
        for turn in range(rounds):
            model = _averaged(dealt, model, STEPS // rounds, turn)
        logits = materialize(score_logits(judged, model))
        overall = logits.withColumn("name", F.lit(""))
        model.shift = best_cuts(overall).first()["cut"]
        for r in best_cuts(logits).filter(F.col("n") >= LEAST_ROWS).filter("toxic > 0 and toxic < n").orderBy("name").collect():
            model.thresholds[r["name"]] = float(1 / (1 + np.exp(model.shift - r["cut"])))
        return model


def score_logits(rows: DataFrame, model: Model) -> DataFrame:
    """name (lang), value (the logit of the text) and label of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                values = shared.value.logits(Features(part.column("text"))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(values), part.column("label")], names=["name", "value", "label"])

    return rows.select("text", "lang", "label").mapInArrow(run, "name string, value double, label int")


def _judged(fitted: Model, texts: pa.Array, langs: list) -> tuple[np.ndarray, np.ndarray]:
    """Scores of some texts, and the thresholds of their languages."""
    return fitted.scores(texts), np.array([fitted.thresholds.get(str(x), 0.5) for x in langs])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, text's score, threshold and toxic (score >= threshold) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                scores, cuts = _judged(shared.value, part.column("text"), part.column("lang").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(cuts), pa.array(scores >= cuts)], names=["doc_id", "score", "threshold", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return rows.mapInArrow(run, "doc_id long, score double, threshold double, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, by the threshold of their language; columns unchanged.

    Rows are judged where they are read, so nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                scores, cuts = _judged(shared.value, part.column(text), part.column(lang).to_pylist())
                yield part.filter(pa.array(scores < cuts)).rename_columns(names)

    # mapInArrow resolves its input's columns by name, which fails for names with dots
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")
