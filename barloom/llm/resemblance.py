"""SimHash near-dedup at a resemblance: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more are linked.

First come the links of operator 5 (simhash), over fingerprints of the five-word shingles: pigeonring chains find the documents within 2 bits, which are nearly all that differ in
a few words. At a similarity of 0.8 fingerprints differ in about 15 % of their bits, more than a chain of segments can prune, so the other candidates come
from the sets themselves and none is missed. All shingles have one order. Two sets of a and b shingles with similarity t share at least
t * max(a, b) of them, so they share one among the first n - ceil(t * n) + 1 of each: its prefix. Let c be the shingles that two prefixes share
and o = ceil(t / (1 + t) * (a + b)) the overlap that the similarity asks for: past the prefix that ends first at most ceil(t * n) - 1
shingles of its set follow, so c + max(ceil(t * a), ceil(t * b)) - 1 >= o. What passes, and what the fingerprints found, is decided by the sets themselves.

The order is by hash, but shingles that are frequent in a sample of the documents come last, so boilerplate is seldom in a prefix. The sample only
changes the cost, never the pairs. It is a share of a large table: what a sample of fixed size finds frequent is in ever more documents as the table grows, and what it misses leads prefixes whose pairs grow with the square. Close groups are linked first, by fingerprints and by few pairs of each shingle (each document with the two before it by size, and the
first); after that only pairs of different components are compared, so a group of near copies is not expanded into all of its pairs as long as those
links hold it together. Tokens of up to CROWD nodes are joined; the nodes of a crowded token are compared in blocks, which return only the pairs that pass the count.

Words are those of simhash (A-Z lower-cased). A shorter text is one shingle. Null and blank texts are one node, as there; an empty table gives an empty table;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .arrays import runs
from .components import components
from .storage import materialize, scope

WORDS = 5
#: The similarity as a fraction, so that no rounding decides.
PART, WHOLE = 4, 5
#: Documents of the sample that orders the shingles, and the least share of the documents, one of so many; a shingle in FREQUENT of them comes last; at most LAST_MOST do, 8 bytes each.
SAMPLE, SHARE, FREQUENT, LAST_MOST = 10_000, 16, 4, 1 << 20
SEED = 43
#: Nodes that share a prefix token beyond which their pairs are counted within tasks, and nodes of a block there.
CROWD, CROWD_BLOCK = 50, 2048
#: Pairs that a crowd's shingle makes from which they are counted as a rectangle, and those of other shingles that are listed at once.
RECTANGLE, LISTED = 1 << 12, 1 << 20
#: Candidates that are compared by one task, and those of a part of a large component.
HOME_NODES, PART_NODES = 2048, 512
#: Candidates, 8 bytes each, up to which their list is sent to all tasks.
SENT_NODES = 1 << 21
#: Links that a task holds at once, 16 bytes each, when it finds components within them.
LINKS_CHUNK = 1 << 19


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles, repeats included."""
    words = (text or "").encode().translate(simhash._NORMAL).split()
    if not words:
        return np.zeros(0, np.int64)
    n = max(1, len(words) - WORDS + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n).view(np.int64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted different hashes of the shingles."""
    return np.unique(shingles(text))


def _need(n: Column) -> Column:
    return F.ceil(n * PART / WHOLE)


def _frequent(docs: DataFrame, sample: int, frequent: int) -> np.ndarray:
    """Shingles of at least frequent documents of a sample."""
    step = max(1, min(docs.count() // max(1, sample), SHARE))
    some = docs.filter(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(step)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                sets = [shingle_set(t.as_py()) for t in batch.column("text")[a : a + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["token"])

    counts = some.mapInArrow(run, "token long").groupBy("token").count().filter(F.col("count") >= frequent)
    return np.sort(counts.orderBy(F.desc("count"), "token").limit(LAST_MOST).select("token").toArrow().column("token").to_numpy())


def _prefixes(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """doc_id, key, node, n (different shingles), fp (fingerprint of all shingles) and prefix of every row; the node of a text without words is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                sizes, prints, taken = [], [], []
                for t in batch.column("text"):
                    every = shingles(t.as_py())
                    prints.append(simhash.majority(simhash.votes(every.view("<u8")), len(every)) if len(every) else 0)
                    found = np.unique(every)
                    n = len(found)
                    sizes.append(n)
                    if len(last) and n:
                        late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
                        found = np.concatenate([found[~late], found[late]])
                    taken.append(found[: n - -(-n * PART // WHOLE) + 1] if n else found)
                key = batch.column("key").to_numpy()
                node = np.where(np.array(sizes) > 0, key, 0)
                offsets = np.cumsum([0, *map(len, taken)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *taken])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(node), pa.array(np.array(sizes, np.int32)), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], names=["doc_id", "key", "node", "n", "fp", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash._key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, node long, n int, fp long, prefix array<long>")


def _enough(pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b, c) that may be similar; c: shingles that their prefixes share."""
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * PART / (PART + WHOLE))
    return pairs.filter(F.col("c") + F.greatest(_need(F.col("n_a")), _need(F.col("n_b"))) - 1 >= overlap).select("a", "b")


def _similar(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """Those of a home's pairs whose texts are similar; each text's shingles are hashed once."""
    sets = {n: shingle_set(t.as_py()) for n, t in zip(texts.column("node").to_pylist(), texts.column("text"))}
    kept = []
    for i, (a, b) in enumerate(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if WHOLE * both >= PART * (len(sets[a]) + len(sets[b]) - both):
            kept.append(i)
    return pairs.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def _homes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where pairs (a, b) are decided: (home, a, b), and (home, node) of the nodes that each home needs.

    Candidates of one component share a home, so a text moves once for all of its pairs. A large component is dealt into parts of about PART_NODES nodes, and its homes are pairs of parts; small ones share homes of about HOME_NODES.
    """
    of = components(pairs, LINKS_CHUNK)
    parts = F.ceil(F.col("m") / PART_NODES).cast("int")
    of = of.join(of.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("m")), F.col("component") == F.col("c"))
    of = materialize(of.select("node", "component", F.pmod(F.xxhash64("node", F.lit(SEED)), parts).alias("part")))
    a, b = (of.select(F.col("node").alias(f"{x}_node"), F.col("component").alias(f"{x}_c"), F.col("part").alias(f"{x}_part")) for x in "ab")
    met = pairs.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
    met = materialize(met.select("a", "b", F.xxhash64("a_c", F.least("a_part", "b_part"), F.greatest("a_part", "b_part")).alias("place")))
    placed = materialize(met.select("place", F.col("a").alias("node")).unionByName(met.select("place", F.col("b").alias("node"))).distinct())
    home = F.pmod("place", F.lit(max(1, -(-placed.count() // HOME_NODES)))).alias("home")
    return met.select(home, "a", "b"), placed.select(home, "node").distinct()


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""
    with scope(docs.sparkSession) as kept:
        met, placed = _homes(materialize(pairs))
        wanted = materialize(placed.select(F.col("node").alias("want")).distinct())
        texts = docs.select(simhash._key().alias("node"), "text")
        # few candidates are sent to all texts, so that other texts do not move; many meet them by a shuffle
        few = wanted.count() <= SENT_NODES
        texts = texts.join(F.broadcast(wanted) if few else wanted, F.col("node") == F.col("want"), "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
        sent = placed.join(texts, "node").select("home", "node", "text")
        kept.append(materialize(met.groupBy("home").cogroup(sent.groupBy("home")).applyInArrow(_similar, "a long, b long")))
    return kept[0]


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * WHOLE >= F.greatest(a, b) * PART


def _fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints pigeonring links: the least node of each fingerprint with the others and with those of linked ones."""
    nodes = materialize(rows.filter("n > 0").select("node", "n", "fp").distinct())
    least = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first"))
    same = nodes.join(least.withColumnRenamed("fp", "l_fp"), (F.col("fp") == F.col("l_fp")) & (F.col("node") != F.col("first.node")) & _sizes_fit(F.col("n"), F.col("first.n")))
    near = materialize(simhash.links(nodes))
    a, b = (least.select(F.col("fp").alias(f"{x}_fp"), F.col("first").alias(f"{x}_first")) for x in "ab")
    linked = near.join(a, F.col("a") == F.col("a_fp")).join(b, F.col("b") == F.col("b_fp")).filter(_sizes_fit(F.col("a_first.n"), F.col("b_first.n")))
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    return same.select(*pair("node", "first.node")).unionByName(linked.select(*pair("a_first.node", "b_first.node")))


def links(rows: DataFrame, docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between nodes of rows (those of _prefixes); their components are those of all similar pairs."""
    nodes = rows.filter("n > 0").dropDuplicates(["node"]).select("node", "n", F.explode("prefix").alias("token"))
    order = Window.partitionBy("token").orderBy("n", "node")
    me = F.struct("node", "n")
    met = nodes.select("token", "node", "n", F.lag(me, 1).over(order).alias("p1"), F.lag(me, 2).over(order).alias("p2"), F.first(me).over(order).alias("p3"), F.lead("node", 1).over(order).alias("next"))
    met = materialize(met.filter(F.col("p1").isNotNull() | F.col("next").isNotNull()).drop("next"))
    few = met.select("node", "n", F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("p")).filter(F.col("p").isNotNull() & (F.col("p.node") != F.col("node")))
    few = few.filter(_sizes_fit(F.col("n"), F.col("p.n"))).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"), F.when(F.col("node") < F.col("p.node"), F.col("n")).otherwise(F.col("p.n")).alias("n_a"), F.when(F.col("node") < F.col("p.node"), F.col("p.n")).otherwise(F.col("n")).alias("n_b"))
    few = _enough(few.groupBy("a", "b").agg(F.any_value("n_a").alias("n_a"), F.any_value("n_b").alias("n_b"), F.count("*").alias("c")))
    close = _verified(_fingerprint_pairs(rows).unionByName(few).distinct(), docs)
    groups = components(close, LINKS_CHUNK).select(F.col("node").alias("g_node"), "component")
    named = met.select("token", "node", "n").join(groups, F.col("node") == F.col("g_node"), "left").select("token", "node", "n", F.coalesce("component", "node").alias("component"))
    named = materialize(named)
    sizes = named.groupBy("token").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    sizes = materialize(sizes.select(F.col("token").alias("o_token"), "m"))
    left = materialize(named.join(sizes.filter(F.col("m") <= crowd), F.col("token") == F.col("o_token"), "left_semi"))
    right = left.select(F.col("token").alias("token_b"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("component_b"))
    rest = left.join(right, (F.col("token") == F.col("token_b")) & (F.col("node") < F.col("b")) & (F.col("component") != F.col("component_b")) & _sizes_fit(F.col("n"), F.col("n_b")))
    rest = _enough(rest.groupBy(F.col("node").alias("a"), "b").agg(F.any_value("n").alias("n_a"), F.any_value("n_b").alias("n_b"), F.count("*").alias("c")))
    dense = _crowd_pairs(named.join(sizes.filter(F.col("m") > crowd), F.col("token") == F.col("o_token")), rows)
    return close.unionByName(_verified(rest.unionByName(dense).distinct(), docs))


def _owners(prefixes: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different tokens of some prefixes, where each one's owners begin, their number, and the owners."""
    lists = prefixes.combine_chunks()
    tokens, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(tokens, kind="stable")
    names, firsts, n = np.unique(tokens[order], return_index=True, return_counts=True)
    return names, firsts, n, at[order]


def _shared(sides: list[pa.ChunkedArray], token: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """By pair of prefixes, one of each side, the tokens that both hold, and whether one of these is smaller than token; same: both sides are the same, and a prefix has no pair with itself."""
    left = _owners(sides[0])
    right = left if same else _owners(sides[1])
    names, x, y = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    if same:
        # a token of one prefix makes no pair
        names, x, y = (k[left[2] > 1] for k in (names, x, y))
    (from_x, n_x, at_x), (from_y, n_y, at_y) = ((firsts[k], n[k], at) for k, (_, firsts, n, at) in ((x, left), (y, right)))
    shared = np.zeros((len(sides[0]), len(sides[1])), np.int32)
    earlier = np.zeros(shared.shape, bool)
    product = n_x * n_y
    for k in np.flatnonzero(product >= RECTANGLE).tolist():
        here = np.ix_(at_x[from_x[k] : from_x[k] + n_x[k]], at_y[from_y[k] : from_y[k] + n_y[k]])
        shared[here] += 1
        if names[k] < token:
            earlier[here] = True
    few = np.flatnonzero(product < RECTANGLE)
    slices = np.cumsum(product[few]) // LISTED
    for some in np.split(few, np.flatnonzero(np.diff(slices)) + 1):
        of, place = np.repeat(some, product[some]), runs(product[some])
        cell = at_x[from_x[of] + place // n_y[of]] * shared.shape[1] + at_y[from_y[of] + place % n_y[of]]
        np.add.at(shared.reshape(-1), cell, 1)
        earlier.reshape(-1)[cell[names[of] < token]] = True
    return shared, earlier


def _crowd_pairs(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be similar among the nodes that share a crowded token and whose prefixes share no smaller one.

    Blocks of nodes meet in pairs of blocks; what two prefixes share is counted within the task, so only pairs that pass are rows.
    """
    blocks = F.ceil(F.col("m") / CROWD_BLOCK).cast("int")
    prefixes = rows.filter("n > 0").select(F.col("node").alias("p_node"), "prefix").dropDuplicates(["p_node"])
    dealt = members.join(prefixes, F.col("node") == F.col("p_node")).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "component", "prefix")

    def compare(table: pa.Table) -> pa.Table:
        token, i, j = (table.column(c)[0].as_py() for c in ("token", "i", "j"))
        own = table.column("own").to_numpy()
        sides = [table.take(pa.array(np.flatnonzero(own == k))) for k in (i, j)]
        node, n, component = ([s.column(c).to_numpy() for s in sides] for c in ("node", "n", "component"))
        shared, earlier = _shared([s.column("prefix") for s in sides], token, i == j)
        x, y = n[0][:, None].astype(np.int64), n[1][None].astype(np.int64)
        need = -(-np.maximum(x, y) * PART // WHOLE)
        ok = (shared > 0) & ~earlier & (component[0][:, None] != component[1][None]) & (np.minimum(x, y) * WHOLE >= np.maximum(x, y) * PART) & (shared + need - 1 >= -(-(x + y) * PART // (PART + WHOLE)))
        if i == j:
            ok &= node[0][:, None] < node[1][None]
        a, b = np.nonzero(ok)
        a, b = node[0][a], node[1][b]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return dealt.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, sample: int = SAMPLE, frequent: int = FREQUENT, crowd: int = CROWD) -> DataFrame:
    """The rows of docs that stay: of each group of similar documents one row, with its smallest doc_id.

    Rows whose doc_id is null name no group and all stay.
    """
    with scope(docs.sparkSession) as kept:
        rows = materialize(_prefixes(docs, _frequent(docs, sample, frequent)))
        groups = components(links(rows, docs, crowd), LINKS_CHUNK).select(F.col("node").alias("g_node"), "component")
        linked = rows.select("doc_id", "key", "node").join(groups, F.col("node") == F.col("g_node"), "left")
        linked = materialize(linked.select("doc_id", "key", F.coalesce("component", "node").alias("component")))
        kept.append(linked)
    return simhash.keep_rows(docs, linked)
