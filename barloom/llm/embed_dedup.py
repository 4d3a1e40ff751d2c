"""Embedding near-dedup by randomised-rotation binary codes.

Vectors are unit-scaled. Pivots, sampled by a hash and thinned so that none are close to each other, divide them into cells, in a tree of two levels: some pivots are
tops, each other pivot belongs to its nearest top; a vector looks among the tops first, then among the pivots of its top. There are sqrt(n) pivots, at most MAX_PIVOTS, so a
vector meets some n^1/4 of them at each level, and what is broadcast is bounded. A vector
lives in the cell that it finds. There its residual from the pivot is rotated at random (a fixed seed) and reduced to
the signs of its coordinates. Stored with them is the correction factor: the inner product of the unit residual with its own
code. Dividing a query's inner product with a code by that factor gives an unbiased estimate of the true inner product, with
a standard error known from the factor. A pair whose estimate plus SURE errors is short of the threshold is dropped; every
other one is computed exactly, in double precision, and linked or not by that value alone.

Every vector is a query in all cells that a neighbour may have found: at each level those whose pivot is nearly as close as the closest. For a neighbour at the threshold in a random
direction, the chance that its cell is not among them is that of NEAR standard deviations at each level (and smaller for closer neighbours).

Equal vectors are one point with a weight, so copies are never compared. A cell is split into blocks of bounded numbers of
residents and queries, so that no group is gathered in one task. A block returns a link count for each of its queries and, for the
components, one edge per linked vector to the smallest of its group within the block, never the pairs.

Vectors of different lengths are never compared; each length has pivots and cells of its own (one cell, split into blocks, where no pivot of a length was sampled).

Defined results: a vector that is null, empty, zero, or holds null or non-finite components
links with nothing; repeated rows are vectors of their own, linked with each other; an empty table gives an empty table; other columns are not
read. Recall is measured against brute force in the tests.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import materialize

THRESHOLD = 0.95
#: Standard errors of an estimate within which a pair is recomputed.
SURE = 4.0
#: Standard deviations that cover the cell of a neighbour at the threshold.
NEAR = 3.0
#: Pivots are thinned so that no two have a larger cosine.
APART = 0.8
#: Pivots, and their bytes, at most.
MAX_PIVOTS, MAX_PIVOT_BYTES = 1 << 14, 16 << 20
#: Residents and queries of a block.
RESIDENTS, QUERIES = 2048, 8192
_SEED = 99
_BLOCK = "size int, cell int, home_part int, query_part int, is_home boolean, vec long, weight long, data binary, code binary, factor double, far double"


@lru_cache(maxsize=8)
def _rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix."""
    return _rotation(size, _SEED)


def encode(residuals: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (packed) of the rotated residuals, correction factors and lengths."""
    far = np.linalg.norm(residuals, axis=1)
    rotated = residuals @ turn
    factor = np.abs(rotated).sum(1) / (math.sqrt(residuals.shape[1]) * np.maximum(far, 1e-300))
    return np.packbits(rotated > 0, axis=1), np.where(far > 0, factor, 1.0), far


def estimates(queries: np.ndarray, codes: np.ndarray, factors: np.ndarray, far: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries (residuals from the pivot) with coded residents, less what both share, and their errors.

    Returned is the estimated inner product of the residuals and one standard error of it.
    """
    size = turn.shape[0]
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1
    length = np.linalg.norm(queries, axis=1)
    raw = (queries @ turn).astype(np.float32) @ signs.T / math.sqrt(size)
    error = np.sqrt(np.maximum(1 - factors**2, 0)) / factors / math.sqrt(max(size - 1, 1))
    return raw * (far / factors)[None], length[:, None] * (far * error)[None]


def _unit(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.float64)
    # first by the largest component, so that no square overflows
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column]).reshape(len(column), -1)


def _thinned(unit: np.ndarray) -> np.ndarray:
    """Those rows, in order, that are not close to one before them."""
    kept = unit[:0]
    for a in range(0, len(unit), 256):
        part = unit[a : a + 256]
        if len(kept):
            part = part[(part @ kept.T).max(1) < APART]
        close, own = part @ part.T >= APART, np.ones(len(part), bool)
        for i in range(1, len(part)):
            own[i] = not (close[i, :i] & own[:i]).any()
        kept = np.concatenate([kept, part[own]])
    return kept


class Pivots:
    """The pivots of one length of vectors, as a tree of two levels; cells are numbered from first."""

    def __init__(self, unit: np.ndarray, size: int, first: int = 0):
        self.first = first
        if not len(unit):
            # no pivot of this length was sampled: any direction will do for the one cell
            unit = np.eye(1, size)
        self.tops = unit[: math.isqrt(len(unit) - 1) + 1]
        order = np.argsort((unit @ self.tops.T).argmax(1), kind="stable")
        self.unit, self.bounds = unit[order], np.searchsorted((unit @ self.tops.T).argmax(1)[order], np.arange(len(self.tops) + 1))

    def __len__(self) -> int:
        return len(self.unit)

    def find(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each point; and pairs of points with the cells where neighbours of theirs may live."""
        close = points @ self.tops.T
        own, home = close.argmax(1), np.zeros(len(points), np.int64)
        near = close >= close.max(1, keepdims=True) - reach
        who, where = [], []
        for t, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:])):
            # a top is its own pivot, so no top is without
            rows = np.flatnonzero(near[:, t])
            if len(rows):
                inner = points[rows] @ self.unit[a:b].T
                best = inner.max(1, keepdims=True)
                mine = own[rows] == t
                home[rows[mine]] = a + inner[mine].argmax(1)
                i, j = np.nonzero(inner >= best - reach)
                who.append(rows[i])
                where.append(a + j)
        return home, np.concatenate([np.zeros(0, np.int64), *who]), np.concatenate([np.zeros(0, np.int64), *where])


def _pick_pivots(points: DataFrame, n: int, kind, most: int = MAX_PIVOTS) -> dict[int, Pivots]:
    """At most sqrt(n) unit vectors in all, no two of a length close, by length."""
    longest = points.agg(F.max("size")).first()[0] or 1
    wanted = max(1, min(math.isqrt(n) + 1, most, MAX_PIVOT_BYTES // (8 * longest)))
    rows = points.orderBy(F.xxhash64("vec"), "vec").limit(wanted).select("size", "data").toArrow()
    out, first = {}, 0
    sizes = rows.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        out[size] = Pivots(_thinned(_unit(_matrix(rows.column("data").take(pa.array(np.flatnonzero(sizes == size))), kind))), size, first)
        first += len(out[size])
    return out


def _smallest_together(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b, and the smallest node of each one's group."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def link(vectors: DataFrame, threshold: float = THRESHOLD, sure: float = SURE, near: float = NEAR, residents: int = RESIDENTS, queries: int = QUERIES, most_pivots: int = MAX_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    kind = np.float64 if "double" in dict(vectors.dtypes)["embedding"] else np.float32
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.withColumn("usable", F.coalesce((F.size("embedding") > 0) & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    usable = rows.filter("usable")
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    points = usable.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("weight"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat, bounds = column.values.to_numpy(zero_copy_only=False).astype(kind), column.offsets.to_numpy()
            data = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("weight"), pa.array(np.diff(bounds).astype(np.int32)), pa.array(data, pa.binary())], names=["vec", "weight", "size", "data"])

    # a null vec_id is no place in a component: such rows are compared as vector -1 less a hash
    points = points.withColumn("vec", F.coalesce("vec", -F.abs(F.xxhash64("embedding") % (1 << 62)) - 1))
    points = materialize(points.select("vec", "weight", "embedding").mapInArrow(pack, "vec long, weight long, size int, data binary"))
    n = points.count()
    if not n:
        return rows.select("vec_id", *alone)
    pivots = _pick_pivots(points, n, kind, most_pivots)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    # bounded: a row for each cell, and for each length that has none
    unknown = sum(map(len, pivots.values()))

    def by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, Pivots]]:
        """The rows of each length, their unit vectors, and the pivots of that length."""
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            part = batch.take(pa.array(np.flatnonzero(sizes == size)))
            yield size, part, _unit(_matrix(part.column("data"), kind)), shared.value.get(size) or Pivots(np.zeros((0, size)), size, unknown)

    def reach(size: int) -> float:
        return near * math.sqrt(2 - 2 * threshold) * math.sqrt(2) / math.sqrt(size)

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, ask = Counter(), Counter()
        for batch in batches:
            for size, _, unit, known in by_size(batch):
                home, _, where = known.find(unit, reach(size))
                for count, cells in ((live, home), (ask, where)):
                    for cell, k in zip(*np.unique(cells, return_counts=True)):
                        count[size, known.first + int(cell)] += int(k)
        cells = sorted(set(live) | set(ask))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in cells], pa.int32()), pa.array([c for _, c in cells], pa.int32()), pa.array([live[c] for c in cells], pa.int64()), pa.array([ask[c] for c in cells], pa.int64())], names=["size", "cell", "live", "ask"])

    sizes = points.mapInArrow(census, "size int, cell int, live long, ask long").groupBy("size", "cell").agg(F.sum("live").alias("live"), F.sum("ask").alias("ask"))
    parts = {(r["size"], r["cell"]): (max(1, -(-r["live"] // residents)), max(1, -(-r["ask"] // queries))) for r in sizes.collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                for size, batch, unit, known in by_size(whole.slice(a, 1024)):
                    home, who, where = known.find(unit, reach(size))
                    split = np.array([parts.get((size, known.first + c), (1, 1)) for c in range(len(known))])
                    home_parts, query_parts = split[:, 0], split[:, 1]
                    vec = batch.column("vec").to_numpy()
                    part = (vec.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    code, factor, far = encode(unit - known.unit[home], rotation(size))
                    # a resident goes to every query part of its cell, a query to every resident part
                    h, hq = np.repeat(np.arange(len(vec)), query_parts[home]), np.concatenate([np.arange(k) for k in query_parts[home]])
                    q, qh = np.repeat(np.arange(len(who)), home_parts[where]), np.concatenate([np.arange(k) for k in home_parts[where]])
                    asks, there = who[q], where[q]
                    row = np.concatenate([h, asks])
                    cell = np.concatenate([home[h], there])
                    is_home = np.arange(len(row)) < len(h)
                    home_part = np.concatenate([part[h] % home_parts[home[h]].astype(np.uint64), qh.astype(np.uint64)])
                    query_part = np.concatenate([hq.astype(np.uint64), part[asks] % query_parts[there].astype(np.uint64)])
                    take = batch.take(pa.array(row))
                    codes = pa.array([x.tobytes() for x in code], pa.binary()).take(pa.array(np.where(is_home, row, 0)))
                    ints = [pa.array(x.astype(np.int32)) for x in (np.full(len(row), size), cell + known.first, home_part, query_part)]
                    yield pa.RecordBatch.from_arrays(
                        [*ints, pa.array(is_home), take.column("vec"), take.column("weight"), take.column("data"), codes, pa.array(factor[row]), pa.array(far[row])],
                        names=["size", "cell", "home_part", "query_part", "is_home", "vec", "weight", "data", "code", "factor", "far"],
                    )

    def compare(table: pa.Table) -> pa.Table:
        homes, asks = table.filter(table.column("is_home")), table.filter(pc.invert(table.column("is_home")))
        out = [np.zeros(0, np.int64)] * 3
        if len(homes) and len(asks):
            size = table.column("size")[0].as_py()
            known = shared.value.get(size) or Pivots(np.zeros((0, size)), size, unknown)
            pivot, turn = known.unit[table.column("cell")[0].as_py() - known.first], rotation(size)
            own, other = _unit(_matrix(homes.column("data"), kind)), _unit(_matrix(asks.column("data"), kind))
            ids, names = homes.column("vec").to_numpy(), asks.column("vec").to_numpy()
            codes, factors, far = _matrix(homes.column("code"), np.uint8), homes.column("factor").to_numpy(), homes.column("far").to_numpy()
            with_pivot = own @ pivot
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a in range(0, len(other), 512):
                part = other[a : a + 512]
                # <x, y> = <x - p, y - p> + <x, p> + <p, y> - <p, p>
                guess, error = estimates(part - pivot, codes, factors, far, turn)
                guess = guess + (part @ pivot)[:, None] + with_pivot[None] - pivot @ pivot
                q, h = np.nonzero((guess + sure * error >= threshold - 1e-6) & (names[a : a + 512, None] != ids[None]))
                for k in range(0, len(q), 1 << 16):
                    i, j = q[k : k + (1 << 16)], h[k : k + (1 << 16)]
                    linked = np.einsum("ij,ij->i", part[i], own[j]) >= threshold
                    found.append((i[linked] + a, j[linked]))
            if found and sum(len(x) for x, _ in found):
                q, h = (np.concatenate(x) for x in zip(*found))
                nodes, low = _smallest_together(names[q], ids[h])
                links = np.zeros(len(nodes), np.int64)
                np.add.at(links, np.searchsorted(nodes, names[q]), homes.column("weight").to_numpy()[h])
                out = [nodes, links, low]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], names=["vec", "links", "low"])

    blocks = points.mapInArrow(deal, _BLOCK).groupBy("size", "cell", "home_part", "query_part")
    links = materialize(blocks.applyInArrow(compare, "vec long, links long, low long"))
    together = components(links.select(F.col("vec").alias("a"), F.col("low").alias("b")))
    # weights stand for the copies of a point
    per_point = links.groupBy("vec").agg(F.sum("links").alias("links"))
    members = usable.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
    members = members.withColumn("vec", F.coalesce("first_id", -F.abs(F.xxhash64("embedding") % (1 << 62)) - 1))
    named = members.join(per_point, "vec", "left").join(together, F.col("vec") == F.col("node"), "left")
    named = named.withColumn("component", F.coalesce("component", "vec"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    shared.unpersist()
    out = usable.join(named, F.col("embedding") == F.col("_embedding")).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return out.unionByName(rows.filter("not usable").select("vec_id", *alone))


def op6(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, n.b FROM reach r JOIN near n ON r.other = n.a),
groups AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
links AS (SELECT a AS vec_id, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM groups LEFT JOIN links USING (vec_id)
"""
