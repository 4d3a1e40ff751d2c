"""SimHash near-dedup with a pigeonring filter.

Words are lower-cased (A-Z only); a document's features are its shingles of three words, repeats included (fewer words:
the whole sequence; none: the fingerprint is zero). A bit of the 64-bit fingerprint is 1 if it is set in over half of
the features' XXH64. Documents whose fingerprints differ in at most 2 bits are linked.

Pigeonring: the 64 bits form a ring of SEGMENTS segments. If two fingerprints differ in at most t bits, some segment
starts a chain in which, for every length l, the first l segments differ in at most l * t / SEGMENTS bits together. The
first segments of such a chain must therefore be equal: they are the join key. Further chain lengths prune what meets
there, and the full Hamming distance decides.

All documents of one fingerprint are one node, so copies are never expanded into pairs. Where one key is shared by more
than CROWD different fingerprints, the chain goes on there: up to LONG segments together, one side with the differences that the budget allows
(at most one bit past the equal segments), so that the rest of the chain is part of the join key. No more than 2 ** 8 fingerprints share such a key, however
many there are in all, and each looks up 33 keys a start.

Defined results: null or blank text has fingerprint zero and is linked like any other; repeated rows each give a row; an
empty table gives an empty table; other columns are not read by link_documents and pass through keep_one.

Scale: texts are read once and not shuffled; everything after works on (doc_id, fingerprint) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import materialize, scope, whole_rows

DISTANCE = 2
SEGMENTS = 8
#: Fingerprints of a key beyond which its chains are followed for LONG segments.
CROWD = 1000
LONG = SEGMENTS - 1
SEED = 42
_NORMAL = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\v\f\r", bytes(range(97, 123)) + b"     ")
_BLOCK = 1 << 16


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are set in over half of n hashes."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_NORMAL).split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    # shingles are slices of the joined words
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _BLOCK):
        ones += votes(np.array([digest(line[s:e], SEED) for s, e in zip(starts[a : a + _BLOCK], stops[a : a + _BLOCK])], "<u8"))
    return majority(ones, n)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(prints.view(np.int64))], names=["doc_id", "key", "fp"])


def _key() -> Column:
    return F.xxhash64("text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text that tells rows of one doc_id apart) and fp, the fingerprint's bits as a long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), "text")
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, key long, fp long")


def _segments(fp: Column) -> list[Column]:
    width = 64 // SEGMENTS
    return [F.shiftrightunsigned(fp, i * width).bitwiseAND((1 << width) - 1) for i in range(SEGMENTS)]


def _free(distance: int) -> int:
    """Segments at the start of a chain that have no budget for a difference."""
    return max(n for n in range(SEGMENTS + 1) if n * distance // SEGMENTS == 0)


def _chain_holds(a: Column, b: Column, start: Column, distance: int) -> Column:
    """Whether the chain of segments from start keeps within its budget at every length."""
    differing = F.array(*[F.bit_count(x) for x in _segments(a.bitwiseXOR(b))])
    ok, total = F.lit(True), F.lit(0)
    for length in range(1, SEGMENTS + 1):
        total = total + F.get(differing, (start + length - 1) % SEGMENTS)
        ok = ok & (total <= length * distance // SEGMENTS)
    return ok


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _long_links(crowded: DataFrame, distance: int) -> DataFrame:
    """Pairs whose chains hold over LONG segments, of prints (fp, start) whose first segments are in a crowd."""
    width = 64 // SEGMENTS
    mask = (1 << LONG * width) - 1
    # the ring turned so that the chain's segments are its lowest bits
    turned = F.col("fp")
    for start in range(1, SEGMENTS):
        by = start * width
        turned = F.when(F.col("start") == start, F.shiftrightunsigned("fp", by).bitwiseOR(F.shiftleft("fp", 64 - by))).otherwise(turned)
    chain = crowded.select("fp", "start", turned.bitwiseAND(mask).alias("chain"))
    spare = range(_free(distance) * width, LONG * width) if LONG * distance // SEGMENTS else ()
    changes = F.array(F.lit(0).cast("long"), *[F.lit(1 << bit) for bit in spare])
    asked = chain.select("fp", "start", F.explode(F.transform(changes, lambda m: m.bitwiseXOR(F.col("chain")))).alias("chain"))
    held = chain.select(F.col("fp").alias("b"), F.col("start").alias("start_b"), F.col("chain").alias("chain_b"))
    return asked.join(held, (F.col("start") == F.col("start_b")) & (F.col("chain") == F.col("chain_b")) & (F.col("fp") < F.col("b")))


def links(prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints that differ in at most distance (1 or 2) bits."""
    if not 1 <= distance <= 2:
        raise ValueError("chains of LONG segments have a budget of one bit, which covers distances 1 and 2")
    prints = prints.select("fp").distinct()
    free, width = _free(distance), 64 // SEGMENTS
    parts = _segments(F.col("fp"))
    chains = []
    for start in range(SEGMENTS):
        key = F.lit(0).cast("long")
        for i in range(free):
            key = F.shiftleft(key, width).bitwiseOR(parts[(start + i) % SEGMENTS])
        chains.append(F.struct(F.lit(start).alias("start"), key.alias("key")))
    keyed = materialize(prints.select("fp", F.explode(F.array(*chains)).alias("chain")).select("fp", "chain.start", "chain.key"))
    crowded = materialize(keyed.groupBy("start", "key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(F.col("start").alias("c_start"), F.col("key").alias("c_key")))
    # a join tests what is filtered after it first; a print meets itself in each of its chains, so the chain's arrays are made only where the cheap tests hold
    near = lambda met: met.filter(F.when((F.col("fp") < F.col("b")) & (_far("fp", "b") <= distance), _chain_holds(F.col("fp"), F.col("b"), F.col("start"), distance))).select(F.col("fp").alias("a"), "b")
    calm, dense = keyed, None
    if not crowded.isEmpty():
        at_crowd = (F.col("start") == F.col("c_start")) & (F.col("key") == F.col("c_key"))
        calm = keyed.join(crowded, at_crowd, "left_anti")
        dense = near(_long_links(keyed.join(crowded, at_crowd, "left_semi"), distance))
    other = calm.select(F.col("fp").alias("b"), F.col("start").alias("start_b"), F.col("key").alias("key_b"))
    found = near(calm.join(other, (F.col("start") == F.col("start_b")) & (F.col("key") == F.col("key_b")) & (F.col("fp") < F.col("b"))))
    return (found if dense is None else found.unionByName(dense)).distinct()


def link_documents(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, key and fp of every row, component (the smallest fp reachable over links) and component_id (the smallest doc_id)."""
    with scope(docs.sparkSession) as kept:
        rows = materialize(fingerprints(docs))
        prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
        groups = components(links(prints, distance))
        named = prints.join(groups, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("fp_key"), F.coalesce("component", "fp").alias("component"), "first_id")
        least = named.groupBy(F.col("component").alias("c")).agg(F.min("first_id").alias("component_id"))
        named = materialize(named.join(least, F.col("component") == F.col("c")).select("fp_key", "component", "component_id"))
        kept += [rows, named]
    return rows.join(named, F.col("fp") == F.col("fp_key")).select("doc_id", "key", "fp", "component", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that stay: of each group of near copies one row, with its smallest doc_id.

    Rows whose doc_id is null name no group and all stay.
    """
    return keep_rows(docs, link_documents(docs, distance))


def keep_rows(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """keep_one() for linked rows: doc_id, key and component."""
    kept = linked.filter(F.col("doc_id").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("kept")).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.key").alias("kept_key"))
    rows = whole_rows(docs, F.col("doc_id").alias("row_id"), _key().alias("row_key"))
    found = rows.join(kept, (F.col("row_id") == F.col("kept_id")) & (F.col("row_key") == F.col("kept_key")))
    return found.dropDuplicates(["row_id", "row_key"]).select("row.*").unionByName(docs.filter(F.col("doc_id").isNull()))


def op5(spark, sf_dir: str) -> DataFrame:
    linked = link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
