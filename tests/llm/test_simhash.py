import random

import xxhash
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in " ".join(words)).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, edges):
    """Smallest node reachable from each."""
    at = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abÉßz") for _ in range(rng.randint(1, 5)))
    base = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)]
    out = [None, "", "  \n", "One", "one", "Two words", "tWo\twords ", "x " * 30_000]
    for t in base:
        for _ in range(rng.randint(1, 6)):
            w = t.split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


def test_documents_against_brute_force(spark):
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts())]
    rows.append(rows[3])
    got = simhash.link_documents(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")).collect()
    want = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(want)
    groups = reach(ids, [(a, b) for a in ids for b in ids if a < b and (want[a] ^ want[b]).bit_count() <= 2])
    assert len(got) == len(rows)
    assert len(set(groups.values())) < len(ids)
    for r in got:
        assert r.fp % 2**64 == want[r.doc_id]
        assert r.component_id == groups[r.doc_id]


def prints(seed, n):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    return [x - 2**64 if x >> 63 else x for x in out]


def test_links_are_whole_with_and_without_crowds(spark):
    rows = prints(1, 400) + [k << 40 for k in range(150)]
    table = spark.createDataFrame([(x,) for x in rows], "fp long")
    every = sorted(set(rows))
    for distance in (1, 2):
        want = {(a, b) for a in every for b in every if a < b and ((a ^ b) % 2**64).bit_count() <= distance}
        for crowd in (0, 3, 1000):
            assert {(r.a, r.b) for r in simhash.links(table, distance, crowd).collect()} == want


def test_keep_one(spark):
    rows = [(4, "a b c d", "x"), (2, "A b  c d", "y"), (9, "quite another text here", "z"), (9, "and one more of that id", "z"), (2, "A b  c d", "y"), (None, "a b c d", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _other string")
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect()) == [("2", "A b  c d"), ("9", "and one more of that id"), ("9", "quite another text here"), ("None", "a b c d")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(5, 5), (300, 200), (250, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reach({n for e in edges for n in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).filter(F.lit(True)).count() == 0


def test_components_in_chunks(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(5, 5), (300, 200), (250, 300), (-9, 2**62), (2**62, 60)]
    edges += [(a, a + rng.choice([1, 2, 7])) for a in rng.sample(range(1000, 1400), 250)] + [(e, e) for e in (7, 900)]
    rng.shuffle(edges)
    want = reach({n for a, b in edges if a != b for n in (a, b)}, [e for e in edges if e[0] != e[1]])
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        for chunk in (1, 20, 100, 10_000):
            assert {r.node: r.component for r in components(table, chunk).collect()} == want, chunk
        assert components(table.limit(0), 100).filter(F.lit(True)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_one_chunk_take_no_round(spark):
    """The driver keeps a record of each job and task, so a loop of rounds over few edges fills it."""
    table = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    jobs = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert components(table, 1000).filter("component = 0").count() == 301
        assert len(jobs()) <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
