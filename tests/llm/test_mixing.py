import hashlib
import random
from collections import Counter, defaultdict

import pytest

from barloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, slice string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


def some(n=300):
    rng = random.Random(5)
    rows = [(i, " \t".join("w" * 3 for _ in range(rng.randint(0, 30))), "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "é", None])) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "  \n", "b"), (n + 2, "word " * 3000, "hot"), (3, rows[3][1], rows[3][2])]


def targets(sizes):
    """Share 1.5 of the total by weight; what is over twice a source's size is shared again, until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] <= weight[s] * unit]
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_targets_and_taken_words(spark):
    rows = some()
    got = mixing.mixed(docs(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.PACKET for s in want)
    again = sorted(map(str, mixing.mixed(docs(spark, rows).repartition(7)).collect()))
    assert again == sorted(map(str, got))


@pytest.mark.parametrize("packet", [1, 128, 10**6])
def test_taken_words_are_those_before_the_cut_of_one_queue(spark, packet):
    rows = some()
    queues, sizes = defaultdict(list), Counter()
    for i, t, s in rows:
        n = len((t or "").split())
        queues[s].append((hashlib.md5(str(i).encode()).hexdigest(), i, n))
        sizes[s] += n
    want, served = targets(sizes), []
    for s, queue in queues.items():
        at = 0
        for turn in range(2):
            for _, i, n in sorted(queue):
                for a in range(0, n, packet):
                    words = min(packet, n - a)
                    at += words
                    served.append((at / want[s], s is None, s or "", i, words))
    left, taken = int(1.5 * sum(sizes.values())), Counter()
    for _, _, _, i, words in sorted(served):
        taken[i] += min(words, left)
        left -= min(words, left)
    got = Counter()
    for r in mixing.mixed(docs(spark, rows), packet=packet).collect():
        got[r.doc_id] += r.taken
    assert +got == +taken


def test_mix_repeats_whole_rows_in_fair_order(spark):
    rows = some()
    plan = mixing.mixed(docs(spark, rows)).collect()
    out = mixing.mix(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "size", "slice"]
    copies = Counter()
    for r in plan:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +copies


def test_empty_and_blank(spark):
    assert mixing.mixed(docs(spark, [])).count() == 0
    assert [(r.size, r.taken) for r in mixing.mixed(docs(spark, [(1, None, None), (2, "", "a")])).collect()] == [(0, 0), (0, 0)]
    assert mixing.mix(docs(spark, [(1, None, None)])).count() == 0
