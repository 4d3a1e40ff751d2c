import random
from collections import Counter, defaultdict

import pytest

from barloom.llm import templates


def tokens_of(line):
    for c in "\t\v\f\r":
        line = line.replace(c, " ")
    return [t for t in line.split(" ") if t]


def plain(rows, min_docs=10, depth=3, share=0.6):
    """Line numbers that each row (id, text) loses, in dictionaries."""
    need = lambda n: -(-int(n * 10 * share) // 10)
    lines = [(i, t, k, tokens_of(x)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[3]]
    masked = lambda t: "<*>" if any(c in "0123456789" for c in t) else t
    leaf = lambda ts: (len(ts), *[masked(t) for t in ts[:depth]])
    docs = defaultdict(set)
    for i, _, _, ts in lines:
        docs[leaf(ts)].add(i)
    distinct = defaultdict(set)
    for i, _, _, ts in lines:
        if len(docs[leaf(ts)]) >= min_docs:
            distinct[tuple(ts)].add(i)
    support = Counter()
    for ts, ids in distinct.items():
        for at, t in enumerate(ts):
            support[leaf(ts), at, t] += len(ids)
    template = {}
    for ts in distinct:
        fixed = sorted((-support[leaf(ts), at, t], at, t) for at, t in enumerate(ts) if support[leaf(ts), at, t] >= min_docs)
        if len(fixed) >= need(len(ts)):
            template[ts] = leaf(ts), tuple(sorted((at, t) for _, at, t in fixed[: need(len(ts))]))
    members = defaultdict(set)
    for i, _, _, ts in lines:
        if tuple(ts) in template:
            members[template[tuple(ts)]].add(i)
    lost = defaultdict(set)
    for i, t, k, ts in lines:
        m = members.get(template.get(tuple(ts)), ())
        if len(m) >= min_docs and i != min(m, key=lambda x: (x is None, x)):
            lost[i, t].add(k)
    return lost


def kept(text, lost):
    if text is None or not lost:
        return text
    rest = [x for k, x in enumerate(text.split("\n")) if k not in lost]
    return "\n".join(rest) if any(tokens_of(x) for x in rest) else ""


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(n):
        text = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 4))]
        if i % 2:
            text.insert(0, f"Posted by user {word()} on day {rng.randrange(50)} in the main forum")
        if i % 3 == 0:
            text.append("All rights reserved \t by the publisher")
        if i % 5 == 0:
            text.append(" ")
        rows.append((i, "\n".join(text)))
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, "All rights reserved by the publisher"), (7, rows[7][1]), (8, "All rights reserved by the publisher"), (104, "word " * 20_000)]


@pytest.mark.parametrize("min_docs", [10, 3])
def test_against_dictionaries(spark, min_docs):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lost = plain(rows, min_docs)
    assert sum(map(len, lost.values())) > 40
    got = Counter((r.doc_id, r.text) for r in templates.drop_lines(docs, min_docs=min_docs).collect())
    assert got == Counter((i, kept(t, lost.get((i, t)))) for i, t in rows)


def test_more_documents_of_a_template_never_bring_it_back(spark):
    def lines(n):
        return [(i, f"On {['Monday', 'Friday'][i % 2]} order {i % 37} of customer c{i % 41} was sent to the store of the town") for i in range(n)]

    for n in (24, 200, 2000):
        docs = spark.createDataFrame(lines(n), "doc_id long, text string")
        left = {r.doc_id for r in templates.drop_lines(docs).filter("text <> ''").collect()}
        # one keeper for each of the tree's two leaves, as the weekday leads the line
        assert left == {0, 1}


def test_null_ids_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_chars int, _id string, _lost string, row string, lost string, `a.b` string, _key string"
    row = lambda i, t: (i, t, len(t or ""), "p", "q", "r", "s", "t", "u")
    line = "the very same line of words"
    docs = spark.createDataFrame([row(i, f"own {i}\n{line}") for i in range(12)] + [row(None, line), row(None, None)], schema)
    got = templates.drop_lines(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sum(line in (r.text or "") for r in rows) == 1 and all((r.n_chars == len(r.text or "")) for r in rows)
    assert all((r._id, r._lost, r.row, r.lost, r["a.b"], r._key) == ("p", "q", "r", "s", "t", "u") for r in rows)
    assert templates.drop_lines(docs.limit(0)).count() == 0
