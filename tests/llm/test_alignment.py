import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import alignment

PATHS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[3])
    # the printable stand-ins of the byte-level vocabulary
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    a_bytes = lambda i: bytes(stand_in[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), a_bytes, (lambda t: b.encode(t)), b_bytes


def groups_of(text, encoders):
    """Groups of A and B ids: cut wherever a token of each ends."""
    encode_a, a_bytes, encode_b, b_bytes = encoders
    if not text:
        return []
    a, b = encode_a(text), encode_b(text)
    if not (b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + text).encode()):
        return []
    ends = lambda ids, of: np.cumsum([len(of(i)) for i in ids]).tolist()
    a_ends, b_ends = ends(a, a_bytes), ends(b, b_bytes)
    common, out, start = sorted(set(a_ends) & set(b_ends)), [], 0
    for end in common:
        out.append(([i for i, e in zip(a, a_ends) if start < e <= end], [i for i, e in zip(b, b_ends) if start < e <= end]))
        start = end
    return out


def plain(texts, encoders):
    groups = [groups_of(t, encoders) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = []
    for g, c in zip(groups, links):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        sha = hashlib.sha256(spelled.encode()).hexdigest() if g else ""
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in c.items()), sha))
    return rows


def texts_of(seed, n):
    rng = random.Random(seed)
    bits = ["the ", "Über", "日本語の", "  ", "\n", "\t\t", "don't", "123456", "<|endoftext|>", "</s>", "<0x41>", "naïve ", "🙂👍🏽", "----------", "aaaaaaa", "http://x.y/z?q=1", "\u00a0", "ﬁ", "e\u0301", "\x00", ".", ","]
    return ["".join(rng.choices(bits, k=rng.choice([1, 2, 5, 40]))) for _ in range(n)]


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, pair int").repartition(3)
    out = alignment.aligned(docs, *PATHS)
    assert out.columns == ["doc_id", *COLUMNS]
    return [tuple(r[c] for c in COLUMNS) for r in sorted(out.collect(), key=lambda r: r.doc_id)]


def test_against_sets_of_ends(spark, encoders):
    texts = [*texts_of(1, 150), None, "", " ", "with ▁ inside", "a" * 3000, "\n" * 500, *["the same text, twice"] * 40, "x " * 20_000]
    got = run(spark, texts)
    want = plain(texts, encoders)
    assert got == want
    assert sum(r[0] > 0 for r in got) > 100 and got[150] == got[151] == got[153] == (0, 0, 0, 0, 0, 0, "")


def test_rows_without_id_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one")], "doc_id long, text string")
    rows = alignment.aligned(docs, *PATHS).collect()
    assert len(rows) == 3 and all(r.count_sum > 0 and r.n_best <= r.n_links for r in rows)
    assert alignment.aligned(docs.limit(0), *PATHS).count() == 0


def test_many_chunks(spark, encoders, monkeypatch):
    texts = texts_of(2, 120)
    want = plain(texts, encoders)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    chunks = alignment.materialize(alignment.linked(docs, *PATHS, chunk_docs=7, chunk_bytes=200))
    assert chunks.count() > 15
    out = alignment.scored(chunks, alignment.pair_counts(chunks)).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in out] == want


def test_a_chunk_meets_its_counts_alone(spark, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "ROW_PAIRS", 40)
    texts = [*texts_of(4, 60), None, "", "a" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    # rows of one chunk, in rows of few pairs
    made = list(alignment.linked(docs, *PATHS).collect())
    assert len(made) > 3 and len({r.chunk for r in made}) == 1 and [i for r in made for i in r.doc_ids] == list(range(63)) and [len(r.pairs) > 0 for r in made] == [True, *[False] * (len(made) - 1)]
    chunks = alignment.materialize(alignment.linked(docs, *PATHS))
    out = alignment.scored(chunks, alignment.pair_counts(chunks))
    assert [tuple(r[c] for c in COLUMNS) for r in out.orderBy("doc_id").collect()] == plain(texts, encoders)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # all chunks of a partition in one batch, each with a list of its counts, took memory that grew with the table
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan and "MapInArrow " not in plan


@pytest.mark.parametrize("at_once", [3, 100, 1 << 20])
def test_long_groups_are_taken_apart(at_once):
    rng = np.random.default_rng(at_once)
    # 90 tokens of 7 bytes and 70 of 9 end together only at the end; then two plain groups of another document
    a, b = rng.integers(0, 20, 93), rng.integers(0, 9, 72)
    a_size, b_size = np.array([7] * 90 + [1, 1, 2]), np.array([9] * 70 + [2, 2])
    a_at, b_at = alignment.group_bounds(a_size, b_size)
    long = list(zip(a_at[:-1], a_at[1:], b_at[:-1], b_at[1:]))
    assert (np.diff(a_at) @ (np.diff(b_at))) == sum((y - x) * (w - v) for x, y, v, w in long) and len(long) == 12
    alignment_limit, alignment.PLAIN_GROUP = alignment.PLAIN_GROUP, 8
    try:
        doc, pair, times = alignment.distinct_pairs(a, b, a_at, b_at, np.array([0] * 10 + [1] * 2), at_once)
    finally:
        alignment.PLAIN_GROUP = alignment_limit
    want = Counter((0 if g < 10 else 1, int(p) << 32 | int(q)) for g, (x, y, v, w) in enumerate(long) for p in a[x:y] for q in b[v:w])
    assert dict(zip(zip(doc.tolist(), pair.tolist()), times.tolist())) == want
