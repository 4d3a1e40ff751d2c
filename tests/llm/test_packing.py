import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def texts():
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()[:120]
    odd = [None, "", " ", "<|endoftext|> it's   \n\n\t x", "日本語テキスト 🙂" * 50, "a" * 30_000, "word " * 20_000, "  x\x0b\x1c y", " " * 3000 + "x"]
    return [*rows, *odd]


def check(rows, ids):
    """Pieces cover every document once, sequences are gapless, and the checksums are right. Returns the padded length."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(part.tobytes())
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padded += at if at & (at - 1) == 0 else 2048
    return padded


@pytest.mark.parametrize("shard_tails", [1500, 7])
def test_pieces(spark, plain, shard_tails):
    rows = [(3 * i, t, 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    got = packing.pack(docs, *paths, public_tokenizers.PATTERN, shard_tails=shard_tails).collect()
    ids = {i: plain(t) for i, t, _ in rows}
    total = sum(map(len, ids.values()))
    assert check(got, ids) == total


def test_repeated_rows_and_empty_table(spark, plain):
    docs = spark.createDataFrame([(1, "one two")] * 3 + [(None, "x")], "doc_id long, text string")
    got = packing.pack_public(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got if r.doc_id) == [(1, 3)] * 3 or sum(r.length for r in got) == 3 * len(plain("one two")) + len(plain("x"))
    assert packing.pack_public(docs.limit(0)).count() == 0


def test_index_against_the_formula():
    rng = random.Random(3)
    tails = [np.array([rng.randrange(40) for _ in range(rng.randint(1, 60))], np.uint16) for _ in range(25)]
    idf, mean = np.linspace(0.1, 4, 40).astype(np.float32), 30.0
    index = packing.Index(tails, idf, mean)

    def weight(t, d):
        f = (tails[d] == t).sum()
        return idf[t] * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(tails[d]) / mean))

    for seed in range(25):
        terms = sorted(set(tails[seed].tolist()), key=lambda t: (-weight(t, seed), t))[: packing.QUERY_TERMS]
        assert np.allclose(index.scores(seed), [sum(weight(t, d) for t in terms) for d in range(25)], rtol=1e-5)


def test_related_tails_share_windows():
    rng = random.Random(1)
    tails = [np.array([rng.randrange(100 * (i % 4), 100 * (i % 4) + 100) for _ in range(50)], np.uint16) for i in range(40)]
    windows = packing.fill(np.full(40, 50), packing.Index(tails, np.ones(400, np.float32), 50.0).scores, 500)
    assert [len({t % 4 for t, _, _ in w}) for w in windows] == [1] * 4


@pytest.mark.parametrize("copies", [20, 80])
def test_related_documents_of_many_shards_share_windows(spark, copies):
    rng = random.Random(2)
    common = [f"common{i}" for i in range(50)]
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for k in range(30)]
    rows = [(j * 30 + k, " ".join(rng.choice(words[k] if rng.random() < 0.5 else common) for _ in range(60))) for k in range(30) for j in range(copies)]
    rng.shuffle(rows)
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def alike(shard_tails):
        topics = defaultdict(list)
        for r in packing.pack(docs, *paths, public_tokenizers.PATTERN, shard_tails=shard_tails).collect():
            topics[r.sequence_id].append(r.doc_id % 30)
        return np.mean([(sum(t == u for t in w) - 1) / (len(w) - 1) for w in topics.values() if len(w) > 1 for u in w])

    # one shard of all tails is the whole index
    assert alike(40) > 0.5 * alike(10**6) > 0.3


def test_route_bounds_shards():
    rng = random.Random(5)
    rows = [(min(int(rng.paretovariate(0.6)), 400), rng.randrange(300), rng.randrange(2**31)) for _ in range(20_000)]
    first = {t: sum(r[0] == t for r in rows) for t in {r[0] for r in rows}}
    route = packing.Route(first, 200)
    crowded = defaultdict(int)
    for a, b, _ in rows:
        if a in route.buckets:
            crowded[a, route.bucket(a, b)] += 1
    route.place(crowded, packing.cluster_order([], first))
    sizes = defaultdict(int)
    for row in rows:
        sizes[route.shard(*row)] += 1
    assert set(sizes) == set(range(100)) and max(sizes.values()) < 300


def test_ids_come_as_an_array_and_equal_the_library():
    json_path = public_tokenizers.path("byte_bpe_50k.json")
    encode, _ = packing._encoder(json_path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    slow = Tokenizer.from_file(json_path)
    for text in ("", " ", "one two  three\n\n", "é漢\U0001f600 \x00", "a<|endoftext|>b", "<|endoftext|>", "x" * 3000):
        ids = encode(text)
        assert isinstance(ids, np.ndarray) and ids.tolist() == slow.encode(text, add_special_tokens=False).ids, text
