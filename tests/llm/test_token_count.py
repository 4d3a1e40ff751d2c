import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from barloom.llm import token_count

PATH = public_tokenizers.path("piece_bpe_32k.model")


def tokenizer(pieces):
    every = [("<unk>", 0.0), *pieces, *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    lowest = min(s for _, s in pieces)
    made = Tokenizer(models.Unigram([(p, s if k and k <= len(pieces) else lowest) for k, (p, s) in enumerate(every)], unk_id=0, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.Metaspace(prepend_scheme="always", split=True)])
    return made


def words(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_ties_and_unknown_characters_against_the_library(seed):
    rng = random.Random(seed)
    pieces = {p: float(-rng.randint(1, 3)) for p in ["▁", *words(rng, "ab▁", 4), *words(rng, "ab", 30), "a", "▁ab", "é"]}
    pieces = tuple((p, s) for p, s in pieces.items() if "▁" not in p[1:])
    plain, count = tokenizer(pieces), token_count.Counter(pieces)
    some = words(rng, "abé\U0001f600c", 500)
    for w, (_, n) in zip(some, count(some)):
        assert n == len(plain.encode(w, add_special_tokens=False).ids), w


def test_documents_against_the_library(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    texts += [None, "", " \n\t", "x" * 40_000, "日本語 🙂 naïve", "word " * 20_000]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)]
    got = token_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    plain = tokenizer(token_count.vocabulary(PATH))
    assert len(got) == len(rows)
    for r in got:
        split = (texts[r.doc_id] or "").encode().split()
        assert r.n_words == len(split)
        assert r.n_tokens == len(plain.encode(b" ".join(split).decode(), add_special_tokens=False).ids), r.doc_id


def test_memory_of_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 3)
    import pyarrow as pa

    counter = token_count.Counter((("▁", -1.0), ("a", -2.0), ("ab", -3.0)))
    for text in ("a b ab aab", "ab b c", "d e f g h", "a b"):
        held = token_count.Words(pa.array([text]))
        hashes, first = token_count.np.unique(held.hashes(), return_index=True)
        _, counts = counter.lookup(held, hashes, first)
        assert counts.tolist() == [counter([held.bytes_of(k).decode()])[0][1] for k in first]


def test_empty_table(spark):
    assert token_count.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
