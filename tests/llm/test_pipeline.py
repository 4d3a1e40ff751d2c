import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import mixing, storage, templates, toxicity

from .test_mixing import targets
from .test_resemblance import plain_set, similar
from .test_simhash import reach

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.materialize(stage(spark, docs, SF))
        after = docs.toPandas()
        if name != "packing":
            assert list(after.columns) == columns
            assert (after.n_chars == after.text.str.len()).all() or name == "toxicity"
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            cuts = np.array([model.thresholds.get(x, 0.5) for x in before.lang])
            assert set(after.doc_id) == set(before.doc_id[model.scores(pa.array(before.text)) < cuts])
        if name == "line dedup":
            con = duckdb.connect()
            con.register("documents", before)
            want = con.execute(templates.ORACLE).df().set_index("doc_id").kept_sha256
            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in zip(after.doc_id, after.text)} == want.to_dict()
        if name == "SimHash near-dedup":
            sets = dict(zip(before.doc_id, map(plain_set, before.text)))
            low = reach(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])
            assert sorted(after.doc_id) == sorted(set(low.values()))
        if name == "mixing":
            words = lambda frame: {s: sum(len(t.encode().split()) for t in g.text) for s, g in frame.groupby("source")}
            want, got, longest = targets(words(before)), words(after), defaultdict(int)
            for s, t in zip(before.source, before.text):
                longest[s] = max(longest[s], len(t.encode().split()))
            # the cut falls within a packet or two of a source's target, and the document that it falls in stays whole
            near = 2 * mixing.PACKET
            assert all(want[s] - near <= got[s] <= want[s] + longest[s] + near for s in want)
            assert max(Counter(after.doc_id).values()) <= 2
        if name == "packing":
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            copies = Counter(before.doc_id)
            ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in zip(before.doc_id, before.text)}
            assert after.length.sum() == sum(len(ids[i]) * n for i, n in copies.items())
            single = [r for r in docs.collect() if copies[r.doc_id] == 1]
            assert {r.doc_id for r in single} == {i for i, n in copies.items() if n == 1}
            sizes = Counter()
            for r in docs.collect():
                sizes[r.sequence_id] += r.length
            assert max(sizes.values()) <= 2048
        before = after


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, _id string, _lost string, row string, `a.b` string"
    rest = ("k", "i", "l", "r", "ab")
    rows = [(None, None, None, None, None), (None, "a b c", "en", None, 5), (1, None, "en", "s", None), (2, "", None, "s", 0), (3, " \n\t", "de", "s", 3), (4, "one word two " * 30_000, "en", "t", 390_000)]
    rows += [(5, "same text in here twice", "en", "t", 23)] * 2 + [(6, "same text in here twice", "en", "t", 23)]
    return spark.createDataFrame([(*r, *rest) for r in rows], schema)


def test_stages_on_odd_documents_and_none(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        some = docs.count() > 0
        for name, stage in corpus_pipeline.STAGES:
            out = storage.materialize(stage(spark, docs, SF))
            assert bool(out.count()) == some
            if name != "packing":
                assert out.columns == docs.columns
                assert all((r._key, r._id, r._lost, r.row, r["a.b"]) == ("k", "i", "l", "r", "ab") for r in out.collect())
            docs = out


def test_tables_of_a_scope_go(spark):
    before = spark.range(3)
    with storage.scope(spark) as kept:
        gone, stays = storage.materialize(before), storage.materialize(before)
        kept.append(stays)
    assert stays.count() == 3
    with pytest.raises(Exception):
        gone.count()
