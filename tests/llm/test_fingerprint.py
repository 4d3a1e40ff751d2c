import hashlib
import re
import unicodedata

import xxhash
from pyspark.sql import functions as F

from barloom.llm import fingerprint

ROWS = [
    (7, "Grüße  aus\tKÖLN"), (3, "grüsse aus köln "), (9, None), (1, ""), (5, "ﬁne   Text"), (4, "fine text"),
    (4, "fine text"), (12, "x" * 50_000), (2, " \n "), (8, "ÅngstrÖm   K"), (11, "Ångström k"),
]


def canonical(text):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"[\s   -     　\x85]+", " ", nfkc(nfkc(text or "").casefold())).strip(" ")


def digest(canon):
    a = xxhash.xxh64_intdigest(canon.encode(), 42)
    return f"{a:016x}"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "fp", "canon") for i, t in rows], "doc_id long, text string, fp string, canon string")


def test_fingerprints_equal_exactly_for_equal_canonical_texts(spark):
    got = {}
    for r in fingerprint.fingerprints(docs(spark, ROWS)).collect():
        got.setdefault(r.doc_id, r.fingerprint)
    for i, text in ROWS:
        assert got[i][:16] == digest(canonical(text))
        for j, other in ROWS:
            assert (got[i] == got[j]) == (canonical(text) == canonical(other))


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    weak = lambda canon: F.lit("same")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs(spark, ROWS), weak).collect()}
    for i, text in ROWS:
        for j, other in ROWS:
            assert (got[i] == got[j]) == (canonical(text) == canonical(other))


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in ROWS if not (i == 4)] + [(100 + k, f"doc {k} é" * k) for k in range(40)]
    docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op4(spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].edited_fingerprint[:16] == digest(canonical(edited))
        assert got[i].near_next == float(canonical(text) == canonical(following))
        assert got[i].near_edited == float(canonical(text) == canonical(edited))


def test_empty_table_and_null_ids(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert fingerprint.op4(spark, f"{tmp_path}/a").count() == 0
    docs(spark, [(None, "a"), (None, None), (5, "b")]).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert fingerprint.op4(spark, f"{tmp_path}/b").count() == 3
