"""Contracts and the versioned store: every problem told, nothing lost, and a crash between data and manifest harmless."""

import pytest
from pyspark.sql import functions as F

from barloom.sources.contracts import Column, Contract, ContractError
from barloom.sources.store import IdentityError, Store

ROWS = [("a", "2024-01-01 00:00", 1.0, 2), ("a", "2024-01-01 01:00", None, 2), ("a", "2024-01-01 01:00", float("nan"), 9), ("a", "2024-01-01 05:30", float("inf"), 2), ("b", "2024-01-01 05:00", -1.0, 2), (None, None, 5.0, None)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "s string, t string, x double, n int").withColumn("t", F.col("t").cast("timestamp_ntz")).repartition(3)


CONTRACT = Contract("c", (Column("x", "double", nullable=False, low=0, high=4), Column("n", values=(1, 2))), key="s", time="t", step=3600, bucket_steps=2)


def test_every_problem_is_counted(spark):
    got = {(r["column"], r.rule): r.n for r in CONTRACT.check(frame(spark)).collect()}
    assert got == {("x", "null"): 1, ("x", "not finite"): 2, ("x", "below"): 1, ("x", "above"): 2, ("n", "not listed"): 1, ("t", "repeated"): 1, ("t", "off grid"): 2, ("t", "after a gap"): 1}
    with pytest.raises(ContractError) as e:
        CONTRACT.require(frame(spark))
    assert str(e.value).count("rows") == 8
    good = frame(spark, ROWS[:1])
    assert CONTRACT.require(good) is good


def test_structure_comes_from_the_schema_alone(spark):
    wanted = CONTRACT.extend("d", Column("gone"), Column("s", "int"))
    assert wanted.structure(frame(spark)) == [("gone", "missing"), ("s", "is string, not int")]
    with pytest.raises(ContractError, match="gone: missing; s: is string, not int"):
        wanted.route(frame(spark))
    for bad in (lambda: Column("x", low=2, high=1), lambda: Column(""), lambda: Contract("c", (Column("a"), Column("a"))), lambda: Contract("c", key="s"), lambda: Contract("c", step=5)):
        with pytest.raises(ValueError):
            bad()


def test_rows_are_routed_and_none_is_lost(spark):
    df = frame(spark).withColumn("broken_too", F.lit(1))
    good, bad = CONTRACT.route(df)
    assert good.columns == df.columns and good.count() == 1 and bad.count() == 5
    told = {(r.s, str(r.x)): list(r.broken) for r in bad.collect()}
    assert told["b", "-1.0"] == ["x: below"] and told["a", "inf"] == ["x: not finite", "x: above", "t: off grid"] and told[None, "5.0"] == ["x: above", "t: off grid"]
    assert sum("t: repeated" in b for b in told.values()) == 1
    assert CONTRACT.check(df.limit(0)).filter("n > 0").count() == 0 and Contract("e").check(df).count() == 0
    good, bad = Contract("e").route(df)
    assert good.count() == 6 and bad.count() == 0


def test_save_load_and_identity(spark, tmp_path):
    store, df = Store(spark, f"{tmp_path}/s"), spark.range(100).withColumn("x", F.col("id") * 2.5)
    with pytest.raises(ValueError, match="empty"):
        store.load()
    with pytest.raises(ValueError, match="identity"):
        store.save(df, {"model": ""})
    assert store.save(df, {"model": "m1", "data": "d"}) == 0
    pinned = store.load(identity={"model": "m1"})
    assert store.save(df.filter("id < 10"), {"model": "m2", "data": "d"}) == 1
    # readers of a version go on with it
    assert pinned.count() == 100 and store.load(0).count() == 100 and store.load().count() == 10
    with pytest.raises(IdentityError, match="model is 'm2', not 'm1'"):
        store.load(identity={"model": "m1", "data": "d"})
    with pytest.raises(ValueError, match="no version 7"):
        store.load(7)
    assert store.verify() and store.load().dtypes == df.dtypes


def test_a_crash_before_the_manifest_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store, df = Store(spark, f"{tmp_path}/s", ("id",)), spark.range(20)
    store.save(df, {"v": "1"})

    def dies(_):
        raise RuntimeError("gone")

    monkeypatch.setattr(store, "_commit", dies)
    for write in (lambda: store.save(df.limit(3), {"v": "2"}), lambda: store.append(spark.range(30), "b")):
        with pytest.raises(RuntimeError, match="gone"):
            write()
    monkeypatch.undo()
    again = Store(spark, f"{tmp_path}/s", ("id",))
    assert again.load().count() == 20 and again.manifest()["version"] == 0 and len(again.orphans()) == 2
    assert len(again.remove_orphans()) == 2 and again.orphans() == [] and again.load().count() == 20
    # the same batch after the crash
    assert again.append(spark.range(30), "b") == 1 and again.load().count() == 30


def test_appends_are_idempotent(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", ("t", "s"))
    rows = lambda a, b, v: spark.createDataFrame([(t, s, float(v)) for t in range(a, b) for s in ("x", None)], "t long, s string, v double")
    assert store.append(rows(0, 5, 1).unionByName(rows(0, 2, 1)), "one", {"feed": "f"}) == 0
    assert store.append(rows(3, 8, 2), "two", {"feed": "f"}) == 1
    assert store.append(rows(3, 8, 9), "two") == 1
    assert store.append(rows(20, 22, 3), "three") == 2
    with pytest.raises(IdentityError):
        store.append(rows(30, 31, 1), "four", {"feed": "other"})
    with pytest.raises(ValueError, match="columns differ"):
        store.append(rows(30, 31, 1).drop("v"), "four")
    got = {(r.t, r.s): r.v for r in store.load().collect()}
    assert len(got) == store.load().count() == 20 and got[4, None] == 1.0 and got[5, "x"] == 2.0
    assert [p["rows"] for p in store.manifest()["parts"]] == [10, 6, 4] and store.verify()
    assert store.append(rows(0, 0, 0), "none") == 3 and store.load().count() == 20
    with pytest.raises(ValueError, match="key"):
        Store(spark, f"{tmp_path}/k").append(rows(0, 1, 1), "b")


def test_a_manifest_is_never_overwritten(spark, tmp_path):
    one, two = (Store(spark, f"{tmp_path}/s") for _ in range(2))
    one.save(spark.range(5), {"v": "1"})
    taken = one.manifest() | {"version": 0}
    with pytest.raises(RuntimeError, match="written by another"):
        two._commit(taken)
    assert two.load().count() == 5
