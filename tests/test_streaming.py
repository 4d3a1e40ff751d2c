"""A stream of bar files gives the features that a batch gives, whatever comes late or twice."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import features, labels
from barloom.sources import bars as source
from barloom.streaming.guards import Guard, advance
from barloom.streaming.session import read_rows, stream_features

SF = "/root/testdata/sf0.001"
COLUMNS = ["symbol", "ts", "k", "open", "high", "low", "close", "volume", "quote_volume", "num_trades", "taker_buy_base"]


def test_stream_equals_batch(spark, tmp_path):
    bars = source.hourly(spark, SF).filter("symbol in ('click', 'view') and k < 90").select(*COLUMNS).cache()
    parts = [bars.filter(F.col("k").between(a, b)) for a, b in ((0, 29), (30, 59))] + [bars.filter("k between 55 and 89 or k = 3")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    families, windows = ["rolling", "candle", "flow"], (5, 10)
    stream_features(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", families, windows).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/features").drop("batch").toPandas().sort_values(["symbol", "k"]).reset_index(drop=True)
    whole, names = features.add_features(source.base_series(bars), families, windows)
    want = whole.select("symbol", "ts", "k", *names).toPandas().sort_values(["symbol", "k"]).reset_index(drop=True)
    assert len(got) == len(want) == 180
    for c in names:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True, atol=1e-9), c
    rejects = spark.read.parquet(f"{tmp_path}/out/rejects").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in rejects} == {"late": 10, "repeated": 2}


def by_row(feed, guard):
    """Bars (with segment and k), rejects and labels of one symbol, one row at a time; feed: dictionaries in order."""
    step, out, rejects = guard.step, [], []
    last, segment, held = None, 0, {}
    for r in feed:
        if r["side"] == "slower":
            held[r["at"]] = r["rate"]
            continue
        if r["at"] % step:
            rejects.append((r["at"], "off grid"))
        elif not all(np.isfinite(r[c]) and r[c] > 0 for c in ("open", "high", "low", "close")):
            rejects.append((r["at"], "price"))
        elif last and r["at"] <= last["at"]:
            rejects.append((r["at"], "repeated" if r["at"] == last["at"] else "late"))
        else:
            missing = (r["at"] - last["at"]) // step - 1 if last else 0
            if missing > guard.max_gap:
                if not guard.restart or segment is None:
                    segment = None
                    rejects.append((r["at"], "gap"))
                    continue
                segment, missing = segment + 1, 0
                start = r["at"]
            if segment is None:
                rejects.append((r["at"], "gap"))
                continue
            start = r["at"] if last is None else start
            price = last["close"] if last else None
            for n in range(missing):
                out.append({"at": last["at"] + (n + 1) * step, "high": price, "close": price, "volume": 0.0, "filled": True, "segment": segment, "start": start})
            volume = max(r["volume"], 0.0) if np.isfinite(r["volume"]) else 0.0
            out.append({"at": r["at"], "high": max(r["high"], r["open"], r["close"]), "close": r["close"], "volume": volume, "filled": False, "segment": segment, "start": start})
            last = r
    for b in out:
        b["k"] = (b["at"] - b["start"]) // step
        known = [t for t in held if t <= b["at"]]
        b["rate"] = held[max(known)] if known and b["at"] - max(known) <= guard.max_age else None
    labels = []
    for i, b in enumerate(out):
        ahead = [x for x in out[i + 1 : i + 1 + guard.horizon] if x["segment"] == b["segment"]]
        if len(ahead) == guard.horizon:
            gain = math.log(max(x["high"] for x in ahead) / b["close"])
            labels.append((b["at"], ahead[-1]["at"], round(gain, 9), int(gain >= guard.barrier)))
    return out, rejects, labels


@pytest.mark.parametrize("seed", range(12))
def test_guard_against_one_row_at_a_time(seed):
    rng = np.random.default_rng(seed)
    guard = Guard(step=60, max_gap=3, restart=seed % 3 > 0, horizon=4, barrier=0.05, snapshots=("rate",), max_age=600, warmup=5, block=3)
    feed, at = [], 6_000
    for _ in range(120):
        at += int(rng.choice([60, 60, 60, 120, 240, 300 if rng.random() < 0.15 else 60, 0 if feed else 60]))
        close = float(np.exp(rng.normal() / 20))
        bar = {"side": "bar", "at": at + int(rng.choice([0] * 30 + [7])), "open": close * 1.01, "high": close * float(rng.choice([1.05, 0.9])), "low": close * 0.99, "close": close, "volume": float(rng.choice([5.0, -1.0, np.nan])), "rate": None}
        bar["close"] = float(rng.choice([close] * 20 + [0.0, np.nan]))
        feed.append(bar)
        if rng.random() < 0.3:
            feed.append({"side": "slower", "at": at + int(rng.integers(0, 50)), "rate": float(rng.integers(100))})
    # micro-batches are in order of time within; what is late comes at the start of a later one
    feed.sort(key=lambda r: (r["at"], r["side"] == "bar"))
    cuts = sorted(rng.choice(len(feed), 6, replace=False).tolist())
    batches = [feed[a:b] for a, b in zip([0, *cuts], [*cuts, len(feed)])]
    for n in range(1, len(batches)):
        bars = [r for r in batches[n - 1] if r["side"] == "bar"]
        batches[n] = bars[-1:] + bars[:1] + batches[n]
    batches = [sorted(b, key=lambda r: r["at"]) for b in batches]
    columns = ["at", "open", "high", "low", "close", "volume"]
    state, made = {}, []
    for b in batches:
        bars = pd.DataFrame([r for r in b if r["side"] == "bar"], columns=[*columns, "quote_volume", "num_trades", "taker_buy_base"])
        slower = pd.DataFrame([r for r in b if r["side"] == "slower"], columns=["at", "rate"])
        bars["at"], slower["at"] = bars["at"] * 1_000_000, slower["at"] * 1_000_000
        made.append(advance(state, bars, slower, guard))
        state = json.loads(json.dumps(state))
    made = pd.concat(made)
    want, rejects, labels = by_row([r for b in batches for r in b], guard)
    got = made[made["kind"] == "bar"]
    seconds = lambda x: (x.astype("int64") // 1_000_000).tolist()
    assert seconds(got["at"]) == [b["at"] for b in want]
    for c in ("high", "close", "volume", "filled", "segment", "k"):
        assert got[c].tolist() == [b[c] for b in want], c
    assert got["rate"].astype(object).where(got["rate"].notna(), None).tolist() == [b["rate"] for b in want]
    assert got["ready"].tolist() == [b["k"] + 1 - (-(b["start"] // 60)) % 3 >= 5 for b in want]
    refused = made[made["kind"] == "reject"]
    assert sorted(zip(seconds(refused["at"]), refused["reason"])) == sorted(rejects) and rejects
    known = made[made["kind"] == "label"]
    assert (list(zip(seconds(known["entry_at"]), seconds(known["at"]), known["m_k"].round(9).tolist(), known["y"].astype(int).tolist())) if len(known) else []) == labels


def test_restarted_stream_equals_batch(spark, tmp_path):
    raw = source.clean(source.to_bars(source.trades(spark, SF))).filter("symbol in ('click', 'view') and ts < '2024-01-08'")
    raw = raw.filter(F.hour("ts") % 7 != 2).withColumn("p", F.hour("ts") / 24).cache()
    slower = raw.filter(F.hour("ts") % 5 == 1).select("symbol", (F.col("ts") + F.expr("interval 90 minutes")).alias("ts"), F.col("volume").alias("rate"))
    guard = Guard(horizon=5, barrier=0.3, snapshots=("rate",), context=("p",), warmup=20)
    ends = ["2024-01-01", "2024-01-03", "2024-01-05", "2024-01-06", "2024-01-08"]
    for a, b in zip(ends, ends[1:]):
        for df, name in ((raw, "bars"), (slower, "slower")):
            df.filter((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        if b in ("2024-01-05", "2024-01-08"):
            # the first run ends here; the second goes on from its checkpoint
            stream_features(spark, f"{tmp_path}/bars", f"{tmp_path}/out", f"{tmp_path}/cp", ["rolling"], (5, 10), guard=guard, snapshots_dir=f"{tmp_path}/slower").awaitTermination()
    got = read_rows(spark, f"{tmp_path}/out", "bar")
    want = source.fill_grid(raw.drop("p"))
    want = source.as_of(want, slower, ["rate"])
    for frame in ("got", "want"):
        df = {"got": got, "want": want}[frame].select("symbol", "ts", "k", "filled", "close", "volume", "rate").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
        df["k"] = df["k"].astype("int64")
        got, want = (df, want) if frame == "got" else (got, df)
    pd.testing.assert_frame_equal(got, want)
    assert want["filled"].sum() > 20
    labelled = labels.barrier_labels(source.fill_grid(raw.drop("p")), 5, 0.3).filter("y is not null").toPandas().sort_values(["symbol", "ts"])
    told = read_rows(spark, f"{tmp_path}/out", "label").toPandas().sort_values(["symbol", "entry_ts"])
    assert told["entry_ts"].tolist() == labelled["ts"].tolist() and told["y"].tolist() == labelled["y"].astype(int).tolist()
    assert np.allclose(told["m_k"].to_numpy(float), labelled["m_k"].to_numpy(float))
    made = spark.read.parquet(f"{tmp_path}/out/features").toPandas().sort_values(["symbol", "k"]).reset_index(drop=True)
    whole, names = features.add_features(source.base_series(source.fill_grid(raw.drop("p"))), ["rolling"], (5, 10))
    whole = whole.filter("k >= 19").toPandas().sort_values(["symbol", "k"]).reset_index(drop=True)
    assert len(made) == len(whole) > 200
    for c in names:
        assert np.allclose(made[c].to_numpy(float), whole[c].to_numpy(float), equal_nan=True, atol=1e-9), c


def test_wide_gap_is_refused_until_a_restart():
    bar = lambda at: {"at": at * 60_000_000, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0, "quote_volume": 1.0, "num_trades": 1.0, "taker_buy_base": 0.0}
    bars = pd.DataFrame([bar(t) for t in (1, 2, 9, 10)])
    none = pd.DataFrame({"at": []})
    out = advance({}, bars, none, Guard(step=60, max_gap=5))
    assert out["kind"].tolist() == ["reject", "reject", "bar", "bar"] and set(out["reason"].dropna()) == {"gap"}
    out = advance({}, bars, none, Guard(step=60, max_gap=6))
    assert (out["kind"] == "bar").all() and len(out) == 10 and out["filled"].sum() == 6
    out = advance({}, bars, none, Guard(step=60, max_gap=5, restart=True))
    assert out["segment"].tolist() == [0, 0, 1, 1] and out["k"].tolist() == [0, 1, 0, 1]
