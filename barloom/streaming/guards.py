"""Guards of a stream of bars, as state for each symbol.

The state of a symbol is the time and close of its last bar, the start of its present segment, the values of slower series that bars to come may need, and the last rows whose labels
are not known yet. A micro-batch's rows of a symbol are put in order of time and then

1. rejected where they are off the grid, have impossible prices, come late or come again;
2. repaired where high, low, volume or the taker's part contradict the rest;
3. preceded by flat bars at the last close where at most max_gap are missing. A wider gap is refused: the bar and all after it are rejected, until a restart; or, with restart, it begins a new segment;
4. given the last known value of each slower series at or before their time (each field on its own, so a null never hides an older value);
5. marked ready once a segment has enough rows from its first block boundary on;
6. followed by the labels that they make known: horizon rows after a bar, whether the high reached the barrier, with what the bar carried as context.

Everything is by numpy over a symbol's rows of a micro-batch; the state holds at most horizon rows and the slower series' values since the last bar. A value of a slower series that arrives after
the bar it belongs to counts for later bars only, as in any live system. Rows of one micro-batch are taken in order of time, not of arrival.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sources.bars import AMOUNTS, PRICES

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_MICROS = 1_000_000
_NULLABLE = {"at": "Int64", "entry_at": "Int64", "k": "Int64", "segment": "Int64", "y": "Int32", "ready": "boolean", "filled": "boolean", "repaired": "boolean"}


@dataclass(frozen=True)
class Guard:
    """step: seconds between bars. max_gap: missing bars that are made up. warmup: rows from the first block boundary (blocks of block rows, counted from anchor, in seconds since 1970) before the first that is ready.
    horizon, barrier: of the labels (0: none). snapshots: fields of the slower series; max_age: seconds after which a value is forgotten. context: columns of bars that their labels carry."""

    step: int = 3600
    max_gap: int = 120
    warmup: int = 1
    block: int = 1
    anchor: int = 0
    restart: bool = False
    horizon: int = 0
    barrier: float = 0.0
    snapshots: tuple[str, ...] = ()
    max_age: int | None = None
    context: tuple[str, ...] = ()

    def schema(self) -> str:
        bar = ", ".join(f"{c} double" for c in (*PRICES, *AMOUNTS, *self.snapshots, *self.context, "m_k"))
        return f"symbol string, kind string, reason string, at long, entry_at long, k long, segment long, ready boolean, filled boolean, repaired boolean, {bar}, y int"


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})")


def timestamp(at: str) -> Column:
    return F.expr(f"{_EPOCH} + make_dt_interval(0, 0, 0, cast({at} as decimal(27, 6)) / 1000000)")


def repaired(bars: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Prices and amounts that agree with one another, and which rows had to be changed."""
    was = {c: bars[c].to_numpy(float) for c in (*PRICES, *AMOUNTS)}
    now = dict(was)
    now["high"], now["low"] = np.maximum.reduce([was["high"], was["open"], was["close"]]), np.minimum.reduce([was["low"], was["open"], was["close"]])
    for c in AMOUNTS:
        now[c] = np.where(np.isfinite(was[c]), was[c], 0.0)
    now["volume"] = np.maximum(now["volume"], 0.0)
    now["taker_buy_base"] = np.minimum(now["taker_buy_base"], now["volume"])
    # what was missing differs from everything
    return now, np.logical_or.reduce([now[c] != was[c] for c in was])


def _last_known(known: list, at: np.ndarray, max_age: int | None) -> tuple[np.ndarray, list]:
    """Of (time, value) pairs in order, the last value at or before each time, and the pairs that later times may need."""
    times, values = np.array([t for t, _ in known], np.int64), np.array([v for _, v in known] + [np.nan])
    place = np.searchsorted(times, at, "right") - 1
    found = values[place]
    if max_age is not None and len(known):
        found = np.where((place >= 0) & (at - times[place] <= max_age * _MICROS), found, np.nan)
    return found, known[max(int(place.max(initial=-1)), 0) :]


def advance(state: dict, bars: pd.DataFrame, snapshots: pd.DataFrame, guard: Guard) -> pd.DataFrame:
    """Rows that new bars and snapshots (both with at) of one symbol make, in the schema without symbol; state is brought forward."""
    step = guard.step * _MICROS
    bars = bars.sort_values("at", kind="stable").reset_index(drop=True)
    at = bars["at"].fillna(-1).to_numpy(np.int64)
    prices = bars[list(PRICES)].to_numpy(float)
    reason = np.full(len(bars), None, object)
    reason[~(np.isfinite(prices) & (prices > 0)).all(axis=1)] = "price"
    reason[bars["at"].isna() | ((at - guard.anchor * _MICROS) % step != 0)] = "off grid"
    last = state.get("last")
    known = pd.isna(reason)
    if last is not None:
        reason[known & (at < last)], reason[known & (at == last)] = "late", "repeated"
        known = pd.isna(reason)
    again = np.zeros(len(bars), bool)
    again[known] = np.diff(at[known], prepend=-1) == 0
    reason[again] = "repeated"
    new = np.flatnonzero(pd.isna(reason))
    before = np.concatenate([[at[new[0]] - step if last is None else last], at[new][:-1]]) if len(new) else new
    missing = (at[new] - before) // step - 1
    wide = missing > guard.max_gap
    if wide.any() and not guard.restart:
        stop = int(wide.argmax())
        refused = np.arange(len(bars)) >= new[stop]
        reason[refused & (pd.isna(reason) | again)] = "gap"
        new, missing, before, wide = new[:stop], missing[:stop], before[:stop], wide[:stop]
    missing = np.where(wide, 0, missing)
    rejects = pd.DataFrame({"kind": "reject", "reason": reason, "at": bars["at"], **{c: bars[c].to_numpy(float) for c in (*PRICES, *AMOUNTS, *guard.context)}})[~pd.isna(reason)]

    values, changed = repaired(bars.iloc[new])
    # made-up bars come before the one that ends their gap
    of = np.repeat(np.arange(len(new)), missing + 1)
    behind = np.repeat(np.cumsum(missing + 1), missing + 1) - 1 - np.arange(len(of))
    filled = behind > 0
    out_at = at[new][of] - behind * step
    close_before = np.concatenate([[state.get("close", np.nan)], values["close"][:-1]])[of] if len(new) else values["close"]
    out = {c: np.where(filled, close_before, values[c][of]) for c in PRICES} | {c: np.where(filled, 0.0, values[c][of]) for c in AMOUNTS}
    starts = wide if last is not None or not len(new) else np.concatenate([[True], wide[1:]])
    segment = state.get("segment", -1) + np.cumsum(starts)[of]
    start = np.where(np.cumsum(starts) > 0, np.maximum.accumulate(np.where(starts, at[new], 0)), state.get("start", 0))[of]
    k = (out_at - start) // step
    offset = (-((start - guard.anchor * _MICROS) // step)) % guard.block
    out |= {"kind": "bar", "at": out_at, "k": k, "segment": segment, "filled": filled, "repaired": ~filled & changed[of], "ready": k + 1 - offset >= guard.warmup}
    for c in guard.context:
        out[c] = np.where(filled, np.nan, bars[c].to_numpy(float)[new][of])

    held = state.setdefault("held", {})
    for c in guard.snapshots:
        fresh = snapshots[["at", c]].dropna()
        pairs = sorted(held.get(c, []) + list(zip(fresh["at"].astype(np.int64).tolist(), fresh[c].astype(float).tolist())), key=lambda x: x[0])
        out[c], held[c] = _last_known(pairs, out_at, guard.max_age)
    out = pd.DataFrame(out)

    made = [rejects, out]
    if guard.horizon:
        columns = ["at", "k", "close", "high", *guard.context]
        path = pd.concat([pd.DataFrame(state.get("tail", []), columns=columns, dtype=float), out[columns].astype(float)], ignore_index=True)
        best = path["high"].rolling(guard.horizon).max().to_numpy()
        ends = np.flatnonzero(path["k"].to_numpy() >= guard.horizon)
        ends = ends[ends >= len(path) - len(out)]
        entry = ends - guard.horizon
        gain = np.log(best[ends] / path["close"].to_numpy()[entry])
        labels = {"kind": "label", "at": path["at"].to_numpy(np.int64)[ends], "entry_at": path["at"].to_numpy(np.int64)[entry], "segment": segment[ends - (len(path) - len(out))], "k": path["k"].to_numpy(np.int64)[entry], "m_k": gain, "y": (gain >= guard.barrier).astype(np.int32)}
        made.append(pd.DataFrame(labels | {c: path[c].to_numpy()[entry] for c in guard.context}))
        state["tail"] = path.tail(guard.horizon).to_numpy().tolist()
    if len(out):
        state |= {"last": int(out_at[-1]), "close": float(out["close"].iloc[-1]), "segment": int(segment[-1]), "start": int(start[-1])}
    return pd.concat([x for x in made if len(x)], ignore_index=True) if any(map(len, made)) else out


def guarded(bars: DataFrame, guard: Guard, snapshots: DataFrame | None = None) -> DataFrame:
    """The rows of guard.schema() that a stream of bars (symbol, ts, prices, amounts, context) and one of slower values (symbol, ts, fields) make.

    kind is bar, label or reject; at and entry_at are microseconds since 1970.
    """
    own, fields = (*PRICES, *AMOUNTS, *guard.context), guard.snapshots
    none = [F.lit(None).cast("double").alias(c) for c in fields]
    both = bars.select("symbol", micros("ts").alias("at"), F.lit(True).alias("is_bar"), *[F.col(c).cast("double").alias(c) for c in own], *none)
    if snapshots is not None:
        both = both.unionByName(snapshots.select("symbol", micros("ts").alias("at"), F.lit(False).alias("is_bar"), *[F.lit(None).cast("double").alias(c) for c in own], *[F.col(c).cast("double").alias(c) for c in fields]))
    names = [c.split()[0] for c in guard.schema().split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        state = json.loads(kept.get[0]) if kept.exists else {}
        is_bar = rows["is_bar"].to_numpy(bool)
        out = advance(state, rows[is_bar], rows[~is_bar], guard)
        kept.update((json.dumps(state),))
        # whole numbers and flags that not all kinds of rows have
        yield out.assign(symbol=key[0]).reindex(columns=names).astype(_NULLABLE)

    return both.groupBy("symbol").applyInPandasWithState(run, guard.schema(), "state string", "append", GroupStateTimeout.NoTimeout)
