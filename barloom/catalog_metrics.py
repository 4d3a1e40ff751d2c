"""Queries of mergeable metrics and of adaptive windowing, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.catalog import _r, query, rounded
from barloom.catalog_strategy import _REPLICATES, _SEED, _UNC, _WINDOWED, _drawn_sql, _edges, _uncertain
from barloom.operators import adwin, metrics, permutation
from barloom.sources import bars as bar_source

#: What acting on scores of 0.5 and more brings, at odds of 1: a user's own metric.
metrics.register_metric("gain", lambda: {"taken": F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0), "won": F.when(F.col("p") >= 0.5, F.col("y")).otherwise(0)}, lambda get: (2 * get("won") - get("taken")) / get("n"))
_ALL = ["brier", "logloss", "ece", "gain", "auc", "ap"]
_FEW = ["brier", "gain", "auc"]
#: Added before rounding on both sides, as scores of three digits give halves of the last digit that is kept.
_NUDGE = 1e-9


def _near_both(df: DataFrame, names: list[str]) -> DataFrame:
    return rounded(df.withColumns({c: F.col(c) + _NUDGE for c in names}))


def _metric_sql(table: str, by: list[str], names: list[str], out: str = "ev", weight: str = "1") -> str:
    """CTEs that end in out: by, n, n_pos, base_rate and the metrics of a table (p, y)."""
    keys = ", ".join(by) + ", " if by else ""
    over, same = f"PARTITION BY {', '.join(by)} " if by else "", " AND ".join(f"g.{c} IS NOT DISTINCT FROM o.{c}" for c in by) or "true"
    clipped = "greatest(least(p, 1 - 1e-15), 1e-15)"
    sums = {
        "brier": f"sum({weight} * pow(p - y, 2)) / sum({weight})",
        "logloss": f"sum(-{weight} * (y * ln({clipped}) + (1 - y) * ln(1 - {clipped}))) / sum({weight})",
        "ece": "(" + " + ".join(f"coalesce(abs(sum({weight} * (p - y)) FILTER (least(floor(p * 10), 9) = {b})), 0)" for b in range(10)) + f") / sum({weight})",
        "gain": f"coalesce(sum({weight} * (2 * y - 1)) FILTER (p >= 0.5), 0) / sum({weight})",
    }
    ordered = {"auc": "sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg))", "ap": "sum(pos * tp / (tp + fp)) / sum(pos)"}
    plain = "".join(f", {sums[n]} AS {n}" for n in names if n in sums)
    return f"""{out}_g AS (SELECT {keys}count(*) AS n, sum({weight} * y) AS n_pos, sum({weight} * y) / sum({weight}) AS base_rate, sum({weight} * (1 - y)) AS n_neg{plain} FROM {table} GROUP BY ALL),
    {out}_s AS (SELECT {keys}p, sum({weight} * y) AS pos, sum({weight} * (1 - y)) AS neg FROM {table} GROUP BY ALL),
    {out}_r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {out}_s WINDOW w AS ({over}ORDER BY p DESC)),
    {out}_o AS (SELECT {keys}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {ordered["auc"]} END AS auc, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {ordered["ap"]} END AS ap FROM {out}_r GROUP BY ALL),
    {out} AS (SELECT {", ".join(f"g.{c}" for c in by) + ", " if by else ""}n, n_pos, base_rate, {", ".join(f"CASE WHEN n_pos > 0 AND n_neg > 0 THEN {n} END AS {n}" for n in names)} FROM {out}_g g JOIN {out}_o o ON {same})"""


def _banded_sql(table: str, by: list[str], names: list[str], least: int, pos: int) -> str:
    """The select of with_bands() of a table that has doc_id."""
    keys = ", ".join(by)
    same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in by)
    return f"""{_metric_sql(table, by, names)}, pts AS (SELECT * FROM ev WHERE n >= {least} AND n_pos >= {pos} AND n_pos < n),
    kept AS (SELECT t.* FROM {table} t JOIN pts ON {same("t", "pts")}), {_drawn_sql(table="kept")}, {_metric_sql("dr", [*by, "replicate"], names, "bs", "w")},
    cut AS (SELECT {keys}, count({names[0]}) AS n_effective, {", ".join(f"quantile_cont({n}, {q}) AS {n}_{end}" for n in names for end, q in (("low", "0.025::DOUBLE"), ("high", "0.975::DOUBLE")))} FROM bs GROUP BY {keys})
    SELECT {", ".join(f"pts.{c}" for c in by)}, n, CAST(n_pos AS BIGINT) AS n_pos, {_r(f"base_rate + {_NUDGE}")} AS base_rate, {", ".join(f"{_r(f'{n} + {_NUDGE}')} AS {n}" for n in names)}, n_effective,
    {", ".join(f"{_r(f'{n}_{end} + {_NUDGE}')} AS {n}_{end}" for n in names for end in ("low", "high"))} FROM pts JOIN cut ON {same("pts", "cut")}"""


def _plain(name: str, by: tuple[str, ...]) -> None:
    keys = ", ".join(by) + ", " if by else ""

    @query(name, f"WITH {_UNC}, {_metric_sql('un', list(by), _ALL)} SELECT {keys}n, CAST(n_pos AS BIGINT) AS n_pos, {', '.join(f'{_r(f'{c} + {_NUDGE}')} AS {c}' for c in ('base_rate', *_ALL))} FROM ev")
    def run(spark, sf_dir: str) -> DataFrame:
        return _near_both(metrics.evaluate(_uncertain(spark, sf_dir), _ALL, by), ["base_rate", *_ALL])


_plain("metrics_whole", ())
_plain("metrics_by_group", ("lang",))
_BANDED = ["base_rate", *_FEW, *[f"{m}_{end}" for m in _FEW for end in ("low", "high")]]


@query("metrics_by_regime", f"WITH {_UNC}, parts AS (SELECT *, CAST(len(list_filter({_edges('regime', 3)}, lambda e: regime > e)) AS INTEGER) AS part FROM un), {_banded_sql('parts', ['part'], _FEW, 10, 2)}")
def metrics_by_regime(spark, sf_dir: str) -> DataFrame:
    return _near_both(metrics.by_regime(_uncertain(spark, sf_dir), "regime", _FEW, "doc_id", _REPLICATES, seed=_SEED, min_rows=10, min_pos=2), _BANDED)


@query("metrics_rolling", f"WITH {_UNC}{_WINDOWED}, {_banded_sql('wi', ['window_start', 'window_end'], _FEW, 8, 2)}")
def metrics_rolling(spark, sf_dir: str) -> DataFrame:
    return _near_both(metrics.rolling(_uncertain(spark, sf_dir), "ts", 3, 1, _FEW, "doc_id", _REPLICATES, seed=_SEED, min_rows=8, min_pos=2), _BANDED)


_BLOCKS, _REPEATS, _FEATURES = 8, 3, ("a", "b")


def _place(kind: str, part: str, own: str) -> str:
    u = f"""('0x' || substr(md5('42|' || f || '|' || r || '|' || doc_id), 1, 8))::BIGINT"""
    return f"SELECT '{kind}' AS mode, f, r, y, a, b, {part} AS part, {own} AS own, row_number() OVER (PARTITION BY f, r, {part} ORDER BY {u}) AS taken FROM spread"


@query(
    "audit_permutation",
    f"""WITH {_UNC}, nb AS (SELECT y, p AS a, unc AS b, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM un),
    spread AS (SELECT *, i * {_BLOCKS} // n AS blk FROM nb, (SELECT unnest({list(_FEATURES)}) AS f), (SELECT unnest(range({_REPEATS})) AS r)),
    placed AS ({_place("within", "blk", "i - CAST(ceil(blk * n / " + str(_BLOCKS) + ".0) AS BIGINT) + 1")} UNION ALL {_place("across", "-1", "i + 1")}),
    dealt AS (SELECT x.mode, x.f AS feature, x.r AS replicate, x.y, 0.7 * CASE WHEN x.f = 'a' THEN g.a ELSE x.a END + 0.3 * CASE WHEN x.f = 'b' THEN g.b ELSE x.b END AS p
      FROM placed x JOIN placed g ON x.mode = g.mode AND x.f = g.f AND x.r = g.r AND x.part = g.part AND x.own = g.taken),
    whole AS (SELECT y, 0.7 * a + 0.3 * b AS p FROM nb), {_metric_sql("whole", [], ["auc"], "base")}, {_metric_sql("dealt", ["feature", "mode", "replicate"], ["auc"])},
    dr AS (SELECT feature, mode, base.auc - ev.auc AS loss FROM ev, base)
    SELECT feature, {", ".join(f"{_r(f'{fn}(loss) FILTER (mode = {chr(39)}{m}{chr(39)})')} AS drop_{m}_{n}" for m in ("within", "across") for n, fn in (("mean", "avg"), ("std", "stddev_pop")))} FROM dr GROUP BY 1""",
)
def audit_permutation(spark, sf_dir: str) -> DataFrame:
    df = _uncertain(spark, sf_dir).select("doc_id", "y", F.col("p").alias("a"), F.col("unc").alias("b"))
    made = permutation.block_importance(df, list(_FEATURES), 0.7 * F.col("a") + 0.3 * F.col("b"), "doc_id", "auc", _BLOCKS, _REPEATS)
    return rounded(made.drop("ratio"))


@query("drift_adwin")
def drift_adwin(spark, sf_dir: str) -> DataFrame:
    """Alarms in the log volume of every symbol's bars. No SQL expresses the histogram; the detector is tested against a plain one."""
    return adwin.adwin(bar_source.hourly(spark, sf_dir), "symbol", "k", F.ln(F.col("volume") + 1), clock=8)
