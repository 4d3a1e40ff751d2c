"""Queries of feature health, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.catalog import _BASE, BLOCK, _r, query, rounded
from barloom.operators import health
from barloom.sources import bars as bar_source

#: Columns by family: as made, imputed, constant, missing throughout, and missing at the end.
_COLUMNS = {"ret__own": "r", "ret__filled": "coalesce(r, 0)", "range__own": "rho", "range__late": "CASE WHEN k < 600 THEN rho END", "vol__own": "logvol", "cost__flat": "CAST(2.5 AS DOUBLE)", "cost__none": "CAST(NULL AS DOUBLE)", "ofi__own": "ofi", "ofi__step": "CASE WHEN k < 200 THEN ofi ELSE 3 + ofi END"}


def _features(spark, sf_dir: str) -> DataFrame:
    base = bar_source.base_series(bar_source.hourly(spark, sf_dir))
    return base.select("symbol", "k", *[F.expr(x).alias(c) for c, x in _COLUMNS.items()], F.when(F.col("r").isNull(), 1).otherwise(0).alias("undef__ret__filled"))


_LONG = " UNION ALL ".join(f"SELECT symbol, k, '{c}' AS name, {x} AS x, {'CASE WHEN r IS NULL THEN 1.0 ELSE 0.0 END' if c == 'ret__filled' else '0.0'} AS undef FROM x" for c, x in _COLUMNS.items())
_HEALTH = f"""{_BASE}, lo AS ({_LONG}),
ends AS (SELECT symbol, name, count(*) AS n, count(x) AS n_valid, min(k) AS k0, max(k) AS k1, min(k) FILTER (x IS NOT NULL) AS a, max(k) FILTER (x IS NOT NULL) AS b FROM lo GROUP BY 1, 2),
gaps AS (SELECT symbol, name, count(*) AS len FROM (SELECT l.symbol, l.name, l.k - row_number() OVER (PARTITION BY l.symbol, l.name ORDER BY l.k) AS island FROM lo l JOIN ends e ON l.symbol = e.symbol AND l.name = e.name WHERE x IS NULL AND l.k > a AND l.k < b) GROUP BY symbol, name, island),
runs AS (SELECT symbol, name, count(*) AS n_runs, max(len) AS longest FROM gaps GROUP BY 1, 2),
patterns AS (
  SELECT e.symbol, e.name, n, n_valid, n - n_valid AS n_null, CASE WHEN a IS NULL THEN n ELSE a - k0 END AS n_leading, CASE WHEN a IS NULL THEN n ELSE k1 - b END AS n_trailing, coalesce(n_runs, 0) AS n_runs, coalesce(longest, 0) AS longest_run,
         CASE WHEN n_valid = n THEN 'clean' WHEN n_valid = 0 THEN 'all_missing' WHEN coalesce(n_runs, 0) > 0 THEN 'scattered' WHEN a > k0 AND b < k1 THEN 'edge' WHEN a > k0 THEN 'leading' ELSE 'trailing' END AS pattern
  FROM ends e LEFT JOIN runs r ON e.symbol = r.symbol AND e.name = r.name),
mo AS (SELECT symbol, name, avg(undef) AS undef_rate, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS low, max(x) AS high, quantile_cont(abs(x), 0.5) FILTER (x <> 0) AS middle FROM lo GROUP BY 1, 2),
sk AS (SELECT l.symbol, l.name, CASE WHEN any_value(std) > 0 THEN avg(pow(x - mean, 3)) / pow(any_value(std), 3) END AS skew FROM lo l JOIN mo ON l.symbol = mo.symbol AND l.name = mo.name GROUP BY 1, 2),
th AS (SELECT symbol, name, min(c) AS least, max(m) - min(m) AS gap, min(s) AS s_low, max(s) AS s_high FROM (
  SELECT l.symbol, l.name, least((k - k0) // (n // 3), 2) AS part, count(x) AS c, avg(x) AS m, stddev_pop(x) AS s FROM lo l JOIN ends e ON l.symbol = e.symbol AND l.name = e.name GROUP BY 1, 2, 3) GROUP BY 1, 2),
he AS (
  SELECT p.*, undef_rate, mean, std, low, high, skew, split_part(p.name, '__', 1) AS family, n_null / n AS missing_rate, coalesce(n_valid > 1 AND std < 1e-12, false) AS is_constant,
         CASE WHEN n_valid >= 2 AND middle > 0 THEN greatest(abs(low), abs(high)) / middle ELSE 0 END AS outlier_ratio,
         CASE WHEN n_valid > 1 AND std >= 1e-12 AND n >= 30 AND least >= 2 THEN gap / std ELSE 0 END AS mean_drift, CASE WHEN n_valid > 1 AND std >= 1e-12 AND n >= 30 AND least >= 2 THEN s_high / s_low ELSE 1 END AS std_ratio
  FROM patterns p JOIN mo ON p.symbol = mo.symbol AND p.name = mo.name JOIN sk ON p.symbol = sk.symbol AND p.name = sk.name JOIN th ON p.symbol = th.symbol AND p.name = th.name),
hs AS (SELECT *, is_constant AND undef_rate > 0.5 AS is_imputed_constant, outlier_ratio > 1e4 AS is_extreme_outlier, mean_drift > 1 OR std_ratio > 100 AS is_non_stationary FROM he)"""


@query("health_patterns", f"WITH {_HEALTH} SELECT symbol, name, n, n_valid, n_null, n_leading, n_trailing, n_runs, longest_run, pattern FROM patterns")
def health_patterns(spark, sf_dir: str) -> DataFrame:
    made = health.missing_patterns(_features(spark, sf_dir), list(_COLUMNS), block_rows=BLOCK)
    return made.drop("n_nan", "n_inf")


_NUMBERS = ("missing_rate", "undef_rate", "mean", "std", "skew", "outlier_ratio", "mean_drift", "std_ratio")


@query("health_features", f"WITH {_HEALTH} SELECT symbol, name, family, pattern, {', '.join(f'{_r(c)} AS {c}' for c in _NUMBERS)}, is_constant, is_imputed_constant, is_extreme_outlier, is_non_stationary FROM hs")
def health_features(spark, sf_dir: str) -> DataFrame:
    made = health.feature_health(_features(spark, sf_dir), list(_COLUMNS), block_rows=BLOCK)
    return rounded(made.select("symbol", "name", "family", "pattern", *_NUMBERS, "is_constant", "is_imputed_constant", "is_extreme_outlier", "is_non_stationary"))


@query(
    "health_families",
    f"""WITH {_HEALTH} SELECT family, count(*) AS n_features, {_r('avg(undef_rate)')} AS avg_undef_rate, {_r('max(missing_rate)')} AS max_missing_rate, count(*) FILTER (pattern = 'scattered') AS n_scattered, count(*) FILTER (is_imputed_constant) AS n_imputed_constant,
    count(*) FILTER (is_constant AND NOT is_imputed_constant) AS n_organic_constant, count(*) FILTER (is_non_stationary) AS n_non_stationary, {_r('avg(std)')} AS avg_std, {_r('avg(abs(skew))')} AS avg_abs_skew FROM hs GROUP BY 1""",
)
def health_families(spark, sf_dir: str) -> DataFrame:
    made = health.summarize_by_family(health.feature_health(_features(spark, sf_dir), list(_COLUMNS), block_rows=BLOCK))
    return rounded(made.select("family", "n_features", "avg_undef_rate", "max_missing_rate", "n_scattered", "n_imputed_constant", "n_organic_constant", "n_non_stationary", "avg_std", "avg_abs_skew"))


@query(
    "health_issues",
    f"""WITH {_HEALTH}, i AS (SELECT symbol, name, CASE WHEN pattern = 'scattered' THEN 'scattered_missing' WHEN pattern = 'all_missing' THEN 'all_missing' WHEN is_extreme_outlier THEN 'extreme_outlier' WHEN is_imputed_constant THEN 'imputed_constant'
    WHEN is_non_stationary THEN 'non_stationary' WHEN is_constant THEN 'organic_constant' WHEN undef_rate > 0.5 THEN 'high_undef' WHEN abs(skew) > 20 THEN 'heavy_skew' END AS issue FROM hs) SELECT * FROM i WHERE issue IS NOT NULL""",
)
def health_issues(spark, sf_dir: str) -> DataFrame:
    return health.flag_issues(health.feature_health(_features(spark, sf_dir), list(_COLUMNS), block_rows=BLOCK)).select("symbol", "name", "issue")
