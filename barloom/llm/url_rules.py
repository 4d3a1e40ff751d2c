"""Judge URLs by rules on hosts and paths.

A rule names a host, a start of a path and a verdict. It fits the URLs of its host and of all its subdomains whose paths start with its own. Every URL
is expanded into expressions: a suffix of its host (whole labels) and a prefix of its path. An expression's SHA-256 is looked up by its first PREFIX hexadecimal
digits in an equi-join with the rules, which are grouped by that prefix; full digests then confirm, and of the rules that fit the longest decides.

Expansion follows the rules' shapes (labels of the host, code points of the path), so a URL of a thousand labels has no more
expressions than there are shapes, and a rule whose path ends within a segment is found as well.

Precedence: the most code points of host and path together, then the longest host. Of rules with one host and path, which differ in the verdict only, the greatest verdict
by code points counts, so block beats allow.

Defined results: a URL that is null or has no `://` has an empty host and path; a URL no rule fits has a null rule and the default verdict; repeated rows and rows of equal or null page_id are
judged each; rules with a null host, path or verdict are left out; without rules every URL has the default verdict; an empty table gives an empty table; other columns are not read. Hosts of rules and URLs are
compared with A-Z in lower case, paths as they are.

Scale: page_id, host and path are written once with a number for each row, so that equal URLs are no group. Only expressions that meet a rule are shuffled by row, and
the last join is on the row's number. An expression that very many URLs share is spread over SALT copies of the rules, if Spark does not find these small enough to send to all tasks. Collected are
the distinct shapes, which host names (127 labels) and the lengths of the rules' paths bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, scope

#: Hexadecimal digits of a digest by which rules and expressions are joined.
PREFIX = 8
#: Copies of the rules among which the expressions are dealt.
SALT = 16
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query.
RULES = [("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK)]


def _lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def _digest(host: Column, path: Column) -> Column:
    # a line feed between them keeps host and path apart
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """One row for each host and path: digest, prefix, labels, chars, and as decision what orders and describes the rule."""
    known = rules.filter("host is not null and path is not null and verdict is not null").select(_lower(F.col("host")).alias("host"), "path", "verdict")
    one = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    size = lambda c: F.length(c)
    decision = F.struct((size("host") + size("path")).alias("length"), size("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict")
    digest = _digest(F.col("host"), F.col("path"))
    return one.select(digest.alias("digest"), F.substring(digest, 1, PREFIX).alias("prefix"), _labels(F.col("host")).alias("labels"), size("path").alias("chars"), decision.alias("decision"))


def _expressions(shapes: list[tuple[int, int]], host: Column, path: Column) -> Column:
    """Digests of the host suffixes and path prefixes of these shapes that a URL has."""
    every = F.array(*[F.struct(F.lit(labels).alias("labels"), F.lit(chars).alias("chars")) for labels, chars in shapes])
    has = F.filter(every, lambda s: (_labels(host) >= s["labels"]) & (F.length(path) >= s["chars"]))
    return F.transform(has, lambda s: _digest(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substr(path, F.lit(1), s["chars"])))


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, salt: int = SALT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url), as a stored table; rules: host, path, verdict."""
    with scope(pages.sparkSession) as kept:
        judged = materialize(_judged(pages, rules, default, salt))
        kept.append(judged)
    return judged


def _judged(pages: DataFrame, rules: DataFrame, default: str, salt: int) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = materialize(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path")))
    table = materialize(rule_table(rules))
    shapes = sorted((r.labels, r.chars) for r in table.select("labels", "chars").distinct().collect())
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    asked = rows.select("row", F.explode(_expressions(shapes, F.col("host"), F.col("path"))).alias("digest"))
    asked = asked.select("row", "digest", F.substring("digest", 1, PREFIX).alias("prefix"), F.pmod(F.xxhash64("row"), F.lit(salt)).alias("copy"))
    candidates = table.groupBy("prefix").agg(F.collect_list(F.struct("digest", "decision")).alias("rules"))
    candidates = candidates.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    # the rules of a prefix that have the whole digest: one, or none where only the prefix agrees
    fits = asked.join(candidates, ["prefix", "copy"]).select("row", F.explode(F.filter("rules", lambda r: r["digest"] == F.col("digest"))).alias("fit"))
    best = fits.groupBy(F.col("row").alias("of_row")).agg(F.max("fit.decision").alias("best"))
    judged = rows.join(best, F.col("row") == F.col("of_row"), "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH cut AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_host, rule_path, verdict) AS (VALUES {_VALUES})
SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, coalesce(arg_max(verdict, length(rule_host || rule_path)), '{ALLOW}') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY r, page_id, host, path"""
