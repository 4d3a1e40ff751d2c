"""Line dedup by a log-template tree.

A fixed-depth tree parses every non-blank line: first level its number of tokens, next levels its leading tokens (those
with a digit become the wildcard). In a leaf, the support of a token at a position is the number of documents (of distinct lines) that carry it
there. A line's template keeps the tokens of its best supported positions, min_constant of them, if each has the support of min_docs documents; all others are
variable fields and become wildcards. Every constant of a template has at least the support of all its documents together, a value of a variable
field only a part of it, so fields go before constants whatever the size of the table. A template that occurs in at least min_docs
documents is recurring, and its lines are dropped everywhere but in the document with the smallest doc_id that has it,
so that no passage vanishes from the corpus. More documents of a template alone in its leaf never make it less recurring; those of another template in the leaf may.

Defined results: null text stays null and has no lines; blank lines are never templates and are kept, except that a text
all of whose other lines go becomes empty; repeated rows each lose the same lines (the smallest doc_id keeps them in
each of its rows); an empty table gives an empty table; further columns pass through, whatever their names.

Scale: lines are counted per leaf first, by hashes of 8 bytes, and only lines in leaves of at least min_docs documents
are looked at closely, each distinct line once with its number of documents. Texts are shuffled once, to meet the
numbers of the lines that they lose. What a line is joined with (its template, its keeper) is a written table of distinct keys, so that AQE can split the
lines of a hot one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_text import SEPARATOR, words
from .storage import materialize, scope, whole_rows

#: Documents that must share a template (and, in a leaf, a constant token).
MIN_DOCS = 10
#: Levels of leading tokens under the level of token counts.
DEPTH = 3
#: Share of a template's positions that are constants.
MIN_CONSTANT = 0.6
WILDCARD = "<*>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _row_key() -> Column:
    return F.xxhash64("text")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(token)


def line_table(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, row_key, line_no, line_text, line (hash of the tokens) and leaf (hash of the path) of non-blank lines."""
    exploded = docs.filter(F.col("text").isNotNull()).select("doc_id", _row_key().alias("row_key"), F.posexplode(_lines(F.col("text"))).alias("line_no", "line_text"))
    rows = exploded.withColumn("tokens", words(F.col("line_text"))).filter(F.size("tokens") > 0)
    leaf = F.xxhash64(F.size("tokens"), *[_masked(F.get("tokens", F.lit(i))) for i in range(depth)])
    return rows.select("doc_id", "row_key", "line_no", "line_text", F.xxhash64("tokens").alias("line"), leaf.alias("leaf"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """doc_id, row_key, line_no, template of the lines of recurring templates, with keeper: the doc_id that keeps them."""
    lines = line_table(docs, depth)
    # a null doc_id is one document
    per_leaf = lines.groupBy("leaf", "doc_id").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.sum("one").alias("docs"))
    leaves = per_leaf.filter(F.col("docs") >= min_docs).select(F.col("leaf").alias("busy_leaf"))
    close = materialize(lines.join(materialize(leaves), F.col("leaf") == F.col("busy_leaf")).drop("busy_leaf"))
    # every distinct line of a leaf once, with the number of its documents
    distinct = close.groupBy("leaf", "line", "doc_id").agg(F.any_value("line_text").alias("line_text")).groupBy("leaf", "line").agg(F.any_value("line_text").alias("line_text"), F.count("*").alias("docs"))
    distinct = materialize(distinct.select("leaf", "line", "docs", words(F.col("line_text")).alias("tokens")))
    placed = distinct.select("leaf", "line", "docs", F.posexplode("tokens").alias("at", "token"))
    constant = placed.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support")).filter(F.col("support") >= min_docs)
    constant = materialize(constant.select(F.col("leaf").alias("c_leaf"), F.col("at").alias("c_at"), F.col("token").alias("c_token"), "support"))
    known = placed.join(constant, (F.col("leaf") == F.col("c_leaf")) & (F.col("at") == F.col("c_at")) & (F.col("token") == F.col("c_token")))
    fixed = known.groupBy("leaf", "line").agg(F.collect_list(F.struct((-F.col("support")).alias("rank"), "at", "token")).alias("fixed"), F.count("*").alias("n_fixed"))
    need = F.ceil(min_constant * F.col("n")).cast("int")
    templates = distinct.select("leaf", "line", F.size("tokens").alias("n")).join(fixed, ["leaf", "line"]).filter(F.col("n_fixed") >= need)
    # the best supported constants, in order of position, name the template within its leaf, which fixes the token count
    best = F.array_sort(F.transform(F.slice(F.array_sort("fixed"), F.lit(1), need), lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"))))
    templates = materialize(templates.select("leaf", "line", F.xxhash64("leaf", best).alias("template")))
    found = close.select("doc_id", "row_key", "line_no", "leaf", "line").join(templates, ["leaf", "line"])
    found = materialize(found.select("doc_id", "row_key", "line_no", "template"))
    per_template = found.groupBy("template", "doc_id").agg(F.lit(1).alias("one")).groupBy("template").agg(F.sum("one").alias("docs"), F.min("doc_id").alias("keeper"))
    recurring = materialize(per_template.filter(F.col("docs") >= min_docs).select(F.col("template").alias("r_template"), "keeper"))
    return found.join(recurring, F.col("template") == F.col("r_template")).drop("r_template")


def lost_lines(docs: DataFrame, **options) -> DataFrame:
    """docs as struct column row, with lost (the sorted numbers of the lines that recur; null if none do) and kept_text, the text without them."""
    with scope(docs.sparkSession) as kept_tables:
        lost = recurring_lines(docs, **options).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        # the same document may come in several rows
        lost = materialize(lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("row_key").alias("lost_key")).agg(F.array_sort(F.collect_set("line_no")).alias("lost")))
        kept_tables.append(lost)
    rows = whole_rows(docs, F.col("doc_id").alias("own_id"), _row_key().alias("own_key"))
    joined = rows.join(lost.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("lost_id")) & (F.col("own_key") == F.col("lost_key")), "left")
    kept = F.filter(_lines(F.col("row.text")), lambda x, i: ~F.array_contains("lost", i))
    blank = F.forall(kept, lambda x: x.rlike(f"^({SEPARATOR})?$"))
    text = F.when(F.col("lost").isNull(), F.col("row.text")).when(blank, F.lit("")).otherwise(F.array_join(kept, "\n"))
    return joined.select("row", "lost", text.alias("kept_text"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that recur; n_chars, where it is a column, follows the text of rows that lose some."""
    own = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("lost").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(dict(docs.dtypes)["n_chars"])
    return lost_lines(docs, **options).select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    rows = lost_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n_lines = F.coalesce(F.size(_lines(F.col("row.text"))), F.lit(0)).cast("long")
    return rows.select("row.doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line_text, generate_subscripts(ls, 1) AS line_no FROM docs),
tokens AS (
  SELECT doc_id, line_no, regexp_extract_all(line_text, '[^\x20\x09-\x0D]+') AS tokens FROM lines),
leafed AS (
  SELECT *, len(tokens) || chr(31) || array_to_string(list_transform(tokens[1:3], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), chr(31)) AS leaf,
         array_to_string(tokens, chr(31)) AS line
  FROM tokens WHERE len(tokens) > 0),
busy AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
dist AS (
  SELECT leaf, line, any_value(tokens) AS tokens, count(DISTINCT doc_id) AS docs FROM leafed WHERE leaf IN (SELECT leaf FROM busy) GROUP BY leaf, line),
placed AS (SELECT leaf, line, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos, len(tokens) AS n FROM dist),
constant AS (SELECT leaf, pos, token, sum(docs) AS support FROM placed GROUP BY leaf, pos, token HAVING sum(docs) >= 10),
ranked AS (
  SELECT leaf, line, pos, token, ceil(0.6::DOUBLE * n) AS need, row_number() OVER (PARTITION BY leaf, line ORDER BY support DESC, pos) AS rank
  FROM placed JOIN constant USING (leaf, pos, token)),
templates AS (
  SELECT leaf, line, leaf || chr(30) || string_agg(pos || chr(31) || token, chr(31) ORDER BY pos) AS template
  FROM ranked WHERE rank <= need GROUP BY leaf, line HAVING count(*) = any_value(need)),
found AS (SELECT doc_id, line_no, template FROM leafed JOIN templates USING (leaf, line)),
recurring AS (SELECT template, min(doc_id) AS keeper FROM found GROUP BY template HAVING count(DISTINCT doc_id) >= 10),
lost AS (SELECT doc_id, list(line_no) AS nos FROM found JOIN recurring USING (template) WHERE doc_id <> keeper GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(ls) AS n_lines, coalesce(len(nos), 0) AS n_dropped, ls AS all_ls, nos,
         list_filter(ls, lambda x, i: nos IS NULL OR NOT list_contains(nos, i)) AS ks
  FROM docs d LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
       sha256(CASE WHEN nos IS NOT NULL AND len(list_filter(ks, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) = 0 THEN ''
                   ELSE coalesce(array_to_string(ks, chr(10)), '') END) AS kept_sha256
FROM kept
"""
