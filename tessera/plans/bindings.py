"""Evaluation rows made of the driver's tables, in Spark and in SQL alike.

A pair is a user's turn (as the gold query) and the assistant's answer (as the prediction); every sixth pairs are copies with a semicolon,
with white space, or empty, so that matches occur. Statuses and flags follow from the ids by rules that both engines read.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tokens import KEYWORDS, TOKEN
from tessera.session import read, spread

PAIR_ID = "a.conv_id * 1000 + a.turn"
PREDICTED = "CASE (a.conv_id + a.turn) % 6 WHEN 0 THEN concat(a.text, ' ;') WHEN 1 THEN concat('  ', a.text, '  ') WHEN 2 THEN '' ELSE b.text END"
STATUS = "CASE (conv_id * 7 + turn * 3) % 11 WHEN 0 THEN NULL WHEN 1 THEN 'connection_failed' WHEN 2 THEN 'excluded_dead_db' WHEN 3 THEN 'gold_failed' WHEN 4 THEN 'pred_failed' ELSE 'compared' END"
FLAGS = {
    "job_id": "concat('job', conv_id % 4)",
    "model": "concat('m', conv_id % 2)",
    "data_source": "CASE WHEN conv_id % 13 = 0 THEN NULL ELSE concat('src', conv_id % 5) END",
    "has_database": "turn % 3 <> 0",
    "gold_executed_ok": "coalesce(execution_status IN ('compared', 'pred_failed'), false)",
    "pred_executed_ok": "coalesce(execution_status = 'compared', false)",
    "execution_match": "CASE WHEN execution_status = 'compared' THEN (conv_id + turn) % 3 <> 0 WHEN execution_status = 'pred_failed' THEN false END",
    "syntax_valid": "CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL ELSE (conv_id + turn) % 5 <> 1 END",
    "schema_trimmed": "CASE WHEN (conv_id * 5 + turn) % 7 = 0 THEN NULL ELSE (conv_id + turn) % 4 = 0 END",
    "prompt_over_budget": "(conv_id + turn) % 9 = 0",
    "prompt_tokens": "length(gold_cypher) % 700 - 5",
    "gold_row_count": "(conv_id + turn) % 4",
    "pred_row_count": "(conv_id * 3 + turn) % 4",
}


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    a, b = spread(c).filter("role = 'user'").alias("a"), c.filter("role = 'assistant'").alias("b")
    both = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return both.selectExpr(f"{PAIR_ID} AS id", "a.conv_id AS conv_id", "a.turn AS turn", "a.text AS gold_cypher", f"{PREDICTED} AS predicted_cypher")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with statuses and flags."""
    base = pairs(spark, sf_dir).selectExpr("*", f"{STATUS} AS execution_status")
    return base.selectExpr("*", *[f"{v} AS {k}" for k, v in FLAGS.items()])


_T = "'" + TOKEN.replace("'", "''") + "'"
#: Common table expressions: pairs, then rows, tokens and counts of shared n-grams by id.
SQL_PAIRS = f"""pairs AS (
  SELECT {PAIR_ID} AS id, a.conv_id, a.turn, a.text AS gold_cypher, {PREDICTED} AS predicted_cypher
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
SQL_ROWS = SQL_PAIRS + f""", st AS (SELECT *, {STATUS} AS execution_status FROM pairs),
rows_ AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in FLAGS.items())} FROM st)"""
SQL_COUNTS = f"""tk AS (SELECT id, regexp_extract_all(coalesce(gold_cypher, ''), {_T}) AS g, regexp_extract_all(coalesce(predicted_cypher, ''), {_T}) AS p FROM pairs),
g1 AS (SELECT id, g AS t, unnest([1, 2, 3, 4]) AS n, 1 AS a, 0 AS b FROM tk UNION ALL SELECT id, p, unnest([1, 2, 3, 4]), 0, 1 FROM tk),
g2 AS (SELECT id, t, n, a, b, unnest(range(1, greatest(len(t) - n + 2, 1))) AS i FROM g1),
g3 AS (SELECT id, array_to_string(t[i:i + n - 1], chr(1)) AS gram, sum(a) AS a, sum(b) AS b FROM g2 GROUP BY 1, 2),
g4 AS (SELECT id, sum(least(a, b))::BIGINT AS overlap, sum(a)::BIGINT AS n_gold, sum(b)::BIGINT AS n_pred FROM g3 GROUP BY id),
counts AS (SELECT p.id, coalesce(overlap, 0) AS overlap, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred FROM pairs p LEFT JOIN g4 USING (id))"""


def sql_gleu(o: str, p: str, g: str) -> str:
    return f"CASE WHEN {p} > 0 AND {g} > 0 THEN least({o}::DOUBLE / {p}, {o}::DOUBLE / {g}) ELSE 0 END"


def sql_bare(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '^\s+', ''), '\s+$', ''), ';+$', ''), '^\s+|\s+$', '', 'g')"


def sql_normal(c: str) -> str:
    words = ", ".join(f"'{k}'" for k in KEYWORDS)
    joined = f"array_to_string(list_transform(regexp_extract_all(coalesce({c}, ''), {_T}), lambda t: CASE WHEN lower(t) IN ({words}) THEN upper(t) ELSE t END), ' ')"
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({joined}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ';+$', ''), '^\s+|\s+$', '', 'g')"


def sql_complexity(c: str) -> str:
    n = lambda p: f"len(regexp_extract_all({c}, '{p}'))"
    hops, matches, withs = n(r"-\s*\["), n(r"(?i)\bmatch\b"), n(r"(?i)\bwith\b")
    aggs, var = n(r"(?i)\b(?:count|sum|avg|min|max|collect|percentile\w*|stdev\w*)\s*\("), rf"regexp_matches({c}, '\[\s*:?\w*\s*\*')"
    return f"""CASE WHEN {var} OR {hops} >= 4 OR {matches} >= 3 OR ({withs} >= 2 AND {aggs} >= 1) THEN 'extra_hard'
  WHEN {hops} >= 2 OR {matches} >= 2 OR ({aggs} >= 1 AND {hops} >= 1) THEN 'hard' WHEN {hops} = 1 OR {aggs} >= 1 OR {withs} >= 1 THEN 'medium' ELSE 'easy' END"""


SQL_SCORED = SQL_ROWS + ", " + SQL_COUNTS + f""",
scored AS (
  SELECT r.*, overlap, n_gold, n_pred, {sql_gleu('overlap', 'n_pred', 'n_gold')} AS gleu, {sql_bare('gold_cypher')} = {sql_bare('predicted_cypher')} AS exact_match,
    {sql_normal('gold_cypher')} = {sql_normal('predicted_cypher')} AS normalised_exact_match, {sql_complexity('gold_cypher')} AS complexity
  FROM rows_ r JOIN counts USING (id))"""
