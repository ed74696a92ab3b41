"""Queries that store results of the driver's tables, read them as a source, and execute pairs of queries against them."""

from pyspark.sql import functions as F

from tessera.functions.text import alias_to_database
from tessera.operators.execution import Executor, client_backend, table_backend
from tessera.plans.bindings import SQL_PAIRS, pairs
from tessera.session import read, work_dir
from tessera.sources.results import read_results, write_results

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


_MODE_ROWS = """SELECT 'db ' || l_linenumber::VARCHAR AS target, 'part ' || (l_partkey % 50)::VARCHAR AS query, l_orderkey % 7 <> 0 AS ok, l_quantity AS quantity FROM lineitem"""


def _mode_results(spark, sf_dir) -> str:
    """Results of a query for each line number and group of parts: the quantities of its lines. A seventh of them failed."""
    l = read(spark, sf_dir, "lineitem")
    line = l.select(F.concat(F.lit("db "), F.col("l_linenumber").cast("string")).alias("target"), F.concat(F.lit("part "), (F.col("l_partkey") % 50).cast("string")).alias("query"), "l_quantity", "l_orderkey")
    each = line.groupBy("target", "query", (F.col("l_orderkey") % 7 != 0).alias("ok")).agg(F.collect_list(F.to_json(F.array("l_quantity"))).alias("r"))
    out = each.select("target", F.concat_ws(" ", "query", F.when(~F.col("ok"), "broken")).alias("query"), "ok", F.array(F.lit("quantity")).alias("keys"), F.when(F.col("ok"), F.col("r")).alias("rows"), F.when(~F.col("ok"), "SyntaxError: broken").alias("error"), F.lit(0.5).alias("elapsed_s"))
    path = work_dir(spark, "results")
    write_results(out, path)
    return path


@plan(f"""WITH r AS ({_MODE_ROWS}) SELECT target, count(DISTINCT concat(query, ok::VARCHAR)) AS results, count(*) FILTER (ok) AS "rows", round(sum(quantity) FILTER (ok), 4) AS quantity
FROM r WHERE target IN ('db 1', 'db 3', 'db 4') GROUP BY 1""")
def stored_results(spark, sf_dir):
    """Results of three targets out of the store, whose schema is inferred; the other targets' files aren't opened."""
    rows = read_results(spark, _mode_results(spark, sf_dir), None).filter(F.col("target").isin("db 1", "db 3", "db 4"))
    value = F.get_json_object(F.col("v"), "$[0]").cast("double")
    each = rows.select("target", "query", F.explode_outer("rows").alias("v"))
    got = each.groupBy("target").agg(F.countDistinct("query").alias("results"), F.count("v").alias("rows"), F.sum(value).alias("quantity"))
    return got.select("target", "results", "rows", F.round("quantity", 4).alias("quantity"))


@plan(f"""WITH r AS ({_MODE_ROWS}), q AS (SELECT DISTINCT target, query || CASE WHEN ok THEN '' ELSE ' broken' END AS query, ok FROM r)
SELECT run, target, count(*) AS answers, count(*) FILTER (ok) AS ok, count(*) FILTER (run = 2) AS from_cache, CASE WHEN run = 1 THEN (SELECT count(*) FROM q) ELSE 0 END::BIGINT AS executed
FROM q, (VALUES (1), (2)) runs(run) GROUP BY run, target""")
def executed_twice(spark, sf_dir):
    """All distinct queries of the lines run against the stored results, then again: the second run executes none of them."""
    results = _mode_results(spark, sf_dir)
    line = read(spark, sf_dir, "lineitem")
    name = F.concat_ws(" ", F.lit("part"), (F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_orderkey") % 7 == 0, "broken"))
    asked = line.select(F.concat(F.lit("db "), F.col("l_linenumber").cast("string")).alias("target"), F.lit("run").alias("kind"), name.alias("query"))
    executor = Executor(spark, work_dir(spark, "answers-store"), table_backend(read_results(spark, results)))
    runs = []
    for run in (1, 2):
        got = executor.answers(asked).groupBy("target").agg(F.count(F.lit(1)).alias("answers"), F.count_if("ok").alias("ok"), F.count_if("from_cache").alias("from_cache"))
        # the first run's answers are read before the second begins
        path = work_dir(spark, "run")
        got.select(F.lit(run).alias("run"), "*", F.lit(executor.executed).cast("long").alias("executed")).write.parquet(path)
        runs.append(spark.read.parquet(path))
    return runs[0].unionByName(runs[1])


def _words_client():
    def connect(target: str):
        """A database that answers a query with its words, a row each; db2 is down, and a query with a `;` in it is an error."""

        def run(query: str):
            if target == "db2":
                raise ConnectionError("ServiceUnavailable: no route")
            if ";" in query:
                raise ValueError("SyntaxError: ;")
            return ["word"], [[w] for w in query.split()]

        return run

    return connect


@plan(f"""WITH {SQL_PAIRS}, e AS (SELECT id, conv_id % 4 AS db, gold_cypher AS g, predicted_cypher AS p, list_filter(regexp_split_to_array(gold_cypher, '\\s+'), lambda w: w <> '') AS gw, list_filter(regexp_split_to_array(predicted_cypher, '\\s+'), lambda w: w <> '') AS pw FROM pairs),
s AS (SELECT *, CASE WHEN db = 2 THEN 'connection_failed' WHEN contains(g, ';') OR len(gw) = 0 THEN 'gold_failed' WHEN contains(p, ';') OR len(pw) = 0 THEN 'pred_failed' ELSE 'compared' END AS execution_status FROM e)
SELECT id, execution_status, CASE execution_status WHEN 'pred_failed' THEN false WHEN 'compared' THEN CASE WHEN regexp_matches(g, '(?i)\\border\\s+by\\b') THEN gw = pw ELSE list_sort(gw) = list_sort(pw) END END AS execution_match,
  CASE WHEN db = 2 OR contains(g, ';') THEN 0 ELSE len(gw) END::BIGINT AS gold_row_count, CASE WHEN db = 2 OR contains(p, ';') THEN 0 ELSE len(pw) END::BIGINT AS pred_row_count,
  CASE WHEN len(pw) = 0 THEN 'empty query' WHEN db = 2 THEN 'down' WHEN contains(p, ';') THEN 'ValueError: SyntaxError: ;' END AS pred_error FROM s""")
def executed_comparison(spark, sf_dir):
    """Gold and predicted queries of all pairs executed by a client and compared; a database that is down is asked three times a task."""
    p = pairs(spark, sf_dir).withColumn("target", alias_to_database(F.concat(F.lit("demo_db_db"), (F.col("conv_id") % 4).cast("string"))))
    executor = Executor(spark, work_dir(spark, "words-store"), client_backend(_words_client(), retries=0))
    got = executor.compare(p)
    down = F.when(F.col("pred_error").contains("ServiceUnavailable"), "down").otherwise(F.col("pred_error"))
    return got.select("id", "execution_status", "execution_match", "gold_row_count", "pred_row_count", down.alias("pred_error"))
