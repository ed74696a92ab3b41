"""Queries of the scoring family, with the SQL that they are held against."""

from pyspark.sql import functions as F

from tessera.functions.complexity import complexity, tier_rank
from tessera.functions.stats import wilson
from tessera.functions.tokens import exact_match, gleu, gleu_counts, normalised_exact_match, tokens
from tessera.operators.evaluation import ERRORS, RESULTS, agreement, error_category, error_table, grouping_sets, is_true, result_category, score_rows, subsets, summarise
from tessera.plans.bindings import SQL_COUNTS, SQL_PAIRS, SQL_ROWS, SQL_SCORED, _T, pairs, rows, sql_bare, sql_complexity, sql_gleu, sql_normal
from tessera.session import read, spread

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


def rounded(df, digits: int = 4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@plan(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {_T}))::INTEGER AS n_tokens FROM documents")
def tokenize_counts(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents")).select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"))


@plan(f"WITH {SQL_PAIRS}, {SQL_COUNTS} SELECT id, overlap, n_gold, n_pred, round({sql_gleu('overlap', 'n_pred', 'n_gold')}, 4) AS gleu FROM counts")
def gleu_sentence(spark, sf_dir):
    return rounded(gleu_counts(pairs(spark, sf_dir), "gold_cypher", "predicted_cypher", ["id"]).withColumn("gleu", gleu(F.col("overlap"), F.col("n_pred"), F.col("n_gold"))))


@plan(f"""WITH {SQL_PAIRS}, {SQL_COUNTS} SELECT (id // 1000) % 8 AS grp, count(*) AS n, round({sql_gleu('sum(overlap)', 'sum(n_pred)', 'sum(n_gold)')}, 4) AS gleu_corpus
FROM counts GROUP BY 1""")
def gleu_corpus(spark, sf_dir):
    c = gleu_counts(pairs(spark, sf_dir), "gold_cypher", "predicted_cypher", ["id"])
    return rounded(c.groupBy(F.expr("(id div 1000) % 8").alias("grp")).agg(F.count(F.lit(1)).alias("n"), gleu(F.sum("overlap"), F.sum("n_pred"), F.sum("n_gold")).alias("gleu_corpus")))


@plan(f"""WITH {SQL_PAIRS} SELECT id, {sql_bare('gold_cypher')} = {sql_bare('predicted_cypher')} AS exact_match,
{sql_normal('gold_cypher')} = {sql_normal('predicted_cypher')} AS normalised_exact_match FROM pairs""")
def exact_match_flags(spark, sf_dir):
    g, p = F.col("gold_cypher"), F.col("predicted_cypher")
    return pairs(spark, sf_dir).select("id", exact_match(g, p).alias("exact_match"), normalised_exact_match(g, p).alias("normalised_exact_match"))


#: Queries of all tiers, made of an order's number.
_QUERY = """CASE o_orderkey % 9 WHEN 0 THEN 'MATCH (n:A) RETURN n' WHEN 1 THEN 'MATCH (a)-[:R]->(b) RETURN b' WHEN 2 THEN 'MATCH (a)-[:R*1..3]->(b) RETURN b'
WHEN 3 THEN 'MATCH (a) WHERE a.x STARTS WITH 1 RETURN a' WHEN 4 THEN 'MATCH (a)<-[:R]-(b) RETURN count(a)' WHEN 5 THEN 'MATCH (a) MATCH (b) OPTIONAL MATCH (c) RETURN a'
WHEN 6 THEN 'MATCH (a)-[r:R*1..3]->(b) RETURN b' WHEN 7 THEN 'MATCH (a)-[:R]-(b)-[:S]-(c) WITH a WITH a RETURN sum(a.x)' ELSE 'RETURN 1' END"""


@plan(f"""WITH q AS (SELECT o_orderstatus, {_QUERY} AS q FROM orders), t AS (SELECT o_orderstatus, {sql_complexity('q')} AS tier FROM q)
SELECT o_orderstatus, tier, (CASE tier WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 4 END)::BIGINT AS tier_rank, count(*) AS n FROM t GROUP BY 1, 2""")
def complexity_tiers(spark, sf_dir):
    q = read(spark, sf_dir, "orders").select("o_orderstatus", complexity(F.expr(_QUERY))["tier"].alias("tier"))
    return q.groupBy("o_orderstatus", "tier").agg(tier_rank(F.first("tier")).cast("long").alias("tier_rank"), F.count(F.lit(1)).alias("n"))


_RAN = "coalesce(execution_status NOT IN ('connection_failed', 'excluded_dead_db'), false)"


def _share(of: str, among: str = "true") -> str:
    return f"round(count(*) FILTER ({of} AND {among})::DOUBLE / nullif(count(*) FILTER ({among}), 0), 4)"


_M = f"""count(*) AS n, round({sql_gleu('sum(overlap)', 'sum(n_pred)', 'sum(n_gold)')}, 4) AS gleu_corpus, round(avg(gleu), 4) AS gleu_mean, {_share('exact_match')} AS exact_match,
{_share('normalised_exact_match')} AS normalised_exact_match, {_share("trim(predicted_cypher) = ''")} AS empty_output_rate,
count(*) FILTER (execution_status = 'connection_failed') AS n_connection_failed, count(*) FILTER (execution_status = 'excluded_dead_db') AS n_excluded_dead_db,
count(*) FILTER ({_RAN}) AS n_executed, {_share('pred_executed_ok', _RAN)} AS executable_rate, {_share('coalesce(execution_match, false)', _RAN)} AS execution_accuracy,
count(*) FILTER ({_RAN} AND NOT gold_executed_ok) AS n_gold_failed, {_share('coalesce(execution_match, false)', f'{_RAN} AND gold_executed_ok')} AS execution_accuracy_gold_ok,
{_share('pred_executed_ok', f'{_RAN} AND gold_executed_ok')} AS executable_rate_gold_ok, count(*) FILTER (execution_status IN ('compared', 'pred_failed') AND gold_executed_ok) AS n_judged,
{_share('coalesce(execution_match, false)', "execution_status IN ('compared', 'pred_failed') AND gold_executed_ok")} AS execution_accuracy_judged,
count(*) FILTER (schema_trimmed) AS n_schema_trimmed, {_share('schema_trimmed', 'schema_trimmed IS NOT NULL')} AS schema_trimmed_rate,
count(*) FILTER (schema_trimmed IS NOT NULL AND prompt_over_budget) AS n_prompt_over_budget, {_share('syntax_valid', 'syntax_valid IS NOT NULL')} AS syntax_valid_rate,
round(avg(prompt_tokens) FILTER (prompt_tokens >= 0), 4) AS prompt_tokens_mean"""
_P95 = "list_sort(list(prompt_tokens) FILTER (prompt_tokens >= 0)) AS l_"


@plan(f"""WITH {SQL_SCORED}, s AS (SELECT job_id, {_M}, {_P95} FROM scored GROUP BY job_id)
SELECT * EXCLUDE (l_), l_[least(len(l_) - 1, floor(len(l_) * 0.95)::INTEGER) + 1] AS prompt_tokens_p95 FROM s""")
def score_summary(spark, sf_dir):
    return rounded(summarise(score_rows(rows(spark, sf_dir), ["id"]), ["job_id"]))


_SETS = [[], ["complexity"], ["data_source"], ["has_database"], ["has_database", "complexity"]]


@plan(f"""WITH {SQL_SCORED} SELECT job_id, model, complexity, data_source, has_database, {_M}, grouping_id(job_id, model, complexity, data_source, has_database)::BIGINT AS grouping
FROM scored GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(['job_id', 'model', *s]) + ')' for s in _SETS)})""")
def score_grouping_sets(spark, sf_dir):
    return rounded(grouping_sets(score_rows(rows(spark, sf_dir), ["id"]), ["job_id", "model"], _SETS, percentiles=False))


_CATEGORY = """CASE WHEN trim(predicted_cypher) = '' THEN 'empty_output' WHEN execution_status IS NULL THEN 'not_executed'
WHEN execution_status IN ('connection_failed', 'excluded_dead_db', 'gold_failed') THEN execution_status WHEN NOT pred_executed_ok THEN CASE WHEN syntax_valid = false THEN 'invalid_query'
WHEN syntax_valid THEN 'runtime_error' ELSE 'execution_error' END WHEN execution_match THEN 'correct' ELSE 'wrong_result' END"""


@plan(f"""WITH {SQL_ROWS}, k AS (SELECT job_id, model, {_CATEGORY} AS kind FROM rows_)
SELECT job_id, model, {', '.join(f"count(*) FILTER (kind = '{e}') AS {e}" for e in ERRORS)} FROM k GROUP BY 1, 2""")
def error_categories_pivot(spark, sf_dir):
    return error_table(rows(spark, sf_dir), ["job_id", "model"])


@plan(f"""WITH {SQL_ROWS}, k AS (SELECT job_id, coalesce(data_source, '-') AS data_source, {_CATEGORY} AS kind FROM rows_)
SELECT data_source, kind, count(*) AS n FROM k GROUP BY 1, 2 ORDER BY n DESC, data_source, kind LIMIT 15""")
def top_errors(spark, sf_dir):
    k = rows(spark, sf_dir).select(F.coalesce("data_source", F.lit("-")).alias("data_source"), error_category().alias("kind"))
    return k.groupBy("data_source", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "data_source", "kind").limit(15)


_JUDGED = "execution_status IN ('compared', 'pred_failed') AND gold_executed_ok"
_RESULT = """CASE WHEN coalesce(execution_match, false) AND gold_row_count > 0 THEN 'correct_nonempty' WHEN coalesce(execution_match, false) AND gold_row_count = 0 THEN 'correct_empty_gold'
WHEN NOT pred_executed_ok THEN 'pred_failed' WHEN pred_row_count = 0 AND gold_row_count > 0 THEN 'wrong_pred_empty' WHEN pred_row_count <> gold_row_count THEN 'wrong_row_count' ELSE 'wrong_same_row_count' END"""


@plan(f"""WITH {SQL_ROWS}, k AS (SELECT job_id, gold_row_count, {_RESULT} AS kind FROM rows_ WHERE {_JUDGED})
SELECT job_id, count(*) AS n_judged, round(avg((gold_row_count = 0)::INTEGER), 4) AS share_gold_empty, {', '.join(f"count(*) FILTER (kind = '{e}') AS n_{e}" for e in RESULTS)} FROM k GROUP BY 1""")
def result_breakdown(spark, sf_dir):
    k = rows(spark, sf_dir).filter(is_true(F.expr(_JUDGED))).select("job_id", "gold_row_count", result_category().alias("kind"))
    return rounded(k.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_judged"), F.avg((F.col("gold_row_count") == 0).cast("double")).alias("share_gold_empty"), *[F.count_if(F.col("kind") == e).alias(f"n_{e}") for e in RESULTS]))


_NAMED = {"all": "true", "excl_source": "coalesce(data_source, '') <> 'src0'", "with_database": "has_database", "without_database": "NOT has_database"}


@plan(f"""WITH {SQL_SCORED}, s AS ({' UNION ALL '.join(f"SELECT *, '{k}' AS subset FROM scored WHERE {v}" for k, v in _NAMED.items())})
SELECT model, subset, {_M} FROM s GROUP BY 1, 2""")
def score_subsets(spark, sf_dir):
    named = {k: F.expr(v) for k, v in _NAMED.items()}
    return rounded(subsets(score_rows(rows(spark, sf_dir), ["id"]), named, ["model"]).drop("prompt_tokens_p95"))


_Z = "1.959963984540054"
_P = "(k / n::DOUBLE)"
_CENTRE = f"(({_P} + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n))"
_HALF = f"({_Z} * sqrt({_P} * (1 - {_P}) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n))"


@plan(f"""WITH g AS (SELECT source, sum(quality)::BIGINT AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, k, n, round({_P}, 4) AS share, round(least(greatest(0, {_CENTRE} - {_HALF}), {_P}), 4) AS share_low, round(greatest(least(1, {_CENTRE} + {_HALF}), {_P}), 4) AS share_high FROM g""")
def wilson_by_group(spark, sf_dir):
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    g = d.groupBy("source").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rounded(g.select("*", (F.col("k") / F.col("n")).alias("share"), low.alias("share_low"), high.alias("share_high")))


@plan("""WITH e AS (SELECT l_partkey, l_suppkey % 3 AS judge, max((l_returnflag <> 'N')::INTEGER) AS r FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_partkey, sum(r) AS k FROM e GROUP BY 1 HAVING count(*) = 3)
SELECT count(*) AS n_items, round(avg((k > 0)::INTEGER), 4) AS any_right, round(avg((k = 3)::INTEGER), 4) AS all_right, round(avg((k * 2 > 3)::INTEGER), 4) AS majority_right FROM c""")
def agreement_models(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 3).alias("judge"), "l_returnflag")
    return rounded(agreement(l, "l_partkey", "judge", F.col("l_returnflag") != "N"))
