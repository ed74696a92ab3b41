"""Queries of the experiment's reports: summaries with bounds, lookups, trade-offs, agreement and integrity."""

from pyspark.sql import functions as F

from tessera.functions.stats import RESAMPLES
from tessera.operators import reports as R
from tessera.operators.evaluation import score_rows
from tessera.operators.paired import all_pairs, paired_rows
from tessera.plans.bindings import SQL_ROWS, SQL_SCORED, rows, sql_gleu, sql_normal
from tessera.plans.scoring import _JUDGED, _RAN, _share, rounded
from tessera.plans.statistics import _sql_boot, sql_mcnemar
from tessera.session import read

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


_Z = "1.959963984540054"


def _bounds(name: str, k: str, n: str) -> str:
    """Wilson's bounds of k of n, in SQL."""
    p, n = f"({k}::DOUBLE / nullif({n}, 0))", f"nullif({n}, 0)"
    centre, half = f"(({p} + {_Z} * {_Z} / (2.0 * {n})) / (1 + {_Z} * {_Z} / {n}))", f"({_Z} * sqrt({p} * (1 - {p}) / {n} + {_Z} * {_Z} / (4.0 * {n} * {n})) / (1 + {_Z} * {_Z} / {n}))"
    low, high = f"least(greatest(0, {centre} - {half}), {p})", f"greatest(least(1, {centre} + {half}), {p})"
    return f"CASE WHEN {n} IS NOT NULL THEN round({low}, 4) END AS {name}_ci_low, CASE WHEN {n} IS NOT NULL THEN round({high}, 4) END AS {name}_ci_high"


_MATCH, _GOLD_OK = "coalesce(execution_match, false)", f"{_RAN} AND gold_executed_ok"
_count = lambda c: f"count(*) FILTER ({c})"
_TEXT = f"""count(*) AS n, round({sql_gleu('sum(overlap)', 'sum(n_pred)', 'sum(n_gold)')}, 4) AS gleu_corpus, {_share('exact_match')} AS exact_match, {_share('normalised_exact_match')} AS normalised_exact_match,
{_share("trim(predicted_cypher) = ''")} AS empty_output_rate, {_count('has_database')} AS n_has_database, {_count("execution_status = 'connection_failed'")} AS n_connection_failed,
{_share('syntax_valid', 'syntax_valid IS NOT NULL')} AS syntax_valid_rate, {_bounds('exact_match', _count('exact_match'), 'count(*)')}, {_bounds('normalised_exact_match', _count('normalised_exact_match'), 'count(*)')}"""
_BOOT = f"{_sql_boot('job_id', 'scored', ['overlap', 'n_gold', 'n_pred'], 'id')}, bm AS (SELECT job_id, {sql_gleu('overlap', 'n_pred', 'n_gold')} AS g FROM bs), bq AS (SELECT job_id, round(quantile_cont(g, 0.025), 4) AS gleu_corpus_ci_low, round(quantile_cont(g, 0.975), 4) AS gleu_corpus_ci_high FROM bm GROUP BY 1)"


@plan(f"""WITH {SQL_SCORED}, {_BOOT}, s AS (SELECT job_id, {_TEXT}, round(avg(gleu), 4) AS gleu_mean, {_count("execution_status = 'excluded_dead_db'")} AS n_excluded_dead_db, {_count('schema_trimmed')} AS n_schema_trimmed,
{_share('schema_trimmed', 'schema_trimmed IS NOT NULL')} AS schema_trimmed_rate, {_count('prompt_over_budget')} AS n_prompt_over_budget, {_count(_RAN)} AS n_executed, {_count(_GOLD_OK)} AS n_gold_ok, {_count(f'{_RAN} AND NOT gold_executed_ok')} AS n_gold_failed,
{_share(_MATCH, _RAN)} AS execution_accuracy_toolkit, {_share('pred_executed_ok', _RAN)} AS executable_rate, {_share(_MATCH, _GOLD_OK)} AS execution_accuracy, {_share('pred_executed_ok', _GOLD_OK)} AS executable_rate_gold_ok,
{_bounds('execution_accuracy', _count(f'{_MATCH} AND {_GOLD_OK}'), _count(_GOLD_OK))}, round(avg(prompt_tokens) FILTER (prompt_tokens >= 0), 4) AS prompt_tokens_mean, round(quantile_cont(prompt_tokens, 0.5) FILTER (prompt_tokens >= 0), 4) AS prompt_tokens_median,
round(quantile_cont(prompt_tokens, 0.95) FILTER (prompt_tokens >= 0), 4) AS prompt_tokens_p95, max(prompt_tokens) FILTER (prompt_tokens >= 0) AS prompt_tokens_max FROM scored GROUP BY 1) SELECT * FROM s JOIN bq USING (job_id)""")
def thesis_summary(spark, sf_dir):
    return rounded(R.thesis_summary(score_rows(rows(spark, sf_dir), ["id"]), ["job_id"]))


@plan(f"""WITH {SQL_SCORED}, {_BOOT}, s AS (SELECT job_id, {_TEXT}, {_count(_JUDGED)} AS n_judged, {_share(_MATCH, _JUDGED)} AS execution_accuracy, {_share('pred_executed_ok', _JUDGED)} AS executable_rate_gold_ok,
{_count(f'{_JUDGED} AND gold_row_count > 0')} AS n_judged_nonempty_gold, {_share(_MATCH, f'{_JUDGED} AND gold_row_count > 0')} AS execution_accuracy_nonempty_gold,
CASE WHEN {_count(_JUDGED)} > 0 THEN round({_count(f'{_JUDGED} AND {_MATCH} AND coalesce(gold_row_count, 0) = 0')}::DOUBLE / greatest(1, {_count(f'{_JUDGED} AND {_MATCH}')}), 4) END AS share_correct_with_empty_gold,
{_bounds('execution_accuracy', _count(f'{_MATCH} AND {_JUDGED}'), _count(_JUDGED))} FROM scored GROUP BY 1) SELECT * FROM s JOIN bq USING (job_id)""")
def edge_summary(spark, sf_dir):
    return rounded(R.edge_summary(score_rows(rows(spark, sf_dir), ["id"]), ["job_id"]))


@plan(f"""WITH {SQL_ROWS} SELECT job_id, count(*) AS n, CASE job_id WHEN 'job0' THEN 1.5 WHEN 'job1' THEN 2.5 END AS seconds_per_item, CASE job_id WHEN 'job0' THEN 'a' WHEN 'job1' THEN 'b' END AS platform FROM rows_ GROUP BY 1""")
def metrics_with_registry(spark, sf_dir):
    registry = spark.createDataFrame([("job0", 1.5, "a"), ("job1", 2.5, "b"), ("job1", 2.5, "b"), ("job9", 0.5, "c")], "job_id string, seconds_per_item double, platform string")
    return R.with_registry(rows(spark, sf_dir).groupBy("job_id").agg(F.count(F.lit(1)).alias("n")), registry, "job_id", ["seconds_per_item", "platform", "gpu"])


@plan("SELECT user_id % 20 AS grp, count(*) AS n, count(c_custkey) AS n_known, min(c_name) AS first_name FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1")
def reference_lookup(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    e = R.map_lookup(read(spark, sf_dir, "events").select("user_id"), "user_id", c, "c_custkey", "c_name", "name")
    return e.groupBy((F.col("user_id") % 20).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("n_known"), F.min("name").alias("first_name"))


@plan("""SELECT l_returnflag, count(*) AS n, sum(CASE l_returnflag WHEN 'R' THEN length(p_name) WHEN 'A' THEN length(p_brand) ELSE 1 END)::BIGINT AS chars
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def corpus_lookup(spark, sf_dir):
    made = F.when(F.col("l_returnflag") == "R", F.length("p_name")).when(F.col("l_returnflag") == "A", F.length("p_brand")).otherwise(1)
    l = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    l = R.looked_up(l, read(spark, sf_dir, "part"), "p_partkey", "l_returnflag", made, "chars")
    return l.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").cast("long").alias("chars"))


@plan("SELECT p_partkey, p_name FROM part WHERE coalesce(starts_with(p_name, 'small'), false)")
def named_rows(spark, sf_dir):
    return R.named(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "small")


_ERROR = "CASE WHEN gold_executed_ok THEN NULL WHEN turn % 4 = 0 THEN '' ELSE concat('e', conv_id % 3) END"


@plan(f"""WITH {SQL_ROWS}, e AS (SELECT data_source, id, turn, execution_status, gold_executed_ok, {_ERROR} AS gold_error FROM rows_ WHERE data_source IS NOT NULL AND execution_status IS NOT NULL AND execution_status <> 'connection_failed'),
g AS (SELECT data_source, count(*) AS n, {_count('NOT gold_executed_ok')} AS n_gold_failed, arg_min(gold_error, id) FILTER (gold_error <> '') AS sample_gold_error FROM e GROUP BY 1)
SELECT *, round(n_gold_failed / n::DOUBLE, 4) AS gold_failure_rate, n_gold_failed = n AS dead FROM g WHERE n_gold_failed > 0""")
def gold_table(spark, sf_dir):
    r = rows(spark, sf_dir).selectExpr("data_source", "id", "turn", "execution_status", "gold_executed_ok", f"{_ERROR} AS gold_error")
    return rounded(R.gold_table(r.union(r.filter("turn = 0")), "data_source", "id", ["turn"]))


_ITEM = "(id // 1000) // 4 * 1000 + turn"
#: Characters of the schema that a row's prompt has: of jobs 2 and 3 the filtered one.
_CHARS = "CASE WHEN conv_id % 4 >= 2 THEN 40 + turn * 7 % 60 ELSE 100 END"


def _by_item(spark, sf_dir, scored: bool = True):
    r = rows(spark, sf_dir).withColumns({"item": F.expr(_ITEM.replace("//", "div")), "schema_chars": F.expr(_CHARS)})
    return score_rows(r, ["id"]) if scored else r


def _paired(spark, sf_dir, values: list[str], jobs: list[tuple]):
    named = spark.createDataFrame(jobs, "model string, job_a string, job_b string")
    return paired_rows(_by_item(spark, sf_dir), named, "job_id", "item", values, ["id"])


_AB = f"""it AS (SELECT *, {_ITEM} AS item, {_CHARS} AS schema_chars FROM scored), p AS (SELECT a.model, a.item, a.schema_chars AS a_c, b.schema_chars AS b_c, a.prompt_tokens AS a_t, b.prompt_tokens AS b_t, b.schema_chars / a.schema_chars::DOUBLE AS r,
  coalesce(a.execution_match, false) AS a_m, coalesce(b.execution_match, false) AS b_m, a.execution_status IN ('compared', 'pred_failed') AND b.execution_status IN ('compared', 'pred_failed') AS judged, a.predicted_cypher AS a_q, b.predicted_cypher AS b_q
  FROM it a JOIN it b ON a.item = b.item AND a.model = b.model AND a.job_id < b.job_id)"""
_DIFF = "src AS (SELECT model, item, (b_m::INTEGER - a_m::INTEGER)::DOUBLE AS d FROM p WHERE coalesce(judged, false) AND r < 0.95)"


@plan(f"""WITH {SQL_SCORED}, {_AB}, {_DIFF}, {_sql_boot('model', 'src', ['d'], 'item')}, q AS (SELECT model, round(quantile_cont(d / n, 0.025), 4) AS pruned_rows_delta_ci_low, round(quantile_cont(d / n, 0.975), 4) AS pruned_rows_delta_ci_high FROM bs GROUP BY 1),
j AS (SELECT *, coalesce(judged, false) AND r < 0.95 AS k FROM p), s AS (SELECT model, count(*) AS n_pairs, avg(a_t) FILTER (a_t >= 0) AS ta, avg(b_t) FILTER (b_t >= 0) AS tb, round(median(r), 4) AS schema_chars_median_ratio, {_share('r >= 0.95')} AS share_rows_hardly_filtered,
{_count('r < 0.95')} AS pruned_rows_n, {_count('k')} AS pruned_rows_n_judged, {_count('k AND a_m')}::DOUBLE / nullif({_count('k')}, 0) AS ea, {_count('k AND b_m')}::DOUBLE / nullif({_count('k')}, 0) AS eb, {_count('k AND a_m AND NOT b_m')} AS oa, {_count('k AND b_m AND NOT a_m')} AS ob FROM j GROUP BY 1)
SELECT model, n_pairs, round(ta, 4) AS prompt_tokens_mean_a, round(tb, 4) AS prompt_tokens_mean_b, schema_chars_median_ratio, share_rows_hardly_filtered, pruned_rows_n, pruned_rows_n_judged, round(ea, 4) AS pruned_rows_ea_a, round(eb, 4) AS pruned_rows_ea_b,
round(100 * (1 - tb / nullif(ta, 0)), 4) AS prompt_token_reduction_pct, round(eb - ea, 4) AS pruned_rows_ea_delta, CASE WHEN pruned_rows_n_judged > 0 THEN round({sql_mcnemar('oa', 'ob')}, 4) END AS pruned_rows_mcnemar_p, pruned_rows_delta_ci_low, pruned_rows_delta_ci_high FROM s LEFT JOIN q USING (model)""")
def schema_trade_off(spark, sf_dir):
    p = _paired(spark, sf_dir, ["prompt_tokens", "schema_chars", "execution_status", "execution_match"], [("m0", "job0", "job2"), ("m1", "job1", "job3")])
    return rounded(R.trade_off(p, ["model"], "item"))


@plan(f"""WITH {SQL_SCORED}, {_AB} SELECT model, count(*) AS n, round(avg((a_q = b_q)::INTEGER), 4) AS identical, round(avg(({sql_normal('a_q')} = {sql_normal('b_q')})::INTEGER), 4) AS identical_normalised FROM p GROUP BY 1""")
def identical_normalised(spark, sf_dir):
    return rounded(R.identical_shares(_paired(spark, sf_dir, ["predicted_cypher"], [("m0", "job0", "job2"), ("m1", "job1", "job3")]), ["model"]))


_RIGHT = f"it AS (SELECT job_id, model, {_ITEM} AS item, {_JUDGED} AS judged, coalesce(execution_match, false)::INTEGER AS c FROM rows_)"


@plan(f"""WITH {SQL_ROWS}, {_RIGHT}, w AS (SELECT model, item, count(DISTINCT job_id) AS k, max(c) FILTER (job_id IN ('job0', 'job1')) AS a, max(c) FILTER (job_id IN ('job2', 'job3')) AS b FROM it WHERE judged GROUP BY 1, 2 HAVING count(DISTINCT job_id) = 2)
SELECT model, item % 3 = 0 AS fully_covered, count(*) AS n_judged_all, round(avg(a), 4) AS ea_full, round(avg(b), 4) AS ea_filtered FROM w WHERE item % 7 <> 6 GROUP BY 1, 2""")
def coverage_accuracy(spark, sf_dir):
    r = R.long_rows(_by_item(spark, sf_dir, scored=False), ["job_id", "item"]).withColumn("variant", F.when(F.col("job_id").isin("job0", "job1"), "full").otherwise("filtered"))
    covered = r.filter("item % 7 <> 6").select("item", F.expr("item % 3 = 0").alias("fully_covered")).distinct()
    return rounded(R.coverage_accuracy(r, ["model"], "variant", ["full", "filtered"], "item", covered))


@plan("""WITH e AS (SELECT l_partkey, l_suppkey % 3 AS judge, max((l_returnflag <> 'N')::INTEGER) AS r FROM lineitem GROUP BY 1, 2),
w AS (SELECT l_partkey, sum(r) AS k, max(r) FILTER (judge = 0) AS a, max(r) FILTER (judge = 1) AS b, max(r) FILTER (judge = 2) AS c FROM e GROUP BY 1 HAVING count(*) = 3)
SELECT count(*) AS n_items, round(avg(a), 4) AS ea_j0, round(avg(b), 4) AS ea_j1, round(avg(c), 4) AS ea_j2, round(avg((k = 0)::INTEGER), 4) AS share_correct_by_0, round(avg((k = 1)::INTEGER), 4) AS share_correct_by_1,
round(avg((k = 2)::INTEGER), 4) AS share_correct_by_2, round(avg((k = 3)::INTEGER), 4) AS share_correct_by_3 FROM w""")
def agreement_shares(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_partkey", F.concat(F.lit("j"), (F.col("l_suppkey") % 3).cast("string")).alias("judge"), "l_returnflag")
    return rounded(R.agreement_shares(l, "l_partkey", "judge", ["j0", "j1", "j2"], F.col("l_returnflag") != "N"))


_REGISTRY = [("job0", "completed", "", "c1", "p1", "t=1", "f1", "f1"), ("job1", "completed", None, "c1", "p2", "", "f1", "f2"), ("job2", "failed", "out of memory", "c2", "p1", None, None, None)]
_SQL_REGISTRY = "jobs AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in _REGISTRY) + ") t(job_id, status, error, git_commit, platform, adapter_verified, fingerprint_trained, fingerprint_now))"
_PCT = lambda c: f"printf('%.1f%%', round_even({c} * 100, 1))"


@plan(f"""WITH {SQL_ROWS}, {_SQL_REGISTRY}, it AS (SELECT *, {_ITEM} AS item FROM rows_), s AS (SELECT job_id, count(DISTINCT item) AS n, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS t FROM it GROUP BY 1),
sc AS (SELECT job_id, {_count(_RAN)} AS ran, {_count(f'{_RAN} AND NOT gold_executed_ok')} AS bad, {_count("execution_status = 'connection_failed'")} AS lost FROM it GROUP BY 1),
pr AS (SELECT a.job_id AS a, b.job_id AS b, avg((a.predicted_cypher = b.predicted_cypher)::INTEGER) AS same FROM it a JOIN it b ON a.item = b.item AND a.job_id = 'job0' AND b.job_id <> 'job0' GROUP BY 1, 2),
ex AS (SELECT DISTINCT r.job_id, coalesce(status, 'not_started') AS status, nullif(error, '') AS error FROM rows_ r LEFT JOIN jobs USING (job_id)), ok AS (SELECT * FROM jobs WHERE status = 'completed'),
dd AS (SELECT data_source FROM rows_ WHERE data_source IS NOT NULL AND execution_status IS NOT NULL AND execution_status <> 'connection_failed' GROUP BY 1 HAVING bool_and(NOT gold_executed_ok))
SELECT 'identical evaluation rows across all jobs' AS "check", 'all' AS subject, count(DISTINCT t) <= 1 AS passed, string_agg(job_id || '=' || n, ', ' ORDER BY job_id) AS detail FROM s
UNION ALL SELECT 'adapter verified at load', job_id, coalesce(adapter_verified, '') <> '', coalesce(adapter_verified, '') FROM ok
UNION ALL SELECT 'tuned outputs differ from the base''s', b, same < 0.9, {_PCT('same')} || ' of predictions identical to ' || a FROM pr
UNION ALL SELECT 'gold queries run', job_id, bad / ran::DOUBLE < 0.05, {_PCT('bad / ran::DOUBLE')} || ' of executed rows had a failing gold query' FROM sc WHERE ran > 0
UNION ALL SELECT 'fingerprint matches', job_id, fingerprint_trained IS NOT DISTINCT FROM fingerprint_now, coalesce(fingerprint_trained, '-') || ' vs ' || coalesce(fingerprint_now, '-') FROM jobs
UNION ALL SELECT 'expected job completed', job_id, status = 'completed', concat_ws(': ', status, error) FROM ex
UNION ALL SELECT 'all jobs from one code commit', 'all', count(DISTINCT git_commit) <= 1, string_agg(DISTINCT git_commit, ', ' ORDER BY git_commit) FROM ok
UNION ALL SELECT 'all jobs from one platform', 'all', count(DISTINCT platform) <= 1, string_agg(DISTINCT platform, ', ' ORDER BY platform) FROM ok
UNION ALL SELECT 'no connection failures', job_id, lost = 0, lost || ' rows connection_failed' FROM sc
UNION ALL SELECT 'databases where every gold query fails', 'all', NULL, coalesce(string_agg(data_source, ', ' ORDER BY data_source), 'none') FROM dd""")
def integrity_report(spark, sf_dir):
    r = _by_item(spark, sf_dir, scored=False)
    jobs = spark.createDataFrame(_REGISTRY, "job_id string, status string, error string, git_commit string, platform string, adapter_verified string, fingerprint_trained string, fingerprint_now string")
    base = spark.createDataFrame([(f"job{k}", "job0", f"job{k}") for k in (1, 2, 3)], "comparison string, job_a string, job_b string")
    same = R.identical_shares(paired_rows(r, base, "job_id", "item", ["predicted_cypher"], ["id"]), ["job_a", "job_b"])
    dead = R.gold_table(r.withColumn("gold_error", F.lit(None).cast("string")), "data_source", "id", ["turn"]).select(F.col("data_source").alias("database"), "dead")
    return R.integrity(r, jobs, r.select("job_id").distinct(), same, dead)


@plan(f"""WITH {SQL_SCORED}, it AS (SELECT *, {_ITEM} AS item FROM scored), pr AS (SELECT a.job_id || ' vs ' || b.job_id AS comparison, a.item, a.gleu AS x, b.gleu AS y, a.prompt_tokens AS u, b.prompt_tokens AS v FROM it a JOIN it b ON a.item = b.item AND a.job_id < b.job_id),
src AS (SELECT comparison || ':sentence_gleu' AS c, item, round(x, 6) AS a, round(y, 6) AS b, round(y, 6) - round(x, 6) AS d FROM pr UNION ALL SELECT comparison || ':prompt_tokens', item, u, v, (v - u)::DOUBLE FROM pr), {_sql_boot('c', 'src', ['d'], 'item')},
q AS (SELECT c, quantile_cont(d / n, 0.025) AS lo, quantile_cont(d / n, 0.975) AS hi, least(1.0, 2 * least(avg((d / n <= 1e-12)::INTEGER), avg((d / n >= -1e-12)::INTEGER))) AS p FROM bs GROUP BY 1)
SELECT split_part(c, ':', 1) AS comparison, split_part(c, ':', 2) AS metric, count(*) AS n_pairs, round(avg(a), 4) AS a_value, round(avg(b), 4) AS b_value, round(avg(d), 4) AS difference, round(any_value(lo), 4) AS ci_low, round(any_value(hi), 4) AS ci_high,
round(greatest(any_value(p), {1 / RESAMPLES}), 4) AS p_value FROM src JOIN q USING (c) GROUP BY c""")
def paired_values(spark, sf_dir):
    """Paired differences of sentence GLEU and of a cost for every two jobs, with bootstrap bounds."""
    r = _by_item(spark, sf_dir)
    named = all_pairs(r.select("job_id").distinct(), "job_id", "job_id").withColumn("comparison", F.concat_ws(" vs ", "job_a", "job_b"))
    p = paired_rows(r, named, "job_id", "item", ["gleu", "prompt_tokens"], ["id"])
    return rounded(R.paired_values(p, ["comparison"], "item", {"sentence_gleu": "gleu", "prompt_tokens": "prompt_tokens"}))
