"""Queries of the paired-comparison family."""

from pyspark.sql import functions as F

from tessera.functions.stats import RESAMPLES, mcnemar, resampled
from tessera.functions.tokens import gleu, gleu_counts
from tessera.operators.evaluation import score_rows
from tessera.operators.paired import adjusted, all_pairs, bootstrap_difference, compare, identical_share, judged_by_all, lookup, paired_rows
from tessera.plans.bindings import SQL_COUNTS, SQL_PAIRS, SQL_SCORED, pairs, rows, sql_gleu
from tessera.plans.scoring import rounded
from tessera.session import read

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


def sql_mcnemar(a: str, b: str) -> str:
    term = f"exp(lgamma({a} + {b} + 1) - lgamma(i + 1) - lgamma({a} + {b} - i + 1) - ({a} + {b}) * ln(2))"
    return f"CASE WHEN {a} + {b} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({a}, {b}) + 1), lambda i: {term}))) END"


_BY_PART = "SELECT o_orderpriority AS family, o_custkey % 40 AS comparison, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 150000)::BIGINT AS a_only, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 150000)::BIGINT AS b_only FROM orders GROUP BY 1, 2"


def _tests(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    failed, dear = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000
    t = o.groupBy(F.col("o_orderpriority").alias("family"), (F.col("o_custkey") % 40).alias("comparison")).agg(F.count_if(failed & ~dear).alias("a_only"), F.count_if(~failed & dear).alias("b_only"))
    return t.withColumn("p_value", mcnemar(F.col("a_only"), F.col("b_only")))


@plan(f"WITH t AS ({_BY_PART}) SELECT *, round({sql_mcnemar('a_only', 'b_only')}, 6) AS p_value FROM t")
def mcnemar_pairs(spark, sf_dir):
    return rounded(_tests(spark, sf_dir), 6)


@plan(f"""WITH t AS ({_BY_PART}), p AS (SELECT *, round({sql_mcnemar('a_only', 'b_only')}, 9) AS p_value FROM t),
h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, comparison) + 1) * p_value) AS raw FROM p)
SELECT family, comparison, round(p_value, 6) AS p_value, round(max(raw) OVER (PARTITION BY family ORDER BY p_value, comparison ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""")
def holm_adjust(spark, sf_dir):
    t = _tests(spark, sf_dir).withColumns({"metric": F.lit("m"), "p_value": F.round("p_value", 9)})
    return rounded(adjusted(t).select("family", "comparison", "p_value", "p_holm"), 6)


_VALUES = ["exact_match", "normalised_exact_match", "execution_match", "gold_executed_ok", "execution_status"]


def _compared(spark, sf_dir):
    """Jobs 0 and 1 to 3 on the same item: an item is a pair's rank within its job."""
    r = rows(spark, sf_dir).withColumn("item", F.expr("(id div 1000) div 4 * 1000 + turn"))
    scored = score_rows(r, ["id"])
    jobs = r.select("job_id").distinct()
    named = all_pairs(jobs, "job_id", "job_id").withColumn("comparison", F.concat_ws(" vs ", "job_a", "job_b"))
    return paired_rows(scored, named, "job_id", "item", [*_VALUES, "gleu", "predicted_cypher"], ["id"])


_PAIRED = SQL_SCORED + """, it AS (SELECT *, (id // 1000) // 4 * 1000 + turn AS item FROM scored),
pr AS (SELECT a.job_id AS job_a, b.job_id AS job_b, a.job_id || ' vs ' || b.job_id AS comparison, a.item, {cols} FROM it a JOIN it b ON a.item = b.item AND a.job_id < b.job_id)""".format(
    cols=", ".join(f"a.{v} AS a_{v}, b.{v} AS b_{v}" for v in [*_VALUES, "gleu", "predicted_cypher"]))


@plan(f"""WITH {_PAIRED}, x AS (
  SELECT comparison, 'exact_match' AS metric, a_exact_match AS a, b_exact_match AS b FROM pr
  UNION ALL SELECT comparison, 'normalised_exact_match', a_normalised_exact_match, b_normalised_exact_match FROM pr
  UNION ALL SELECT comparison, 'execution_match', coalesce(a_execution_match, false), coalesce(b_execution_match, false) FROM pr
  WHERE a_gold_executed_ok AND b_gold_executed_ok AND a_execution_status IN ('compared', 'pred_failed') AND b_execution_status IN ('compared', 'pred_failed')),
t AS (SELECT comparison, metric, count(*) AS n_pairs, avg(a::INTEGER) AS a_value, avg(b::INTEGER) AS b_value, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM x GROUP BY 1, 2)
SELECT comparison, metric, n_pairs, round(a_value, 4) AS a_value, round(b_value, 4) AS b_value, a_only, b_only, round({sql_mcnemar('a_only', 'b_only')}, 4) AS p_value FROM t""")
def paired_tests(spark, sf_dir):
    return rounded(compare(_compared(spark, sf_dir), ["comparison"]))


@plan(f"WITH {_PAIRED} SELECT comparison, count(*) AS n, round(avg((a_predicted_cypher = b_predicted_cypher)::INTEGER), 4) AS identical FROM pr GROUP BY 1")
def identical_share_jobs(spark, sf_dir):
    return rounded(identical_share(_compared(spark, sf_dir), ["comparison"], "a_predicted_cypher", "b_predicted_cypher"))


def _sql_boot(group: str, source: str, values: list[str], order: str) -> str:
    """Sums of values over resamples drawn as resampled() draws them."""
    hexes = "('0x' || substr(md5(concat_ws(':', b, i)), 1, 8))::BIGINT"
    return f"""br AS (SELECT {group}, {', '.join(values)}, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
bd AS (SELECT {group}, b, {hexes} % n AS d FROM br, range(1, {RESAMPLES + 1}) t(b)),
bs AS (SELECT bd.{group}, bd.b, {', '.join(f'sum(br.{v}) AS {v}' for v in values)}, count(*) AS n FROM bd JOIN br ON bd.{group} = br.{group} AND bd.d = br.i GROUP BY 1, 2)"""


@plan(f"""WITH {SQL_PAIRS}, {SQL_COUNTS}, src AS (SELECT id, (id // 1000) % 4 AS grp, overlap, n_gold, n_pred FROM counts), {_sql_boot('grp', 'src', ['overlap', 'n_gold', 'n_pred'], 'id')},
m AS (SELECT grp, {sql_gleu('overlap', 'n_pred', 'n_gold')} AS g FROM bs)
SELECT grp, round(quantile_cont(g, 0.025), 6) AS ci_low, round(quantile_cont(g, 0.975), 6) AS ci_high FROM m GROUP BY 1""")
def bootstrap_gleu_ci(spark, sf_dir):
    c = gleu_counts(pairs(spark, sf_dir), "gold_cypher", "predicted_cypher", ["id"]).withColumn("grp", F.expr("(id div 1000) % 4"))
    sums = resampled(c, ["grp"], ["id"], ["overlap", "n_gold", "n_pred"]).withColumn("g", gleu(F.col("overlap"), F.col("n_pred"), F.col("n_gold")))
    q = sums.groupBy("grp").agg(F.percentile("g", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return rounded(q.select("grp", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high")), 6)


@plan(f"""WITH {_PAIRED}, src AS (SELECT comparison, item, round(b_gleu - a_gleu, 6) AS d FROM pr), {_sql_boot('comparison', 'src', ['d'], 'item')},
m AS (SELECT comparison, d / n AS m FROM bs), p AS (SELECT comparison, count(*) AS n_pairs, avg(d) AS difference FROM src GROUP BY 1),
q AS (SELECT comparison, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, quantile_cont(m, 0.05) AS tost_low, quantile_cont(m, 0.95) AS tost_high,
  least(1.0, 2 * least(avg((m <= 1e-12)::INTEGER), avg((m >= -1e-12)::INTEGER))) AS p FROM m GROUP BY 1)
SELECT comparison, n_pairs, round(difference, 6) AS difference, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(tost_low, 6) AS tost_low, round(tost_high, 6) AS tost_high,
  tost_low > -0.05 AND tost_high < 0.05 AS equivalent, round(greatest(p, {1 / RESAMPLES}), 6) AS p_value, p < {1 / RESAMPLES} AS p_is_bound FROM p JOIN q USING (comparison)""")
def paired_bootstrap_tost(spark, sf_dir):
    p = _compared(spark, sf_dir).withColumns({"zero": F.lit(0.0), "d": F.round(F.col("b_gleu") - F.col("a_gleu"), 6)})
    return rounded(bootstrap_difference(p, ["comparison"], "item", "zero", "d"), 6)


@plan("""WITH k AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2), w AS (SELECT n_nationkey AS c_nationkey, s AS c_mktsegment FROM nation, (SELECT unnest(['BUILDING', 'MACHINERY', 'NONE']) AS s))
SELECT c_nationkey, c_mktsegment, c_custkey FROM w LEFT JOIN k USING (c_nationkey, c_mktsegment)""")
def job_lookup(spark, sf_dir):
    wanted = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("NONE"))).alias("c_mktsegment"))
    return lookup(read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), wanted, ["c_nationkey", "c_mktsegment"], ["c_custkey"])


@plan("""WITH j AS (SELECT l_partkey, l_suppkey % 4 AS judge, (l_returnflag = 'R')::INTEGER AS r FROM lineitem), k AS (SELECT l_partkey FROM j GROUP BY 1 HAVING count(DISTINCT judge) = 4)
SELECT judge, count(*) AS n, round(avg(r), 4) AS share FROM j SEMI JOIN k USING (l_partkey) GROUP BY 1""")
def judged_everywhere(spark, sf_dir):
    j = read(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 4).alias("judge"), (F.col("l_returnflag") == "R").cast("double").alias("r"))
    return rounded(judged_by_all(j, "l_partkey", "judge").groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("share")))


@plan("""WITH r AS (SELECT l_linenumber AS job, l_partkey AS item, l_quantity AS q, l_discount AS d, row_number() OVER (PARTITION BY l_linenumber, l_partkey ORDER BY l_orderkey, l_quantity, l_discount) AS place FROM lineitem),
o AS (SELECT * FROM r WHERE place = 1) SELECT a.job AS job_a, b.job AS job_b, count(*) AS n, round(sum(b.q - a.q), 4) AS quantity, round(avg((a.d = b.d)::INTEGER), 4) AS same_discount FROM o a JOIN o b ON a.item = b.item AND a.job < b.job GROUP BY 1, 2""")
def paired_repeats(spark, sf_dir):
    """Line numbers as jobs and parts as items, which most jobs have many times: the line of the smallest order counts, and
    of an order's own the least."""
    lines = read(spark, sf_dir, "lineitem").withColumnsRenamed({"l_linenumber": "job", "l_partkey": "item"})
    named = all_pairs(lines.select("job").distinct(), "job", "job").withColumn("comparison", F.concat_ws(" vs ", "job_a", "job_b"))
    p = paired_rows(lines, named, "job", "item", ["l_quantity", "l_discount"], ["l_orderkey"])
    each = p.groupBy("job_a", "job_b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b_l_quantity") - F.col("a_l_quantity")).alias("quantity"), F.avg((F.col("a_l_discount") == F.col("b_l_discount")).cast("double")).alias("same_discount"))
    return rounded(each)
