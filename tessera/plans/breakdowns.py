"""Queries of breakdowns in order, latency, training, benches, retention and elements outside a schema."""

from pyspark.sql import functions as F

from tessera.functions.graph_query import query_elements
from tessera.operators import breakdowns as B
from tessera.operators import schema as S
from tessera.operators.evaluation import score_rows
from tessera.plans.bindings import SQL_SCORED, rows
from tessera.plans.schemas import _parts
from tessera.plans.scoring import rounded
from tessera.session import read, work_dir
from tessera.sources import records as R

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


_TIERS = "list_position(['easy', 'medium', 'hard', 'extra_hard'], label)"


@plan(f"""WITH {SQL_SCORED}, l AS (SELECT 'by_database_access' AS section, CASE WHEN has_database THEN 'with_database' ELSE 'no_database' END AS label, * FROM scored UNION ALL SELECT 'by_complexity', complexity, * FROM scored
UNION ALL SELECT 'by_data_source', coalesce(data_source, 'unknown'), * FROM scored),
m AS (SELECT section, label, count(*) AS n, round(avg(exact_match::INTEGER), 4) AS exact_match, round(avg(gleu), 4) AS gleu_mean FROM l GROUP BY 1, 2),
p AS (SELECT *, CASE section WHEN 'by_complexity' THEN {_TIERS} WHEN 'by_database_access' THEN CASE label WHEN 'no_database' THEN 1 ELSE 2 END ELSE row_number() OVER (PARTITION BY section ORDER BY n DESC, label) END::INTEGER AS place FROM m)
SELECT * FROM p WHERE section <> 'by_data_source' OR place <= 15""")
def score_breakdowns(spark, sf_dir):
    s = score_rows(rows(spark, sf_dir), ["id"])
    got = B.score_breakdowns(s.withColumn("complexity", F.col("complexity")), percentiles=False)
    return rounded(got.select("section", "place", "label", "n", "exact_match", "gleu_mean"))


_Q = lambda c, n: ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {n}_p{p}" for q, p in ((0.5, 50), (0.9, 90), (0.95, 95)))
_LAT = """SELECT l_linenumber, l_extendedprice AS wall, CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice * l_discount END AS pre, l_extendedprice * (1 - l_discount) AS decode, l_suppkey AS pn, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS gn,
l_quantity * 3 AS pt, l_quantity AS tt, l_partkey % 11 = 0 AS stopped, CASE WHEN l_orderkey % 13 = 0 THEN 'timeout' END AS error FROM lineitem"""


@plan(f"""WITH r AS ({_LAT}) SELECT l_linenumber, count(*) AS n, round(avg(wall), 6) AS wall_ms_mean, {_Q('wall', 'wall_ms')}, round(max(wall), 6) AS wall_ms_max, round(avg(pre), 6) AS prefill_ms_mean, {_Q('pre', 'prefill_ms')}, round(max(pre), 6) AS prefill_ms_max,
round(avg(decode), 6) AS decode_ms_mean, {_Q('decode', 'decode_ms')}, round(max(decode), 6) AS decode_ms_max, round(avg(pn), 6) AS prompt_tokens_mean, round(avg(gn), 6) AS generated_tokens_mean, round(median(pt), 6) AS prefill_tps_median, round(median(tt), 6) AS decode_tps_median,
round(sum(pre) / sum(wall), 6) AS prefill_share_of_wall, round(3.6e6 / avg(wall), 6) AS queries_per_hour, count(*) FILTER (stopped) AS n_stopped_limit, count(error) AS n_request_errors FROM r GROUP BY 1""")
def latency_stats(spark, sf_dir):
    """Times of all lines: price as wall time, of which the discount is the prefill, missing for some."""
    l = read(spark, sf_dir, "lineitem").selectExpr(
        "l_linenumber", "l_extendedprice AS wall", "CASE WHEN l_partkey % 7 <> 0 THEN l_extendedprice * l_discount END AS pre", "l_extendedprice * (1 - l_discount) AS decode", "l_suppkey AS pn",
        "CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS gn", "l_quantity * 3 AS pt", "l_quantity AS tt", "l_partkey % 11 = 0 AS stopped", "CASE WHEN l_orderkey % 13 = 0 THEN 'timeout' END AS error")
    return rounded(B.latency_stats(l, ["l_linenumber"], "wall", "pre", "decode", "pn", "gn", "pt", "tt", "stopped", "error"), 6)


@plan("""WITH c AS (SELECT user_id, event_id AS step, CASE WHEN event_id % 3 <> 0 THEN value END AS loss, CASE WHEN event_id % 3 = 0 THEN value * 2 END AS ev, CASE WHEN user_id % 4 <> 0 THEN value / 10 END AS vram FROM events),
m AS (SELECT c_custkey AS user_id, (c_custkey % 9) * 100 AS global_step, c_acctbal AS told FROM customer),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS z FROM c WHERE loss IS NOT NULL),
s AS (SELECT user_id, count(*) AS points, round(min_by(loss, step), 4) AS first_value, round(max_by(loss, step), 4) AS last_value, round(min(loss), 4) AS least_value, round(avg(loss) FILTER (z <= 5), 4) AS tail_mean, max(step) AS last_step FROM t GROUP BY 1),
e AS (SELECT user_id, round(max_by(ev, step) FILTER (ev IS NOT NULL), 4) AS last_eval_loss, round(min(ev), 4) AS least_eval_loss, max(vram) AS v FROM c GROUP BY 1)
SELECT user_id, global_step, coalesce(points, 0) AS points, first_value, last_value, least_value, tail_mean, last_step, last_eval_loss, least_eval_loss, round(points / nullif(global_step // 10, 0), 3) AS coverage, round(coalesce(v, told), 4) AS vram_peak_gb
FROM m LEFT JOIN s USING (user_id) LEFT JOIN e USING (user_id) WHERE points IS NOT NULL""")
def training_summary(spark, sf_dir):
    """Customers as runs, with their events as a curve: losses, coverage of what should have been logged, peak memory."""
    e = read(spark, sf_dir, "events").selectExpr("user_id", "event_id AS step", "CASE WHEN event_id % 3 <> 0 THEN value END AS loss", "CASE WHEN event_id % 3 = 0 THEN value * 2 END AS ev", "CASE WHEN user_id % 4 <> 0 THEN value / 10 END AS vram")
    meta = read(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "(c_custkey % 9) * 100 AS global_step", "c_acctbal AS vram_peak_gb")
    got = B.training_summary(e, meta, "user_id", "step", "loss", "ev", "vram").filter("points > 0")
    keep = [c for c in got.columns if c != "coverage"]
    return rounded(got.select(*keep)).join(got.select(F.col("user_id").alias("u"), "coverage"), F.col("user_id") == F.col("u")).drop("u")


@plan("""WITH s AS (SELECT DISTINCT o_custkey, o_orderkey // 10 AS step FROM orders), c AS (SELECT o_custkey, step, row_number() OVER (PARTITION BY o_custkey ORDER BY step DESC) AS r FROM s WHERE step % 3 <> 0),
f AS (SELECT o_custkey, min(step) AS floor FROM c WHERE r <= 2 GROUP BY 1) SELECT o_custkey, step, coalesce(step >= floor, true) OR step % 10 = 0 AS kept FROM s LEFT JOIN f USING (o_custkey)""")
def protected_checkpoints(spark, sf_dir):
    s = read(spark, sf_dir, "orders").select("o_custkey", F.expr("o_orderkey div 10").alias("step")).distinct()
    return B.protected_retention(s, "o_custkey", "step", F.col("step") % 3 != 0, 2, F.col("step") % 10 == 0)


@plan("""WITH b AS (SELECT s_nationkey AS model, s_suppkey % 4 + 1 AS threads, CASE WHEN s_suppkey % 2 = 0 THEN 512 ELSE 0 END AS n_prompt, CASE WHEN s_suppkey % 2 = 1 THEN 64 ELSE 0 END AS n_gen, abs(s_acctbal) + 1 AS ts FROM supplier UNION ALL
SELECT c_nationkey, c_custkey % 4 + 1, CASE WHEN c_custkey % 3 = 0 THEN 512 ELSE 0 END, CASE WHEN c_custkey % 3 <> 0 THEN 64 ELSE 0 END, abs(c_acctbal) + 1 FROM customer),
t AS (SELECT model, threads, max(ts) FILTER (n_prompt > 0) AS pp, max(ts) FILTER (n_gen > 0) AS tg FROM b GROUP BY 1, 2), e AS (SELECT model, threads, 700 / pp + 48 / tg AS s FROM t WHERE pp IS NOT NULL AND tg IS NOT NULL)
SELECT model, arg_min(threads, s) AS threads, round(min(s), 6) AS seconds FROM e GROUP BY 1""")
def best_threads(spark, sf_dir):
    """Suppliers and customers as speeds of tests by nation and number of threads."""
    side = lambda t, k, n, prompt: read(spark, sf_dir, t).selectExpr(f"{n} AS model", f"{k} % 4 + 1 AS threads", f"CASE WHEN {prompt} THEN 512 ELSE 0 END AS n_prompt", f"CASE WHEN {prompt} THEN 0 ELSE 64 END AS n_gen", f"abs({'s' if t == 'supplier' else 'c'}_acctbal) + 1 AS ts")
    b = side("supplier", "s_suppkey", "s_nationkey", "s_suppkey % 2 = 0").unionByName(side("customer", "c_custkey", "c_nationkey", "c_custkey % 3 = 0"))
    return B.best_threads(b, ["model"], "threads", "n_prompt", "n_gen", "ts", 700, 48).withColumn("seconds", F.round("seconds", 6))


@plan("""SELECT 'm' || p_size AS model, 'q' || p_partkey % 3 AS quant, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'pp512' ELSE 'tg64' END AS test, count(*) AS n, round(avg(CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END), 4) AS speed, count(*) FILTER (p_partkey % 7 = 0) AS errors,
round(max(CASE WHEN p_partkey % 7 <> 0 THEN 8.0 * p_partkey * 1000 / 4000 END), 4) AS bits FROM part GROUP BY 1, 2, 3""")
def bench_records(spark, sf_dir):
    """Parts as tests of benches, a document a size, written as JSON with nested rows and read back."""
    p = read(spark, sf_dir, "part")
    failed = F.col("p_partkey") % 7 == 0
    ok = lambda c: F.when(~failed, c)
    row = F.struct(F.concat(F.lit("q"), (F.col("p_partkey") % 3).cast("string")).alias("quant"), F.when(failed, "crashed").alias("error"), ok(F.when(F.col("p_partkey") % 2 == 0, 512).otherwise(0)).alias("n_prompt"), ok(F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(64)).alias("n_gen"), ok(F.lit(4)).alias("n_threads"),
                   ok(F.col("p_retailprice")).alias("avg_ts"), ok(F.col("p_partkey") * 1000).alias("model_size"), ok(F.lit(4000)).alias("model_n_params"))
    docs = p.groupBy(F.concat(F.lit("m"), "p_size").alias("model")).agg(F.collect_list(row).alias("rows"))
    path = work_dir(spark, "bench")
    R.write_lines(docs, path)
    got = R.bench_rows(R.read_lines(spark, path, R.BENCH))
    each = got.groupBy("model", "quant", "test").agg(F.count(F.lit(1)).alias("n"), F.avg("avg_ts").alias("speed"), F.count("error").alias("errors"), F.max("bits_per_weight").alias("bits"))
    return each.withColumns({"speed": F.round("speed", 4), "bits": F.round("bits", 4)})


_USED = "concat('MATCH (a:Part', p_size, ')-[r:', CASE WHEN p_size % 2 = 0 THEN 'SUPPLIED_BY' ELSE 'MADE_BY' END, ']->(b:Supplier) WHERE ', CASE WHEN p_size % 3 = 0 THEN 'r.since' ELSE 'a.name' END, ' > 1 RETURN b.name AS y')"


@plan("""WITH p AS (SELECT p_size, p_partkey, p_partkey % 3 AS kind, (p_size % 2 = 1 OR p_partkey % 3 = 1)::INTEGER AS rel, (p_partkey % 3 = 1)::INTEGER AS lab, (p_partkey % 3 = 1 AND p_size % 3 = 0)::INTEGER AS prop,
  (p_partkey % 3 = 0 AND p_size % 3 = 0)::INTEGER AS lost, p_partkey % 5 > 0 AS judged, (p_partkey % 2 = 0)::INTEGER AS ok FROM part WHERE p_partkey % 3 <> 2),
q AS (SELECT *, greatest(rel, lab, prop) AS unk FROM p)
SELECT p_size % 4 AS job, count(*) AS n_checked, round(avg(unk), 4) AS share_any_unknown, round(avg(lab), 4) AS share_unknown_labels, round(avg(rel), 4) AS share_unknown_rel_types, round(avg(prop), 4) AS share_unknown_properties, round(avg(lost), 4) AS share_outside_prompt,
round(avg(ok) FILTER (unk = 1 AND judged), 4) AS accuracy_with_unknown, round(avg(ok) FILTER (unk = 0 AND judged), 4) AS accuracy_without_unknown FROM q GROUP BY 1""")
def outside_schema(spark, sf_dir):
    """Queries about all parts against their schema and its pruned part: labels, relationship types and properties that are in neither, or only
    in the whole one."""
    d = _parts(spark, sf_dir).withColumn("e", query_elements(F.expr(_USED)))
    d = S.prune(S.parsed(d, "schema_text"), "schema", "question", "small").filter("schema.parsed")
    d = S.unknown_elements(d, "e", "schema", "small")
    d = d.withColumns({"execution_status": F.when(F.col("p_partkey") % 5 > 0, "compared"), "gold_executed_ok": F.lit(True), "execution_match": F.col("p_partkey") % 2 == 0})
    return rounded(B.outside_schema(d.withColumn("job", F.col("p_size") % 4), ["job"]))


@plan("""WITH g AS (SELECT source, count(*) AS n, sum(quality)::BIGINT AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n::DOUBLE AS v FROM g)
SELECT source, round(greatest(v - (v - 0.1), 0), 4) AS bar_low, round(greatest(least(v + 0.1, 0.5) - v, 0), 4) AS bar_high FROM p""")
def interval_bars(spark, sf_dir):
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    v = d.groupBy("source").agg(F.avg("quality").alias("v"))
    bars = B.interval_bars(F.col("v"), F.col("v") - 0.1, F.least(F.col("v") + 0.1, F.lit(0.5)))
    return rounded(v.select("source", *[c.alias(k) for k, c in bars.items()]))
