"""Queries of examples, families, wide tables, benches and headlines."""

from pyspark.sql import functions as F

from tessera.functions.stats import wilson
from tessera.operators import analysis as A
from tessera.plans.bindings import SQL_PAIRS, _T, pairs
from tessera.plans.schemas import _QUESTION, _SCHEMA
from tessera.plans.scoring import _CENTRE, _HALF, _P, rounded
from tessera.session import read, spread

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


def _corpus(spark, sf_dir):
    p = spread(read(spark, sf_dir, "part"))
    target = F.when(F.col("p_partkey") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" RETURN "), "p_partkey"))
    return p.select(F.col("p_partkey").cast("string").alias("instance_id"), F.expr(_QUESTION).alias("question"), F.expr(_SCHEMA).alias("schema"), target.alias("cypher"), F.lit("db").alias("database_reference"), F.col("p_brand").alias("data_source"))


@plan(f"""SELECT CAST(p_partkey AS VARCHAR) AS instance_id, {_QUESTION} AS question, length({_SCHEMA})::INTEGER AS chars, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE concat('RETURN ', p_partkey) END AS target FROM part""")
def built_examples(spark, sf_dir):
    return A.examples(_corpus(spark, sf_dir)).select("instance_id", "question", F.length("schema_text").alias("chars"), "target")


_JOBS = """SELECT concat('j', min(c_custkey)) AS job_id, concat('m', c_nationkey) AS model, ['enhanced', 'pruned'][c_custkey % 2 + 1] AS variant, ['zero_shot', 'fine_tuned', 'cross_schema'][c_custkey % 3 + 1] AS condition,
['hf', 'llamacpp'][c_custkey // 6 % 2 + 1] AS backend FROM customer GROUP BY 2, 3, 4, 5"""


@plan(f"""WITH j AS ({_JOBS}), p AS (SELECT a.job_id AS job_a, b.job_id AS job_b, a.model AS am, b.model AS bm, a.variant AS av, b.variant AS bv, a.condition AS ac, b.condition AS bc, a.backend AS ab, b.backend AS bb FROM j a, j b)
SELECT job_a, job_b, 'fine_tuning_effect' AS family, am || ' ' || av AS comparison FROM p WHERE am = bm AND av = bv AND ab = bb AND ac = 'zero_shot' AND bc = 'fine_tuned' UNION ALL
SELECT job_a, job_b, 'schema_filtering', am || ' ' || ac FROM p WHERE am = bm AND ac = bc AND ab = bb AND ac IN ('fine_tuned', 'zero_shot') AND av = 'enhanced' AND bv = 'pruned' UNION ALL
SELECT job_a, job_b, 'model_comparison', am || ' vs ' || bm FROM p WHERE ab = bb AND am < bm AND av = 'enhanced' AND bv = 'enhanced' AND ac = 'fine_tuned' AND bc = 'fine_tuned' UNION ALL
SELECT job_a, job_b, 'quantisation', am || ' ' || av FROM p WHERE am = bm AND av = bv AND ac = 'fine_tuned' AND bc = 'fine_tuned' AND ab = 'hf' AND bb = 'llamacpp' UNION ALL
SELECT job_a, job_b, 'schema_inference_effect', am FROM p WHERE am = bm AND ab = bb AND av = 'enhanced' AND bv = 'enhanced' AND ac = 'fine_tuned' AND bc = 'cross_schema' UNION ALL
SELECT job_a, job_b, 'schema_training_effect', am FROM p WHERE am = bm AND ab = bb AND av = 'enhanced' AND bv = 'pruned' AND ac = 'cross_schema' AND bc = 'fine_tuned'""")
def comparison_families(spark, sf_dir):
    """A registry of jobs out of the customers, one for each combination that occurs, and the pairs that differ in one respect."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    named = c.select(k, F.concat(F.lit("m"), "c_nationkey").alias("model"), pick(["enhanced", "pruned"], k % 2).alias("variant"), pick(["zero_shot", "fine_tuned", "cross_schema"], k % 3).alias("condition"), pick(["hf", "llamacpp"], F.floor(k / 6) % 2).alias("backend"))
    jobs = named.groupBy("model", "variant", "condition", "backend").agg(F.concat(F.lit("j"), F.min(k)).alias("job_id"))
    return A.comparison_families(jobs).select("job_a", "job_b", "family", "comparison")


@plan("""SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN n END) AS O, max(CASE WHEN o_orderstatus = 'P' THEN n END) AS P
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def wide_metrics(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return A.wide(n, ["o_orderpriority"], "o_orderstatus", "n", ["F", "O", "P"])


@plan("""WITH c AS (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS cost FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY cost, l_suppkey) AS r FROM c)
SELECT l_partkey, l_suppkey, cost FROM r WHERE r = 1""")
def cheapest_choice(spark, sf_dir):
    return A.cheapest(read(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", F.col("l_extendedprice"))


@plan("""WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, n_chars FROM r WHERE r = n // 2 + 1""")
def typical_documents(spark, sf_dir):
    return A.typical(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id")


@plan("SELECT p_partkey, round(length(p_name)::DOUBLE / (length(p_name) + p_size - 3), 4) AS ratio FROM part WHERE length(p_name) + p_size - 3 <> 0 AND length(p_name)::DOUBLE / (length(p_name) + p_size - 3) < 0.95")
def pruned_rows(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.length("p_name").alias("after"), (F.length("p_name") + F.col("p_size") - 3).alias("before"))
    return rounded(A.pruned(p, "before", "after").select("p_partkey", "ratio"))


@plan(f"""WITH {SQL_PAIRS}, d AS (SELECT conv_id % 4 AS grp, len(regexp_extract_all(predicted_cypher, {_T})) - len(regexp_extract_all(gold_cypher, {_T})) AS d, count(*) AS n FROM pairs GROUP BY 1, 2)
SELECT grp, '{{' || string_agg('"' || d || '":' || n, ',' ORDER BY d) || '}}' AS diff_counts, round(coalesce(sum(n) FILTER (d = 0), 0) / sum(n), 4)::DOUBLE AS share_equal FROM d GROUP BY 1""")
def token_parity(spark, sf_dir):
    from tessera.functions.tokens import tokens

    p = pairs(spark, sf_dir).select((F.col("conv_id") % 4).alias("grp"), F.size(tokens(F.col("gold_cypher"))).alias("a"), F.size(tokens(F.col("predicted_cypher"))).alias("b"))
    return rounded(A.difference_counts(p, ["grp"], "a", "b"))


@plan(f"""WITH g AS (SELECT source, sum(toxic)::BIGINT AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, printf('%.3f [%.3f, %.3f]', {_P}, least(greatest(0, {_CENTRE} - {_HALF}), {_P}), greatest(least(1, {_CENTRE} + {_HALF}), {_P})) AS toxic FROM g""")
def headline_table(spark, sf_dir):
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    g = d.groupBy("source").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return A.headline(g.select("source", (F.col("k") / F.col("n")).alias("toxic"), low.alias("toxic_low"), high.alias("toxic_high")), ["source"], ["toxic"])


@plan("""SELECT l_partkey, round(sum(l_quantity) / 1e6, 6) AS size_mb, round(8.0 * sum(l_quantity) / nullif(max(l_linenumber) - 1, 0), 4) AS bits_per_weight, round(3.6e6 / nullif(avg(l_tax), 0), 0) AS per_hour FROM lineitem GROUP BY 1""")
def derived_units(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("b"), (F.max("l_linenumber") - 1).alias("p"), F.avg("l_tax").alias("m"))
    u = A.units(F.col("b"), F.col("p"), F.col("m"))
    return g.select("l_partkey", F.round(u["size_mb"], 6).alias("size_mb"), F.round(u["bits_per_weight"], 4).alias("bits_per_weight"), F.round(u["per_hour"], 0).alias("per_hour"))


@plan("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS run_value, event_type AS run_event_type FROM events")
def coerced_numbers(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("value"), "event_type")
    return A.prefixed(A.numeric(e, ["value"]), "run_", ["event_id"])


@plan("""WITH l AS (SELECT unnest(['BUILDING', 'NONE', 'MACHINERY']) AS c_mktsegment), c AS (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_name LIKE '%7%' GROUP BY 1) SELECT c_mktsegment, n FROM l LEFT JOIN c USING (c_mktsegment)""")
def reindexed_labels(spark, sf_dir):
    c = A.with_database(read(spark, sf_dir, "customer"), "c_name", "7").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return A.reindexed(c, "c_mktsegment", ["BUILDING", "NONE", "MACHINERY"])
