"""Queries over health, telemetry, latency, samples, sets and plans."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.arrays import cosine, masked_labels, padded, padded_length
from tessera.functions.tokens import tokens
from tessera.operators import tables as T
from tessera.operators.evaluation import top_groups
from tessera.plans.bindings import SQL_PAIRS, SQL_ROWS, _T, pairs, rows
from tessera.plans.scoring import rounded
from tessera.session import read

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


_ORDERS = "SELECT n_name, o_orderstatus, o_orderpriority, o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_BAD = "o_orderstatus = 'F' OR n_name < 'B'"


def _orders(spark, sf_dir):
    o, c, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("n_name", "o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey")


@plan(f"""WITH o AS ({_ORDERS}), c AS (SELECT n_name, count(*) AS executed, count(*) FILTER ({_BAD}) AS failed FROM o GROUP BY 1 HAVING count(*) FILTER ({_BAD}) > 0),
e AS (SELECT n_name, o_orderpriority AS e, count(*) AS c, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, o_orderpriority) AS r FROM o WHERE {_BAD} GROUP BY 1, 2),
t AS (SELECT n_name, string_agg(e || ':' || c, '; ' ORDER BY r) AS top_errors FROM e WHERE r <= 5 GROUP BY 1)
SELECT n_name, executed, failed, round(failed / executed::DOUBLE, 4) AS failure_rate, failed = executed AS dead, top_errors FROM c JOIN t USING (n_name)""")
def gold_health(spark, sf_dir):
    return rounded(T.gold_health(_orders(spark, sf_dir), "n_name", F.expr(_BAD), F.col("o_orderpriority")))


@plan(f"""WITH o AS ({_ORDERS}), d AS (SELECT n_name FROM o GROUP BY 1 HAVING bool_and({_BAD}))
SELECT n_name IN (SELECT n_name FROM d) AS dead_database, o_orderstatus, count(*) AS n FROM o GROUP BY 1, 2""")
def dead_flag_semijoin(spark, sf_dir):
    return T.flag_dead(_orders(spark, sf_dir), "n_name", F.expr(_BAD)).groupBy("dead_database", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


_EVENTS = "SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS step, value, floor(epoch(ts))::BIGINT AS secs, event_id FROM events"
_DEDUP = f"""WITH e AS ({_EVENTS}), d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, step ORDER BY (event_id % 3 <> 0)::INTEGER, secs DESC, event_id DESC) AS r FROM e)"""


def _events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp").cast("long")
    return e.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("step"), "value", at.alias("secs"), "event_id")


def _latest(spark, sf_dir):
    return T.latest_events(_events(spark, sf_dir), ["user_id", "event_type", "step"], (F.col("event_id") % 3 != 0).cast("int"), "secs", "event_id")


@plan(f"{_DEDUP} SELECT user_id, event_type, step, value, secs, event_id FROM d WHERE r = 1")
def telemetry_dedup(spark, sf_dir):
    return _latest(spark, sf_dir)


@plan(f"""{_DEDUP}, c AS (SELECT user_id, step, min(value) AS value FROM d WHERE r = 1 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS z FROM c)
SELECT user_id, count(*) AS points, round(min_by(value, step), 4) AS first_value, round(max_by(value, step), 4) AS last_value, round(min(value), 4) AS least_value,
round(avg(value) FILTER (z <= 5), 4) AS tail_mean, max(step) AS last_step FROM k GROUP BY 1""")
def telemetry_summary(spark, sf_dir):
    curve = _latest(spark, sf_dir).groupBy("user_id", "step").agg(F.min("value").alias("value"))
    return rounded(T.curve_summary(curve, "user_id", "step", "value"))


@plan(f"""WITH e AS ({_EVENTS}), s AS (SELECT user_id, event_type, max(secs) - min(secs) AS s FROM e GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, round(sum(s) / 3600.0, 4)::DOUBLE AS hours FROM s GROUP BY 1""")
def session_spans(spark, sf_dir):
    return rounded(T.session_hours(_events(spark, sf_dir), "user_id", "event_type", "secs").withColumn("hours", F.col("hours").cast("double")))


@plan("""WITH p AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
r AS (SELECT user_id, place, place - row_number() OVER (PARTITION BY user_id ORDER BY place) AS g FROM p WHERE f)
SELECT user_id, min(place) AS first_place, max(place) AS last_place, count(*) AS length FROM r GROUP BY user_id, g""")
def consecutive_failures(spark, sf_dir):
    r = T.failure_runs(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return r.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("first_place", "last_place", "length")])


@plan("""SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95,
round(max(value), 4) AS longest, round(3.6e6 / nullif(avg(value), 0), 2) AS per_hour FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    l = T.latency(read(spark, sf_dir, "events"), ["event_type"], "value")
    return l.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p90", "p95", "longest")], F.round("per_hour", 2).alias("per_hour"))


def _rank(p: float) -> str:
    return f"l[least(len(l) - 1, floor(len(l) * {p})::INTEGER) + 1] AS p{round(p * 100)}"


@plan(f"""WITH g AS (SELECT lang, list_sort(list(n_chars)) AS l, round(avg(n_chars), 4) AS mean, max(n_chars) AS longest, round(avg((n_chars > 2000)::INTEGER), 4) AS over_budget FROM documents GROUP BY 1)
SELECT lang, len(l)::BIGINT AS n, mean, {', '.join(map(_rank, (0.5, 0.9, 0.95, 0.99)))}, longest, over_budget FROM g""")
def nearest_rank_percentiles(spark, sf_dir):
    return rounded(T.lengths(read(spark, sf_dir, "documents"), ["lang"], "n_chars", 2000))


@plan("""SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, round(median(n_chars), 4)::DOUBLE AS median_chars, max(n_chars) AS most_chars,
round(avg((lang = 'en')::INTEGER), 4) AS share_en, array_to_string(list_sort(list(DISTINCT lang)), '; ') AS lang_list FROM documents""")
def dataset_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    langs = F.array_join(F.array_sort(F.collect_set("lang")), "; ")
    return rounded(d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.median("n_chars").alias("median_chars"), F.max("n_chars").alias("most_chars"), F.avg((F.col("lang") == "en").cast("double")).alias("share_en"), langs.alias("lang_list")))


@plan("WITH u AS (SELECT source AS alias FROM documents UNION ALL SELECT 'benchmark' FROM benchmark) SELECT alias, count(*) AS n FROM u GROUP BY 1")
def alias_counts(spark, sf_dir):
    u = read(spark, sf_dir, "documents").select(F.col("source").alias("alias")).union(read(spark, sf_dir, "benchmark").select(F.lit("benchmark")))
    return u.groupBy("alias").agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 12")
def top_sources(spark, sf_dir):
    return top_groups(read(spark, sf_dir, "documents"), "source", 12)


@plan("SELECT c_custkey, c_name FROM customer ORDER BY md5(concat_ws(':', '3407', c_custkey)), c_custkey LIMIT 500")
def sample_seeded(spark, sf_dir):
    return T.sample(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 500, 3407)


@plan("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '3407', doc_id)), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= least(200, greatest(1, floor(n * 0.05))) THEN 'val' ELSE 'train' END AS split FROM r""")
def split_train_val(spark, sf_dir):
    return T.split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05, 200, 3407)


@plan("""WITH c AS (SELECT lang, count(*) AS c, sum(count(*)) OVER () AS t, row_number() OVER (ORDER BY lang) = count(*) OVER () AS last FROM documents GROUP BY 1), q AS (SELECT lang, last, round_even(100.0 * c / t, 0)::BIGINT AS q FROM c),
z AS (SELECT lang, CASE WHEN last THEN 100 - coalesce(sum(q) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE q END AS q FROM q),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '3407', doc_id)), doc_id) AS r FROM documents) SELECT doc_id, d.lang FROM d JOIN z USING (lang) WHERE r <= q""")
def sample_stratified(spark, sf_dir):
    return T.stratified(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 100, 3407)


@plan("SELECT lang, count(*) AS n, substr(sha256(array_to_string(list_sort(list(doc_id)), chr(10))), 1, 16) AS fingerprint FROM documents GROUP BY 1")
def row_fingerprint(spark, sf_dir):
    return T.fingerprint(read(spark, sf_dir, "documents"), ["lang"], "doc_id")


@plan("""WITH i AS (SELECT source, count(DISTINCT sha256(lang)) AS k, substr(sha256(array_to_string(list_sort(list(DISTINCT lang)), chr(10))), 1, 16) AS f FROM documents GROUP BY 1)
SELECT count(*) AS n_groups, count(DISTINCT f) AS n_sets, count(DISTINCT f) = 1 AS same_sets FROM i""")
def set_equality(spark, sf_dir):
    each = T.fingerprint(read(spark, sf_dir, "documents").select("source", "lang").distinct(), ["source"], "lang")
    return each.agg(F.count(F.lit(1)).alias("n_groups"), F.countDistinct("fingerprint").alias("n_sets"), (F.countDistinct("fingerprint") == 1).alias("same_sets"))


@plan("""WITH e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT label, list_inner_product(v, c) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(c, c))) AS s FROM e JOIN c USING (label))
SELECT label, count(*) AS n, round(avg(s), 4) AS mean_score FROM s WHERE s >= 0.45 GROUP BY 1""")
def cosine_filter(spark, sf_dir):
    """Vectors near their label's centroid, over all components."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    c = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda m: m["x"]).alias("c"))
    s = e.join(c, "label").withColumn("s", cosine(F.col("v"), F.col("c")))
    return rounded(s.filter("s >= 0.45").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score")))


@plan("""WITH g AS (SELECT l_returnflag, l_partkey % 50 AS m, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2), h AS (SELECT l_returnflag, m, q + (CASE WHEN m = 7 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS q FROM g),
b AS (SELECT l_returnflag, m || '|' || q AS r, 1 AS s FROM g UNION ALL SELECT l_returnflag, m || '|' || q, -1 FROM h), e AS (SELECT l_returnflag, r, sum(s) AS d, count(*) AS c FROM b GROUP BY 1, 2)
SELECT l_returnflag, bool_and(d = 0) AS same, sum(c)::BIGINT AS rows, sum(abs(d))::BIGINT AS differing FROM e GROUP BY 1""")
def result_set_equality(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("m", F.col("l_partkey") % 50)
    g = l.groupBy("l_returnflag", "m").agg(F.sum("l_quantity").cast("long").alias("q"))
    h = g.withColumn("q", F.col("q") + F.when((F.col("m") == 7) & (F.col("l_returnflag") == "R"), 1).otherwise(0))
    return T.same_results(g, h, ["l_returnflag"], ["m", "q"])


@plan("""WITH r AS (SELECT l_returnflag, md5('l_partkey,l_linestatus|' || row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_linestatus) || ':{"c0":' || l_partkey || ',"c1":"' || l_linestatus || '"}') AS m FROM lineitem)
SELECT l_returnflag, concat_ws('-', count(*), sum(('0x' || substr(m, 1, 12))::BIGINT), sum(('0x' || substr(m, 13, 12))::BIGINT)) AS signature FROM r GROUP BY 1""")
def result_signatures(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_linestatus", "l_orderkey", "l_linenumber")
    return T.result_signature(l, ["l_returnflag"], ["l_partkey", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"], compare_keys=True)


@plan("""WITH e AS (SELECT n_nationkey, s FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer)), a AS (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2)
SELECT n_nationkey, e.s AS segment, coalesce(n, 0) AS n FROM e LEFT JOIN a ON n_nationkey = c_nationkey AND e.s = a.s""")
def expected_vs_actual(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    segments = c.select(F.col("c_mktsegment").alias("segment")).distinct()
    expected = read(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(segments), F.lit(True))
    actual = c.filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return T.expected_against_actual(expected, actual, ["n_nationkey", "segment"], "n", 0)


_LAST = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)"


@plan(f"""WITH k AS (SELECT o_custkey, o_orderstatus, o_orderpriority, {_LAST} AS r FROM orders), d AS (SELECT * FROM k WHERE r = 1), p AS (SELECT c_custkey AS o_custkey, 'O' AS o_orderstatus, concat(1 + c_custkey % 2, '-x') AS o_orderpriority FROM customer),
j AS (SELECT p.o_custkey, CASE WHEN d.o_custkey IS NULL THEN 'new' WHEN p.o_orderstatus <> d.o_orderstatus THEN 'o_orderstatus differs' WHEN p.o_orderpriority <> d.o_orderpriority THEN 'o_orderpriority differs' END AS reason FROM p LEFT JOIN d USING (o_custkey))
SELECT coalesce(reason, '-') AS reason, CASE WHEN reason IS NULL THEN 'reuse' ELSE 'run' END AS action, count(*) AS n FROM j GROUP BY 1, 2""")
def provenance_reuse(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    done = read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r = 1").select("o_custkey", "o_orderstatus", "o_orderpriority")
    planned = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.concat((F.col("c_custkey") % 2 + 1).cast("string"), F.lit("-x")).alias("o_orderpriority"))
    j = T.reuse(planned, done, ["o_custkey"], ["o_orderstatus", "o_orderpriority"])
    return j.groupBy(F.coalesce("reason", F.lit("-")).alias("reason"), "action").agg(F.count(F.lit(1)).alias("n"))


@plan("""WITH r AS (SELECT o_orderkey, o_orderpriority, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running_cost FROM orders)
SELECT o_orderpriority, o_orderkey, running_cost FROM r WHERE running_cost <= 500000000""")
def budget_admission(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"))
    return T.admitted(o, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "cost", 500000000).select("o_orderpriority", "o_orderkey", "running_cost")


@plan("""WITH s AS (SELECT DISTINCT o_custkey, (o_orderkey // 10) AS step FROM orders), c AS (SELECT *, step % 3 <> 0 AS c FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, c ORDER BY step DESC) AS r FROM c),
f AS (SELECT *, min(CASE WHEN c AND r <= 2 THEN step END) OVER (PARTITION BY o_custkey) AS floor FROM r) SELECT o_custkey, step, coalesce(step >= floor, true) AS kept FROM f""")
def checkpoint_retention(spark, sf_dir):
    s = read(spark, sf_dir, "orders").select("o_custkey", F.expr("o_orderkey div 10").alias("step")).distinct()
    return T.retention(s, "o_custkey", "step", F.col("step") % 3 != 0, 2)


@plan(f"""WITH {SQL_PAIRS}, t AS (SELECT id, id % 16 AS batch, len(regexp_extract_all(gold_cypher, {_T})) AS p, len(regexp_extract_all(predicted_cypher, {_T})) AS h FROM pairs),
w AS (SELECT *, (ceil(max(p + h) OVER (PARTITION BY batch) / 8.0) * 8)::INTEGER AS width FROM t)
SELECT id, width, width AS padded_ids, width AS padded_labels, (p + h)::BIGINT AS attention, p::BIGINT AS masked, (width - p - h)::BIGINT AS padding FROM w""")
def batch_padding(spark, sf_dir):
    p = pairs(spark, sf_dir).select("id", (F.col("id") % 16).alias("batch"), tokens(F.col("gold_cypher")).alias("p"), tokens(F.col("predicted_cypher")).alias("h"))
    p = p.select("id", "batch", F.transform("p", lambda t: F.hash(t)).alias("prompt"), F.transform("h", lambda t: F.hash(t)).alias("target"))
    p = p.withColumns({"ids": F.concat("prompt", "target"), "labels": masked_labels(F.col("prompt"), F.col("target"))})
    longest = p.groupBy("batch").agg(padded_length(F.max(F.size("ids"))).alias("width"))  # a row a batch
    p = p.join(longest, "batch")
    p = p.withColumns({"pi": padded(F.col("ids"), F.col("width"), 0), "pl": padded(F.col("labels"), F.col("width"), -100)})
    masked = F.size(F.filter(F.slice("labels", 1, F.size("prompt")), lambda x: x == -100)).cast("long")
    return p.select("id", "width", F.size("pi").alias("padded_ids"), F.size("pl").alias("padded_labels"), F.size("ids").cast("long").alias("attention"), masked.alias("masked"), (F.col("width") - F.size("ids")).cast("long").alias("padding"))


@plan(f"""WITH {SQL_ROWS}, j AS (SELECT job_id, count(*) AS n, count(*) FILTER (execution_status = 'connection_failed') AS c, count(*) FILTER (execution_status = 'gold_failed') AS g FROM rows_ GROUP BY 1)
SELECT 'connection_failures' AS "check", job_id AS subject, c = 0 AS passed, concat(c, ' of ', n) AS detail FROM j UNION ALL
SELECT 'gold_failures_under_5_percent', job_id, CASE WHEN n >= 20 THEN g * 20 < n END, concat(g, ' of ', n) FROM j""")
def integrity_checks(spark, sf_dir):
    status = lambda s: F.count_if(F.coalesce(F.col("execution_status") == s, F.lit(False)))
    j = rows(spark, sf_dir).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), status("connection_failed").alias("c"), status("gold_failed").alias("g"))
    of = lambda c: F.concat_ws(" of ", F.col(c), F.col("n"))
    a = j.select(*T.check("connection_failures", F.col("job_id"), F.col("c") == 0, of("c")))
    return a.unionByName(j.select(*T.check("gold_failures_under_5_percent", F.col("job_id"), F.when(F.col("n") >= 20, F.col("g") * 20 < F.col("n")), of("g"))))


@plan(f"""WITH {SQL_ROWS}, c AS (SELECT job_id, coalesce(execution_status, 'none') AS s, count(*) AS n FROM rows_ GROUP BY 1, 2)
SELECT job_id, '[' || string_agg('{{"status":"' || s || '","n":' || n || '}}', ',' ORDER BY s) || ']' AS report FROM c GROUP BY 1""")
def canonical_report_json(spark, sf_dir):
    c = rows(spark, sf_dir).groupBy("job_id", F.coalesce("execution_status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("report"))


@plan("""SELECT source, lang, coalesce(quality, -1) AS quality, count(*) AS n_all, count(*) FILTER (doc_id % 10 = 0) AS n_subset FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2, 3""")
def composition(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("source", "lang", F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("doc_id") % 10 == 0).alias("n_subset"))
