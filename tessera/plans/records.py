"""Queries that write the driver's tables in the record formats and read them back by the readers."""

from pyspark.sql import functions as F

from tessera.operators.evaluation import score_rows
from tessera.plans.bindings import SQL_SCORED, rows
from tessera.plans.scoring import rounded
from tessera.session import read, work_dir
from tessera.sources import records as R

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


@plan("""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)
SELECT CASE WHEN p_partkey % 5 = 0 THEN concat('train_', i) ELSE p_partkey::VARCHAR END AS instance_id, p_name AS question, CASE WHEN p_partkey % 2 = 0 THEN 'a' WHEN p_partkey % 3 = 0 THEN 'b' END AS database_reference,
CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE p_brand END AS data_source, 'train' AS split FROM p""")
def corpus_records(spark, sf_dir):
    """A split in several files: ids from the row's place in the split, the first database name that isn't empty, an unknown source."""
    p = read(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey AS STRING) END AS instance_id", "p_name AS question", "CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE '' END AS database_reference_alias",
        "CASE WHEN p_partkey % 3 = 0 THEN 'b' END AS database_reference", "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS data_source")
    folder = work_dir(spark, "corpus")
    R.write_table(p.repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey").drop("p_partkey"), f"{folder}/train.parquet")
    return R.read_corpus(spark, folder, "train").select("instance_id", "question", "database_reference", "data_source", "split")


@plan(f"""WITH {SQL_SCORED} SELECT job_id, CASE job_id WHEN 'job0' THEN 'm0' WHEN 'job1' THEN 'm1' END AS model_key, count(*) AS n, count(*) FILTER (exact_match) AS n_exact, round(avg(gleu), 4) AS gleu, count(DISTINCT id) AS ids FROM scored WHERE job_id <> 'job3' GROUP BY 1""")
def scored_records(spark, sf_dir):
    """Jobs' scored rows as JSON lines, of completed jobs alone, beside the job's meta document, of which one is broken."""
    folder = work_dir(spark, "scored")
    s = score_rows(rows(spark, sf_dir), ["id"]).select("job_id", F.col("id").cast("string").alias("instance_id"), "gold_cypher", "predicted_cypher", "gleu", "exact_match", "execution_status")
    for k in range(4):
        R.write_lines(s.filter(F.col("job_id") == f"job{k}").drop("job_id"), f"{folder}/job{k}_scored.jsonl")
    meta = spark.createDataFrame([("job0", '{"model_key": "m0", "n_instances": 3}'), ("job1", '{"model_key": "m1"}'), ("job2", "{broken")], "job_id string, value string")
    for k in range(3):
        meta.filter(F.col("job_id") == f"job{k}").select("value").coalesce(1).write.text(f"{folder}/meta/job{k}.json")
    told = R.read_documents(spark, f"{folder}/meta/*.json", R.META).withColumn("job_id", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.json/", 1))
    completed = spark.createDataFrame([(f"job{k}",) for k in range(3)], "job_id string")
    got = R.with_meta(R.read_scored(spark, [f"{folder}/job{k}_scored.jsonl" for k in range(4)], completed), told)
    return rounded(got.groupBy("job_id", "model_key").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact_match").alias("n_exact"), F.avg("gleu").alias("gleu"), F.countDistinct("instance_id").alias("ids")))


@plan("SELECT concat('s', user_id % 3) AS session, count(*) AS n, round(sum(value), 4) AS loss, count(DISTINCT event_id) AS steps FROM events GROUP BY 1")
def event_records(spark, sf_dir):
    """Telemetry lines of three sessions; a session is the folder that holds the file's folder."""
    folder = work_dir(spark, "events")
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), F.lit("run").alias("run_name"), (F.col("user_id") % 3).alias("s"))
    for k in range(3):
        R.write_lines(e.filter(F.col("s") == k).drop("s"), f"{folder}/s{k}")
    got = R.read_events(spark, f"{folder}/*")
    return rounded(got.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.countDistinct("step").alias("steps")))


@plan("SELECT n_regionkey AS run, n_nationkey AS step, n_nationkey / 4.0 AS loss FROM nation")
def history_records(spark, sf_dir):
    """Trainer states, one document a run, with a list of entries each."""
    folder, n = work_dir(spark, "history"), read(spark, sf_dir, "nation")
    states = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("step"), (F.col("n_nationkey") / 4.0).alias("loss"))).alias("log_history"))).alias("value"))
    for k in range(5):
        states.filter(F.col("n_regionkey") == k).select("value").coalesce(1).write.text(f"{folder}/r{k}.json")
    got = R.exploded_history(spark, f"{folder}/*.json")
    return got.select(F.regexp_extract("file", r"/r(\d)\.json", 1).cast("long").alias("run"), "step", "loss")


@plan(r"""WITH p AS (SELECT concat(CASE WHEN o_orderkey % 4 = 0 THEN 'logs/' ELSE 'x/runs/' END, 'r', o_custkey % 5, '/checkpoint-', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '-tmp' ELSE '/model' END) AS path FROM orders),
m AS (SELECT regexp_extract(path, 'runs/([^/]+)/checkpoint-(\d+)(?:/|$)', 1) AS run, regexp_extract(path, 'runs/([^/]+)/checkpoint-(\d+)(?:/|$)', 2)::BIGINT AS step FROM p WHERE regexp_matches(path, 'runs/([^/]+)/checkpoint-(\d+)(?:/|$)'))
SELECT run, count(*) AS n, max(step) AS last_step FROM m GROUP BY 1""")
def listing_records(spark, sf_dir):
    """Checkpoint folders in a listing of files: the newest step of each run, from which it would resume."""
    o = read(spark, sf_dir, "orders").selectExpr("concat(CASE WHEN o_orderkey % 4 = 0 THEN 'logs/' ELSE 'x/runs/' END, 'r', o_custkey % 5, '/checkpoint-', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '-tmp' ELSE '/model' END) AS path")
    return R.parsed_paths(o).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last_step"))


@plan("""WITH l AS (SELECT concat(CASE c_custkey % 3 WHEN 0 THEN 'Adapter verified: ' WHEN 1 THEN 'Remapped ' ELSE 'step ' END, c_name) AS value FROM customer)
SELECT CASE WHEN contains(value, 'Adapter') THEN 'verified' ELSE 'remapped' END AS mark, count(*) AS n, min(value) AS first_line FROM l WHERE contains(value, 'Adapter verified:') OR contains(value, 'Remapped') GROUP BY 1""")
def log_records(spark, sf_dir):
    """Lines of text logs that hold a mark."""
    folder = work_dir(spark, "logs")
    read(spark, sf_dir, "customer").selectExpr("concat(CASE c_custkey % 3 WHEN 0 THEN 'Adapter verified: ' WHEN 1 THEN 'Remapped ' ELSE 'step ' END, c_name) AS value").write.text(folder)
    return R.log_marks(spark, folder, {"verified": "Adapter verified:", "remapped": "Remapped"}).groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_line"))


@plan("SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def key_value_records(spark, sf_dir):
    """Text of `key: value` lines; of a key that comes twice, the first."""
    text = F.concat(F.lit("Name: "), "n_name", F.lit("\nno pair\nRegion:"), F.col("n_regionkey").cast("string"), F.lit("\nName: again"))
    n = read(spark, sf_dir, "nation").select("n_nationkey", R.key_values(text).alias("m"))
    return n.select("n_nationkey", F.col("m")["Name"].alias("name"), F.col("m")["Region"].alias("region"))


@plan("SELECT c_custkey::VARCHAR AS c_custkey, c_name, concat('a; ', c_mktsegment) AS tags, NULL::VARCHAR AS extra FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name, NULL, 'b' FROM supplier")
def flat_records(spark, sf_dir):
    """Two tables whose columns differ, as one CSV: what one lacks is null, lists are joined by semicolons."""
    folder = work_dir(spark, "csv")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array(F.lit("a"), "c_mktsegment").alias("tags"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("b").alias("extra"))
    R.write_table(R.union_all([c, s]), folder, "csv.gz", joined=True)
    return spark.read.option("header", True).csv(folder).select("c_custkey", "c_name", "tags", "extra")
