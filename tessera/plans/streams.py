"""Streaming queries over the events table, drained with all that is there."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.session import read, work_dir
from tessera.streaming.guards import chained, drain, event_counts, failure_guard, file_stream, first_events, last_segment, latest_state
from tessera.streaming.state import breaker, log_lines

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source reads folders; a single file is found by its name
    return file_stream(spark, f"{sf_dir}/events*.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(df, mode: str = "append", **how):
    return drain(df, "out", f"{work_dir(df.sparkSession, 'stream')}/state", mode, **how)


@plan("""WITH p AS (SELECT user_id, event_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY place) AS k FROM (SELECT *, place - row_number() OVER (PARTITION BY user_id ORDER BY place) AS g FROM p WHERE f))
SELECT user_id, event_id AS "at", 3::BIGINT AS run FROM r WHERE k = 3""")
def stream_guard(spark, sf_dir):
    """Users with three errors in a row."""
    e = _stream(spark, sf_dir).select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return _drained(failure_guard(e, "user_id", "event_id", "failed", 3))


@plan("SELECT user_id, event_type, count(DISTINCT props) AS n FROM events GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    """Distinct events, each passed on once however often it is replayed."""
    e = first_events(_stream(spark, sf_dir), "ts", ["user_id", "event_type", "props"], "400 days")
    return _drained(e.select("user_id", "event_type", "props")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@plan("SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Events by type and day; the counts replace each other as late events come."""
    w = event_counts(_stream(spark, sf_dir), "ts", ["event_type"], "1 day", "2 days")
    return _drained(w, "complete").select("event_type", F.col("window.start").cast("date").cast("string").alias("day"), "n")


@plan("SELECT c_custkey, concat('done ', c_custkey) AS line FROM customer")
def progress_lines(spark, sf_dir):
    line = F.concat(F.lit("1%\r50%\rdone "), "c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", last_segment(line).alias("line"))


@plan("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_latest(spark, sf_dir):
    """The event that holds for each user and type: a later one supersedes."""
    return _drained(latest_state(_stream(spark, sf_dir), ["user_id", "event_type"], "event_id", ["value"]), "complete")


@plan("SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_type = 'error' GROUP BY 1")
def stream_chained(spark, sf_dir):
    """A first stream picks errors, a second counts them by user."""
    errors = _stream(spark, sf_dir).filter("event_type = 'error'").select("user_id", "event_id")
    out = chained(errors, lambda e: e.selectExpr("user_id", "event_id", "1 AS one"), work_dir(spark, "chained"))
    return out.groupBy("user_id").agg(F.count("one").alias("n"), F.sum("event_id").alias("ids"))


@plan("""WITH p AS (SELECT user_id, event_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY place) AS k FROM (SELECT *, place - row_number() OVER (PARTITION BY user_id ORDER BY place) AS g FROM p WHERE f)),
o AS (SELECT user_id, min(event_id) AS opened FROM r WHERE k = 3 GROUP BY 1)
SELECT user_id, count(*) FILTER (opened IS NULL OR event_id <= opened) AS calls, count(*) FILTER (event_id > opened) AS spared, count(*) FILTER (NOT f AND (opened IS NULL OR event_id <= opened)) AS ok FROM p LEFT JOIN o USING (user_id) GROUP BY 1""")
def stream_breaker(spark, sf_dir):
    """Events as requests to their users' targets, an error as a lost connection: after three in a row the rest is answered without a call."""
    e = _stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    got = _drained(breaker(e, "user_id", "event_id", lambda r: (r.event_type != "error", r.event_type == "error", None)), rocksdb=True)
    return got.groupBy("user_id").agg(F.count_if("called").alias("calls"), F.count_if(~F.col("called")).alias("spared"), F.count_if("ok").alias("ok"))


@plan("""SELECT c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS line_number, 'done ' || c_name AS line FROM customer""")
def stream_log_lines(spark, sf_dir):
    """A log a nation, a progress line a customer, cut into pieces of 57 characters that come in three micro-batches in a scattered order."""
    line = F.concat(F.lit("1%\r50%\rdone "), "c_name", F.when(F.col("c_custkey") % 3 == 0, "\r").otherwise(""), F.lit("\n"))
    w = Window.partitionBy("c_nationkey")
    parts = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", line.alias("line"))
    ends = F.sum(F.length("line")).over(w.orderBy("c_custkey"))
    parts = parts.select(F.col("c_nationkey").alias("file"), "line", (ends - F.length("line")).alias("begin"), ends.alias("end"), F.sum(F.length("line")).over(w).alias("size"))
    # a piece takes its part of each line that it overlaps
    cut = parts.withColumn("piece", F.explode(F.sequence(F.expr("begin div 57"), F.expr("(end - 1) div 57"))))
    own = F.substring("line", F.greatest(F.lit(1), F.col("piece") * 57 - F.col("begin") + 1).cast("int"), (F.least(F.col("end"), (F.col("piece") + 1) * 57) - F.greatest(F.col("begin"), F.col("piece") * 57)).cast("int"))
    pieces = cut.withColumn("own", own).groupBy("file", "piece", "size").agg(F.array_sort(F.collect_list(F.struct("begin", "own"))).alias("t"))
    pieces = pieces.select("file", (F.col("piece") * 57).alias("offset"), F.array_join("t.own", "").alias("text"), ((F.col("piece") + 1) * 57 >= F.col("size")).alias("last"))
    path = work_dir(spark, "log")
    pieces.repartition(3, F.xxhash64("file", "offset")).write.parquet(path)
    return _drained(log_lines(file_stream(spark, path, pieces.schema)), rocksdb=True)


@plan("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, 3::BIGINT AS runs FROM events GROUP BY 1")
def stream_resumed(spark, sf_dir):
    """A stream that its time limit stops after each of the first two micro-batches, and that goes on where it stopped."""
    path = work_dir(spark, "source")
    read(spark, sf_dir, "events").select("event_id", "event_type").repartition(3).write.parquet(path)
    state = f"{work_dir(spark, 'resumed')}/state"
    for _ in range(2):
        drain(file_stream(spark, path, "event_id long, event_type string"), "out", state, seconds=0)
    out = drain(file_stream(spark, path, "event_id long, event_type string"), "out", state).withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    runs = out.agg(F.countDistinct("batch").alias("runs"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).join(F.broadcast(runs))
