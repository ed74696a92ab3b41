"""Queries of batches by length, similar elements, plans of jobs, checkpoints to resume from, manifests and counters of examples."""

from pyspark.sql import functions as F

from tessera.functions.tokens import tokens
from tessera.operators import analysis as A
from tessera.operators import planning as P
from tessera.operators.ordering import in_order, length_batches, padding
from tessera.operators.similarity import prune_by_vectors, similar
from tessera.plans.bindings import _T
from tessera.plans.schemas import _PROMPT, _QUESTION, _SCHEMA, _parts
from tessera.session import read, spread, work_dir
from tessera.sources.manifest import manifest, tree_digest

PLANS: dict = {}


def plan(sql: str | None = None):
    def add(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return add


_BATCH = "SELECT doc_id, n_chars, (sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT // 200000 AS batch FROM documents"


@plan(_BATCH)
def sorted_batches(spark, sf_dir):
    """All documents in batches of 200,000 characters by length, in their old order again."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return length_batches(d, "n_chars", 200_000, [F.col("doc_id")]).orderBy("doc_id")


@plan(f"""WITH s AS ({_BATCH}), u AS (SELECT doc_id, n_chars, (sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT // 200000 AS batch FROM documents),
p AS (SELECT 'sorted' AS batches, batch, count(*) * max(n_chars) - sum(n_chars) AS padding FROM s GROUP BY batch UNION ALL SELECT 'as they come', batch, count(*) * max(n_chars) - sum(n_chars) FROM u GROUP BY batch)
SELECT batches, count(*) AS n, sum(padding)::BIGINT AS padding FROM p GROUP BY 1""")
def batch_savings(spark, sf_dir):
    """Padding of batches by length, beside that of batches of the same size in the order of ids."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    plain = in_order(d, [F.col("doc_id")], F.col("n_chars")).withColumn("batch", F.floor((F.col("running") - 1) / 200_000))
    both = {"sorted": length_batches(d, "n_chars", 200_000, [F.col("doc_id")]), "as they come": plain}
    each = [padding(b, "batch", "n_chars").agg(F.count(F.lit(1)).alias("n"), F.sum("padding").alias("padding")).select(F.lit(k).alias("batches"), "n", "padding") for k, b in both.items()]
    return each[0].unionByName(each[1])


@plan("""WITH e AS (SELECT label, concat('e', vec_id) AS element, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings),
s AS (SELECT q.vec_id AS question, element, list_cosine_similarity(q.embedding::DOUBLE[], e.v) AS score FROM embeddings q JOIN e ON e.label = q.label AND place <= 8)
SELECT question, element, round(score, 6) AS score FROM s WHERE score >= 0.45""")
def similar_elements(spark, sf_dir):
    """All vectors as questions against the eight elements (first vectors) of their label's schema, by cosine."""
    v = read(spark, sf_dir, "embeddings")
    ranked = v.groupBy("label").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, 8).alias("first"))
    elements = v.join(ranked, "label").filter(F.array_contains("first", F.col("vec_id")))
    elements = elements.select(F.col("label").alias("group"), F.concat(F.lit("e"), "vec_id").alias("element"), F.col("embedding").alias("vector"))
    questions = v.select(F.col("vec_id").alias("question"), F.col("label").alias("group"), F.col("embedding").alias("vector"))
    got = similar(questions, elements, 0.45)
    return got.select("question", "element", F.round("score", 6).alias("score"))


@plan()
def schema_prune_vectors(spark, sf_dir):
    """Schemas of all parts, pruned by vectors of their questions and elements: a text's vector is that of the row that its CRC-32 falls on."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.agg(F.max("vec_id") + 1).first()[0]
    at = lambda c: F.crc32(F.encode(c, "UTF-8")) % n
    rows = _parts(spark, sf_dir).withColumn("__at", at(F.col("question"))).join(v.select(F.col("vec_id").alias("__at"), F.col("embedding").alias("vector")), "__at", "left").drop("__at")
    from tessera.operators.similarity import schema_elements

    names = schema_elements(rows.select("schema_text").distinct(), "schema_text").select("name").distinct()
    vectors = names.withColumn("vec_id", at(F.col("name"))).join(v, "vec_id").select("name", F.col("embedding").alias("vector"))
    return prune_by_vectors(rows, "p_partkey", "schema_text", "vector", vectors, "pruned", 0.1).select("p_partkey", "pruned")


_JOBS = """j AS (SELECT 'n' || n_nationkey AS job, n_nationkey::BIGINT AS k, 1 AS cost, 0 AS level, NULL AS need FROM nation UNION ALL SELECT 'c' || c_custkey, c_custkey, 2, 1, 'n' || c_nationkey FROM customer
UNION ALL SELECT 'o' || o_orderkey, o_orderkey, o_orderkey % 5 + 1, 2, 'c' || o_custkey FROM orders),
r AS (SELECT *, CASE WHEN k % 4 <> 0 THEN 'new' WHEN k % 8 <> 0 THEN 'status failed' WHEN k % 3 = 0 THEN 'code differs' END AS reason FROM j)"""


def _sql_level(level: int, spent: str, before: str | None) -> str:
    ready = f"coalesce((SELECT status IN ('reused', 'admitted') FROM {before} b WHERE b.job = r.need), false)" if before else "true"
    return f"""a{level} AS (SELECT *, {ready} AS ready FROM r WHERE level = {level}),
l{level} AS (SELECT *, CASE WHEN reason IS NULL THEN 'reused' WHEN NOT ready THEN 'waiting' WHEN sum(CASE WHEN ready AND reason IS NOT NULL THEN cost ELSE 0 END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) <= 2000 - {spent} THEN 'admitted' ELSE 'over budget' END AS status FROM a{level}),
s{level} AS (SELECT {spent} + coalesce(sum(cost) FILTER (status = 'admitted'), 0) AS s FROM l{level})"""


@plan(f"""WITH {_JOBS}, {_sql_level(0, '0', None)}, {_sql_level(1, '(SELECT s FROM s0)', 'l0')}, {_sql_level(2, '(SELECT s FROM s1)', 'l1')}
SELECT job, level, status, reason FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)""")
def job_plan(spark, sf_dir):
    """Nations, their customers and their orders as jobs that need one another, with a budget; some are finished, some with other code."""
    n, c, o = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    job = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    row = lambda df, mark, key, cost: df.select(job(mark, key).alias("job"), F.col(key).cast("long").alias("k"), cost.cast("long").alias("cost"))
    jobs = row(n, "n", "n_nationkey", F.lit(1)).unionByName(row(c, "c", "c_custkey", F.lit(2))).unionByName(row(o, "o", "o_orderkey", F.col("o_orderkey") % 5 + 1)).withColumn("code", F.lit("v1"))
    needs = c.select(job("c", "c_custkey").alias("job"), job("n", "c_nationkey").alias("needs")).unionByName(o.select(job("o", "o_orderkey").alias("job"), job("c", "o_custkey").alias("needs")))
    finished = jobs.filter("k % 4 = 0").select("job", F.when(F.col("k") % 3 == 0, "v2").otherwise("v1").alias("code"), F.when(F.col("k") % 8 == 0, "completed").otherwise("failed").alias("status"))
    return P.plan_jobs(jobs, needs, finished, ["code"], [F.col("k"), F.col("job")], "cost", 2000).select("job", "level", "status", "reason")


@plan("""WITH f AS (SELECT o_custkey AS run, o_orderkey // 10 AS step, CASE o_orderkey % 3 WHEN 0 THEN 'state' WHEN 1 THEN 'weights' ELSE 'notes' END AS file FROM orders),
e AS (SELECT run, step, count(DISTINCT file) FILTER (file IN ('state', 'weights')) = 2 AS ok FROM f GROUP BY 1, 2),
b AS (SELECT run, max(step) FILTER (ok) AS chosen, count(*) AS checkpoints, max(step) AS newest FROM e GROUP BY 1),
s AS (SELECT run, count(*) AS skipped FROM e JOIN b USING (run) WHERE step > coalesce(chosen, -1) GROUP BY 1)
SELECT c_custkey AS run, chosen AS step, coalesce(checkpoints, 0) AS checkpoints, coalesce(skipped, 0) AS skipped, CASE WHEN chosen IS NOT NULL THEN newest - chosen END AS repeated,
CASE WHEN checkpoints IS NULL THEN 'start' WHEN chosen IS NULL THEN 'not resumable' ELSE 'resume' END AS state FROM customer LEFT JOIN b ON run = c_custkey LEFT JOIN s USING (run)""")
def resume_steps(spark, sf_dir):
    """Customers as runs and their orders as files of checkpoints: the newest that has both state and weights."""
    file = F.when(F.col("o_orderkey") % 3 == 0, "state").when(F.col("o_orderkey") % 3 == 1, "weights").otherwise("notes")
    listing = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.expr("o_orderkey div 10").alias("step"), file.alias("file"))
    return P.resume_choice(listing, ["state", "weights"], read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run")))


@plan("""WITH f AS (SELECT c_nationkey AS nation, string_agg(concat(c_custkey, ' ', c_name, chr(10)), '' ORDER BY c_custkey) AS t FROM customer GROUP BY 1),
s AS (SELECT nation, strlen(t) AS bytes, sha256(t) AS sha256 FROM f) SELECT *, (SELECT sha256(string_agg(concat(sha256, ' nation=', nation), chr(10) ORDER BY concat('nation=', nation))) FROM s) AS digest FROM s""")
def file_manifest(spark, sf_dir):
    """A file of customers a nation: sizes, hashes, and one digest of all files."""
    path = work_dir(spark, "files")
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.concat_ws(" ", "c_custkey", "c_name").alias("value"))
    c.repartition("nation").sortWithinPartitions("nation", "c_custkey").drop("c_custkey").write.partitionBy("nation").text(path)
    files = manifest(spark, path, "*.txt").withColumn("path", F.substring_index("path", "/", 1))
    return files.select(F.substring_index("path", "=", -1).cast("int").alias("nation"), "bytes", "sha256", F.lit(tree_digest(files)).alias("digest"))


@plan(f"""WITH p AS (SELECT p_partkey % 60 AS n, len(regexp_extract_all(concat({_PROMPT[0]}, {_SCHEMA}, {_PROMPT[1]}, {_QUESTION}, {_PROMPT[2]}), {_T})) AS prompt FROM part)
SELECT count(*) AS "rows", count(*) FILTER (n = 0) AS empty_target, count(*) FILTER (n + 32 > 80) AS long_target, count(*) FILTER (n BETWEEN 1 AND 48) AS kept, count(*) FILTER (n BETWEEN 1 AND 48 AND prompt + n > 80) AS trimmed FROM p""")
def example_counters(spark, sf_dir):
    """Token features of all parts within 80 tokens, and how many rows that drops and trims, counted as they are written."""
    p = spread(read(spark, sf_dir, "part"))
    rows = p.select(F.expr(_QUESTION).alias("question"), F.expr(_SCHEMA).alias("schema_text"), F.expr("repeat('a ', CAST(p_partkey % 60 AS INT))").alias("target"))
    counters = A.Counters()
    A.features(rows, 80, ids=lambda c: F.transform(tokens(c), lambda t: F.hash(t)), counters=counters).write.parquet(work_dir(spark, "features"))
    got = counters.get()
    names = ["rows", "empty_target", "long_target", "kept", "trimmed"]
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))
