"""Readers and writers of the toolkit's records, with explicit schemas and defaults."""

import json
import logging
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.tables import flat

log = logging.getLogger(__name__)

CORPUS = "question STRING, schema STRING, cypher STRING, data_source STRING, instance_id STRING, database_reference_alias STRING, database_reference STRING, database STRING"
PREDICTION = (
    "instance_id STRING, question STRING, gold_cypher STRING, predicted_raw STRING, predicted_cypher STRING, database_reference STRING, data_source STRING, schema_mode STRING, "
    "schema_chars BIGINT, schema_chars_untrimmed BIGINT, schema_trimmed BOOLEAN, prompt_over_budget BOOLEAN, prompt_tokens BIGINT"
)
SCORED = PREDICTION + (
    ", gleu DOUBLE, exact_match BOOLEAN, normalised_exact_match BOOLEAN, complexity STRING, gold_hops INT, syntax_valid BOOLEAN, syntax_error STRING, execution_status STRING, "
    "execution_match BOOLEAN, gold_executed_ok BOOLEAN, pred_executed_ok BOOLEAN, gold_error STRING, pred_error STRING, gold_row_count BIGINT, pred_row_count BIGINT, "
    "order_sensitive BOOLEAN, gold_from_cache BOOLEAN, pred_from_cache BOOLEAN, dead_database BOOLEAN"
)
EVENT = (
    "run_name STRING, model STRING, variant STRING, session STRING, source STRING, step BIGINT, epoch DOUBLE, loss DOUBLE, eval_loss DOUBLE, train_runtime DOUBLE, grad_norm DOUBLE, "
    "learning_rate DOUBLE, wall_time DOUBLE, vram_peak_gb DOUBLE"
)
META = "run_name STRING, tag STRING, model_key STRING, backend STRING, split STRING, n_instances INT, schema_mode STRING, max_seq_length INT, total_seconds DOUBLE, seconds_per_item DOUBLE, timestamp STRING"
#: Records of planned jobs, of benches (a row a test in a nested array) and of exported models.
JOB = "job_id STRING, run_name STRING, model STRING, variant STRING, condition STRING, quant STRING, schema_mode STRING, reference_job_id STRING, priority INT, status STRING, error STRING, git_commit STRING, cpu_model STRING, edge_ids_sha STRING"
BENCH = (
    "model STRING, run_name STRING, status STRING, rows ARRAY<STRUCT<quant: STRING, error: STRING, n_prompt: INT, n_gen: INT, n_threads: INT, avg_ts: DOUBLE, stddev_ts: DOUBLE, model_size: BIGINT, "
    "model_n_params: BIGINT, gguf_size_bytes: BIGINT, n_batch: INT, n_ubatch: INT, cpu_info: STRING, build_commit: STRING, test_time: STRING>>"
)
EXPORT = "run_name STRING, model STRING, base STRING, status STRING, files ARRAY<STRUCT<quant: STRING, path: STRING, bytes: BIGINT, sha256: STRING>>, error STRING"
SPLITS = ("train", "test")


def with_defaults(df: DataFrame, schema: str) -> DataFrame:
    """All columns of a schema, those that are missing as NULL; others stay behind them."""
    have = {c.lower() for c in df.columns}
    fields = T._parse_datatype_string(schema).fields
    cols = [(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    known = {f.name.lower() for f in fields}
    return df.select(*cols, *[c for c in df.columns if c.lower() not in known])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def empty_is_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def read_corpus(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """A split with its defaults: an id from the row's place, the first database name that isn't empty, an unknown source."""
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    raw = spark.read.parquet(f"{folder}/{split}.parquet")
    df = with_defaults(raw.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__i")), CORPUS)
    # a row's place in the split: its place in its file and the rows of the files before, of which there is one row each
    files = df.groupBy(F.col("__f").alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    files = files.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    df = df.join(files, F.col("__f") == F.col("__g")).withColumn("__i", F.col("__i") + F.col("__before"))
    database = F.coalesce(*[empty_is_null(F.col(c)) for c in ("database_reference_alias", "database_reference", "database")])
    return df.withColumns({
        "instance_id": F.coalesce(empty_is_null(F.col("instance_id")), F.concat_ws("_", F.lit(split), "__i")),
        "database_reference": database,
        "data_source": F.coalesce(empty_is_null(F.col("data_source")), F.lit("unknown")),
        "split": F.lit(split),
    }).drop("__f", "__g", "__i", "__before", "database")


def read_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped, fields that are missing are NULL."""
    return spark.read.schema(schema).json(path)


def read_scored(spark: SparkSession, paths, completed: DataFrame | None = None) -> DataFrame:
    """Scored rows of many jobs, with job_id from the name of the file or of the folder that Spark wrote in its place; only of completed jobs
    (job_id), if those are given. Paths that are missing are skipped with a warning; patterns are left to Spark."""
    if isinstance(paths, list) and not any(c in p for p in paths for c in "*?[{"):
        paths = existing(spark, paths)
        if not paths:
            return spark.createDataFrame([], f"{SCORED}, job_id STRING")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)(?:_scored)?\.jsonl?(?:/[^/]*)?$", 1)
    df = spark.read.schema(SCORED).json(paths).withColumn("job_id", name)
    return df if completed is None else df.join(completed.select("job_id").distinct(), "job_id", "left_semi")


def with_meta(rows: DataFrame, meta: DataFrame, on: str = "job_id") -> DataFrame:
    """Rows beside what their job's meta document says; a job whose document is missing or broken has nulls."""
    have = [c for c in meta.columns if c != on and c not in rows.columns]
    return rows.join(meta.filter(F.col(on).isNotNull()).dropDuplicates([on]).select(on, *have), on, "left")


def read_documents(spark: SparkSession, path, schema: str) -> DataFrame:
    """One JSON document a file; a broken one gives NULLs."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def bench_rows(documents: DataFrame) -> DataFrame:
    """A row a test of each bench document (BENCH), with its name (pp and prompt tokens, or tg and generated ones), sizes in megabytes and bits
    a weight. A failed test has its error; a document without tests has one row of nulls."""
    d = documents.select("model", "run_name", F.explode_outer("rows").alias("r")).select("model", "run_name", "r.*")
    reads = (F.coalesce("n_prompt", F.lit(0)) > 0) & (F.coalesce("n_gen", F.lit(0)) == 0)
    test = F.when(F.col("error").isNull() & F.col("n_threads").isNotNull(), F.when(reads, F.concat(F.lit("pp"), "n_prompt")).otherwise(F.concat(F.lit("tg"), F.coalesce("n_gen", F.lit(0)))))
    mb = lambda c: F.nullif(F.col(c), F.lit(0).cast("long")) / 1e6
    bits = F.try_divide(8.0 * F.col("model_size"), F.nullif(F.col("model_n_params"), F.lit(0).cast("long")))
    return d.withColumns({"test": test, "model_size_mb": mb("model_size"), "gguf_size_mb": mb("gguf_size_bytes"), "bits_per_weight": F.when(F.col("model_size") > 0, bits)})


def export_files(documents: DataFrame) -> DataFrame:
    """A row a file of each export document (EXPORT)."""
    return documents.select("run_name", "model", "base", "status", "error", F.explode_outer("files").alias("f")).select("run_name", "model", "base", "status", "error", "f.*")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there; a warning tells of each that isn't. A list of files that a plan names, one a job."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            found.append(path)
        else:
            log.warning("%s is missing; skipped", path)
    return found


def read_events(spark: SparkSession, path) -> DataFrame:
    """Telemetry lines of all sessions; the session is the folder that holds the file's folder."""
    df = with_defaults(spark.read.schema(EVENT).json(path).withColumn("__p", F.split(F.col("_metadata.file_path"), "/")), EVENT)
    return df.withColumn("session", F.coalesce("session", F.get("__p", F.size("__p") - 2))).drop("__p")


def exploded_history(spark: SparkSession, path) -> DataFrame:
    """Trainer states: one row an entry of log_history."""
    states = read_documents(spark, path, f"log_history ARRAY<STRUCT<{_struct('step BIGINT, epoch DOUBLE, loss DOUBLE, eval_loss DOUBLE, grad_norm DOUBLE, learning_rate DOUBLE')}>>")
    return states.select(F.col("_metadata.file_path").alias("file"), F.inline("log_history"))


def _struct(ddl: str) -> str:
    return ", ".join(":".join(x.split()) for x in ddl.split(","))


def parsed_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """run and step of checkpoint folders in a listing: runs/<run>/checkpoint-<step>/..."""
    p = r"runs/([^/]+)/checkpoint-(\d+)(?:/|$)"
    return paths.filter(F.col(column).rlike(p)).withColumns({"run": F.regexp_extract(column, p, 1), "step": F.regexp_extract(column, p, 2).cast("long")})


def log_marks(spark: SparkSession, path, marks: dict[str, str]) -> DataFrame:
    """Lines of text logs that hold a mark, with its name; marks are regular expressions."""
    named = F.array_compact(F.array(*[F.when(F.col("value").rlike(p), F.lit(k)) for k, p in marks.items()]))
    return spark.read.text(path).select("value", F.explode(named).alias("mark"))


def key_values(c: Column) -> Column:
    """`key: value` lines of a text as a map; of a key that comes twice, the first value."""
    rows = F.filter(F.split(c, "\n"), lambda l: l.contains(":"))
    pairs = F.transform(rows, lambda l: F.struct(F.trim(F.substring_index(l, ":", 1)).alias("k"), F.trim(F.substring(l, F.instr(l, ":") + 1, F.length(l))).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


# ---- sinks -----------------------------------------------------------------------------------------------------------------------------
def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", joined: bool = False) -> None:
    """parquet, csv (with a header) or csv.gz; nested columns go into CSV as JSON, lists if joined by semicolons."""
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    text = lambda c, t: flat(F.col(c), t) if joined else F.to_json(c) if t.startswith(("struct", "array", "map")) else F.col(c)
    out = df.select(*[text(c, t).alias(c) for c, t in df.dtypes])
    w = out.write.mode("overwrite").option("header", True)
    (w.option("compression", "gzip") if kind == "csv.gz" else w).csv(path)


def report_document(tables: dict[str, DataFrame], rows: int = 10_000) -> str:
    """Small report tables as one JSON document; a table of more rows than that doesn't belong in one."""
    out = {}
    for name, df in tables.items():
        got = df.select(F.to_json(F.struct(*df.columns)).alias("j")).limit(rows + 1).collect()
        if len(got) > rows:
            raise ValueError(f"{name} has over {rows} rows; write it as a table")
        out[name] = [json.loads(r.j) for r in got]
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def _small(df: DataFrame, rows: int) -> list:
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"over {rows} rows; write them as a table")
    return got


def markdown(df: DataFrame, rows: int = 1_000) -> str:
    """A small table as Markdown; `-` where a value is missing. One of more rows is an error."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(map(show, r)) + " |" for r in _small(df, rows)])


def markdown_report(sections: dict[str, DataFrame], title: str = "Evaluation", rows: int = 1_000) -> str:
    """Small tables (overall, by complexity, by source, health of gold queries) under headings, as one Markdown document; `none` for an empty one."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        parts += [f"## {name}", markdown(df, rows) if df.limit(1).count() else "none"]
    return "\n\n".join(parts) + "\n"


def latex(df: DataFrame, rows: int = 1_000) -> str:
    """A small table as a LaTeX tabular; one of more rows is an error."""
    show = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("&", r"\&").replace("%", r"\%")
    body = [" & ".join(map(show, r)) + r" \\" for r in [df.columns, *_small(df, rows)]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", *body, r"\end{tabular}"])


def tag_of(path: str) -> str:
    return PurePosixPath(path).stem
