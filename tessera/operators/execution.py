"""Executing queries against databases: answers come from a content-addressed store where it has them, and are added to it where it hasn't."""

import json
import math
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import FATAL_CONNECTION, TRANSIENT_CONNECTION, connection_trouble, is_ordered
from tessera.session import work_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

ANSWER = "key STRING, target STRING, kind STRING, query STRING, ok BOOLEAN, keys ARRAY<STRING>, rows ARRAY<STRING>, error STRING, elapsed_s DOUBLE"
#: Connection errors in a row after which a target counts as unreachable.
PATIENCE = 3
#: Requests of one target that one task takes; a target that is asked more is dealt to several.
TASK_REQUESTS = 1000

#: A backend makes answers (ANSWER) of requests (key, target, kind, query), one for each.
Backend = Callable[[DataFrame], DataFrame]
#: Of a target, a function that runs a query and returns its column names and rows, or raises.
Connect = Callable[[str], Callable[[str], tuple[list[str], list[list]]]]


def canonical(value, digits: int = 6):
    """A value as it is stored: fractions rounded, keys in order, bytes as hex, other types as text."""
    if isinstance(value, float):
        return round(value, digits) if math.isfinite(value) else str(value)
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, list | tuple):
        return [canonical(v, digits) for v in value]
    if isinstance(value, dict):
        return {str(k): canonical(value[k], digits) for k in sorted(value, key=str)}
    return value.hex() if isinstance(value, bytes | bytearray) else str(value)


def _trouble(error: str) -> str | None:
    low = error.lower()
    return "fatal" if any(t in low for t in FATAL_CONNECTION) else "transient" if any(t in low for t in TRANSIENT_CONNECTION) else None


def client_backend(connect: Connect, retries: int = 2, wait: Callable[[int, bool], None] | None = None, pause_s: float = 0.0, digits: int = 6) -> Backend:
    """Calls a database client, a connection a task and target.

    A failed call is tried again `retries` times; wait(attempt, connection) sleeps between tries. A fatal connection error, or PATIENCE
    connection errors in a row, make a target unreachable: its later requests in the task are answered without a call. A request of kind
    `explain` runs `EXPLAIN query` and keeps no rows. Requests of a target go to tasks of TASK_REQUESTS.
    """
    wait = wait or (lambda attempt, connection: time.sleep(5.0 * (attempt + 1) if connection else 1.0 + attempt))

    def one(run, query: str, kind: str):
        error, trouble = "unknown", None
        for attempt in range(retries + 1):
            if pause_s:
                time.sleep(pause_s)
            began = time.monotonic()
            try:
                keys, rows = run()(f"EXPLAIN {query}" if kind == "explain" else query)
                rows = [] if kind == "explain" else [json.dumps(canonical(list(r), digits), sort_keys=True, ensure_ascii=False) for r in rows]
                return True, [str(k) for k in keys], rows, None, round(time.monotonic() - began, 3), None
            except Exception as e:  # whatever a client raises is the query's result
                error = f"{type(e).__name__}: {e}"
                trouble = _trouble(error)
            if trouble == "fatal":
                break
            if attempt < retries:
                wait(attempt, trouble is not None)
        return False, [], [], error, 0.0, trouble

    def calls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict = {}
        failures: dict[str, int] = {}
        closed: dict[str, str] = {}
        for pdf in frames:
            out = []
            for key, target, kind, query in pdf[["key", "target", "kind", "query"]].itertuples(index=False):
                if target in closed:
                    out.append((key, target, kind, query, False, [], [], f"unreachable: {closed[target]}", 0.0))
                    continue

                def run(target=target):
                    if target not in clients:
                        clients[target] = connect(target)
                    return clients[target]

                *answer, trouble = one(run, query, kind)
                failures[target] = failures.get(target, 0) + 1 if trouble else 0
                if trouble == "fatal" or failures[target] >= PATIENCE:
                    closed[target] = answer[3]
                out.append((key, target, kind, query, *answer))
            yield pd.DataFrame(out, columns=["key", "target", "kind", "query", "ok", "keys", "rows", "error", "elapsed_s"])

    def backend(requests: DataFrame) -> DataFrame:
        counts = requests.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / TASK_REQUESTS).alias("__tasks"))
        dealt = requests.join(counts, "target").withColumn("__salt", F.pmod(F.xxhash64("key"), F.col("__tasks")))
        return dealt.repartition("target", "__salt").select("key", "target", "kind", "query").mapInPandas(calls, ANSWER)

    return backend


def table_backend(results: DataFrame, most_targets: int = 1000) -> Backend:
    """Answers from a table of results (target, query, ok, keys, rows, error, elapsed_s). Only the targets that are asked for are read, if they
    are not more than most_targets; of more, all. A query without a result is answered with an error."""

    def backend(requests: DataFrame) -> DataFrame:
        asked = [r.target for r in requests.select("target").distinct().limit(most_targets + 1).collect()]
        found = results.filter(F.col("target").isin(asked)) if len(asked) <= most_targets else results
        once = found.groupBy("target", "query").agg(F.max(F.struct("ok", "keys", "rows", "error", "elapsed_s")).alias("a"))
        return requests.join(once, ["target", "query"], "left").select(
            "key", "target", "kind", "query", F.coalesce("a.ok", F.lit(False)).alias("ok"), F.coalesce("a.keys", F.array().cast("array<string>")).alias("keys"),
            F.when(F.col("kind") == "explain", F.array().cast("array<string>")).otherwise(F.coalesce("a.rows", F.array().cast("array<string>"))).alias("rows"),
            F.when(F.col("a").isNull(), "no stored result").otherwise(F.col("a.error")).alias("error"), F.coalesce("a.elapsed_s", F.lit(0.0)).alias("elapsed_s"))

    return backend


@dataclass
class Executor:
    """Runs requests through a backend and keeps the answers in a store, in a folder for each of the first two digits of their keys.

    A request's key is the SHA-256 of target, kind and query. Equal requests run once. Answers that tell of the connection are given but
    not stored, as they say nothing of the query; such rows in an older store are passed over. A run that finds all its requests in the store
    calls nothing and writes nothing. A run that fails has stored nothing.
    """

    spark: SparkSession
    store: str
    backend: Backend
    #: Requests that the last call of answers() had to run.
    executed: int = field(default=0, init=False)

    def _stored(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"{ANSWER}, bucket STRING")
        rows = self.spark.read.schema(f"{ANSWER}, bucket STRING").parquet(self.store)
        return rows.filter(F.col("ok") | connection_trouble(F.col("error")).isNull())

    def answers(self, requests: DataFrame) -> DataFrame:
        """One row for each distinct (target, kind, query): ANSWER, from_cache and connection (fatal, transient or null)."""
        asked = requests.select("target", F.coalesce("kind", F.lit("run")).alias("kind"), F.coalesce("query", F.lit("")).alias("query")).distinct()
        asked = asked.withColumn("key", F.sha2(F.encode(F.concat_ws("|", "target", "kind", "query"), "UTF-8"), 256)).withColumn("bucket", F.left("key", F.lit(2)))
        blank = F.trim(F.regexp_replace("query", r"\s+", " ")) == ""
        stored = self._stored()
        missing = asked.filter(~blank).join(stored.select("bucket", "key"), ["bucket", "key"], "left_anti")
        made = f"{work_dir(self.spark, 'answers')}"
        self.backend(missing.select("key", "target", "kind", "query")).write.parquet(made)
        new = self.spark.read.schema(ANSWER).parquet(made)
        good = new.filter(F.col("ok") | connection_trouble(F.col("error")).isNull())
        self.executed = new.count()
        if self.executed:
            good.withColumn("bucket", F.left("key", F.lit(2))).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.store)
        # two runs at a time may both have stored a key
        place = F.row_number().over(Window.partitionBy("key").orderBy("elapsed_s", F.to_json(F.struct("ok", "keys", "rows", "error"))))
        old = stored.join(asked.select("bucket", "key"), ["bucket", "key"], "left_semi").withColumn("n", place).filter("n = 1").drop("n", "bucket")
        empty = asked.filter(blank).select(
            "key", "target", "kind", "query", F.lit(False).alias("ok"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("rows"),
            F.lit("empty query").alias("error"), F.lit(0.0).alias("elapsed_s"))
        out = old.withColumn("from_cache", F.lit(True)).unionByName(new.unionByName(empty).withColumn("from_cache", F.lit(False)))
        unreachable = F.when(F.col("error").startswith("unreachable: "), "transient")
        return out.withColumn("connection", F.when(~F.col("ok"), F.coalesce(connection_trouble(F.col("error")), unreachable)))

    def compare(self, pairs: DataFrame, order_sensitive: bool = True, compare_keys: bool = False) -> DataFrame:
        """Pairs (target, gold_cypher, predicted_cypher and other columns) with what their execution says: both queries of all pairs in one
        run. Rows are compared as multisets, or in their order where the gold query has one."""
        ask = lambda c: pairs.select("target", F.lit("run").alias("kind"), F.col(c).alias("query"))
        path = work_dir(self.spark, "compared")
        self.answers(ask("gold_cypher").unionByName(ask("predicted_cypher"))).write.parquet(path)
        told = self.spark.read.parquet(path).select("target", "query", F.struct("ok", "keys", "rows", "error", "from_cache", "connection").alias("a"))
        out = pairs.withColumns({"__g": F.coalesce("gold_cypher", F.lit("")), "__p": F.coalesce("predicted_cypher", F.lit("")), "__t": F.col("target")})
        for c, name in (("__g", "gold"), ("__p", "pred")):
            side = told.select(F.col("target").alias("__u"), F.col("query").alias("__q"), F.col("a").alias(name))
            out = out.join(side, F.col("__t").eqNullSafe(F.col("__u")) & (F.col(c) == F.col("__q"))).drop("__u", "__q")
        ordered = is_ordered(F.col("gold_cypher")) if order_sensitive else F.lit(False)
        same = F.when(ordered, F.col("gold.rows") == F.col("pred.rows")).otherwise(F.array_sort("gold.rows") == F.array_sort("pred.rows"))
        if compare_keys:
            same = same & (F.col("gold.keys") == F.col("pred.keys"))
        lost = F.col("gold.connection").isNotNull() | F.col("pred.connection").isNotNull()
        status = F.when(lost, "connection_failed").when(~F.col("gold.ok"), "gold_failed").when(~F.col("pred.ok"), "pred_failed").otherwise("compared")
        out = out.withColumns({
            "execution_status": status, "execution_match": F.when(status == "pred_failed", False).when(status == "compared", same),
            "gold_executed_ok": F.col("gold.ok"), "pred_executed_ok": F.col("pred.ok"), "gold_error": F.col("gold.error"), "pred_error": F.col("pred.error"),
            "gold_row_count": F.size("gold.rows").cast("long"), "pred_row_count": F.size("pred.rows").cast("long"), "order_sensitive": ordered,
            "gold_from_cache": F.col("gold.from_cache"), "pred_from_cache": F.col("pred.from_cache"),
        })
        return out.drop("__g", "__p", "__t", "gold", "pred")

    def validate(self, requests: DataFrame) -> DataFrame:
        """Requests (target, query) with syntax_valid and syntax_error; null where the target couldn't be asked."""
        told = self.answers(requests.select("target", F.lit("explain").alias("kind"), "query")).select(F.col("target").alias("__t"), F.col("query").alias("__q"), "ok", "error", "connection")
        both = requests.join(told, F.col("target").eqNullSafe(F.col("__t")) & (F.coalesce("query", F.lit("")) == F.col("__q")))
        return both.withColumns({"syntax_valid": F.when(F.col("connection").isNull(), F.col("ok")), "syntax_error": F.col("error")}).drop("__t", "__q", "ok", "error", "connection")
