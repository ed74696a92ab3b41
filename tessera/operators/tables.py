"""Health, telemetry, latency, sampling, set and planning tables."""

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType

from tessera.functions.stats import nearest_ranks
from tessera.operators.ordering import in_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


# ---- health of gold queries ------------------------------------------------------------------------------------------------------------
def _group(by: str) -> Column:
    """A group's name; a null or an empty one is `(none)`."""
    name = F.col(by).cast("string")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("(none)")).otherwise(name)


def gold_health(rows: DataFrame, by: str, failed: Column, error: Column, ran: Column | None = None, top: int = 5) -> DataFrame:
    """Groups with a failure among the rows that ran (all, by default): rows, failures, their rate, whether all fail (dead), and the most
    frequent errors, of 300 characters at most.

    Null or empty groups are `(none)`, null or empty errors `unknown`; a null in failed is a failure, one in ran is not a run.
    """
    rows = rows if ran is None else rows.filter(ran)
    text = F.when(F.coalesce(error, F.lit("")) == "", F.lit("unknown")).otherwise(F.left(error, F.lit(300)))
    base = rows.select(_group(by).alias(by), F.coalesce(failed, F.lit(True)).alias("__f"), text.alias("__e"))
    counts = base.groupBy(by).agg(F.count(F.lit(1)).alias("executed"), F.count_if("__f").alias("failed")).filter("failed > 0")
    errors = base.filter("__f").groupBy(by, "__e").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by).orderBy(F.desc("c"), "__e")
    best = errors.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("r", F.col("__e").alias("error"), F.col("c").alias("n")))).alias("__top"))
    out = counts.join(best, by)
    text = F.array_join(F.transform("__top", lambda x: F.concat_ws(":", x["error"], x["n"].cast("string"))), "; ")
    return out.select(by, "executed", "failed", (F.col("failed") / F.col("executed")).alias("failure_rate"), (F.col("failed") == F.col("executed")).alias("dead"), text.alias("top_errors"))


def flag_dead(rows: DataFrame, by: str, failed: Column, ran: Column | None = None) -> DataFrame:
    """Adds dead_database: whether all rows of its group that ran fail; null for a row that didn't run. Null and empty groups are one; a
    null in failed is a failure."""
    ran = F.lit(True) if ran is None else F.coalesce(ran, F.lit(False))
    dead = rows.filter(ran).groupBy(_group(by).alias("__by")).agg(F.every(F.coalesce(failed, F.lit(True))).alias("__dead")).filter("__dead")
    flag = F.when(ran, F.coalesce("__dead", F.lit(False)))
    return rows.join(dead, _group(by) == F.col("__by"), "left").withColumn("dead_database", flag).drop("__by", "__dead")


def exclude_dead(rows: DataFrame) -> DataFrame:
    """The policy that takes rows of dead databases out of the evidence."""
    return rows.withColumns({"execution_status": F.when(F.col("dead_database"), "excluded_dead_db").otherwise(F.col("execution_status")), "execution_match": F.when(~F.col("dead_database"), F.col("execution_match"))})


# ---- telemetry -------------------------------------------------------------------------------------------------------------------------
def latest_events(events: DataFrame, key: list[str], priority: Column, time: str, tie: str) -> DataFrame:
    """One event a key: of the best priority, then the latest, so that a replay after a resume replaces what it repeats."""
    w = Window.partitionBy(*key).orderBy(priority, F.desc(time), F.desc(tie))
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def curve_summary(curve: DataFrame, run: str, step: str, value: str, tail: int = 5) -> DataFrame:
    """First, last and least value and the mean of the last ones, by step. The tail is ranked once; all else is one aggregation."""
    ranked = curve.withColumn("__r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step))))
    return ranked.groupBy(run).agg(
        F.count(F.lit(1)).alias("points"), F.min_by(value, step).alias("first_value"), F.max_by(value, step).alias("last_value"), F.min(value).alias("least_value"),
        F.avg(F.when(F.col("__r") <= tail, F.col(value))).alias("tail_mean"), F.max(step).alias("last_step"))


def session_hours(events: DataFrame, run: str, session: str, seconds: str) -> DataFrame:
    spans = events.groupBy(run, session).agg((F.max(seconds) - F.min(seconds)).alias("__s"))
    return spans.groupBy(run).agg(F.count(F.lit(1)).alias("sessions"), (F.sum("__s") / 3600.0).alias("hours"))


def failure_runs(events: DataFrame, by: list[str], order: list[str], failed: Column) -> DataFrame:
    """Runs of consecutive failures (gaps and islands): by, the run's first and last place and length."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = events.select(*by, *[c for c in order if c not in by], failed.alias("__f"), F.row_number().over(w).alias("place"))
    runs = placed.filter("__f").withColumn("__g", F.col("place") - F.row_number().over(w))
    return runs.groupBy(*by, "__g").agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"), F.count(F.lit(1)).alias("length")).drop("__g")


def retention(steps: DataFrame, run: str, step: str, complete: Column, keep: int) -> DataFrame:
    """Adds kept: the newest complete steps, and what is newer than the oldest of them."""
    c = steps.withColumn("__c", complete)
    w = Window.partitionBy(run, "__c").orderBy(F.desc(step))
    c = c.withColumn("__r", F.when(F.col("__c"), F.row_number().over(w)))
    floor = F.min(F.when(F.col("__r") <= keep, F.col(step))).over(Window.partitionBy(run))
    return c.withColumn("kept", F.coalesce(F.col(step) >= floor, F.lit(True))).drop("__c", "__r")


# ---- latency and lengths ---------------------------------------------------------------------------------------------------------------
def latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and interpolated percentiles; queries an hour from the mean in milliseconds."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("q")
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q, F.max(value).alias("longest"))
    return out.select(*by, "n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p95"), "longest", F.try_divide(F.lit(3.6e6), F.col("mean")).alias("per_hour"))


def lengths(rows: DataFrame, by: list[str], value: str, budget: int) -> DataFrame:
    """Mean, percentiles by nearest rank (which no interpolation gives), and the share over a budget."""
    v = F.col(value)
    plain = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("longest"), F.avg((v > budget).cast("double")).alias("over_budget"))
    ranks = nearest_ranks(rows, by, value, {f"p{round(p * 100)}": p for p in (0.5, 0.9, 0.95, 0.99)})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    out = plain.join(ranks.withColumnsRenamed({c: f"__{c}" for c in by}), same, "left").drop(*[f"__{c}" for c in by])
    return out.select(*by, "n", "mean", "p50", "p90", "p95", "p99", "longest", "over_budget")


# ---- samples and splits ----------------------------------------------------------------------------------------------------------------
def order_key(seed: int, key: str) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, in no order."""
    return rows.withColumn("__o", order_key(seed, key)).orderBy("__o", key).limit(n).drop("__o")


def split(rows: DataFrame, key: str, fraction: float, most: int, seed: int) -> DataFrame:
    """Adds split: min(most, max(1, int(n * fraction))) rows are val, the others train; a fraction of 0 or less gives train alone.

    The validation rows are a bounded sample, so they are joined as a broadcast; the table is neither sorted nor shuffled.
    """
    if fraction <= 0:
        return rows.withColumn("split", F.lit("train"))
    n = min(most, max(1, int(rows.count() * fraction)))
    val = sample(rows.select(key), key, n, seed).select(F.col(key).alias("__k"))
    out = rows.join(F.broadcast(val) if n <= 1_000_000 else val, F.col(key) == F.col("__k"), "left")
    return out.withColumn("split", F.when(F.col("__k").isNotNull(), "val").otherwise("train")).drop("__k")


def stratified(rows: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """n rows with each stratum's share of them, rounded half to even (the last stratum takes what is left)."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("__c"))
    all_, order = Window.partitionBy(), Window.orderBy(stratum)
    quota = F.bround(F.lit(float(n)) * F.col("__c") / F.sum("__c").over(all_)).cast("long")
    counts = counts.withColumn("__q", quota)
    before = F.coalesce(F.sum("__q").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(order) == F.count(F.lit(1)).over(all_)
    counts = counts.withColumn("__q", F.when(last, F.lit(n) - before).otherwise(F.col("__q"))).select(F.col(stratum).alias("__s"), "__q")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order_key(seed, key), key))
    # no quota is over n, and that limit is a constant, so each task sends on n rows of a stratum at most
    return rows.withColumn("__r", place).filter(F.col("__r") <= n).join(counts, F.col(stratum).eqNullSafe(F.col("__s"))).filter("__r <= __q").drop("__r", "__s", "__q")


def _digests(batches):
    """SHA-256 of each group's keys, one a line, from rows (group, key) that come sorted."""
    group, sha, n, rows = None, None, 0, []
    for b in batches:
        for g, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if g != group:
                if group is not None:
                    rows.append((group, n, sha.hexdigest()))
                group, sha, n = g, hashlib.sha256(), 0
            sha.update((b"\n" if n else b"") + key.encode())
            n += 1
        if len(rows) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["__g", "__n", "fingerprint"])
            rows = []
    if group is not None:
        rows.append((group, n, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["__g", "__n", "fingerprint"])


def fingerprint(rows: DataFrame, by: list[str], key: str, digits: int = 16) -> DataFrame:
    """n and the first digits of the SHA-256 of the group's sorted keys, one a line; null keys count as rows alone.

    Such a digest takes the keys one after the other: a group's go through one task, sorted by Spark and read as a stream, and none is held.
    """
    group = F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(by)]), {"ignoreNullFields": "false"})
    keyed = rows.filter(F.col(key).isNotNull()).select(group.alias("__g"), F.col(key).alias("__k"))
    streams = keyed.repartition("__g").sortWithinPartitions("__g", "__k").select("__g", F.col("__k").cast("string"))
    made = streams.mapInArrow(_digests, "__g string, __n long, fingerprint string").select("__g", F.left("fingerprint", F.lit(digits)).alias("fingerprint"))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("__c", group)
    empty = hashlib.sha256(b"").hexdigest()[:digits]
    return counts.join(made, F.col("__c") == F.col("__g"), "left").select(*by, "n", F.coalesce("fingerprint", F.lit(empty)).alias("fingerprint"))


# ---- sets, plans, integrity ------------------------------------------------------------------------------------------------------------
def normalised(c: Column, kind: DataType, digits: int = 6) -> Column:
    """A value of any depth in its canonical form: numbers with a fraction rounded, fields and keys in order, bytes as hex, and what is
    neither a number, a truth value nor text as text."""
    if isinstance(kind, (FloatType, DoubleType)):
        return F.round(c.cast("double"), digits)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: normalised(x, kind.elementType, digits))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[normalised(c[f.name], f.dataType, digits).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, MapType):
        entry = lambda e: F.struct(e["key"].cast("string").alias("key"), normalised(e["value"], kind.valueType, digits).alias("value"))
        return F.when(c.isNotNull(), F.array_sort(F.transform(F.map_entries(c), entry), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    if isinstance(kind, BinaryType):
        return F.lower(F.hex(c))
    return c if isinstance(kind, (BooleanType, StringType, IntegralType, NullType)) else c.cast("string")


def row_text(rows: DataFrame, values: list, digits: int = 6) -> Column:
    """A row's values (names or columns), in their order, as one text, nulls included, whatever they are called."""
    kinds = [f.dataType for f in rows.select(*values).schema.fields]
    cols = [F.col(v) if isinstance(v, str) else v for v in values]
    return F.to_json(F.struct(*[normalised(c, t, digits).alias(f"c{k}") for k, (c, t) in enumerate(zip(cols, kinds, strict=True))]), {"ignoreNullFields": "false"})


def same_results(a: DataFrame, b: DataFrame, by: list[str], values: list, order: list[str] | None = None, theirs: list | None = None, compare_keys: bool = False) -> DataFrame:
    """Whether two results are equal group by group: as multisets of rows or, with order, row by row in that order.

    Rows are compared by their normalised values in the order of values; theirs: b's, where they differ. With compare_keys the names of
    both must be the same too.
    """
    theirs = values if theirs is None else theirs

    def side(t, cols, sign):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) if order else F.lit(0)
        return t.select(*by, place.alias("__p"), row_text(t, cols).alias("__r"), F.lit(sign).alias("__s"))

    keys = F.lit(not compare_keys or a.select(*values).columns == b.select(*theirs).columns)
    both = side(a, values, 1).union(side(b, theirs, -1))
    each = both.groupBy(*by, "__p", "__r").agg(F.sum("__s").alias("__d"), F.count(F.lit(1)).alias("__c"))
    return each.groupBy(*by).agg((F.every(F.col("__d") == 0) & keys).alias("same"), F.sum("__c").alias("rows"), F.sum(F.abs("__d")).alias("differing"))


def result_signature(rows: DataFrame, by: list[str], values: list[str], order: list[str] | None = None, compare_keys: bool = False) -> DataFrame:
    """A signature of each group's rows that two results share if they are equal: row count and sums of two halves of each row's MD5, so
    no group is gathered. With order a row's place counts, with compare_keys the names of the columns."""
    text = row_text(rows, values)
    if order:
        text = F.concat_ws(":", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("string"), text)
    if compare_keys:
        text = F.concat_ws("|", F.lit(",".join(values)), text)
    digest = rows.select(*by, F.md5(text.cast("binary")).alias("__m"))
    half = lambda at: F.sum(F.conv(F.substring("__m", at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return digest.groupBy(*by).agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), half(1), half(13)).alias("signature"))


def expected_against_actual(expected: DataFrame, actual: DataFrame, on: list[str], value: str, missing) -> DataFrame:
    return expected.join(actual, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(missing)))


def admitted(jobs: DataFrame, by: list[str], order: list, cost: str, budget: float) -> DataFrame:
    """Jobs in order while the running cost of their group fits the budget. One running sum goes over all rows, by ranges of the order, and a
    group's begins with what the groups before it hold; so no task holds a group."""
    groups = [F.col(c).asc_nulls_first() for c in by]
    all_ = in_order(jobs, [*groups, *[F.col(c).asc() if isinstance(c, str) else c for c in order]], F.col(cost), running="running_cost").drop("rank")
    before = all_.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(F.col("running_cost") - F.coalesce(F.col(cost), F.lit(0))).alias("__before"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    out = all_.join(before, on) if by else all_.crossJoin(before)
    return out.withColumn("running_cost", F.col("running_cost") - F.col("__before")).drop("__before", *[f"__{c}" for c in by]).filter(F.col("running_cost") <= budget)


def reuse(planned: DataFrame, finished: DataFrame, on: list[str], provenance: list[str]) -> DataFrame:
    """Adds action: reuse where a finished job has the same provenance; else run, with the first field that differs as reason."""
    done = finished.select(*on, *[F.col(p).alias(f"__{p}") for p in provenance], F.lit(True).alias("__done"))
    j = planned.join(done, on, "left")
    reason = F.when(F.col("__done").isNull(), "new")
    for p in provenance:
        reason = reason.when(~F.col(p).eqNullSafe(F.col(f"__{p}")), f"{p} differs")
    return j.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "reuse").otherwise("run")).drop("__done", *[f"__{p}" for p in provenance])


def check(name: str, subject: Column, passed: Column, detail: Column) -> list[Column]:
    """A row of the integrity table; passed is true, false or NULL (not judged)."""
    return [F.lit(name).alias("check"), subject.cast("string").alias("subject"), passed.cast("boolean").alias("passed"), detail.cast("string").alias("detail")]


def flat(c: Column, kind: str) -> Column:
    """A value as one text: lists joined by semicolons, structs and maps as JSON."""
    return F.array_join(c.cast("array<string>"), "; ") if kind.startswith("array") else F.to_json(c) if kind.startswith(("struct", "map")) else c.cast("string")


def with_interval_text(value: Column, low: Column, high: Column) -> Column:
    """`v [low, high]` with three digits, halves to even; empty without a value."""
    v, lo, hi = (F.bround(c, 3) for c in (value, low, high))
    return F.when(value.isNull(), F.lit("")).when(low.isNull(), F.format_string("%.3f", v)).otherwise(F.format_string("%.3f [%.3f, %.3f]", v, lo, hi))
