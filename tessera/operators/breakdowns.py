"""Breakdowns of scored rows in a fixed order, latency in full, training summaries, benches and what queries use outside their schema."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.complexity import tier_rank
from tessera.operators.evaluation import JUDGED, is_true, measures
from tessera.operators.ordering import percentiles
from tessera.operators.tables import curve_summary

#: Sources that a breakdown shows.
TOP_SOURCES = 15


def score_breakdowns(rows: DataFrame, has_database: str = "has_database", complexity: str = "complexity", source: str = "data_source", top: int = TOP_SOURCES, **kw) -> DataFrame:
    """section, place, label and the measures of scored rows: by access to a database (with_database after no_database), by tier from easy to
    extra_hard (tiers without rows don't show, one that is unknown comes last), and of the `top` largest sources, the largest first.

    One pass counts all three at once: a row goes to its three labels.
    """
    access = F.when(is_true(has_database), "with_database").otherwise("no_database")
    labels = {"by_database_access": access, "by_complexity": F.coalesce(complexity, F.lit("unknown")), "by_data_source": F.coalesce(source, F.lit("unknown"))}
    each = rows.withColumn("__l", F.explode(F.array(*[F.struct(F.lit(k).alias("section"), c.alias("label")) for k, c in labels.items()])))
    told = each.groupBy(F.col("__l.section").alias("section"), F.col("__l.label").alias("label")).agg(*[c.alias(k) for k, c in measures(**kw).items()])
    # sources can be many: only the first are placed
    first = told.filter(F.col("section") == "by_data_source").orderBy(F.desc("n"), "label").limit(top)
    largest = first.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))), lambda x: x["label"]).alias("__first"))
    tier = F.nullif(tier_rank(F.col("label")), F.lit(0))
    place = F.when(F.col("section") == "by_complexity", F.coalesce(tier, F.lit(9))).when(F.col("section") == "by_database_access", F.when(F.col("label") == "no_database", 1).otherwise(2)).otherwise(F.array_position("__first", F.col("label")))
    placed = told.join(F.broadcast(largest)).withColumn("place", place.cast("int")).filter("place > 0").drop("__first")  # one row of at most `top` labels
    return placed.select("section", "place", "label", *[c for c in placed.columns if c not in ("section", "place", "label")])


def latency_stats(rows: DataFrame, by: list[str], wall: str, prefill: str, decode: str, prompt_tokens: str, generated: str, prefill_tps: str, decode_tps: str, stopped: str, error: str) -> DataFrame:
    """Of each group mean, p50, p90, p95 and the longest of three times in milliseconds, token means, medians of speeds, the prefill's share
    of the wall time, queries an hour, and counts of answers that hit the limit and of failed requests. Values that are missing don't
    count; a measure of which all are missing is null."""
    times = {"wall_ms": wall, "prefill_ms": prefill, "decode_ms": decode}
    out = {"n": F.count(F.lit(1))}
    for name, c in times.items():
        v = F.col(c).cast("double")
        out |= {f"{name}_mean": F.avg(v), f"{name}_max": F.max(v)}
    out |= {"prompt_tokens_mean": F.avg(prompt_tokens), "generated_tokens_mean": F.avg(generated)}
    all_wall = F.sum(F.col(wall).cast("double"))
    out |= {"prefill_share_of_wall": F.when(all_wall > 0, F.sum(F.col(prefill).cast("double")) / all_wall), "queries_per_hour": F.when(all_wall > 0, F.lit(3.6e6) / F.avg(wall))}
    out |= {"n_stopped_limit": F.count_if(is_true(stopped)), "n_request_errors": F.count(error)}
    plain = rows.groupBy(*by).agg(*[c.alias(k) for k, c in out.items()])
    values = {k: F.col(c) for k, c in (times | {"prefill_tps": prefill_tps, "decode_tps": decode_tps}).items()}
    ranks = percentiles(rows, by, values, {"p50": 0.5, "p90": 0.9, "p95": 0.95}).withColumnsRenamed({c: f"__{c}" for c in by} | {f"{k}_tps_p50": f"{k}_tps_median" for k in ("prefill", "decode")})
    done = plain.join(ranks, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left")
    cols = [f"{k}_{s}" for k in times for s in ("mean", "p50", "p90", "p95", "max")]
    return done.select(*by, "n", *cols, *[f"{k}_mean" for k in ("prompt_tokens", "generated_tokens")], "prefill_tps_median", "decode_tps_median", "prefill_share_of_wall", "queries_per_hour", "n_stopped_limit", "n_request_errors")


def training_summary(curve: DataFrame, meta: DataFrame, run: str, step: str, loss: str, eval_loss: str, vram: str, logging_steps: int = 10) -> DataFrame:
    """curve_summary() of a run's losses, with its last and least eval loss, the share of the expected points that were logged, and the peak
    memory: of the curve's, or where that has none what the run's meta row tells (run, global_step, vram_peak_gb)."""
    own = curve_summary(curve.filter(F.col(loss).isNotNull()), run, step, loss)
    rest = curve.groupBy(run).agg(F.max_by(eval_loss, F.when(F.col(eval_loss).isNotNull(), F.col(step))).alias("last_eval_loss"), F.min(eval_loss).alias("least_eval_loss"), F.max(vram).alias("__vram"))
    told = meta.select(run, "global_step", F.col("vram_peak_gb").alias("__told"))
    expected = F.floor(F.coalesce("global_step", F.lit(0)) / logging_steps)
    out = told.join(own, run, "left").join(rest, run, "left").withColumn("points", F.coalesce("points", F.lit(0)))
    out = out.withColumns({"coverage": F.round(F.try_divide(F.col("points"), F.nullif(expected, F.lit(0).cast("long"))), 3), "vram_peak_gb": F.coalesce("__vram", "__told")})
    return out.drop("__vram", "__told")


def best_threads(bench: DataFrame, by: list[str], threads: str, prompt: str, generated: str, speed: str, prompt_tokens: int, generated_tokens: int) -> DataFrame:
    """The number of threads with the least estimated time of a query, and that time in seconds: prompt_tokens at the speed of the rows that
    only read a prompt, and generated_tokens at that of the rows that only generate. Threads without both don't count."""
    reads = (F.coalesce(prompt, F.lit(0)) > 0) & (F.coalesce(generated, F.lit(0)) == 0)
    writes = (F.coalesce(generated, F.lit(0)) > 0) & (F.coalesce(prompt, F.lit(0)) == 0)
    each = bench.groupBy(*by, threads).agg(F.max(F.when(reads, F.col(speed))).alias("pp"), F.max(F.when(writes, F.col(speed))).alias("tg")).filter("pp > 0 AND tg > 0")
    seconds = prompt_tokens / F.col("pp") + generated_tokens / F.col("tg")
    return each.groupBy(*by).agg(F.min(F.struct(seconds.alias("seconds"), F.col(threads).alias("threads"))).alias("m")).select(*by, F.col("m.threads").alias("threads"), F.col("m.seconds").alias("seconds"))


def protected_retention(steps: DataFrame, run: str, step: str, complete: Column, keep: int, protected: Column) -> DataFrame:
    """Adds kept: the `keep` newest complete steps of a run, what is newer than the oldest of them, and protected ones. Without a complete
    step, or for a keep of 0, all are kept."""
    if keep <= 0:
        return steps.withColumn("kept", F.lit(True))
    done = steps.withColumn("__c", complete)
    newest = done.filter("__c").groupBy(F.col(run).alias("__run")).agg(F.slice(F.sort_array(F.collect_set(step), asc=False), 1, keep).alias("__n")).select("__run", F.array_min("__n").alias("__floor"))
    out = done.join(newest, F.col(run).eqNullSafe(F.col("__run")), "left")
    return out.withColumn("kept", F.coalesce(F.col(step) >= F.col("__floor"), F.lit(True)) | F.coalesce(protected, F.lit(False))).drop("__c", "__run", "__floor")


def outside_schema(rows: DataFrame, by: list[str], kinds: tuple = ("labels", "rel_types", "properties")) -> DataFrame:
    """Shares of queries that use elements that their schema lacks (unknown_<kind>), of each kind and of any, and that use some which it has
    but the prompt's part of it lacks (missing_<kind>); and the accuracy of judged rows with and without unknown elements."""
    any_ = sum((F.col(f"unknown_{k}") for k in kinds[1:]), F.col(f"unknown_{kinds[0]}")) > 0
    outside = sum((F.col(f"missing_{k}") for k in kinds[1:]), F.col(f"missing_{kinds[0]}")) > 0
    judged, right = is_true(F.col("execution_status").isin(*JUDGED)) & is_true("gold_executed_ok"), is_true("execution_match").cast("double")
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_checked"), share(any_).alias("share_any_unknown"), *[share(F.col(f"unknown_{k}") > 0).alias(f"share_unknown_{k}") for k in kinds], share(outside).alias("share_outside_prompt"),
        F.avg(F.when(any_ & judged, right)).alias("accuracy_with_unknown"), F.avg(F.when(~any_ & judged, right)).alias("accuracy_without_unknown"))


def interval_bars(value: Column, low: Column, high: Column) -> dict[str, Column]:
    """Lengths of an interval's bars below and above a value, never under 0, as a plot needs them."""
    return {"bar_low": F.greatest(value - low, F.lit(0.0)), "bar_high": F.greatest(high - value, F.lit(0.0))}
