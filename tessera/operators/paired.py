"""Paired comparisons of jobs: one join for all comparisons, then tests and intervals."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import MARGIN, RESAMPLES, holm, mcnemar, resampled
from tessera.operators.evaluation import JUDGED, first_rows, is_true

METRICS = ("exact_match", "normalised_exact_match", "execution_match")


def all_pairs(jobs: DataFrame, job: str, order: str) -> DataFrame:
    """Every unordered pair of jobs; jobs is a registry, its size the number of jobs."""
    a, b = jobs.select(F.col(job).alias("job_a"), F.col(order).alias("__a")), jobs.select(F.col(job).alias("job_b"), F.col(order).alias("__b"))
    return a.join(b, F.col("__a") < F.col("__b")).select("job_a", "job_b")


def paired_rows(rows: DataFrame, comparisons: DataFrame, job: str, item: str, values: list[str], order: list) -> DataFrame:
    """Rows of job_a and job_b on the same item, for each comparison (comparison, job_a, job_b). Where a job has an item more than once, its
    first row in the given order counts, and of rows that tie in it that of the least values; so it never matters how rows are dealt."""
    ties = [c for c in values if not rows.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    own = first_rows(rows, [job, item], [*order, *ties]).select(job, item, *values)
    a = own.select(F.col(job).alias("job_a"), item, *[F.col(v).alias(f"a_{v}") for v in values])
    b = own.select(F.col(job).alias("job_b"), F.col(item).alias("__item"), *[F.col(v).alias(f"b_{v}") for v in values])
    left = a.join(comparisons, "job_a")
    return left.join(b, (left["job_b"] == b["job_b"]) & (left[item] == b["__item"])).drop(b["job_b"]).drop("__item")


def compare(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Exact McNemar tests of the three binary metrics: execution only where both sides are judged and both gold queries ran."""
    judged = is_true("a_gold_executed_ok") & is_true("b_gold_executed_ok") & is_true(F.col("a_execution_status").isin(*JUDGED)) & is_true(F.col("b_execution_status").isin(*JUDGED))
    rows = []
    for m in METRICS:
        ok = judged if m == "execution_match" else F.lit(True)
        rows.append(F.when(ok, F.struct(F.lit(m).alias("metric"), is_true(f"a_{m}").alias("a"), is_true(f"b_{m}").alias("b"))))
    each = pairs.select(*by, F.explode(F.array_compact(F.array(*rows))).alias("x")).select(*by, "x.*")
    out = each.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("a").cast("double")).alias("a_value"), F.avg(F.col("b").cast("double")).alias("b_value"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"))
    return out.withColumn("p_value", mcnemar(F.col("a_only"), F.col("b_only")))


def adjusted(tests: DataFrame, family: str = "family", tie: str = "comparison", level: float = 0.95) -> DataFrame:
    """Holm's adjustment within each family and metric, and whether it is significant."""
    return holm(tests, "p_value", [family, "metric"], [tie]).withColumn("significant_holm", F.col("p_holm") < 1 - level)


def floored(p, resamples: int):
    """A bootstrap p-value of at least 1 / resamples, whether that is a bound, and how it is shown."""
    floor = 1.0 / resamples
    value = F.greatest(p, F.lit(floor))
    return value, p < floor, F.when(p < floor, F.lit(f"< {floor:.2g}")).otherwise(F.format_string("%.3g", value))


def bootstrap_difference(pairs: DataFrame, by: list[str], item: str, a: str, b: str, resamples: int = RESAMPLES, level: float = 0.95, margin: float = MARGIN) -> DataFrame:
    """The mean of b - a with a percentile interval, a (2 * level - 1) interval for equivalence within the margin, and a two-sided p."""
    diffs = pairs.select(*by, item, (F.coalesce(F.col(b), F.lit(0.0)) - F.coalesce(F.col(a), F.lit(0.0))).alias("d"))
    means = resampled(diffs, by, [item], ["d"], resamples).withColumn("m", F.col("d") / F.col("n"))
    alpha = 1 - level
    q = F.percentile("m", F.array(*[F.lit(x) for x in (alpha / 2, 1 - alpha / 2, alpha, 1 - alpha)])).alias("q")
    boot = means.groupBy(*by).agg(q, F.avg((F.col("m") <= 1e-12).cast("double")).alias("__lo"), F.avg((F.col("m") >= -1e-12).cast("double")).alias("__hi"))
    point = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("d").alias("difference"))
    out = point.join(boot, by)
    p = F.least(F.lit(1.0), 2 * F.least("__lo", "__hi"))
    value, bound, _ = floored(p, resamples)
    return out.select(*by, "n_pairs", "difference", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), F.col("q")[2].alias("tost_low"), F.col("q")[3].alias("tost_high"), ((F.col("q")[2] > -margin) & (F.col("q")[3] < margin)).alias("equivalent"), value.alias("p_value"), bound.alias("p_is_bound"))


def identical_share(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("identical"))


def lookup(jobs: DataFrame, wanted: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """For each wanted key the first job that has it, or null."""
    w = Window.partitionBy(*on).orderBy(*order)
    return wanted.join(jobs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"), on, "left")


def judged_by_all(rows: DataFrame, item: str, judge: str) -> DataFrame:
    """Rows of items that every judge has (a k-way intersection by counting, not by k joins)."""
    judges = rows.select(judge).distinct().agg(F.count(F.lit(1)).alias("__m"))
    full = rows.select(item, judge).distinct().groupBy(item).count().join(F.broadcast(judges)).filter("count = __m").select(item)
    return rows.join(full, item, "left_semi")
