"""Examples and token features, comparison families, wide tables, benches and headlines."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import last, masked_labels
from tessera.functions.text import alias_to_database
from tessera.functions.tokens import strip, tokens
from tessera.operators.ordering import in_order
from tessera.operators.schema import apply_mode, fit_prompt
from tessera.operators.tables import with_interval_text

#: Longest share of a schema that counts as pruned.
PRUNED_RATIO = 0.95


def examples(corpus: DataFrame, mode: str = "enhanced") -> DataFrame:
    """instance_id, question, schema_text, target, database_reference and data_source of corpus rows."""
    d = apply_mode(corpus, "schema", "question", mode, "schema_text")
    return d.select("instance_id", F.coalesce("question", F.lit("")).alias("question"), "schema_text", strip(F.coalesce("cypher", F.lit(""))).alias("target"), "database_reference", "data_source")


def with_database(rows: DataFrame, alias: str, only: str | None = None) -> DataFrame:
    """Rows whose alias names a database, and holds `only`, if that is given."""
    a = F.col(alias)
    ok = alias_to_database(a).isNotNull()
    return rows.filter(ok & a.contains(only) if only else ok)


def numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers; what is none, NULL."""
    return rows.withColumns({c: F.col(c).try_cast("double") for c in columns})


def prefixed(rows: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return rows.select(*keep, *[F.col(c).alias(prefix + c) for c in rows.columns if c not in keep])


def units(size_bytes: Column, params: Column, mean_ms: Column) -> dict[str, Column]:
    """Megabytes, bits a weight, queries an hour."""
    return {"size_mb": size_bytes / 1e6, "bits_per_weight": F.try_divide(8.0 * size_bytes, F.nullif(params, F.lit(0))), "per_hour": F.try_divide(F.lit(3.6e6), F.nullif(mean_ms, F.lit(0.0)))}


class Counters:
    """What features() drops and trims, counted in the pass that does so; read after an action has run over its result, once."""

    def __init__(self):
        self.before, self.after = Observation(), Observation()

    def get(self) -> dict[str, int]:
        """rows, empty_target and long_target (dropped), kept, trimmed, over_budget (kept with a prompt that was cut)."""
        return {k: int(v or 0) for k, v in (self.before.get | self.after.get).items()}


def features(rows: DataFrame, budget: int, ids: Callable[[Column], Column] | None = None, slack: int = 32, counters: Counters | None = None) -> DataFrame:
    """input_ids and labels of examples (question, schema_text, target) that fit a budget.

    Rows without a target, and with one of over budget - slack tokens, are dropped; so no row is left whose labels are all ignored, and
    no filter stands above the unrolled loop, which would be copied into it. The schema is trimmed to fit; a prompt that still overflows
    keeps its end. Ids default to hashes of the query tokens. counters gets the numbers of what is dropped and trimmed.
    """
    count = (lambda p: F.size(ids(p))) if ids else None
    ids = ids or (lambda c: F.transform(tokens(c), lambda t: F.hash(t)))
    d = rows.withColumn("__target", ids(F.col("target")))
    empty, long_ = F.coalesce(F.col("target"), F.lit("")) == "", F.size("__target") + slack > budget
    if counters:
        d = d.observe(counters.before, F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("empty_target"), F.count_if(~empty & long_).alias("long_target"))
    d = d.filter((F.col("target") != "") & ~long_)
    d = fit_prompt(d.withColumnRenamed("schema_text", "__schema"), "__schema", "question", F.size("__target"), budget, count=count)
    d = d.withColumn("__prompt", ids(F.col("prompt")))
    d = d.withColumn("__prompt", F.when(F.col("over_budget"), last(F.col("__prompt"), budget - F.size("__target"))).otherwise(F.col("__prompt")))
    whole, labels = F.concat("__prompt", "__target"), masked_labels(F.col("__prompt"), F.col("__target"))
    d = d.withColumns({"input_ids": last(whole, F.lit(budget)), "labels": last(labels, F.lit(budget))})
    if counters:
        d = d.observe(counters.after, F.count(F.lit(1)).alias("kept"), F.count_if("schema_trimmed").alias("trimmed"), F.count_if("over_budget").alias("over_budget"))
    return d.drop("__target", "__prompt", "__schema", "prompt")


def comparison_families(jobs: DataFrame) -> DataFrame:
    """job_a, job_b, comparison and family for a registry of job_id, model, variant (enhanced, pruned), condition (zero_shot, fine_tuned,
    cross_schema) and backend: what each pair of jobs that differ in one respect tells."""
    a, b = jobs.toDF(*[f"a_{c}" for c in jobs.columns]), jobs.toDF(*[f"b_{c}" for c in jobs.columns])
    same = lambda *cs: [F.col(f"a_{c}") == F.col(f"b_{c}") for c in cs]
    is_ = lambda side, **kw: [F.col(f"{side}_{k}") == v for k, v in kw.items()]

    def family(name, label, *conditions):
        on = conditions[0]
        for c in conditions[1:]:
            on = on & c
        return a.join(b, on).select(F.col("a_job_id").alias("job_a"), F.col("b_job_id").alias("job_b"), label.alias("comparison"), F.lit(name).alias("family"))

    text = lambda *parts: F.concat_ws(" ", *parts)
    parts = [
        family("fine_tuning_effect", text(F.col("a_model"), F.col("a_variant")), *same("model", "variant", "backend"), *is_("a", condition="zero_shot"), *is_("b", condition="fine_tuned")),
        family("schema_filtering", text(F.col("a_model"), F.col("a_condition")), *same("model", "condition", "backend"), F.col("a_condition").isin("fine_tuned", "zero_shot"), *is_("a", variant="enhanced"), *is_("b", variant="pruned")),
        family("model_comparison", text(F.col("a_model"), F.lit("vs"), F.col("b_model")), *same("backend"), F.col("a_model") < F.col("b_model"), *is_("a", variant="enhanced", condition="fine_tuned"), *is_("b", variant="enhanced", condition="fine_tuned")),
        family("quantisation", text(F.col("a_model"), F.col("a_variant")), *same("model", "variant"), *is_("a", condition="fine_tuned", backend="hf"), *is_("b", condition="fine_tuned", backend="llamacpp")),
        family("schema_inference_effect", text(F.col("a_model")), *same("model", "backend"), *is_("a", variant="enhanced", condition="fine_tuned"), *is_("b", variant="enhanced", condition="cross_schema")),
        family("schema_training_effect", text(F.col("a_model")), *same("model", "backend"), *is_("a", variant="enhanced", condition="cross_schema"), *is_("b", variant="pruned", condition="fine_tuned")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wide(rows: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Metric rows as columns; the names are given, so no pass looks for them."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def cheapest(rows: DataFrame, keys: list[str], choice: str, cost: Column) -> DataFrame:
    """The choice of the least cost for each key, and that cost; ties go to the smaller choice."""
    return rows.groupBy(*keys).agg(F.min(F.struct(cost.alias("cost"), F.col(choice).alias("choice"))).alias("m")).select(*keys, F.col("m.choice").alias(choice), F.col("m.cost").alias("cost"))


def typical(rows: DataFrame, by: list[str], size: str, tie: str) -> DataFrame:
    """The middle row of each group by size (the upper of two), nulls first. tie tells rows of one size apart.

    Rows are placed by ranges over all groups, see in_order(), and a group's places begin after those of the groups before it; so no task
    holds a group.
    """
    placed = in_order(rows, [*[F.col(c).asc_nulls_first() for c in by], F.col(size).asc_nulls_first(), F.col(tie)], rank="__r")
    middle = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg((F.min("__r") + F.floor(F.count(F.lit(1)) / 2)).alias("__m"))
    return placed.join(middle.select("__m"), F.col("__r") == F.col("__m"), "left_semi").drop("__r")


def pruned(rows: DataFrame, before: str, after: str) -> DataFrame:
    return rows.withColumn("ratio", F.try_divide(F.col(after).cast("double"), F.nullif(F.col(before).cast("double"), F.lit(0.0)))).filter(F.col("ratio") < PRUNED_RATIO)


def difference_counts(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """How often each difference b - a occurs, as JSON in the order of the differences, and the share of zeros."""
    each = rows.groupBy(*by, (F.col(b) - F.col(a)).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "n"))), lambda x: F.concat(F.lit('"'), x["d"].cast("string"), F.lit('":'), x["n"].cast("string"))), ","), F.lit("}"))
    return each.groupBy(*by).agg(text.alias("diff_counts"), F.try_divide(F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)).cast("double"), F.sum("n").cast("double")).alias("share_equal"))


def headline(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`v [low, high]` for each column that has column_low and column_high."""
    return rows.select(*keys, *[with_interval_text(F.col(c), F.col(f"{c}_low"), F.col(f"{c}_high")).alias(c) for c in columns])


def reindexed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each label, in the order given; labels that are missing have NULLs."""
    labels = rows.sparkSession.createDataFrame([(i, k) for i, k in enumerate(order)], f"__o int, {key} string")
    return labels.join(rows, key, "left").orderBy("__o").drop("__o")
