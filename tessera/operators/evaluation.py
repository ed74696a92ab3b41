"""Scored rows and the tables made of them: one bundle of conditional measures, at any grouping."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.complexity import complexity
from tessera.functions.stats import nearest_rank_of, wilson
from tessera.functions.tokens import exact_match, gleu, gleu_counts, normalised_exact_match

#: Statuses that say nothing about the prediction, statuses that are judged, classes of errors and results.
NOT_SCORED = ("connection_failed", "excluded_dead_db")
JUDGED = ("compared", "pred_failed")
ERRORS = ("empty_output", "not_executed", "connection_failed", "excluded_dead_db", "gold_failed", "invalid_query", "runtime_error", "execution_error", "correct", "wrong_result")
RESULTS = ("correct_nonempty", "correct_empty_gold", "pred_failed", "wrong_pred_empty", "wrong_row_count", "wrong_same_row_count")


def is_true(c) -> Column:
    """NULL counts as false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(False))


def score_rows(rows: DataFrame, key: list[str], gold: str = "gold_cypher", pred: str = "predicted_cypher") -> DataFrame:
    """Adds gleu and its counts (overlap, n_gold, n_pred), exact_match, normalised_exact_match, complexity and gold_hops. key tells rows apart."""
    g, p = F.col(gold), F.col(pred)
    shape = complexity(g)
    scored = rows.withColumns({"exact_match": exact_match(g, p), "normalised_exact_match": normalised_exact_match(g, p), "complexity": shape["tier"], "gold_hops": shape["hops"]})
    counts = gleu_counts(rows, gold, pred, key)
    return scored.join(counts, key, "left").withColumn("gleu", gleu(F.col("overlap"), F.col("n_pred"), F.col("n_gold")))


def executed() -> Column:
    return is_true(F.col("execution_status").isNotNull() & ~F.col("execution_status").isin(*NOT_SCORED))


def rate(of: Column, among: Column | None = None) -> Column:
    """The share of rows, among those given, for which something holds; NULL if there are none."""
    among = F.lit(True) if among is None else among
    return F.try_divide(F.count_if(among & of).cast("double"), F.count_if(among).cast("double"))


def measures(pred: str = "predicted_cypher", percentiles: bool = True) -> dict[str, Column]:
    """The summary of scored rows as aggregates. Three accuracies differ in their denominators: of executed rows, of those whose gold
    query ran, and of judged ones. Unrounded."""
    ran, gold_ok, match, ok = executed(), is_true("gold_executed_ok"), is_true("execution_match"), is_true("pred_executed_ok")
    judged = is_true(F.col("execution_status").isin(*JUDGED)) & gold_ok
    status = lambda s: F.count_if(is_true(F.col("execution_status") == s))
    fitted, valid = F.col("schema_trimmed").isNotNull(), F.col("syntax_valid").isNotNull()
    counted = F.when(F.col("prompt_tokens") >= 0, F.col("prompt_tokens"))
    out = {
        "n": F.count(F.lit(1)),
        "gleu_corpus": gleu(F.sum("overlap"), F.sum("n_pred"), F.sum("n_gold")),
        "gleu_mean": F.avg(F.coalesce("gleu", F.lit(0.0))),
        "exact_match": rate(is_true("exact_match")),
        "normalised_exact_match": rate(is_true("normalised_exact_match")),
        "empty_output_rate": rate(F.coalesce(F.col(pred), F.lit("")).rlike(r"\A\s*\z")),
        "n_connection_failed": status("connection_failed"),
        "n_excluded_dead_db": status("excluded_dead_db"),
        "n_executed": F.count_if(ran),
        "executable_rate": rate(ok, ran),
        "execution_accuracy": rate(match, ran),
        "n_gold_failed": F.count_if(ran & ~gold_ok),
        "execution_accuracy_gold_ok": rate(match, ran & gold_ok),
        "executable_rate_gold_ok": rate(ok, ran & gold_ok),
        "n_judged": F.count_if(judged),
        "execution_accuracy_judged": rate(match, judged),
        "n_schema_trimmed": F.count_if(is_true("schema_trimmed")),
        "schema_trimmed_rate": rate(is_true("schema_trimmed"), fitted),
        "n_prompt_over_budget": F.count_if(fitted & is_true("prompt_over_budget")),
        "syntax_valid_rate": rate(is_true("syntax_valid"), valid),
        "prompt_tokens_mean": F.avg(counted),
    }
    if percentiles:
        out["prompt_tokens_p95"] = nearest_rank_of("CASE WHEN prompt_tokens >= 0 THEN prompt_tokens END", 0.95)
    return out


def summarise(rows: DataFrame, by: list[str] | None = None, **kw) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(*[c.alias(k) for k, c in measures(**kw).items()])


def grouping_sets(rows: DataFrame, keys: list[str], extras: list[list[str]], **kw) -> DataFrame:
    """summarise() by keys + each of extras in one pass, with grouping_id; groups of NULL are kept apart from what is not grouped by."""
    sets = [[F.col(c) for c in keys + e] for e in extras]
    every = list(dict.fromkeys(c for e in [keys, *extras] for c in e))
    cols = {k: v for k, v in measures(**kw).items()}
    return rows.groupingSets(sets, *[F.col(c) for c in every]).agg(*[c.alias(k) for k, c in cols.items()], F.grouping_id(*every).alias("grouping"))


def with_interval(df: DataFrame, k: str, n: str, name: str, level: float = 0.95) -> DataFrame:
    low, high = wilson(F.col(k), F.col(n), level)
    return df.withColumns({f"{name}_low": low, f"{name}_high": high})


def error_category(pred: str = "predicted_cypher") -> Column:
    status = F.col("execution_status")
    return (
        F.when(F.coalesce(F.col(pred), F.lit("")).rlike(r"\A\s*\z"), "empty_output").when(status.isNull(), "not_executed")
        .when(status.isin("connection_failed", "excluded_dead_db", "gold_failed"), status)
        .when(~is_true("pred_executed_ok"), F.when(F.col("syntax_valid") == F.lit(False), "invalid_query").when(is_true("syntax_valid"), "runtime_error").otherwise("execution_error"))
        .when(is_true("execution_match"), "correct").otherwise("wrong_result"))


def error_table(rows: DataFrame, keys: list[str], **kw) -> DataFrame:
    """One column a class of error, zeros where there are none. The classes are given, so no extra pass looks for them."""
    kinds = rows.select(*keys, error_category(**kw).alias("__kind"))
    return kinds.groupBy(*keys).agg(*[F.count_if(F.col("__kind") == e).alias(e) for e in ERRORS])


def result_category(gold_rows: str = "gold_row_count", pred_rows: str = "pred_row_count") -> Column:
    g, p, right = F.coalesce(gold_rows, F.lit(-1)), F.coalesce(pred_rows, F.lit(-1)), is_true("execution_match")
    return (
        F.when(right & (g > 0), "correct_nonempty").when(right & (g == 0), "correct_empty_gold").when(~is_true("pred_executed_ok"), "pred_failed")
        .when((p == 0) & (g > 0), "wrong_pred_empty").when(p != g, "wrong_row_count").otherwise("wrong_same_row_count"))


def subsets(rows: DataFrame, named: dict[str, Column], by: list[str]) -> DataFrame:
    """summarise() of every named subset in one pass: each row goes to the subsets that it is in."""
    names = F.array_compact(F.array(*[F.when(is_true(c), F.lit(k)) for k, c in named.items()]))
    return summarise(rows.withColumn("subset", F.explode(names)), [*by, "subset"])


def top_groups(rows: DataFrame, by: str, k: int, order: str = "n") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias(order)).orderBy(F.desc(order), F.asc(by)).limit(k)


def agreement(rows: DataFrame, item: str, judge: str, right: Column) -> DataFrame:
    """Over items that every judge has: how many judges are right, in shares."""
    each = rows.groupBy(item, judge).agg(F.max(right.cast("int")).alias("r"))
    judges = each.select(judge).distinct().agg(F.count(F.lit(1)).alias("m"))
    counted = each.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("k")).join(F.broadcast(judges)).filter("n = m")
    avg = lambda c: F.avg(c.cast("double"))
    return counted.agg(F.count(F.lit(1)).alias("n_items"), avg(F.col("k") > 0).alias("any_right"), avg(F.col("k") == F.col("m")).alias("all_right"), avg(F.col("k") * 2 > F.col("m")).alias("majority_right"))


def first_rows(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")
