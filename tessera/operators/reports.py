"""Summaries with intervals, lookups, trade-offs and the integrity table of a whole experiment."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import LEVEL, MARGIN, RESAMPLES, mcnemar, resampled, wilson
from tessera.functions.tokens import gleu, normalise
from tessera.operators.evaluation import JUDGED, executed, first_rows, is_true, rate
from tessera.operators.paired import bootstrap_difference

#: A schema is pruned if less than this share of it is left; outputs of a tuned model differ if under this share is the same;
#: the share of gold queries that may fail.
PRUNED, SAME, GOLD_FAILURES = 0.95, 0.9, 0.05


def long_rows(rows: DataFrame, keys: list[str], errors: tuple = ("gold_error", "pred_error", "syntax_error"), digits: int = 300) -> DataFrame:
    """keys first, and flags: has_database, empty_output, judged, correct; errors cut to `digits` characters, empty ones null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(r"\A\s*\z")
    cut = {c: F.left(F.nullif(F.col(c), F.lit("")), F.lit(digits)) for c in errors if c in rows.columns}
    judged = is_true(F.col("execution_status").isin(*JUDGED)) & is_true("gold_executed_ok")
    flags = {"empty_output": blank("predicted_cypher"), "judged": judged, "correct": is_true("execution_match")}
    if "database_reference" in rows.columns:
        flags["has_database"] = F.coalesce("database_reference", F.lit("")) != ""
    return rows.select(*keys, *[c for c in rows.columns if c not in keys]).withColumns(cut | flags)


def _with_bounds(df: DataFrame, shares: dict[str, tuple[str, str]], level: float) -> DataFrame:
    """Wilson bounds beside each share: name -> (successes, trials), columns that are dropped if they start with __."""
    for name, (k, n) in shares.items():
        low, high = wilson(F.col(k), F.col(n), level)
        df = df.withColumns({f"{name}_ci_low": low, f"{name}_ci_high": high})
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _with_gleu_bounds(summary: DataFrame, scored: DataFrame, by: list[str], item: str, resamples: int, level: float) -> DataFrame:
    """Percentile bounds of the corpus GLEU over resamples of rows, joined to a summary by group."""
    sums = resampled(scored.select(*by, item, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("overlap", "n_gold", "n_pred")]), by, [item], ["overlap", "n_gold", "n_pred"], resamples)
    q = F.percentile(gleu(F.col("overlap"), F.col("n_pred"), F.col("n_gold")), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("__q")
    bounds = sums.groupBy(*by).agg(q).select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__q")[0].alias("gleu_corpus_ci_low"), F.col("__q")[1].alias("gleu_corpus_ci_high"))
    on = [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)]
    return summary.join(bounds, on, "left").drop(*[f"__by{k}" for k in range(len(by))])


def _text_measures() -> dict[str, Column]:
    right, close = is_true("exact_match"), is_true("normalised_exact_match")
    return {
        "n": F.count(F.lit(1)), "gleu_corpus": gleu(F.sum("overlap"), F.sum("n_pred"), F.sum("n_gold")), "__k_em": F.count_if(right), "exact_match": rate(right),
        "__k_nem": F.count_if(close), "normalised_exact_match": rate(close), "empty_output_rate": rate(F.coalesce("predicted_cypher", F.lit("")).rlike(r"\A\s*\z")),
        "n_has_database": F.count_if(is_true("has_database")), "n_connection_failed": F.count_if(is_true(F.col("execution_status") == "connection_failed")),
        "syntax_valid_rate": rate(is_true("syntax_valid"), F.col("syntax_valid").isNotNull()),
    }


def thesis_summary(scored: DataFrame, by: list[str], item: str = "id", resamples: int = RESAMPLES, level: float = LEVEL) -> DataFrame:
    """The summary of scored rows with bounds: bootstrap for corpus GLEU, Wilson for shares. Accuracy is of rows whose gold query ran
    (execution_accuracy) and of all that ran (execution_accuracy_toolkit); prompt lengths of at least 0 count."""
    ran, ok, match = executed(), is_true("gold_executed_ok"), is_true("execution_match")
    counted = F.when(F.col("prompt_tokens") >= 0, F.col("prompt_tokens"))
    more = {
        "gleu_mean": F.avg("gleu"), "n_excluded_dead_db": F.count_if(is_true(F.col("execution_status") == "excluded_dead_db")), "n_schema_trimmed": F.count_if(is_true("schema_trimmed")),
        "schema_trimmed_rate": rate(is_true("schema_trimmed"), F.col("schema_trimmed").isNotNull()), "n_prompt_over_budget": F.count_if(is_true("prompt_over_budget")),
        "n_executed": F.count_if(ran), "n_gold_ok": F.count_if(ran & ok), "n_gold_failed": F.count_if(ran & ~ok), "execution_accuracy_toolkit": rate(match, ran),
        "executable_rate": rate(is_true("pred_executed_ok"), ran), "__k_ea": F.count_if(match & ran & ok), "execution_accuracy": rate(match, ran & ok),
        "executable_rate_gold_ok": rate(is_true("pred_executed_ok"), ran & ok), "prompt_tokens_mean": F.avg(counted), "prompt_tokens_median": F.percentile(counted, F.lit(0.5)),
        "prompt_tokens_p95": F.percentile(counted, F.lit(0.95)), "prompt_tokens_max": F.max(counted),
    }
    out = scored.groupBy(*by).agg(*[c.alias(k) for k, c in (_text_measures() | more).items()])
    out = _with_bounds(out, {"exact_match": ("__k_em", "n"), "normalised_exact_match": ("__k_nem", "n"), "execution_accuracy": ("__k_ea", "n_gold_ok")}, level)
    return _with_gleu_bounds(out, scored, by, item, resamples, level)


def edge_summary(scored: DataFrame, by: list[str], item: str = "id", gold_rows: str = "gold_row_count", resamples: int = RESAMPLES, level: float = LEVEL) -> DataFrame:
    """The summary of judged rows with bounds, the accuracy where the gold result isn't empty, and of what is correct the share with an empty
    one, which is weak evidence."""
    judged = is_true(F.col("execution_status").isin(*JUDGED)) & is_true("gold_executed_ok")
    match, full = is_true("execution_match"), F.coalesce(F.col(gold_rows), F.lit(0)) > 0
    more = {
        "n_judged": F.count_if(judged), "__k_ea": F.count_if(judged & match), "execution_accuracy": rate(match, judged), "executable_rate_gold_ok": rate(is_true("pred_executed_ok"), judged),
        "n_judged_nonempty_gold": F.count_if(judged & full), "execution_accuracy_nonempty_gold": rate(match, judged & full),
        "share_correct_with_empty_gold": F.when(F.count_if(judged) > 0, F.count_if(judged & match & (F.coalesce(F.col(gold_rows), F.lit(0)) == 0)) / F.greatest(F.lit(1), F.count_if(judged & match))),
    }
    out = scored.groupBy(*by).agg(*[c.alias(k) for k, c in (_text_measures() | more).items()])
    out = _with_bounds(out, {"exact_match": ("__k_em", "n"), "normalised_exact_match": ("__k_nem", "n"), "execution_accuracy": ("__k_ea", "n_judged")}, level)
    return _with_gleu_bounds(out, scored, by, item, resamples, level)


# ---- lookups ---------------------------------------------------------------------------------------------------------------------------
def with_registry(metrics: DataFrame, registry: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Metrics with those of the columns that the registry has; a job that it lacks keeps nulls, one that it has twice counts once."""
    own = [c for c in columns if c in registry.columns]
    return metrics.join(first_rows(registry.select(on, *own), [on], own or [on]), on, "left")


def map_lookup(rows: DataFrame, key: str, reference: DataFrame, ref_key: str, ref_value: str, out: str) -> DataFrame:
    """Adds the value that a reference has for the row's key, or null; of several the least."""
    ref = reference.groupBy(F.col(ref_key).alias("__k")).agg(F.min(ref_value).alias(out))
    return rows.join(ref, F.col(key) == F.col("__k"), "left").drop("__k")


def looked_up(rows: DataFrame, corpus: DataFrame, on: str, mode: str, made: Column, out: str) -> DataFrame:
    """Adds what is made of the corpus row of an id in a mode, worked out once for each distinct (id, mode); null for an unknown id."""
    wanted = rows.select(F.col(on).alias("__i"), F.col(mode).alias("__m")).distinct()
    each = wanted.join(corpus, F.col("__i") == corpus[on]).withColumn(mode, F.col("__m")).select("__i", "__m", made.alias(out))
    return rows.join(each, F.col(on).eqNullSafe(F.col("__i")) & F.col(mode).eqNullSafe(F.col("__m")), "left").drop("__i", "__m")


def named(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose name starts with a prefix; a null name doesn't."""
    return rows.filter(F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False)))


# ---- tables of the whole experiment ----------------------------------------------------------------------------------------------------
def gold_table(rows: DataFrame, db: str, item: str, order: list[str], error: str = "gold_error") -> DataFrame:
    """Databases with failing gold queries, each item once: size, failures, rate (highest first), dead, and the first error that isn't empty."""
    ran = rows.filter(F.col("execution_status").isNotNull() & (F.col("execution_status") != "connection_failed"))
    once = first_rows(ran.filter(F.col(db).isNotNull()), [db, item], order)
    bad = ~is_true("gold_executed_ok")
    text = F.nullif(F.col(error), F.lit(""))
    sample = F.min(F.when(text.isNotNull(), F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate([item, *order])], text.alias("e"))))["e"]
    out = once.groupBy(db).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_gold_failed"), sample.alias("sample_gold_error")).filter("n_gold_failed > 0")
    return out.withColumn("gold_failure_rate", F.col("n_gold_failed") / F.col("n")).withColumn("dead", F.col("n_gold_failed") == F.col("n")).orderBy(F.desc("gold_failure_rate"), db)


def trade_off(pairs: DataFrame, by: list[str], item: str, chars: str = "schema_chars", threshold: float = PRUNED, resamples: int = RESAMPLES, level: float = LEVEL) -> DataFrame:
    """Schema filtering, for pairs of rows of a full (a_) and a filtered (b_) prompt: how much shorter prompts get, how many schemas are
    hardly filtered, and the accuracy on judged rows whose schema is: of both sides, their difference with bounds and McNemar's test."""
    ratio = F.try_divide(F.col(f"b_{chars}").cast("double"), F.nullif(F.col(f"a_{chars}"), F.lit(0)).cast("double"))
    p = pairs.withColumns({"__r": ratio, "__p": F.coalesce(ratio < threshold, F.lit(False))})
    tokens = lambda s: F.avg(F.when(F.col(f"{s}_prompt_tokens") >= 0, F.col(f"{s}_prompt_tokens")))
    judged = F.col("__p") & is_true(F.col("a_execution_status").isin(*JUDGED)) & is_true(F.col("b_execution_status").isin(*JUDGED))
    a, b = is_true("a_execution_match"), is_true("b_execution_match")
    out = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), tokens("a").alias("prompt_tokens_mean_a"), tokens("b").alias("prompt_tokens_mean_b"), F.median("__r").alias("schema_chars_median_ratio"),
        rate(F.coalesce(F.col("__r") >= threshold, F.lit(False))).alias("share_rows_hardly_filtered"), F.count_if("__p").alias("pruned_rows_n"), F.count_if(judged).alias("pruned_rows_n_judged"),
        rate(a, judged).alias("pruned_rows_ea_a"), rate(b, judged).alias("pruned_rows_ea_b"), F.count_if(judged & a & ~b).alias("a_only"), F.count_if(judged & b & ~a).alias("b_only"))
    out = out.withColumns({"prompt_token_reduction_pct": 100 * (1 - F.try_divide(F.col("prompt_tokens_mean_b"), F.col("prompt_tokens_mean_a"))), "pruned_rows_ea_delta": F.col("pruned_rows_ea_b") - F.col("pruned_rows_ea_a")})
    out = out.withColumn("pruned_rows_mcnemar_p", F.when(F.col("pruned_rows_n_judged") > 0, mcnemar(F.col("a_only"), F.col("b_only"))))
    diffs = p.filter(judged).select(*by, item, (b.cast("double") - a.cast("double")).alias("d"))
    q = F.percentile(F.col("d") / F.col("n"), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q")
    bounds = resampled(diffs, by, [item], ["d"], resamples).groupBy(*by).agg(q)
    return out.join(bounds, by, "left").withColumns({"pruned_rows_delta_ci_low": F.col("q")[0], "pruned_rows_delta_ci_high": F.col("q")[1]}).drop("q", "a_only", "b_only")


def coverage_accuracy(rows: DataFrame, by: list[str], variant: str, variants: list[str], item: str, covered: DataFrame) -> DataFrame:
    """Accuracy of each variant over the items that all of a group's variants have judged, apart for items whose schema elements are all
    covered and others; covered: item, fully_covered. Items that covered lacks don't count."""
    j = rows.filter(F.col("judged")).groupBy(*by, item, variant).agg(F.max(is_true("correct").cast("int")).alias("c"))
    wide = j.groupBy(*by, item).agg(F.count(F.lit(1)).alias("k"), *[F.max(F.when(F.col(variant) == v, F.col("c"))).alias(f"v{i}") for i, v in enumerate(variants)]).filter(F.col("k") == len(variants))
    known = wide.join(covered.select(item, F.col("fully_covered")), item)
    return known.groupBy(*by, "fully_covered").agg(F.count(F.lit(1)).alias("n_judged_all"), *[F.avg(f"v{i}").alias(f"ea_{v}") for i, v in enumerate(variants)])


def agreement_shares(rows: DataFrame, item: str, judge: str, judges: list[str], right: Column) -> DataFrame:
    """Over items that all judges have: of each judge the share right, and the share of items that exactly k judges have right."""
    each = rows.groupBy(item).agg(*[F.max(F.when(F.col(judge) == j, right.cast("int"))).alias(f"r{i}") for i, j in enumerate(judges)])
    both = each.dropna(subset=[f"r{i}" for i in range(len(judges))]).withColumn("k", sum((F.col(f"r{i}") for i in range(len(judges))), F.lit(0)))
    shares = [F.avg((F.col("k") == i).cast("double")).alias(f"share_correct_by_{i}") for i in range(len(judges) + 1)]
    return both.agg(F.count(F.lit(1)).alias("n_items"), *[F.avg(f"r{i}").alias(f"ea_{j}") for i, j in enumerate(judges)], *shares)


def identical_shares(pairs: DataFrame, by: list[str], a: str = "a_predicted_cypher", b: str = "b_predicted_cypher") -> DataFrame:
    """The share of pairs with the same prediction, as it is and normalised."""
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("identical"), F.avg((normalise(F.col(a)) == normalise(F.col(b))).cast("double")).alias("identical_normalised"))


def percent(c: Column) -> Column:
    """A share as a percentage with one digit, halves to even; nan without a value."""
    return F.coalesce(F.format_string("%.1f%%", F.bround(c * 100, 1)), F.lit("nan"))


def integrity(rows: DataFrame, jobs: DataFrame, expected: DataFrame, pairs: DataFrame, dead: DataFrame) -> DataFrame:
    """check, subject, passed (null: only told) and detail.

    rows: job_id, item, execution_status, gold_executed_ok. jobs: job_id, status, error, git_commit, platform, adapter_verified, fingerprint_trained,
    fingerprint_now. expected: job_id. pairs: job_a, job_b, identical (a share). dead: database, dead. All but rows are registries.
    """
    def told(df: DataFrame, name: str, subject: Column, passed: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("check"), subject.cast("string").alias("subject"), passed.cast("boolean").alias("passed"), detail.cast("string").alias("detail"))

    everything, job = F.lit("all"), F.col("job_id")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    # a set of rows is told by its size and a sum of hashes, so no set is gathered
    half = F.conv(F.substring(F.md5(F.col("item").cast("string").cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    sets = rows.select("job_id", "item").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum(half).alias("s"))
    same = sets.agg((F.countDistinct("n", "s") <= 1).alias("ok"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "job_id", F.col("n").cast("string")))), ", ").alias("d"))
    status = rows.groupBy("job_id").agg(F.count_if(executed()).alias("ran"), F.count_if(executed() & ~is_true("gold_executed_ok")).alias("bad"), F.count_if(is_true(F.col("execution_status") == "connection_failed")).alias("lost"))
    state = expected.select("job_id").join(jobs, "job_id", "left").withColumn("status", F.coalesce("status", F.lit("not_started")))
    done = jobs.filter("status = 'completed'")
    share = F.try_divide(F.col("bad").cast("double"), F.nullif(F.col("ran"), F.lit(0)).cast("double"))
    one = lambda c: done.agg((F.countDistinct(c) <= 1).alias("ok"), listed(F.col(c)).alias("d"))
    parts = [
        told(same, "identical evaluation rows across all jobs", everything, F.col("ok"), F.col("d")),
        told(done, "adapter verified at load", job, F.coalesce(F.col("adapter_verified"), F.lit("")) != "", F.coalesce(F.col("adapter_verified"), F.lit(""))),
        told(pairs, "tuned outputs differ from the base's", F.col("job_b"), F.col("identical") < SAME, F.concat(percent(F.col("identical")), F.lit(" of predictions identical to "), F.col("job_a"))),
        told(status.filter("ran > 0"), "gold queries run", job, share < GOLD_FAILURES, F.concat(percent(share), F.lit(" of executed rows had a failing gold query"))),
        told(jobs, "fingerprint matches", job, F.col("fingerprint_trained").eqNullSafe(F.col("fingerprint_now")), F.concat_ws(" vs ", F.coalesce("fingerprint_trained", F.lit("-")), F.coalesce("fingerprint_now", F.lit("-")))),
        told(state, "expected job completed", job, F.col("status") == "completed", F.concat_ws(": ", "status", F.nullif(F.col("error"), F.lit("")))),
        told(one("git_commit"), "all jobs from one code commit", everything, F.col("ok"), F.col("d")),
        told(one("platform"), "all jobs from one platform", everything, F.col("ok"), F.col("d")),
        told(status, "no connection failures", job, F.col("lost") == 0, F.concat(F.col("lost").cast("string"), F.lit(" rows connection_failed"))),
        told(dead.agg(listed(F.when(F.col("dead"), F.col("database"))).alias("d")), "databases where every gold query fails", everything, F.lit(None), F.when(F.col("d") == "", "none").otherwise(F.col("d"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def equivalence(df: DataFrame, low: str, high: str, margin: float = MARGIN) -> DataFrame:
    """Adds equivalent_within_margin: both bounds inside the margin; null without bounds."""
    return df.withColumn("equivalent_within_margin", (F.col(low) > -margin) & (F.col(high) < margin))


def paired_values(pairs: DataFrame, by: list[str], item: str, metrics: dict[str, str], digits: int = 6, resamples: int = RESAMPLES) -> DataFrame:
    """Metrics that aren't a yes or no, such as sentence GLEU and latencies: means of both sides (nulls are 0), the mean of b - a with bootstrap
    bounds and p; metrics: name -> column, of which pairs has a_ and b_. Values are rounded, so that equal ones differ by 0."""
    value = lambda s, c: F.round(F.coalesce(F.col(f"{s}_{c}").cast("double"), F.lit(0.0)), digits)
    each = F.array(*[F.struct(F.lit(k).alias("metric"), value("a", c).alias("a"), value("b", c).alias("b")) for k, c in metrics.items()])
    long = pairs.select(*by, item, F.explode(each).alias("x")).select(*by, item, "x.*")
    sides = long.groupBy(*by, "metric").agg(F.avg("a").alias("a_value"), F.avg("b").alias("b_value"))
    boot = bootstrap_difference(long, [*by, "metric"], item, "a", "b", resamples)
    return sides.join(boot.select(*by, "metric", "n_pairs", "difference", "ci_low", "ci_high", "p_value"), [*by, "metric"])
