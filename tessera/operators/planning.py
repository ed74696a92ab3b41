"""Plans of jobs with prerequisites: levels, reuse of what is finished, admission within a budget; and the checkpoint to resume from."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import in_order
from tessera.operators.tables import reuse
from tessera.session import staged


def levels(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """job and level: 0 without prerequisites, else one more than the highest of them. needs has job and needs.

    Semi-naive rounds: each looks only at jobs whose prerequisites have risen in the last one, so there are as many rounds as levels. A
    prerequisite that is no job counts as one of level -1. A cycle is an error.
    """
    links = needs.select("job", "needs").distinct()
    known = jobs.select("job").distinct()
    links = staged(links.join(known, "job", "left_semi").join(known.withColumnRenamed("job", "needs"), "needs", "left_semi"), "needs")
    level = staged(known.withColumn("level", F.lit(0)), "levels")
    risen, rounds, most = level, 0, None
    while True:
        higher = links.join(risen.withColumnRenamed("job", "needs"), "needs").groupBy("job").agg((F.max("level") + 1).alias("new"))
        risen = staged(higher.join(level, "job").filter("new > level").select("job", F.col("new").alias("level")), "risen")
        if risen.isEmpty():
            return level
        rounds += 1
        if most is None:
            most = known.count()
        if rounds >= most:
            raise ValueError("prerequisites form a cycle")
        level = staged(level.join(risen.withColumnRenamed("level", "up"), "job", "left").select("job", F.coalesce("up", "level").alias("level")), "levels")


def plan_jobs(jobs: DataFrame, needs: DataFrame, finished: DataFrame, provenance: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """jobs with level, status and reason.

    A job is `reused` if a finished one has its provenance (finished has job, status and those columns); others are `admitted` level by
    level, in the given order while the cost of all that is admitted fits the budget, `over budget` beyond that, and `waiting` if a
    prerequisite is neither reused nor admitted. reason says why a job isn't reused: new, its status, or the first column that differs.
    Costs are whole numbers.
    """
    ranked = jobs.join(levels(jobs, needs), "job")
    done = finished.select("job", *provenance, F.col("status").alias("__status"))
    complete = done.filter(F.col("__status") == "completed").drop("__status").dropDuplicates(["job"])
    other = done.select("job", "__status").groupBy("job").agg(F.max(F.col("__status") == "completed").alias("__ok"), F.min("__status").alias("__status"))
    told = reuse(ranked, complete, ["job"], provenance).join(other, "job", "left")
    told = told.withColumn("reason", F.when((F.col("reason") == "new") & ~F.col("__ok"), F.concat(F.lit("status "), "__status")).otherwise(F.col("reason")))
    told = staged(told.drop("__ok", "__status"), "told")
    links = staged(needs.select("job", "needs").distinct(), "links")
    spent, settled = 0, None
    for level in range((told.agg(F.max("level")).first()[0] or 0) + 1):
        own = told.filter(F.col("level") == level)
        ready = own.select("job")
        if settled is not None or level == 0:
            good = told.filter(F.lit(False)).select("job") if settled is None else settled.filter("status IN ('reused', 'admitted')").select("job")
            lacking = links.join(ready, "job", "left_semi").join(good.withColumnRenamed("job", "needs"), "needs", "left_anti").select("job").distinct()
            own = own.join(lacking.withColumn("__lacks", F.lit(True)), "job", "left")
        run = own.filter("action = 'run' AND __lacks IS NULL")
        run = in_order(run, order, F.col(cost)).withColumn("status", F.when(F.col("running") <= budget - spent, "admitted").otherwise("over budget")).drop("rank", "running")
        rest = own.filter("action = 'reuse' OR __lacks IS NOT NULL").withColumn("status", F.when(F.col("action") == "reuse", "reused").otherwise("waiting"))
        both = staged(run.unionByName(rest).drop("__lacks", "action"), "level")
        spent += both.filter("status = 'admitted'").agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
        settled = both if settled is None else settled.unionByName(both)
    return settled


def resume_choice(listing: DataFrame, required: list[str], runs: DataFrame | None = None) -> DataFrame:
    """Of each run (listing has run, step and file), the newest checkpoint that holds all required files, and what is skipped for it.

    Columns: run, step (null if none holds them all), checkpoints, skipped (newer ones that lack a file), repeated (steps that will be run
    again) and state: resume, not resumable (there are checkpoints, none complete) or, for runs of a registry that have none, start.
    """
    each = listing.groupBy("run", "step").agg(F.count_distinct(F.when(F.col("file").isin(required), F.col("file"))).alias("__have"))
    complete = F.when(F.col("__have") == len(set(required)), F.col("step"))
    best = each.groupBy("run").agg(F.max(complete).alias("chosen"), F.count(F.lit(1)).alias("checkpoints"), F.max("step").alias("newest"))
    newer = each.join(best.select("run", "chosen"), "run").filter(F.col("step") > F.coalesce("chosen", F.lit(-1))).groupBy("run").agg(F.count(F.lit(1)).alias("skipped"))
    out = best.join(newer, "run", "left")
    if runs is not None:
        out = runs.select("run").distinct().join(out, "run", "left")
    state = F.when(F.col("checkpoints").isNull(), "start").when(F.col("chosen").isNull(), "not resumable").otherwise("resume")
    return out.select("run", F.col("chosen").alias("step"), F.coalesce("checkpoints", F.lit(0)).alias("checkpoints"), F.coalesce("skipped", F.lit(0)).alias("skipped"), F.when(F.col("skipped") > 0, F.col("newest") - F.col("chosen")).otherwise(F.when(F.col("chosen").isNotNull(), 0)).alias("repeated"), state.alias("state"))
