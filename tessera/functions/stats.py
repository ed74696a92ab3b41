"""Intervals and tests, as column expressions and small transforms."""

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The confidence level, bootstrap resamples, the margin of equivalence.
LEVEL, RESAMPLES, MARGIN = 0.95, 2000, 0.05
#: Pairs up to which McNemar's terms fit in a double as they are.
EXACT = 1000
#: Rows of a group that a bootstrap holds as one array at most, and resamples that share a copy of it.
HELD, BLOCK = 1 << 18, 50


def wilson(k: Column, n: Column, level: float = LEVEL) -> tuple[Column, Column]:
    """Wilson's score interval, clamped to [0, 1] and to hold k / n; nulls for n = 0."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    d = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / d
    scale = 1 + z * z / d
    centre = (p + z * z / (2 * d)) / scale
    half = z * F.sqrt(p * (1 - p) / d + z * z / (4 * d * d)) / scale
    low, high = F.least(F.greatest(F.lit(0.0), centre - half), p), F.greatest(F.least(F.lit(1.0), centre + half), p)
    return F.when(d.isNotNull(), low), F.when(d.isNotNull(), high)


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """The exact two-sided McNemar test: min(1, 2 * P(X <= min)) for X ~ Binomial(a + b, 1/2); 1 for no pairs.

    Up to EXACT pairs the terms C(n, i) are summed as they are: whole numbers, each from the one before, and 2**n is a power of two, so
    nothing is lost but beyond 2**53 a last bit. More pairs are summed in logarithms, so that nothing overflows.
    """
    n, m = (only_a + only_b).cast("double"), F.least(only_a, only_b).cast("int")
    steps = F.when(m >= 1, F.sequence(F.lit(1), F.greatest(F.lit(1), m))).otherwise(F.array().cast("array<int>"))

    def plain(acc, i):
        t = acc["t"] * (n - i + 1) / i
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    # log C(n, i) grows by log((n - i + 1) / i); s is log of the sum so far
    def logs(acc, i):
        t = acc["t"] + F.log((n - i + 1) / i)
        hi, lo = F.greatest(t, acc["s"]), F.least(t, acc["s"])
        return F.struct(t.alias("t"), (hi + F.log1p(F.exp(lo - hi))).alias("s"))

    few = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), plain)["s"] / F.pow(F.lit(2.0), n - 1)
    many = 2 * F.exp(F.aggregate(steps, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s")), logs)["s"] - n * F.log(F.lit(2.0)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.when(n <= EXACT, few).otherwise(many)))


def holm(df: DataFrame, p: str, by: list[str], order: list[str], out: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment within by; order breaks ties."""
    w = Window.partitionBy(*by).orderBy(p, *order)
    raw = F.least(F.lit(1.0), (F.count(F.lit(1)).over(Window.partitionBy(*by)) - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("__raw", raw).withColumn(out, F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__raw")


def nearest_rank(values: Column, p: float) -> Column:
    """Element min(n - 1, int(n * p)) of the sorted values, counted from 0; an aggregate over groups that fit in an array."""
    s = F.array_sort(F.collect_list(values))
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * F.lit(p)).cast("int")))


def nearest_rank_of(expression: str, p: float) -> Column:
    """The same of an SQL expression, for p under 1 and any group: an aggregate that counts equal values and gathers no rows. The least
    value with a larger share of the rows at or below it than p; the tiny rest makes `at least` into `more than`."""
    return F.expr(f"percentile_disc({p} + 1e-12D) WITHIN GROUP (ORDER BY {expression})")


def nearest_ranks(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """By group the elements min(n - 1, int(n * share)) of the sorted values, counted from 0, under the names of shares.

    Equal values are counted first, and ranks are running sums of the counts, so no group is gathered into an array. Nulls don't count.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    own = Window.partitionBy(*by)
    c = c.withColumns({"__n": F.sum("__c").over(own), "__to": F.sum("__c").over(own.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))})
    rank = lambda p: F.least(F.col("__n") - 1, F.floor(F.col("__n") * F.lit(p)))
    return c.groupBy(*by).agg(*[F.min(F.when(F.col("__to") > rank(p), F.col("__v"))).alias(k) for k, p in shares.items()])


def resampled(df: DataFrame, by: list[str], order: list[str], values: list[str], resamples: int = RESAMPLES) -> DataFrame:
    """Bootstrap: by, b (1 to resamples) and the sums of values over n draws with replacement from each group's n rows.

    Draw i of resample b is row md5(b:i) modulo n in the given order, the same in any engine. Groups of HELD rows at most are arrays that
    blocks of resamples draw from in place, so no draw is shuffled. If there is a larger one, draws are counted by row and joined with the
    rows.
    """
    number = lambda i, n: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("b"), i).cast("binary")), 1, 8), 16, 10).cast("long"), n)
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= HELD:
        named = [F.col(v).alias(f"v{k}") for k, v in enumerate(values)]
        held = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *named))).alias("__a"))
        held = held.withColumn("__a", F.transform("__a", lambda x: F.struct(*[x[f"v{k}"].alias(f"v{k}") for k in range(len(values))])))
        each = held.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples), F.lit(BLOCK)))).repartition(df.sparkSession.sparkContext.defaultParallelism, *by, "b")
        kinds = dict(df.dtypes)
        wide = lambda v: F.lit(0.0) if kinds[v] in ("double", "float") else F.lit(0).cast("long")
        zero = F.struct(*[wide(v).alias(f"v{k}") for k, v in enumerate(values)])
        n = F.size("__a")
        each = each.withColumn("b", F.explode(F.sequence(F.col("b"), F.least(F.col("b") + (BLOCK - 1), F.lit(resamples)))))

        def add(acc, i):
            x = F.get(F.col("__a"), number(i, n).cast("int"))
            return F.struct(*[(acc[f"v{k}"] + x[f"v{k}"]).alias(f"v{k}") for k in range(len(values))])

        sums = each.select(*by, "b", F.aggregate(F.sequence(F.lit(0), n - 1), zero, add).alias("__s"), n.cast("long").alias("n"))
        return sums.select(*by, "b", *[F.col(f"__s.v{k}").alias(v) for k, v in enumerate(values)], "n")
    w = Window.partitionBy(*by)
    rows = df.select(*by, *values, (F.row_number().over(w.orderBy(*order)) - 1).alias("__i"), F.count(F.lit(1)).over(w).alias("__n"))
    draws = rows.select(*by, "__i", "__n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).select(*by, "b", number(F.col("__i"), F.col("__n")).alias("__d")).groupBy(*by, "b", "__d").count()
    chosen = draws.join(rows.select(*by, F.col("__i").alias("__d"), *values), [*by, "__d"])
    return chosen.groupBy(*by, "b").agg(*[F.sum(F.col(v) * F.col("count")).alias(v) for v in values], F.sum("count").alias("n"))
