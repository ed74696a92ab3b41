"""How involved a query is, from counts of its patterns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
HOP, MATCH, WITH = r"-\s*\[", r"(?i)\bmatch\b", r"(?i)\bwith\b"
AGGREGATION = r"(?i)\b(count|sum|avg|min|max|collect|percentile\w*|stdev\w*)\s*\("
VARIABLE_LENGTH = r"\[\s*:?\w*\s*\*"
TIERS = ("easy", "medium", "hard", "extra_hard")


def complexity(c: Column) -> Column:
    """A struct of tier, hops, match_clauses, aggregations, variable_length and with_clauses; a null query counts as empty."""
    q = F.coalesce(c, F.lit(""))
    n = lambda p: F.regexp_count(q, F.lit(p))
    hops, matches, aggs, withs, varlen = n(HOP), n(MATCH), n(AGGREGATION), n(WITH), q.rlike(VARIABLE_LENGTH)
    tier = (
        F.when(varlen | (hops >= 4) | (matches >= 3) | ((withs >= 2) & (aggs >= 1)), "extra_hard")
        .when((hops >= 2) | (matches >= 2) | ((aggs >= 1) & (hops >= 1)), "hard")
        .when((hops == 1) | (aggs >= 1) | (withs >= 1), "medium").otherwise("easy"))
    return F.struct(tier.alias("tier"), hops.alias("hops"), matches.alias("match_clauses"), aggs.alias("aggregations"), varlen.alias("variable_length"), withs.alias("with_clauses"))


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)
