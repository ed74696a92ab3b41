"""Query tokens, pooled n-grams, GLEU and exact match, as column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The token pattern and the words that normalisation writes in capitals.
TOKEN = r"""[A-Za-z_][A-Za-z_0-9]*|\d+\.\d+|\d+|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\sA-Za-z0-9_]"""
KEYWORDS = (
    "match", "optional", "where", "return", "with", "order", "by", "skip", "limit", "create", "merge", "delete", "detach", "set", "remove",
    "unwind", "call", "yield", "union", "all", "distinct", "as", "and", "or", "not", "in", "is", "null", "true", "false", "asc", "desc",
    "case", "when", "then", "else", "end", "contains", "starts", "ends", "count", "sum", "avg", "min", "max", "collect", "exists", "xor",
    "on", "foreach", "using",
)
LONGEST = 4


def strip(c: Column) -> Column:
    """Without white space at both ends, whatever its kind."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def ngrams(toks: Column, longest: int = LONGEST) -> Column:
    """All n-grams of 1 to longest tokens as strings, duplicates kept."""

    def of(n):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(toks) - n + 1)), lambda i: i + n - 1 <= F.size(toks))
        return F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), "\x01"))

    return F.concat(*[of(n) for n in range(1, longest + 1)])


def gleu_counts(pairs: DataFrame, gold: str, pred: str, keep: list[str]) -> DataFrame:
    """keep + overlap, n_gold, n_pred of each row: shared and own n-grams as multisets.

    keep must tell rows apart. Rows are dealt by their first kept column once; both aggregations then run within that partitioning,
    because grouping by more columns is satisfied by it.
    """
    rows = pairs.select(*keep, tokens(F.col(gold)).alias("__g"), tokens(F.col(pred)).alias("__p")).repartition(keep[0])
    side = lambda c, mine: F.transform(ngrams(F.col(c)), lambda x: F.struct(x.alias("gram"), F.lit(mine).alias("g"), F.lit(1 - mine).alias("p")))
    each = rows.select(*keep, F.explode_outer(F.concat(side("__g", 1), side("__p", 0))).alias("x"))
    each = each.groupBy(*keep, F.col("x.gram").alias("gram")).agg(F.sum("x.g").alias("g"), F.sum("x.p").alias("p"))
    total = each.groupBy(*keep).agg(F.sum(F.least("g", "p")).alias("overlap"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    return total.select(*keep, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("overlap", "n_gold", "n_pred")])


def gleu(overlap: Column, n_pred: Column, n_gold: Column) -> Column:
    """min(overlap / n_pred, overlap / n_gold); 0 if either side has none. For a row, or for sums over rows (corpus GLEU)."""
    return F.when((n_pred > 0) & (n_gold > 0), F.least(overlap / F.nullif(n_pred, F.lit(0)), overlap / F.nullif(n_gold, F.lit(0)))).otherwise(F.lit(0.0))


def normalise(c: Column) -> Column:
    """Tokens one blank apart, keywords in capitals, without semicolons at the end."""
    words = F.transform(tokens(c), lambda t: F.when(F.lower(t).isin(*KEYWORDS), F.upper(t)).otherwise(t))
    one = strip(F.regexp_replace(F.array_join(words, " "), r"\s+", " "))
    return strip(F.regexp_replace(one, r";+\z", ""))


def bare(c: Column) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r";+\z", ""))


def exact_match(gold: Column, pred: Column) -> Column:
    return bare(gold) == bare(pred)


def normalised_exact_match(gold: Column, pred: Column) -> Column:
    return normalise(gold) == normalise(pred)
