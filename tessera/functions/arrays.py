"""Vectors and token arrays, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def last(a: Column, k: Column) -> Column:
    """The last k elements; none for k of 0 or less."""
    return F.when(k > 0, F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), F.greatest(k, F.lit(0)))).otherwise(F.slice(a, 1, 0))


def masked_labels(prompt: Column, target: Column) -> Column:
    """The target's ids after as many ignored places as the prompt has."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), target)


def padded_length(longest: Column, multiple: int = 8) -> Column:
    return (F.ceil(longest / multiple) * multiple).cast("int")


def padded(a: Column, length: Column, value: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value), length - F.size(a)))
