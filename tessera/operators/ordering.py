"""Places and running sums over whole tables in an order, without a window that spans the table or a group."""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import parts_for, staged

#: Accuracy of the sketches that percentiles() takes brackets from, and what a bracket has on both sides of a share: more than twice a sketch's error.
SKETCH, SLACK = 5_000, 5e-4

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def _counted(batches):
    """Each row's place in its partition from 1, and the partition's sum up to it of the last column."""
    place, total = 0, 0
    for b in batches:
        if b.num_rows:
            sums = np.cumsum(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)) + total
            places = np.arange(place + 1, place + 1 + b.num_rows)
            place, total = int(places[-1]), sums[-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(places), pa.array(sums)], [*b.schema.names[:-1], "__place", "__sum"])


def in_order(rows: DataFrame, order: list[Column], value: Column | None = None, rank: str = "rank", running: str = "running") -> DataFrame:
    """Adds each row's place from 1, and the sum of value up to and with it, in an order over all rows.

    Rows are dealt by ranges of the order and sorted, each task numbers and sums its own, and what the ranges before hold is added from a
    table of one row a range. The order must tell all rows apart for reruns to agree. A null value counts as 0.
    """
    kind = "double" if value is not None and rows.select(value.alias("v")).schema["v"].dataType.simpleString() in ("float", "double") else "long"
    v = F.lit(0).cast("long") if value is None else F.coalesce(value.cast(kind), F.lit(0).cast(kind))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    d = rows.withColumn("__v", v).repartitionByRange(parts_for(rows), *order).sortWithinPartitions(*order)
    done = staged(d.mapInArrow(_counted, f"{columns}, __place long, __sum {kind}").withColumn("__part", F.spark_partition_id()), "ordered")
    parts = done.groupBy("__part").agg(F.max("__place").alias("__n"), F.max_by("__sum", "__place").alias("__s"))
    w = Window.orderBy("__part")
    parts = parts.select(F.col("__part").alias("__p"), (F.sum("__n").over(w) - F.col("__n")).alias("__n"), (F.sum("__s").over(w) - F.col("__s")).alias("__s"))
    out = done.join(parts, F.col("__part") == F.col("__p")).withColumn(rank, F.col("__n") + F.col("__place"))
    if value is not None:
        out = out.withColumn(running, (F.col("__s") + F.col("__sum")).cast(kind))
    return out.drop("__part", "__p", "__n", "__s", "__place", "__sum")


def length_batches(rows: DataFrame, length: str, budget: int, tie: list[Column]) -> DataFrame:
    """Adds batch (from 0): rows by length, cut wherever a multiple of budget is passed, so that a batch's lengths sum up to the budget and one
    row's length at most. Rows keep their columns; whoever needs the old order sorts by a column that tells it."""
    out = in_order(rows, [F.col(length).asc_nulls_first(), *tie], F.col(length))
    return out.withColumn("batch", F.floor(F.greatest(F.col("running") - 1, F.lit(0)) / budget).cast("long")).drop("rank", "running")


def padding(batches: DataFrame, batch: str, length: str) -> DataFrame:
    """Of each batch its rows, longest row and padding: what lengths lack of the longest."""
    n = F.coalesce(F.col(length), F.lit(0)).cast("long")
    each = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("longest"), F.sum(n).alias("__own"))
    return each.select(batch, "n", "longest", (F.col("n") * F.col("longest") - F.col("__own")).alias("padding"))


def percentiles(rows: DataFrame, by: list[str], values: dict[str, Column], shares: dict[str, float]) -> DataFrame:
    """By group the interpolated percentiles of each value, as columns <value>_<share>: what lies at (n - 1) * share of the n sorted values,
    counted from 0. Nulls don't count; a value of which all are null has nulls.

    Exact, without a task that holds a group's values, as the percentile aggregate does. 1. Sketches of all rows give a bracket for each
    share. 2. All values are counted: those in a bracket each for itself, those below and between brackets together. 3. The counts are
    placed by ranges, see in_order(), and a group's places begin after those before it. Where a place sought lies outside its bracket,
    that group's values are counted each for itself.
    """
    d, names = rows.select(*by, *[c.cast("double").alias(f"__{k}") for k, c in values.items()]), list(shares)
    near = F.array(*[F.lit(min(1.0, max(0.0, p + e))) for e in (-SLACK, SLACK) for p in shares.values()])
    edges = staged(d.groupBy(*by).agg(*[F.percentile_approx(f"__{k}", near, SKETCH).alias(f"__e_{k}") for k in values]), "edges")
    ends = staged(_counted_percentiles(d, by, edges, list(values), list(shares.values())), "ends")
    out_of = " OR ".join(f"e{i} IS NULL" for i in range(2 * len(shares)))
    if ends.filter(out_of).limit(1).count():
        missed = ends.filter(out_of).select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate([*by, "__m"])])
        same = [F.col(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate([*by, "__m"])]
        again = _counted_percentiles(d.join(missed, same[:-1], "left_semi"), by, None, list(values), list(shares.values()))
        ends = ends.join(missed, same, "left_anti").unionByName(again.join(missed, same, "left_semi"))
    place = lambda p: (F.col("__n") - 1) * F.lit(p)
    between = lambda lo, hi, p: F.when(lo == hi, lo).otherwise((F.ceil(place(p)) - place(p)) * lo + (place(p) - F.floor(place(p))) * hi)
    each = ends.select(*by, "__m", *[between(F.col(f"e{2 * i}"), F.col(f"e{2 * i + 1}"), shares[s]).alias(f"s{i}") for i, s in enumerate(names)])
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("__m") == k, F.col(f"s{i}"))).alias(f"{k}_{s}") for k in values for i, s in enumerate(names)])


def _counted_percentiles(d: DataFrame, by: list[str], edges: DataFrame | None, values: list[str], shares: list[float]) -> DataFrame:
    """by, __m (the value's name), __n and the values e0, e1, ... below and above each share's place; null where one is outside its bracket.
    edges: by and the ends of the brackets, the lower first, as arrays __e_<value>; without, all values are counted each for itself."""
    k, own = len(shares), [*by, "__m"]
    named = lambda df, prefix: df.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("m"), F.col(f"{prefix}{v}").alias("v")) for v in values])).alias("__e")).select(*by, F.col("__e.m").alias("__m"), F.col("__e.v").alias("__v")).filter("__v is not null")
    each, past, inside = named(d, "__"), F.lit(0), F.lit(edges is None)
    if edges is not None:
        ends = staged(named(edges, "__e_"), "brackets").toDF(*[f"__k{i}" for i in range(len(own))], "__e")
        each = each.join(ends, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(own)])
        v, e = F.col("__v"), lambda i: F.get("__e", F.lit(i))
        for i in range(k):
            past, inside = past + (v > e(k + i)).cast("int"), inside | v.between(e(i), e(k + i))
    counted = each.select(*own, past.alias("__past"), F.when(inside, F.col("__v")).alias("__x")).groupBy(*own, "__past", "__x").agg(F.count(F.lit(1)).alias("__c"))
    counted = staged(counted, "counted")  # its size is known then, of which in_order() asks
    # what lies below a bracket comes before what lies in it
    placed = in_order(counted, [*[F.col(c).asc_nulls_first() for c in [*own, "__past", "__x"]]], F.col("__c"), running="__to").drop("rank")
    sizes = staged(placed.groupBy(*own).agg(F.min(F.col("__to") - F.col("__c")).alias("__base"), F.sum("__c").alias("__n")), "sizes").withColumnsRenamed({c: f"__s{i}" for i, c in enumerate(own)})
    placed = placed.join(sizes, [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(own)])
    at = lambda r: F.min(F.when(F.col("__to") - F.col("__base") > r, F.struct("__to", "__x")))["__x"]
    ranks = [end((F.col("__n") - 1) * F.lit(p)) for p in shares for end in (F.floor, F.ceil)]
    return placed.groupBy(*own, "__n").agg(*[at(r).alias(f"e{i}") for i, r in enumerate(ranks)])
