"""Proportional stratified interleaving: documents into shards that all hold the same mixture of sources."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Shelter, materialise, table

#: Rows that one sorted bucket holds on average; it bounds what a task must sort together.
BUCKET_ROWS = 2048


def interleave(docs: DataFrame, shards: int = 16, seed: int = 11, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Within each source, rows are ranked in a seeded pseudo-random order; the fractional rank (rank - phase) / rows of the source,
    with a phase in [0, 1) hashed from the source, sorts all rows, and that order is cut into runs whose lengths differ by one at most.
    So each shard has, of every source, the source's share of rows but for one or two.

    No window spans a source or the table: both orders are cut into buckets of about BUCKET_ROWS rows by the value that they are sorted
    by, ranks are taken within a bucket, and the buckets' first ranks come from running sums over the small table of bucket counts.
    A source that holds a third of all rows is spread over as many buckets as it needs.

    Null sources are one source. A row's place is drawn by its id and its other columns, so null or repeated ids make no bucket large, but
    rows equal in all columns do lie in one. Rows equal in all columns get distinct slots. An empty table gives an empty result.
    Input columns named shard or slot, in any case, are replaced.
    """
    s = Shelter(docs)
    docs, id_col, source_col = s.df, s(id_col), s(source_col)
    src = F.col(source_col)
    rest = [F.col(c) for c, kind in docs.dtypes if c not in (id_col, source_col) and "map<" not in kind and "variant" not in kind]
    tie = F.xxhash64(*rest) if rest else F.lit(0).cast("long")
    # with the other columns, so that rows without an id, or of one id, are spread too
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), *([tie] if rest else [])), 11) * F.lit(2.0**-53)
    rows = docs.withColumns({"__u": unit, "__tie": tie})
    sizes = docs.groupBy(src.alias("__s")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", F.ceil(F.col("__n") / BUCKET_ROWS).cast("long"))
    rows = rows.join(sizes, src.eqNullSafe(F.col("__s")), "left").withColumn("__b", F.floor(F.col("__u") * F.col("__k")).cast("long")).drop("__s")
    counts = docs.select(src.alias("__s"), unit.alias("__u")).join(sizes.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left")
    counts = counts.groupBy("__s", F.floor(F.col("__u") * F.col("__k")).cast("long").alias("__c")).agg(F.count(F.lit(1)).alias("__m"))
    before = _running(counts, "__s").select("__s", F.col("__c"), "__before")
    own = F.row_number().over(Window.partitionBy(source_col, "__b").orderBy("__u", id_col, "__tie"))
    ranked = rows.withColumn("__r", own).join(before, src.eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__c")), "left").withColumn("__r", F.col("__r") + F.col("__before"))
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), src), 11) * F.lit(2.0**-53)
    ranked = materialise(ranked.withColumn("__f", (F.col("__r") - phase) / F.col("__n")).drop("__r", "__before", "__s", "__c", "__b", "__k", "__n"), "ranked")

    total = ranked.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    at = F.least(F.lit(buckets - 1), F.floor(F.col("__f") * buckets)).cast("long")
    ranked = ranked.withColumn("__b", at)
    before = ranked.groupBy(F.col("__b").alias("__c")).agg(F.count(F.lit(1)).alias("__m"))
    before = before.join(_running(before), "__c")
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__f", source_col, "__u", id_col, "__tie")) - 1
    out = ranked.withColumn("__p", place).join(before, F.col("__b") == F.col("__c"), "left").withColumn("__p", F.col("__p") + F.col("__before"))
    # shard i holds the places from ceil(i * total / shards) on
    shard = F.expr(f"__p * {shards} div {max(total, 1)}")
    first = F.expr(f"((__p * {shards} div {max(total, 1)}) * {total} + {shards - 1}) div {shards}")
    out = out.withColumns({"shard": shard.cast("int"), "slot": (F.col("__p") - first).cast("long")})
    return s.back(out, "shard", "slot")


def _running(counts: DataFrame, *by: str) -> DataFrame:
    """The sum of __m over smaller __c within by, for each __c. Two levels, so that no task holds more than the square root of the table."""
    wide = counts.withColumn("__g", F.expr("__c div 1024"))
    groups = wide.groupBy(*by, "__g").agg(F.sum("__m").alias("__gm"))
    groups = groups.withColumn("__gb", F.sum("__gm").over(Window.partitionBy(*by).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)))
    groups = groups.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__g").alias("__h"), F.coalesce("__gb", F.lit(0)).alias("__gb"))
    inner = wide.withColumn("__ib", F.sum("__m").over(Window.partitionBy(*by, "__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)))
    on = F.col("__g") == F.col("__h")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    return inner.join(groups, on).select(*by, "__c", (F.coalesce("__ib", F.lit(0)) + F.col("__gb")).alias("__before"))


def op1_sharding(spark, sf_dir):
    """All documents in 16 shards by the law `rows`; see interleave(). Strata are the sources, so equal texts may be in different shards."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    return interleave(d).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
