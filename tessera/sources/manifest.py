"""Manifests of files: a hash of each file by chunks, and one digest of all by a tree over their paths' order."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import in_order

#: Bytes of a chunk, and hashes that a node of the tree joins.
CHUNK, WIDTH = 1 << 24, 1024


def manifest(spark: SparkSession, path: str, pattern: str = "*", chunk: int = CHUNK) -> DataFrame:
    """path (below the folder), bytes, chunks and sha256 of each file below a folder.

    A file of one chunk has its own SHA-256, as any tool gives it; of a longer one it is the SHA-256 of its chunks' hashes in hex, one
    after the other, so that chunks can be hashed apart. The scan reads whole files, so none may be over 2 GB; it passes over
    empty ones.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    n = F.greatest(F.ceil(F.col("length") / chunk), F.lit(1)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.sha2(F.substring(F.col("content"), k * chunk + 1, F.lit(chunk)), 256))
    whole = F.when(n == 1, hashes[0]).otherwise(F.sha2(F.array_join(hashes, "").cast("binary"), 256))
    return files.select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), F.col("length").alias("bytes"), n.alias("chunks"), whole.alias("sha256"))


def tree_digest(files: DataFrame, width: int = WIDTH) -> str:
    """One SHA-256 of path and sha256 of all files: in the order of paths each run of `width` lines is hashed, then each run of `width` of
    those, until one is left. No task holds more than `width` lines, and the digest doesn't depend on how files are dealt to tasks."""
    lines = in_order(files.select("path", "sha256"), [F.col("path")]).select(F.col("rank"), F.concat_ws(" ", "sha256", "path").alias("line"))
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
        lines = lines.groupBy(F.floor((F.col("rank") - 1) / width).cast("long").alias("rank")).agg(F.sha2(joined.cast("binary"), 256).alias("line")).withColumn("rank", F.col("rank") + 1)
        top = lines.limit(2).collect()
        if len(top) < 2:
            return top[0].line if top else ""
