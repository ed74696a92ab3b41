"""The session that the engine is tuned for."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """UTC, ANSI, adaptive execution with skewed joins split. Shuffle partitions are left to the cluster unless given."""
    builder = SparkSession.builder.appName("tessera")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan):
    """A scan in at least as many partitions as there are cores, for heavy work on small files; a scan of many splits stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def parts_for(df, mb: int = 64) -> int:
    """Partitions for a shuffle of all of df: spark.sql.shuffle.partitions, or more if the optimiser's estimate of its bytes asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 62 else max(least, size // (mb << 20))  # without statistics the estimate is the largest long


def staged(df, label: str = "t"):
    """df written to the shared folder and read again: worked out once, and safe from lost executors."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_dir(spark, label: str) -> str:
    """A new folder's name under spark.checkpoint.dir, which the driver and all executors see. Where that is unset: in a folder of our own in a
    local session; on a cluster, whose executors could not see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base}/{label}-{uuid.uuid4().hex}"
