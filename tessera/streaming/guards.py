"""Streams over append-only logs: appending, guards, deduplication and compaction."""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.streaming.state import carried  # noqa: F401


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class Limit(StreamingQueryListener):
    """A wall-clock limit on one query: after so many seconds since it began, at the end of a micro-batch, it asks for a stop."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.began, self.due, self.run = seconds, clock, clock(), False, ""

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.run:
            self.check()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def check(self) -> bool:
        self.due = self.due or self.clock() - self.began >= self.seconds
        return self.due


class _Stopped(Exception):
    """Raised in place of a micro-batch that begins after the limit: it isn't committed, so the next run begins with it."""


STOPPED = "stopped between micro-batches by its time limit"


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append", seconds: float | None = None, clock: Callable[[], float] = time.monotonic, rocksdb: bool = False) -> DataFrame:
    """Runs a stream over all that is there, or for at most so many seconds, and returns what it has emitted in this and earlier runs.

    Each micro-batch goes to its own Parquet folder under `checkpoint`-`name`, which a batch that is run again after a failure overwrites; nothing passes
    through the driver. In complete mode the last batch is the result, in the others all are.

    With a limit the batch that is running when the time is over is finished and committed, and no other begins; the first one always
    runs. Another call with the same name and checkpoint goes on with the next batch: no row is lost, none comes twice. rocksdb: for states
    that need that store.
    """
    spark, kind, path = df.sparkSession, df.schema, f"{checkpoint}-{name}"
    limit = None if seconds is None else Limit(seconds, clock)
    done: list[int] = []

    def batch(part: DataFrame, number: int) -> None:
        if limit and done and limit.check():
            raise _Stopped(STOPPED)
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.append(number)

    writer = df.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    if rocksdb:
        spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if limit:
        spark.streams.addListener(limit)
    q = None
    try:
        q = writer.start()
        if limit:
            limit.run = str(q.runId)
        q.awaitTermination()
    except StreamingQueryException as e:
        if not (limit and limit.due and STOPPED in str(e)):
            raise
    finally:
        if q:
            q.stop()
        if limit:
            spark.streams.removeListener(limit)
        if rocksdb:
            spark.conf.set(store, before) if before else spark.conf.unset(store)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return spark.createDataFrame([], kind)
    if mode != "complete":
        return spark.read.schema(kind).parquet(f"{path}/batch=*")
    last = max(int(f.getPath().getName().removeprefix("batch=")) for f in files.listStatus(at))
    return spark.read.schema(kind).parquet(f"{path}/batch={last}")


def chained(first: DataFrame, then: Callable[[DataFrame], DataFrame], checkpoint: str) -> DataFrame:
    """Two stages as producer and consumer: the first stream's rows land in files, and a second stream works on them in batches of files as they
    came. Either can be stopped and started again at its checkpoint."""
    drain(first, "rows", f"{checkpoint}/first")
    return drain(then(file_stream(first.sparkSession, f"{checkpoint}/first-rows/batch=*", first.schema)), "rows", f"{checkpoint}/second")


def append_log(df: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Appends events as JSON lines; with an interval at most once in it, else all that is there and then ends."""
    w = df.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def mirror(df: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, interval: str | None = None, tries: int = 3, pause_s: float = 1.0):
    """Hands each non-empty batch to write, at most once in an interval and up to `tries` times, with growing pauses, if it fails; an unchanged source hands over nothing."""

    def batch(part: DataFrame, _: int) -> None:
        if not part.limit(1).count():
            return
        for left in range(tries - 1, -1, -1):
            try:
                return write(part)
            except Exception:  # whatever the other side raises
                if not left:
                    raise
                time.sleep(pause_s * (tries - left))

    w = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def failure_guard(df: DataFrame, key: str, order: str, failed: str, patience: int) -> DataFrame:
    """One row a key when `patience` failures have come in a row: key, at (the order of the last) and run. A success resets the count.

    State is a counter and a flag a key. Within a micro-batch events are taken in their order; a key's events must arrive in order.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, open_ = state.get if state.exists else (0, False)
        out = []
        events = pd.concat(list(batches)).sort_values(order)
        for at, bad in zip(events[order].tolist(), events[failed].tolist(), strict=True):
            run = run + 1 if bad else 0
            if run >= patience and not open_:
                open_ = True
                out.append((k[0], at, run))
            elif not bad:
                open_ = False
        state.update((run, open_))
        yield pd.DataFrame(out, columns=[key, "at", "run"])

    return df.select(key, order, failed).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long, run long", "run long, open boolean", "append", GroupStateTimeout.NoTimeout)


def first_events(df: DataFrame, time: str, key: list[str], delay: str) -> DataFrame:
    """Replayed events once, as long as they come within delay; state older than that is dropped."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def latest_state(df: DataFrame, key: list[str], rank: str, values: list[str]) -> DataFrame:
    """What holds for each key: the values of the event of the highest rank so far, so that a later session's event supersedes one that it
    replays. For complete mode; state is one row a key."""
    best = F.max(F.struct(rank, *values)).alias("best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"best.{c}").alias(c) for c in [rank, *values]])


def event_counts(df: DataFrame, time: str, by: list[str], window: str, delay: str) -> DataFrame:
    return df.withWatermark(time, delay).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))


def last_segment(line: Column) -> Column:
    """What a progress line shows in the end: the part after its last carriage return."""
    return F.element_at(F.split(line, "\r"), -1)
