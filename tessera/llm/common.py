"""What the operators share: the shared work folder, word splitting and hashing of Arrow text in numpy."""

import ctypes
import functools
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's, Python's and RE2's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that numpy works on at a time; a longer document is worked on alone.
SLICE_BYTES = 1 << 20


#: Bytes of an Arrow batch: texts are long, and a task holds several copies of a batch in its JVM and its Python worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lowers spark.sql.execution.arrow.maxBytesPerBatch to most, where it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name, str(most + 1))).removesuffix("b")) > most:
        spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, one of our own in a local session; on a
    cluster, whose executors could not see it, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing will read again. Others are left alone."""
    for t in tables:
        path = getattr(t, "_tessera_path", None)
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts_for(df: DataFrame, mb: int = 64) -> int:
    """Partitions for a shuffle of all of df: spark.sql.shuffle.partitions, or more if the optimiser's estimate of its bytes asks for it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 62 else max(least, size // (mb << 20))  # without statistics the estimate is the largest long


def ddl(df: DataFrame) -> str:
    """The columns of df for a function's output schema."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def with_columns(df: DataFrame, cols: dict) -> DataFrame:
    """Adds columns, in place of those of the same name."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {k.lower() for k in cols}], *[v.alias(k) for k, v in cols.items()])


class Shelter:
    """The table with its columns as c0, c1, ..., so that no name of an operator's own can clash with one of the input's; and back."""

    def __init__(self, df: DataFrame):
        bound_batches(df.sparkSession)
        self.names = df.columns
        self.df = df.toDF(*[f"c{k}" for k in range(len(self.names))])

    def __call__(self, name: str) -> str:
        """The name here of an input column: the one so spelled, or the first that differs in case alone."""
        low = [n.lower() for n in self.names]
        return f"c{self.names.index(name) if name in self.names else low.index(name.lower())}"

    def back(self, out: DataFrame, *added: str, without: str | None = None) -> DataFrame:
        """out under the input's names, and the added columns in place of those that are named so in any case. without: an input column that is left out."""
        new = {a.lower() for a in (*added, *([self.names[int(self(without)[1:])]] if without else []))}
        return out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(self.names) if n.lower() not in new], *added)


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def worker_cache() -> dict:
    """Lives as long as the Python worker, across tasks."""
    return sys.__dict__.setdefault("_tessera_cache", {})


def give_back() -> None:
    """What this worker has freed goes back to the system; Arrow's and C's allocators would keep it as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(make):
    """Of a maker of functions over batches: such a function calls give_back() at the end of each task, for workers live on through later stages."""

    @functools.wraps(make)
    def made(*args):
        run = make(*args)

        def out(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

        return out

    return made


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n. Those for a slice of text are kept; longer ones are not."""
    cache = worker_cache()
    if "powers" not in cache or n > SLICE_BYTES:
        with np.errstate(over="ignore"):
            made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SLICE_BYTES), np.uint64(b), np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        if n > SLICE_BYTES:
            return made
        cache["powers"] = made
    return cache["powers"]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each codes[start:end]: a polynomial modulo 2**64, mixed with the length. Spans ascend and don't overlap; they are
    worked on in runs of SLICE_BYTES codes (or one span), so that a long text needs no long tables."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        own, a, e = codes[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]
        up, down = _powers(len(own))
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], out=sums[1:])
        out[i:j] = mix((sums[e] - sums[a]) * down[a] + (e - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def text_buffers(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow string array: the bytes, each text's offsets (one more than texts), and which texts are null."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()) if not pa.types.is_large_string(arr.type) else arr
    null = np.asarray(arr.is_null())
    if null.any():
        arr = arr.fill_null("")
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64, len(arr) + 1, arr.offset * 8) if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs, null


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Runs [i, j) of whole texts of at most limit bytes, or one text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True):
    """Of texts data[offs[i]:offs[i+1]] that start at offs[0] = 0: the words' hashes and their texts' indices."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tok = ~_SPACE[data]
    before = np.empty_like(tok)
    before[0], before[1:] = False, tok[:-1]
    heads = offs[:-1][offs[:-1] < len(data)]
    before[heads] = False
    after = np.empty_like(tok)
    after[-1], after[:-1] = False, tok[1:]
    after[heads[heads > 0] - 1] = False
    starts, ends = np.flatnonzero(tok & ~before), np.flatnonzero(tok & ~after) + 1
    return span_hashes(_LOWER[data] if lower else data, starts, ends), np.searchsorted(offs, starts, side="right") - 1


def text_words(arr):
    """For each run of texts of an Arrow string array: its range [i, j), word hashes, and word's text index from 0."""
    data, offs, _ = text_buffers(arr)
    for i, j in slices(offs):
        own = offs[i : j + 1]
        h, doc = words(data[own[0] : own[-1]], own - own[0])
        yield i, j, h, doc
