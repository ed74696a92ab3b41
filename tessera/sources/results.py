"""Stored results of queries as a data source: a task for each file of the targets that are asked for, and no other file is opened.

Results lie as JSON lines in a folder a target (write_results()). Reading goes through pyarrow's file systems, so a path may have any scheme
that these know; a plain path is a folder that the driver and all executors share.
"""

import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.json
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema

#: Targets whose first file is looked at to infer a schema, and bytes of it; a field that is in no such piece needs a schema of the caller's.
INFER_TARGETS, INFER_BYTES = 16, 1 << 20
#: Bytes that are parsed at a time; no record is longer.
BLOCK_BYTES = 64 << 20
_NULL = "__HIVE_DEFAULT_PARTITION__"
RESULT = "target STRING, query STRING, ok BOOLEAN, keys ARRAY<STRING>, rows ARRAY<STRING>, error STRING, elapsed_s DOUBLE"


def _files(path: str) -> dict[str | None, list[str]]:
    """The files of each target, in order."""
    fs, root = pa.fs.FileSystem.from_uri(path)
    found: dict = {}
    for folder in sorted(fs.get_file_info(pa.fs.FileSelector(root)), key=lambda f: f.path):
        name = folder.path.rsplit("/", 1)[-1]
        if folder.type == pa.fs.FileType.Directory and name.startswith("target="):
            target = unquote(name.removeprefix("target="))
            own = [f.path for f in fs.get_file_info(pa.fs.FileSelector(folder.path)) if f.size and not f.path.rsplit("/", 1)[-1].startswith(("_", "."))]
            found[None if target == _NULL else target] = sorted(own)
    return found


def _wider(a: T.DataType | None, b: T.DataType) -> T.DataType:
    """The type that holds both: of numbers a double, of lists by their elements, else text."""
    if a is None or a == b or isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_wider(a.elementType, b.elementType))
    return T.DoubleType() if {type(a), type(b)} <= {T.LongType, T.DoubleType} else T.StringType()


class _Target(InputPartition):
    def __init__(self, target: str | None, file: str):
        self.target, self.file = target, file


class StoredResults(DataSource):
    """Option path: the folder. Columns: target, then the records' fields. Filters on target choose the files."""

    @classmethod
    def name(cls) -> str:
        return "stored_results"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_type

        fs, _ = pa.fs.FileSystem.from_uri(self.options["path"])
        kinds: dict[str, T.DataType | None] = {}
        for files in list(_files(self.options["path"]).values())[:INFER_TARGETS]:
            for file in files[:1]:
                with fs.open_input_stream(file) as f:
                    piece = f.read(INFER_BYTES)
                    while b"\n" not in piece and (more := f.read(INFER_BYTES)):
                        piece += more
                lines = piece[: piece.rindex(b"\n") + 1] if b"\n" in piece else piece
                for field in pa.json.read_json(pa.BufferReader(lines), pa.json.ReadOptions(block_size=max(len(lines), 1))).schema:
                    kinds[field.name] = _wider(kinds.get(field.name), T.NullType() if pa.types.is_null(field.type) else from_arrow_type(field.type))
        fields = [T.StructField(k, T.StringType() if t is None or isinstance(t, T.NullType) else t) for k, t in kinds.items()]
        return T.StructType([T.StructField("target", T.StringType()), *fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema
        self.wanted: set | None = None  # targets; None: all

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute == ("target",):
                values = set(f.value) if isinstance(f, In) else {f.value}
                values -= set() if isinstance(f, EqualNullSafe) else {None}
                self.wanted = values if self.wanted is None else self.wanted & values
            elif not (isinstance(f, IsNotNull) and f.attribute == ("target",) and self.wanted is not None and None not in self.wanted):
                yield f

    def partitions(self) -> list[_Target]:
        return [_Target(t, f) for t, files in _files(self.path).items() if self.wanted is None or t in self.wanted for f in files]

    def read(self, partition: _Target) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Target):  # no partition at all
            return
        kinds = to_arrow_schema(self.schema)
        inner = pa.schema([f for f in kinds if f.name != "target"])
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        size = min(BLOCK_BYTES, max(1, fs.get_file_info(partition.file).size))
        with fs.open_input_stream(partition.file) as f:
            for b in pa.json.open_json(f, pa.json.ReadOptions(block_size=size), pa.json.ParseOptions(explicit_schema=inner, unexpected_field_behavior="ignore")):
                target = pa.array([partition.target] * b.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([target if n == "target" else b.column(n) for n in kinds.names], schema=kinds)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_results(df: DataFrame, path: str) -> None:
    """Records as JSON lines, a folder a target. Null fields are left out."""
    df.write.mode("append").partitionBy("target").json(path)


def read_results(spark: SparkSession, path: str, schema: str | None = RESULT) -> DataFrame:
    """Stored results; of the targets that a filter asks for, if there is one. Without a schema it is inferred."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredResults)
    reader = spark.read.format("stored_results").option("path", path)
    return (reader.schema(schema) if schema else reader).load()
