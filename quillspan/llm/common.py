"""What the operators of this subpackage share: keys, shared folders, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch in place of Spark's defaults: texts may be long, and a worker holds a few batches.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, as in tests on one machine, a temporary one is
    set; executors of other machines would not see that one, so there the setting
    is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspan-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before us
            return


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_holder: list = [None, None]


def claim(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """A Python worker serves tasks of many operators: it keeps one operator's dictionary, and gives the last one's memory back."""
    if _holder[0] != name:
        if _holder[1]:
            _holder[1]()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # where the C library can't, memory stays with the process
                ctypes.CDLL(None).malloc_trim(0)
        _holder[:] = [name, clear]


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes for the session's plans, which read these settings when they run; what its owner has set stays."""
    for key, (default, value) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


#: A table of fewer rows, of a few dozen bytes each, goes to all tasks.
SMALL_ROWS = 500_000


def if_small(df: DataFrame) -> DataFrame:
    """df, a written table of short keys, marked for a broadcast where its size allows it."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def text_of(column: str | Column = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(column: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def text_key(column: Column) -> Column:
    """128 bits of a text, to tell texts apart without carrying them."""
    return F.unhex(F.md5(column.cast("binary")))


def by_batch(fn: Callable[[dict[str, list]], dict[str, list] | Iterator[dict[str, list]]], schema: pa.Schema, rows: int = 1):
    """A function for mapInArrow from one that takes and gives columns as lists, of ``rows`` rows or more where there are."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows:
                yield pa.Table.from_batches(held)
                held = []
        if sum(x.num_rows for x in held):
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            out = fn({n: t.column(i).to_pylist() for i, n in enumerate(t.schema.names)})
            for x in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([pa.array(x[f.name], f.type) for f in schema], schema=schema)

    return run


def arrow_schema(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str, rows: int = 1) -> DataFrame:
    """mapInArrow with a function made once in each task; make() runs on the executor."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = pa.schema([pa.field(f.name, f.type) for f in arrow_schema(kind)])
    bounded_batches(df.sparkSession)

    def run(batches):
        yield from by_batch(make(), arrow, rows)(batches)

    return df.mapInArrow(run, kind)
