"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The classes that the operators' contracts name, as Java regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Python twin of ``ascii_lower`` for UTF-8 bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Nothing above this many bytes is broadcast by an operator of this package.
BROADCAST_LIMIT = 64 << 20

_own_shared: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the setting is absent, a local one, if the session is local."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_shared:
        _own_shared.append(tempfile.mkdtemp(prefix="lattica-"))
    return "file://" + _own_shared[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return the table read back.

    Lineage ends here, the files outlive any executor, and they are deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row: no later filter or projection is moved in front of them and repeats them."""
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return made.select(*kept, *(F.col("_once")[n].alias(n) for n in columns))


def words_of(text: Column) -> Column:
    """Array of the words ``WORD_CLASS`` of a text; empty for none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def text_blocks(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of a batch's rows with their texts, about ``limit`` bytes at a time: no more are Python objects at once."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for lo, hi in slices(sizes, sizes, limit):
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()


@functools.cache
def _freeze() -> None:
    """Once in a worker: leave the modules that it has imported out of collections, which take 70 ms otherwise."""
    gc.freeze()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives freed memory back at its end: workers outlive their tasks beside the executor's heap."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _freeze()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidy


def slices(values: list, sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about ``limit``; a larger item stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(values):
        yield start, len(values)
