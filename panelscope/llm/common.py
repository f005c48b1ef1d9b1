"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from panelscope.session import cut_lineage, forget  # noqa: F401

#: The C library's way to give memory back, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: A-Z to a-z; digits, letters and every byte of a non-ASCII character stay, all else becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: What goes to a Python worker at once: texts and shingle sets are long, and batches are held on both sides.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a bounded size from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lost executors cost no earlier work, later steps read it again."""
    small_batches(df.sparkSession)
    return cut_lineage(df, f"llm-{name}")


#: Rows that are worth a task of their own.
TASK_ROWS = 4096


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than its about ``rows`` rows are worth, two a core at least: nothing moves, shuffled partitions are read together."""
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, rows // TASK_ROWS + 1)
    return df.coalesce(tasks) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def discard(*tables: DataFrame) -> None:
    """Removes ``stored`` tables that nothing reads any more."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if folder.getName().startswith("llm-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(name: str) -> str:
    """Column name that no table can hold already."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 ``text``: runs of [0-9a-z] and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def rows_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def release() -> None:
    """Gives a worker's free memory back: workers stay for other stages, and the executor's memory is one."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` as they are; frees memory after the last of a task that had many bytes."""
    total = 0
    for batch in batches:
        total += batch.nbytes
        yield batch
    if total > BATCH_BYTES:
        release()


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of about ``most`` bytes of text, one row at least: bounds what a worker holds."""
    for batch in whole(batches):
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0)).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads the bits of ``x`` (uint64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
