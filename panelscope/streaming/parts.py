"""Tables that batches of a stream merge into, in parts by a hash of the key.

``part=P/epoch=E`` holds the rows of part P as batch E left them.  The note of
a batch, ``epoch=E`` in the folder of notes beside it, has a row for every part: the epoch whose rows are
valid after that batch, -1 if the part is empty, and a number that the job
keeps.  A note is written last and has rows whatever the table holds, so a
batch that fails half-way leaves the note before it valid, and a table from
which all rows were deleted is empty, not an older one.

A batch reads and writes the parts of its own keys; notes have ``count`` rows.
The state before the last one is kept for a batch that runs again, older ones
are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a table; a part should fit a few tasks.
PARTS = 64
#: Epoch of the rows that were there before the first batch; of a part without rows.
START, EMPTY = -2, -1


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def put(spark: SparkSession, path: str, value: dict) -> None:
    """A small file of JSON, there as a whole or not at all."""
    p, fs = _path(spark, path)
    half, _ = _path(spark, f"{path}.half")
    out = fs.create(half, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(half, p)


def get(spark: SparkSession, path: str) -> dict | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs of the files and folders named ``epoch=N`` in ``path``."""
    p, fs = _path(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and not n.endswith(".half"))


class Parts:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], count: int = PARTS):
        self.spark, self.path, self.keys, self.count = spark, path, list(keys), count

    def _of(self, df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int"))

    def _note(self, epoch: int | None) -> tuple[dict[int, int], int | None]:
        """({part: valid epoch}, number) of the last note, before ``epoch`` if it is given."""
        known = [e for e in epochs(self.spark, f"{self.path}-notes") if epoch is None or e < epoch]
        if not known:
            return {}, None
        note = get(self.spark, f"{self.path}-notes/epoch={known[-1]}")
        return {p: e for p, e in enumerate(note["valid"])}, note["number"]

    def note(self, epoch: int) -> int | None:
        """The number noted by the batch before ``epoch``."""
        return self._note(epoch)[1]

    def _schema(self) -> StructType | None:
        found = get(self.spark, f"{self.path}-schema")
        return None if found is None else StructType.fromJson(found)

    def _load(self, paths: list[str]) -> DataFrame:
        schema = self._schema()
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _read(self, valid: dict[int, int]) -> DataFrame:
        return self._load([f"{self.path}/part={p}/epoch={e}" for p, e in sorted(valid.items()) if e != EMPTY])

    def _touched(self, batch: DataFrame) -> list[int]:
        return [r["part"] for r in self._of(batch).select("part").distinct().collect()]  # at most ``count``

    def _write(self, df: DataFrame, epoch: int) -> None:
        """Replaces the rows of this epoch, part by part."""
        if self._schema() is None:
            put(self.spark, f"{self.path}-schema", json.loads(df.schema.json()))
        rows = self._of(df).withColumn("epoch", F.lit(epoch))
        rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "epoch").parquet(self.path)

    def _finish(self, epoch: int, valid: dict[int, int], number: int | None) -> None:
        put(self.spark, f"{self.path}-notes/epoch={epoch}", {"valid": [valid.get(p, EMPTY) for p in range(self.count)], "number": number})
        for e in [e for e in epochs(self.spark, f"{self.path}-notes") if e < epoch][:-1]:
            remove(self.spark, f"{self.path}-notes/epoch={e}")

    def start(self, rows: DataFrame) -> None:
        """``rows`` as the table before the first batch."""
        if not epochs(self.spark, f"{self.path}-notes"):
            self._write(rows, START)
            self._finish(START, {p: START for p in range(self.count) if exists(self.spark, f"{self.path}/part={p}/epoch={START}")}, None)

    def stored(self, batch: DataFrame, epoch: int) -> DataFrame:
        """Rows valid before ``epoch`` in the parts that the keys of ``batch`` are in."""
        return self._kept(self._touched(batch), epoch)

    def _kept(self, touched: list[int], epoch: int) -> DataFrame:
        if exists(self.spark, f"{self.path}-notes"):
            valid = self._note(epoch)[0]
            return self._read({p: valid.get(p, EMPTY) for p in touched})
        return self._load([f"{self.path}/part={p}/epoch={e}" for p in touched for e in epochs(self.spark, f"{self.path}/part={p}") if e < epoch])

    def merge(self, batch: DataFrame, epoch: int, merged: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None) -> None:
        """The parts of ``batch``'s keys become ``merged(stored, batch)``; all others stay."""
        valid, _ = self._note(epoch)
        touched = self._touched(batch)
        old = self._read({p: valid.get(p, EMPTY) for p in touched}) if self._schema() is not None else batch.limit(0)
        for p in touched:
            remove(self.spark, f"{self.path}/part={p}/epoch={epoch}")  # of a run that failed
        if touched:
            self._write(merged(old, batch), epoch)
        after = valid | {p: epoch if exists(self.spark, f"{self.path}/part={p}/epoch={epoch}") else EMPTY for p in touched}
        self._finish(epoch, after, number)
        for p in touched:
            for e in epochs(self.spark, f"{self.path}/part={p}"):
                if e not in (after[p], valid.get(p)):
                    remove(self.spark, f"{self.path}/part={p}/epoch={e}")

    def add(self, batch: DataFrame, epoch: int, new: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``new(stored, batch)`` is added to the parts of ``batch``'s keys; all epochs of a part are valid."""
        touched = self._touched(batch)
        if not touched:
            return
        old = self._kept(touched, epoch) if self._schema() is not None else batch.limit(0)
        for p in touched:
            remove(self.spark, f"{self.path}/part={p}/epoch={epoch}")
        self._write(new(old, batch), epoch)

    def table(self) -> DataFrame:
        """The whole table: of the last note, or all that was added."""
        if exists(self.spark, f"{self.path}-notes"):
            return self._read(self._note(None)[0])
        return self._kept(list(range(self.count)), 1 << 62)
