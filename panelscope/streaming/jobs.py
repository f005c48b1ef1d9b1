"""Request and event streams (T ids).

A job has a folder of its own: ``state`` is the checkpoint, so that a later run
goes on where the last one stopped; tables lie beside it.  A batch that runs
again after a failure replaces its own output.

Tables that batches merge into are kept in parts by a hash of the key (see
``streaming.parts``): a batch reads and writes the parts that its keys are in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.operators.maintain import merge_latest
from panelscope.operators.search import ai_err, ai_ng
from panelscope.session import scratch_path
from panelscope.sources.manifests import latest_panel_images
from panelscope.sources.requests import read_requests
from panelscope.sources.store import import_accuracy
from panelscope.streaming.parts import Parts, exists


class Done(NamedTuple):
    """What a run leaves: the job's folder and the rows that came too late."""

    folder: str
    late: int


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """File stream over the Parquet files of one name."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def stream_requests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Parsed requests of text files; bad lines keep their error."""
    return read_requests(spark.readStream.option("pathGlobFilter", pattern).text(folder))


def stream_counters(records: DataFrame) -> DataFrame:
    """Per machine totals and the latest verdict; state is one row per
    machine."""
    return records.groupBy("machine_no").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("ai_judgment") == "OK").alias("ok"), F.count_if(ai_ng()).alias("ng"),
        F.count_if(ai_err()).alias("err"), F.max(F.struct("request_time", "id", "ai_judgment")).alias("m"),
    ).select("machine_no", "total", "ok", "ng", "err", F.col("m.ai_judgment").alias("last_verdict"))


class Windowed(NamedTuple):
    """A stream of rows with their window: ``rows`` has the key columns, the counts of ``sums`` for one row,
    _time and _end (the row's and its window's end) and _row (the row as it came)."""

    rows: DataFrame
    sums: tuple[str, ...]
    delay: str


def windowed(records: DataFrame, keys: dict[str, Column], sums: dict[str, Column], end: Column, delay: str) -> Windowed:
    one = {k: c.cast("bigint") for k, c in sums.items()}
    row = F.struct(*[F.col(c) for c in records.columns])
    return Windowed(records.select(*[c.alias(k) for k, c in (keys | one).items()], F.col("request_time").alias("_time"), end.alias("_end"), row.alias("_row")), tuple(sums), delay)


def stream_shift(records: DataFrame, delay: str = "1 hour") -> Windowed:
    """12-hour shifts from 08:00 on event time."""
    w = F.window("request_time", "12 hours", "12 hours", "8 hours")
    return windowed(
        records.where("request_time IS NOT NULL"), {"shift_start": w.start.cast("timestamp_ntz")},
        {"total": F.lit(1), "ng": ai_ng(), "err": ai_err()}, w.end, delay,
    )


def stream_machines(records: DataFrame, delay: str = "1 hour") -> Windowed:
    """Machines seen per hour, one row each."""
    w = F.window("request_time", "1 hour")
    return windowed(records.where("request_time IS NOT NULL"), {"hour": w.start.cast("timestamp_ntz"), "machine_no": F.col("machine_no")}, {"n": F.lit(1)}, w.end, delay)


def run_available(stream: DataFrame, save: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> Done:
    """Processes what is there and stops.

    A batch is kept while it is saved, as a save may read it more than once.
    """

    def kept(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            save(batch, epoch)
        finally:
            batch.unpersist()

    q = stream.writeStream.outputMode(mode).foreachBatch(kept).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return Done(folder, 0)


def table_of(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` with its epoch column, or None before the first batch."""
    return spark.read.option("basePath", path).parquet(path) if exists(spark, path) else None


def job_folder(spark: SparkSession, name: str, folder: str | None) -> str:
    return folder or scratch_path(spark, name)


def run_append(stream: DataFrame, name: str, folder: str | None = None) -> Done:
    """Every batch adds its rows to ``rows``."""
    folder = job_folder(stream.sparkSession, name, folder)
    return run_available(stream, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}"), folder)


def run_state(stream: DataFrame | Windowed, name: str, keys: Sequence[str], folder: str | None = None) -> Done:
    """Update-mode rows replace those of their keys.  T03, T07: see ``run_windows``."""
    if isinstance(stream, Windowed):
        return run_windows(stream, name, keys, folder)
    folder = job_folder(stream.sparkSession, name, folder)

    def save(batch: DataFrame, epoch: int) -> None:
        Parts(batch.sparkSession, f"{folder}/rows", keys).merge(batch, epoch, lambda old, new: old.join(new.select(*keys), list(keys), "left_anti").unionByName(new))

    return run_available(stream, save, folder, "update")


def run_windows(stream: Windowed, name: str, keys: Sequence[str], folder: str | None = None) -> Done:
    """Counts per window and key, added up batch by batch.

    A row is late if its window ended at or before the watermark: the latest
    time of all earlier batches less the delay.  Late rows go to the table
    ``late`` as they came; none is lost.
    """
    folder, late = job_folder(stream.rows.sparkSession, name, folder), []

    def save(batch: DataFrame, epoch: int) -> None:
        parts = Parts(batch.sparkSession, f"{folder}/rows", keys)
        mark = parts.note(epoch)  # microseconds
        behind = F.lit(False) if mark is None else F.unix_micros("_end") <= F.lit(mark)
        top = F.unix_micros(F.max("_time") - F.expr(f"INTERVAL {stream.delay}"))
        count, top = batch.agg(F.count_if(behind), top).first()
        if count:
            batch.where(behind).select("_row.*").write.mode("overwrite").parquet(f"{folder}/late/epoch={epoch}")
        late.append(count)
        new = batch.where(~behind).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in stream.sums])
        marks = [m for m in (mark, top) if m is not None]
        parts.merge(new, epoch, lambda old, add: old.unionByName(add).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in stream.sums]), max(marks) if marks else None)

    run_available(stream.rows, save, folder)
    return Done(folder, sum(late))


def late_rows(spark: SparkSession, done: Done) -> DataFrame | None:
    """Rows that came too late, of all runs, with the epoch of their batch; None if there are none."""
    return table_of(spark, f"{done.folder}/late")


def latest_state(spark: SparkSession, done: Done) -> DataFrame:
    """The merged table of a job."""
    return Parts(spark, f"{done.folder}/rows", ()).table()


def run_import(stream: DataFrame, name: str, keys: Sequence[str] = ("request_time", "pnl_id"), order: str = "id", folder: str | None = None) -> Done:
    """The first row per key by ``order``, against all that was ever stored; nothing is too late.

    A batch reads the stored rows of the parts that its own keys are in.
    """
    folder = job_folder(stream.sparkSession, name, folder)

    def save(batch: DataFrame, epoch: int) -> None:
        Parts(batch.sparkSession, f"{folder}/rows", keys).add(batch, epoch, lambda old, new: import_accuracy(old, new, order, keys))

    return run_available(stream, save, folder)


def run_duplicates(listing: DataFrame, name: str, maximum: int = 20, folder: str | None = None) -> Done:
    """Files per panel directory; panels with more than ``maximum`` are marked and keep their newest per prefix.

    ``files`` keeps all that was listed, in parts by directory; ``rows`` has,
    per epoch, the result of each directory that the batch touched, over all
    its files, which lie in the parts of those directories.
    """
    folder = job_folder(listing.sparkSession, name, folder)

    def save(batch: DataFrame, epoch: int) -> None:
        files = Parts(batch.sparkSession, f"{folder}/files", ("dir",))
        files.add(batch, epoch, lambda old, new: new)
        touched = files.stored(batch, epoch + 1).join(batch.select("dir").distinct(), "dir", "left_semi")
        latest_panel_images(touched, maximum).write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    return run_available(listing, save, folder)


def latest_panels(spark: SparkSession, done: Done) -> DataFrame:
    """The last result of each directory."""
    rows = table_of(spark, f"{done.folder}/rows")
    last = rows.groupBy("dir").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["dir", "epoch"]).drop("epoch")


def run_upsert(changes: DataFrame, name: str, target: DataFrame, keys: Sequence[str], value: str, folder: str | None = None) -> Done:
    """Last change wins (change_no; deleted = 1 removes), one row of ``history`` per change with the value before it.

    ``target`` is the table before the first batch; its columns are ``keys``
    and ``value``.
    """
    folder = job_folder(changes.sparkSession, name, folder)

    def save(batch: DataFrame, epoch: int) -> None:
        parts = Parts(batch.sparkSession, f"{folder}/rows", keys)
        parts.start(target.select(*keys, value))
        stored = parts.stored(batch, epoch).select(*keys, F.col(value).alias("_stored"))
        order = W.partitionBy(*keys).orderBy("change_no")
        before = F.when(F.row_number().over(order) == 1, F.col("_stored")).otherwise(F.lag(F.when(F.col("deleted") == 0, F.col(value))).over(order))
        history = batch.join(stored, list(keys), "left").select(*keys, "change_no", before.alias("old_value"), F.when(F.col("deleted") == 0, F.col(value)).alias("new_value"))
        history.write.mode("overwrite").parquet(f"{folder}/history/epoch={epoch}")
        parts.merge(batch, epoch, lambda old, new: merge_latest(old, new, list(keys)))

    return run_available(changes, save, folder)
