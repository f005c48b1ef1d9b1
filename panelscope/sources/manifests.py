"""Sample manifests, exports and file listings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.functions.text import ric_judgment
from panelscope.operators.search import search

# Manifest columns, in file order.
MANIFEST_FIELDS = [
    "sample_id", "collected_at", "label", "source_type", "prefix",
    "glass_id", "image_name",
    "inference_record_id", "image_result_id",
    "tile_idx", "edge_defect_id",
    "crop_path", "heatmap_path",
    "ai_score", "defect_x", "defect_y",
    "ric_judgment", "over_review_category", "over_review_note",
    "inference_timestamp", "status",
]

# Header of the search export.
SEARCH_HEADER = ["ID", "玻璃編號", "機種", "機台", "機檢判定", "AI判定", "耗時(s)", "建立時間", "圖片數", "NG圖片數"]

# Prefixes of lighting files, and encodings of report pages by preference.
LIGHTINGS = ["G0F00000", "R0F00000", "W0F00000", "WGF50500", "STANDARD"]
HTML_ENCODINGS = ("utf-8", "gb2312", "gbk", "big5", "latin-1")


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key by ``order``, as an aggregate combined map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = (F.max if last else F.min)(F.struct(*order, *rest)).alias("_m")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in [*order, *rest]])


def read_manifest(spark: SparkSession, paths: str | list[str], fields: Sequence[str] = MANIFEST_FIELDS) -> DataFrame:
    """All columns text, found by their names in the header; those that a
    file lacks are empty.  The last row of a sample id wins.  Of every row only ``fields`` are carried on.

    Each path is a file or a folder of files with one header.  Values may hold
    line ends, so a file is read by one task.  Files may start with a byte order mark.  No path gives an empty manifest.
    """
    fields = list(fields)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    read = list(dict.fromkeys(["sample_id", *fields]))
    rows = None
    for no, path in enumerate([paths] if isinstance(paths, str) and paths else paths or []):
        raw = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
        have = {c.lstrip("\ufeff").strip(): c for c in raw.columns}
        part = raw.select(
            *[(F.coalesce(F.col(f"`{have[n]}`"), F.lit("")) if n in have else F.lit("")).alias(n) for n in read],
            F.lit(no).alias("_path"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"),
        )
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], schema)
    return last_rows(rows.where("sample_id <> ''"), ["_path", "_file", "_line"]).select(fields)


def last_rows(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Last row per sample id."""
    return _first(rows, ["sample_id"], order, last=True)


def in_file_order(df: DataFrame) -> DataFrame:
    """Fixed columns, missing ones empty, range-sorted by sample id.  Rows
    that lie by ranges of it already (see ``by_sample``) are not moved again."""
    have = set(df.columns)
    cols = [
        F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) if n in have else F.lit("").alias(n) for n in MANIFEST_FIELDS
    ]
    if dict(df.dtypes).get("sample_id") == "string":
        # sorted as it is, as its ranges are known; nulls and the empty texts they become are first both ways
        return df.orderBy("sample_id").select(*cols)
    return df.select(*cols).orderBy("sample_id")


def write_manifest(df: DataFrame, path: str, compression: str = "none") -> None:
    """``in_file_order`` as files with one header each."""
    (
        in_file_order(df).write.mode("overwrite").option("compression", compression)
        .option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    )


def by_sample(rows: DataFrame) -> DataFrame:
    """Rows by ranges of the sample id, which serve the last row per id as well as the order of the files."""
    return rows.repartitionByRange("sample_id")


def merge_manifests(batches: dict[str, DataFrame], existing: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Union in name order; ``existing`` lists the crop files by path.

    Rows need a ``line_no`` column giving their place in the file.
    """
    names = [n for n in sorted(batches) if n not in set(exclude)]
    if not names:
        raise ValueError("no batches to merge")
    union = None
    for name in names:
        part = batches[name].withColumn("batch", F.lit(name))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return merge_rows(union, existing)


def merge_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """S09 on rows that carry their batch name."""
    if "status" in rows.columns:
        rows = rows.where(F.coalesce("status", F.lit("ok")) == "ok")
    seen = _first(rows, ["sample_id"], ["batch", "line_no"])

    def prefixed(c: str) -> Column:
        rel = F.replace(F.col(c), F.lit("\\"), F.lit("/"))
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat_ws("/", "batch", rel)).otherwise("")

    named = seen.withColumn("crop_path", prefixed("crop_path")).where("crop_path <> ''")
    if "heatmap_path" in named.columns:
        named = named.withColumn("heatmap_path", prefixed("heatmap_path"))
    # a listing may be as long as the manifest, and longer than its plan says: it must not be sent to the driver
    return named.join(existing.select(F.col("path").alias("crop_path")).hint("merge"), "crop_path", "left_semi")


def search_export(records: DataFrame, images: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """The ten columns of all hits, or of the newest ``limit``."""
    top = search(records, **filters)
    if limit is not None:
        top = top.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    ids = top.select(F.col("id").alias("record_id"))
    counts = images.join(ids, "record_id", "left_semi").groupBy(F.col("record_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_images"), F.sum("is_ng").alias("ng_images")
    )
    return top.join(counts, "id", "left").select(
        "id", "glass_id", "model_id", "machine_no", "machine_judgment", "ai_judgment", "processing_seconds", "created_at",
        F.coalesce("total_images", F.lit(0)).alias("total_images"), F.coalesce("ng_images", F.lit(0)).alias("ng_images"),
    )


def export_search(frame: DataFrame, path: str) -> None:
    """CSV with the reference header, marked as UTF-8."""
    named = frame.toDF(*SEARCH_HEADER).withColumnRenamed("ID", "﻿ID")
    named.write.mode("overwrite").option("header", "true").csv(path)


def export_scratch(scored: DataFrame, threshold: float) -> DataFrame:
    """Flip and judgment per classified sample."""
    flipped = F.col("score") > threshold
    positive = F.col("is_positive") == 1
    return scored.select(
        "sample_id", "label", "is_positive",
        F.format_string("%.6f", F.col("score").cast("double")).alias("score"),
        flipped.cast("int").alias("flipped"),
        F.when(positive & flipped, "TP").when(positive, "FN").when(flipped, "FP (leak)").otherwise("TN").alias("judgment"),
        "glass_id", "image_name", "crop_path",
    )


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def panel_prefix(name: Column) -> Column:
    """Stem without a six-digit time tail."""
    return F.regexp_replace(stem(name), r"_[0-9]{6}$", "")


def latest_panel_images(listing: DataFrame, maximum: int = 20) -> DataFrame:
    """Panels with more files than ``maximum`` keep the newest per prefix.

    ``listing``: dir, name, mtime.  Kept panels carry ``duplicated``.
    """
    keyed = listing.select("dir", "name", "mtime", panel_prefix(F.col("name")).alias("prefix"))
    counts = keyed.groupBy("dir").agg((F.count(F.lit(1)) > maximum).alias("duplicated"))
    newest = keyed.groupBy("dir", "prefix").agg(F.max(F.struct("mtime", "name")).alias("m"))
    many = newest.join(counts.where("duplicated"), "dir").select("dir", F.col("m.name").alias("name"), "duplicated")
    few = keyed.join(counts.where("NOT duplicated"), "dir").select("dir", "name", "duplicated")
    return many.unionByName(few)


def lighting_files(listing: DataFrame) -> DataFrame:
    """First file by name for each lighting of a directory."""
    hit = F.lit(None).cast("string")
    for p in reversed(LIGHTINGS):
        hit = F.when(F.col("name").startswith(p), F.lit(p)).otherwise(hit)
    return (
        listing.withColumn("lighting", hit).where("lighting IS NOT NULL").groupBy("dir", "lighting").agg(F.min("name").alias("name"))
    )


def list_jobs(listing: DataFrame) -> DataFrame:
    """Directories that hold manifest.csv, by name."""
    return listing.where("name = 'manifest.csv'").select("dir").distinct().orderBy("dir")


class _Table(HTMLParser):
    """Header cells and body rows of the tables in one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.headers: list[str] = []
        self.rows: list[list[str]] = []
        self._row: list[str] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("th", "td"):
            self._cell = []
        elif tag == "tr":
            self._row = []

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("th", "td") and self._cell is not None:
            text = "".join(self._cell).replace("\xa0", " ").strip()
            self._cell = None
            (self.headers if tag == "th" else self._row).append(text)
        elif tag == "tr" and self._row:
            self.rows.append(self._row)


def decode_page(content: bytes) -> str:
    for name in HTML_ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return ""


def html_rows(pages: DataFrame) -> DataFrame:
    """Rows of HTML exports as maps.  ``pages``: page_id, content BINARY;
    each page is parsed inside the task that read it."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, content in zip(batch["page_id"], batch["content"]):
                table = _Table()
                table.feed(decode_page(bytes(content)))
                for no, row in enumerate(table.rows):
                    if any(row):
                        padded = row + [""] * len(table.headers)
                        out.append((page_id, no, dict(zip(table.headers, padded))))
            yield pd.DataFrame(out, columns=["page_id", "row_no", "cells"])

    return pages.select("page_id", "content").mapInPandas(parse, "page_id bigint, row_no int, cells map<string,string>")


def import_ric(rows: DataFrame, filename: str) -> tuple[DataFrame, DataFrame]:
    """Re-inspection rows (map column ``cells``) and their batch row.

    Rows without a panel id are dropped; the verdict comes from the data text.
    """
    cell = lambda k: F.coalesce(F.try_element_at(F.col("cells"), F.lit(k)), F.lit(""))
    kept = rows.select(
        *[c for c in rows.columns if c != "cells"],
        F.trim(cell("PNL_ID")).alias("pnl_id"), F.trim(cell("MACH_ID")).alias("mach_id"),
        cell("DATASTR").alias("datastr"), cell("TIME_STAMP").alias("time_text"),
    ).where("pnl_id <> ''").withColumn("ric_judgment", ric_judgment("datastr"))
    batch = kept.agg(F.count(F.lit(1)).alias("total_records")).select(F.lit(filename).alias("filename"), "total_records")
    return kept, batch
