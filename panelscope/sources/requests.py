"""Request lines, defect reports and logs as text frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name parts a report may end a defect with.
KNOWN_PREFIXES = ["G0F00000", "R0F00000", "W0F00000", "WGF50500", "WGF00000", "B0F00000", "STANDARD"]


def _whole(c: Column) -> Column:
    """Text of digits with an optional sign to a number, else NULL."""
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("int"))


def parse_bomb(raw: Column) -> Column:
    """struct(kind, coords) of ``(x/y;x/y)`` or ``(x1/y1/x2/y2)``.

    One bad group among several is left out; a bad single one gives NULL.
    """
    trimmed = F.trim(raw)
    inner = F.when(trimmed.rlike(r"^\(.*\)$"), trimmed.substr(F.lit(2), F.length(trimmed) - 2)).otherwise(trimmed)
    groups = F.filter(F.transform(F.split(inner, ";"), lambda g: F.trim(g)), lambda g: g != "")
    values = F.transform(groups, lambda g: F.transform(F.split(g, "/"), lambda v: _whole(v)))

    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    good = F.filter(values, lambda v: (F.size(v) == 2) & F.forall(v, lambda n: n.isNotNull()))
    points = F.transform(good, lambda v: point(F.get(v, 0), F.get(v, 1)))
    only = F.get(values, 0)
    is_line = (F.size(groups) == 1) & (F.size(only) == 4) & F.forall(only, lambda n: n.isNotNull())
    line = F.array(point(F.get(only, 0), F.get(only, 1)), point(F.get(only, 2), F.get(only, 3)))
    return F.when(is_line, F.struct(F.lit("line").alias("kind"), line.alias("coords"))).when(
        F.size(points) > 0, F.struct(F.lit("point").alias("kind"), points.alias("coords"))
    )


def read_requests(lines: DataFrame, text: str = "value") -> DataFrame:
    """One row per request; a bad line becomes a row with ``error``.

    Works on a batch or streaming frame; other columns are carried along.
    """
    rest = [c for c in lines.columns if c != text]
    clean = F.trim(F.regexp_replace(F.col(text), r"[\x00\r\n]", ""))
    parts = F.split(clean, "AOI@")
    glued = F.size(parts) > 2
    later = F.transform(F.filter(F.slice(parts, 2, F.size(parts)), lambda p: F.trim(p) != ""), lambda p: F.concat(F.lit("AOI@"), p))
    single = lines.select(*rest, F.explode(F.when(glued, later).otherwise(F.array(clean))).alias("line"))
    body = single.withColumn("line", F.trim("line")).withColumn("_p", F.split(F.expr("substring(line, 5)"), ";"))
    n = F.size("_p")
    at = lambda i: F.get("_p", F.lit(i))
    res = F.split(at(3), ",")
    w, h = _whole(F.get(res, 0)), _whole(F.get(res, 1))
    bombed = (n >= 8) & F.trim(at(6)).startswith("(") & F.trim(F.get("_p", n - 2)).endswith(")")
    coords = F.trim(F.array_join(F.slice("_p", 7, F.greatest(F.lit(0), n - 7)), ";"))
    error = (
        F.when(~F.col("line").startswith("AOI@"), "bad_prefix")
        .when(n < 6, "too_few_fields")
        .when(w.isNull() | h.isNull(), "bad_resolution")
    )
    good = F.col("error").isNull()
    return (
        body.withColumn("error", error)
        .select(
            *rest, "line", "error",
            F.when(good, at(0)).alias("glass_id"),
            F.when(good, at(1)).alias("model_id"),
            F.when(good, at(2)).alias("machine_no"),
            F.when(good, w).alias("res_w"),
            F.when(good, h).alias("res_h"),
            F.when(good, at(4)).alias("machine_judgment"),
            F.when(good & bombed, F.trim(at(5))).alias("bomb_prefix"),
            F.when(good & bombed, parse_bomb(coords)).alias("bomb"),
            F.when(
                good,
                F.when(bombed, F.trim(F.get("_p", n - 1))).otherwise(F.trim(F.array_join(F.slice("_p", 6, F.greatest(F.lit(0), n - 5)), ";"))),
            ).alias("image_dir"),
        )
    )


def report_dir(image_dir: Column, old: str = "yuantu", new: str = "Report") -> Column:
    """First ``old`` in the path replaced, NULL when absent."""
    at = F.instr(image_dir, old)
    return F.when(
        at > 0,
        F.concat(image_dir.substr(F.lit(1), at - 1), F.lit(new), image_dir.substr(at + len(old), F.length(image_dir))),
    )


def parse_aoi_reports(files: DataFrame, prefixes: Sequence[str] = KNOWN_PREFIXES) -> DataFrame:
    """Defects of the newest report per directory.  ``files``: dir, name,
    mtime, text; other columns of the file are not needed."""
    newest = files.groupBy("dir").agg(F.max(F.struct("mtime", "name", "text")).alias("m")).select("dir", F.col("m.name").alias("name"), F.col("m.text").alias("text"))
    line = F.regexp_replace(F.trim(F.get(F.split("text", r"\r?\n"), 1)), ",+$", "")
    ng = F.filter(F.transform(F.split(line, ";"), lambda f: F.trim(f)), lambda f: f.startswith("NG") & (F.length(f) > 2))
    names = "|".join(sorted(prefixes, key=lambda p: (-len(p), p)))
    pattern = rf"([A-Za-z0-9]+?)([0-9]{{10}})({names})"
    found = newest.withColumn("_t", F.when(line.startswith("@"), F.substring(F.get(ng, 0), 3, 1 << 30)))
    whole = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
    rows = found.select("dir", "name", F.posexplode(whole).alias("no", "hit"))
    part = lambda g: F.regexp_extract("hit", f"^{pattern}$", g)
    return rows.select(
        "dir", "name", "no", part(1).alias("code"), part(3).alias("prefix"),
        F.substring(part(2), 1, 5).cast("int").alias("product_x"), F.substring(part(2), 6, 5).cast("int").alias("product_y"),
    )


def read_text_files(spark: SparkSession, paths: list[str] | str, pattern: str = "*") -> DataFrame:
    """Whole text files with directory, name and modification time."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(paths, wholetext=True)
    path = F.col("_metadata.file_path")
    return raw.select(
        F.regexp_replace(path, r"/[^/]*$", "").alias("dir"), F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"),
    )


def read_aoi_reports(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return parse_aoi_reports(read_text_files(spark, paths, "*.{txt,TXT}"))


def parse_defects(files: DataFrame) -> DataFrame:
    """Records ``file,code,x,y`` of Defect.txt; bad numbers keep their
    row with ``bad`` set, so they can be sent to a reject output."""
    rest = [c for c in files.columns if c != "text"]
    rows = files.select(*rest, F.posexplode(F.split(F.trim("text"), ";")).alias("no", "record")).where("trim(record) <> ''")
    f = rows.withColumn("_f", F.split(F.trim("record"), ",")).where(F.size("_f") >= 4)
    x, y = _whole(F.get("_f", 2)), _whole(F.get("_f", 3))
    return f.select(
        *rest, "no", F.trim(F.get("_f", 0)).alias("file_name"), F.trim(F.get("_f", 1)).alias("code"), x.alias("x"), y.alias("y"),
        (x.isNull() | y.isNull()).alias("bad"),
    )


def read_defects(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return parse_defects(read_text_files(spark, paths, "Defect.txt"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with a number that grows along the file."""
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")
    )
