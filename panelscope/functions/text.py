"""Text, map and date column functions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label folder of each over-review category.
OVER_LABELS = {
    "edge_false_positive": "over_edge_false_positive",
    "within_spec": "over_within_spec",
    "overexposure": "over_overexposure",
    "surface_scratch": "over_surface_scratch",
    "surface_dirt": "over_surface_dirt",
    "bubble": "over_bubble",
    "aoi_ai_false_positive": "over_aoi_ai_false_positive",
    "dust_mask_incomplete": "over_dust_mask_incomplete",
    "other": "over_other",
}

# Product resolution by the sixth letter of the model id.
RESOLUTIONS = {
    "B": (1366, 768),
    "H": (1920, 1080),
    "J": (1920, 1200),
    "K": (2560, 1440),
    "G": (2560, 1600),
}
DEFAULT_RESOLUTION = (1920, 1080)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ric_judgment(datastr: Column | str) -> Column:
    """NG when any ``name,NG`` part is present."""
    parts = F.split(F.coalesce(_col(datastr), F.lit("")), ";")
    return F.when(
        F.exists(parts, lambda p: p.contains(",") & (F.upper(F.trim(F.substring_index(p, ",", -1))) == "NG")),
        "NG",
    ).otherwise("OK")


def ric_per_prefix(datastr: Column | str) -> Column:
    """map prefix -> verdict; the last of equal prefixes wins."""
    parts = F.filter(F.split(F.coalesce(_col(datastr), F.lit("")), ";"), lambda p: p.contains(","))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.trim(p.substr(F.lit(1), F.length(p) - F.length(F.substring_index(p, ",", -1)) - 1)).alias("k"),
            F.upper(F.trim(F.substring_index(p, ",", -1))).alias("v"),
        ),
    )
    last = F.filter(
        pairs,
        lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["k"] == e["k"]),
    )
    return F.map_from_entries(last)


def stem(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), r"(?<=.)\.[^.]*$", "")


def image_prefix(name: Column | str) -> Column:
    """stem without its last ``_`` part."""
    return F.regexp_replace(stem(name), r"_[^_]*$", "")


def sample_id(glass: Column | str, name: Column | str, kind: str, no: Column | str) -> Column:
    """glass_stem_tileN / edgeN / tridN."""
    if kind not in ("tile", "edge", "trid"):
        raise ValueError(f"unknown sample kind {kind}")
    return F.concat_ws("_", _col(glass), stem(name), F.concat(F.lit(kind), _col(no).cast("string")))


def sample_filename(glass, name, key, taken_at: Column | str) -> Column:
    """yyyymmdd_glass_stem_key.png; ``taken_at`` is text, T or blank."""
    day = F.replace(F.substring(_col(taken_at), 1, 10), F.lit("-"), F.lit(""))
    return F.concat(F.concat_ws("_", day, _col(glass), stem(name), _col(key)), F.lit(".png"))


def product_resolution(model: Column | str) -> Column:
    """struct(w, h)."""
    letter = F.upper(F.substring(_col(model), 6, 1))
    out = F.struct(F.lit(DEFAULT_RESOLUTION[0]).alias("w"), F.lit(DEFAULT_RESOLUTION[1]).alias("h"))
    for code, (w, h) in RESOLUTIONS.items():
        out = F.when(letter == code, F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"))).otherwise(out)
    return out


def grade(auroc: Column | str) -> Column:
    """F13."""
    a = _col(auroc)
    return (
        F.when(a.isNull(), "n/a")
        .when(a >= 0.95, "excellent")
        .when(a >= 0.85, "good")
        .when(a >= 0.70, "fair")
        .when(a >= 0.55, "poor")
        .otherwise("fail")
    )


def badge(verdict: Column | str) -> Column:
    v = _col(verdict)
    return F.when(v == "OK", "badge-ok").when(v.startswith("NG"), "badge-ng").otherwise("badge-err")


def machine_badge(verdict: Column | str) -> Column:
    v = _col(verdict)
    return F.when(v == "OK", "badge-ok").when(v == "HY", "badge-err").otherwise("badge-ng")


def decode_config(value: Column | str, tag: Column | str) -> Column:
    """struct(number, whole, mapping, raw) by type tag."""
    v, t = _col(value), _col(tag)
    return F.struct(
        F.when(t == "float", v.try_cast("double")).alias("number"),
        F.when(t == "int", v.try_cast("bigint")).alias("whole"),
        F.when(t.isin("dict", "json"), F.from_json(v, "map<string,string>")).alias("mapping"),
        v.alias("raw"),
    )


def check_date(text_value: str) -> str:
    """F15."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text_value or ""):
        raise ValueError(f"date must be YYYY-MM-DD: {text_value!r}")
    return text_value


def effective_config(defaults: DataFrame, params: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """F16: stored values replace defaults, but for the names in ``keep``."""
    stored = params.select("name", F.col("value").alias("stored")).where(~F.col("name").isin(list(keep)) if keep else F.lit(True))
    return defaults.join(stored, "name", "left").select(
        "name", F.coalesce("stored", "value").alias("value"), F.col("stored").isNotNull().alias("overridden")
    )


def sample_label(ric: Column | str, category: Column | str) -> Column:
    """Label, or NULL when the row is not collected."""
    label = F.lit(None).cast("string")
    for name, folder in OVER_LABELS.items():
        label = F.when(_col(category) == name, F.lit(folder)).otherwise(label)
    return F.when(_col(ric) == "NG", "true_ng").when(_col(ric) == "OK", label)


def sample_label_error(ric: Column | str, category: Column | str) -> Column:
    """Reason a row cannot be labelled, for the reject output."""
    known = F.coalesce(_col(category), F.lit("")).isin([""] + list(OVER_LABELS))
    return F.when(~_col(ric).isin("NG", "OK"), "unknown_ric").when((_col(ric) == "OK") & ~known, "unknown_category")


def skip_file(name: Column | str, side_shots: Sequence[str], skips: Sequence[str]) -> Column:
    """Stem equal to a listed prefix or continued by ``_``; a skip entry
    may also name the whole file."""
    s, n = stem(name), _col(name)
    hit = n.isin(list(skips)) if skips else F.lit(False)
    for p in [*side_shots, *skips]:
        hit = hit | (s == p) | s.startswith(p + "_")
    return hit


def map_path(path: Column | str, mapping: Mapping[str, str]) -> Column:
    """First mapping whose prefix matches, separators turned to ``/``."""
    p = F.replace(_col(path), F.lit("/"), F.lit("\\"))
    out = F.replace(p, F.lit("\\"), F.lit("/"))
    for source, target in reversed(list(mapping.items())):
        src = source.replace("/", "\\")
        rest = F.replace(p.substr(F.lit(len(src) + 1), F.length(p)), F.lit("\\"), F.lit("/"))
        out = F.when(F.lower(p).startswith(src.lower()), F.concat(F.lit(target.rstrip("/")), rest)).otherwise(out)
    return out
