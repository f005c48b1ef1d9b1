"""Anomaly maps as one array row per tile (G ids).

A tile row carries ``h``, ``w`` and row-major ``heat`` (and ``dust``) arrays,
or the same as binary columns, a byte a value (0..255), which reach Python
whole and not value by value.  Per-tile measures are taken over stacks of tiles, one Arrow batch at a time, in
the task that read them: they need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def draw_test_maps(tiles: DataFrame, side: int = 16, packed: bool = False) -> DataFrame:
    """Two bumps of heat and a dust disc per tile, chosen by its part number, as arrays or ``packed`` in bytes."""
    y, x = np.mgrid[:side, :side]
    near = (x - 4) ** 2 + (y - 4) ** 2
    forms = [
        np.maximum(0, 60 - 4 * near) + np.maximum(0, 50 - 4 * ((x - 11) ** 2 + (y - 4 - shift) ** 2)) for shift in range(8)
    ]
    value = (lambda f: F.lit(f.astype(np.uint8).tobytes())) if packed else (lambda f: F.lit(f.ravel().tolist()))
    heat = F.array(*[value(f) for f in forms])
    disc, none = value((near <= 6).astype(int)), value(np.zeros((side, side), int))
    return tiles.withColumns(
        {
            "h": F.lit(side), "w": F.lit(side),
            "heat": F.element_at(heat, (F.col("part_no") % 8 + 1).cast("int")),
            "dust": F.when(F.col("part_no") % 3 != 0, disc).otherwise(none),
        }
    )


def pixels(maps: DataFrame, keys: list[str], value: str = "heat", only_positive: bool = True) -> DataFrame:
    """Sparse pixel rows (keys, px, py, v) of dense maps."""
    rows = maps.select(*keys, "w", F.posexplode(value).alias("_i", "v"))
    if only_positive:
        rows = rows.where("v > 0")
    return rows.select(
        *keys,
        (F.col("_i") % F.col("w")).alias("px"),
        F.expr("cast(_i div w AS int)").alias("py"),
        "v",
    )


def _rows(column: pa.Array) -> np.ndarray:
    """Values of a column; lists or bytes of equal length are rows of a matrix."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distinct_rows(parts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different rows of ``parts``, laid side by side, and for
    every row which of them it equals.  Rows are told apart by a sum of
    weighted words and then compared whole; if two different ones share a sum,
    every row stands for itself."""
    n = len(parts[0])
    words, sums = [], np.zeros(n, np.uint64)
    for p in parts:
        if p.dtype == object:
            return np.arange(n), np.arange(n)
        raw = np.ascontiguousarray(p).reshape(n, -1).view(np.uint8)
        if raw.shape[1] % 8:
            raw = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8)))
        words.append(raw.view(np.uint64))
        weights = np.random.default_rng(len(words)).integers(1, 1 << 63, words[-1].shape[1], dtype=np.uint64)
        sums += words[-1] @ (weights * np.uint64(2) + np.uint64(1))
    _, first, which = np.unique(sums, return_index=True, return_inverse=True)
    if all(np.array_equal(w, w[first][which]) for w in words):
        return first, which
    return np.arange(n), np.arange(n)


def found_in_stacks(
    maps: DataFrame, keys: Sequence[str], schema: str, find: Callable, arrays: Sequence[str] = ("heat", "dust"), extra: Sequence[str] = ()
) -> DataFrame:
    """Rows ``find`` gives for stacks of tiles of equal size, with the ``keys`` of their tiles.

    ``find(*arrays, extra)`` gets stacks (n, h, w) and returns the tile number
    of each row, rising, and the columns of ``schema``.  Equal tiles of an
    Arrow batch (of a million pixels of it, where it is larger) are measured once and their rows given to each of them.
    """
    held = [a for a in arrays if a in maps.columns]
    sent = maps.select(*dict.fromkeys([*keys, *extra, "h", "w"]), *[F.col(a).alias(f"_{a}") for a in held])
    key_types = ", ".join(f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows_of_stacks(batch, keys, schema, find, arrays, extra)

    return sent.mapInArrow(run, f"{key_types}, {schema}")


def rows_of_stacks(
    batch: pa.RecordBatch, keys: Sequence[str], schema: str, find: Callable, arrays: Sequence[str], extra: Sequence[str] = ()
) -> Iterator[pa.RecordBatch]:
    """``found_in_stacks`` of one Arrow batch, which has its arrays under their names with an underscore before."""
    names, types = zip(*[c.split() for c in schema.split(", ")])
    sizes = np.stack([batch.column("h").to_numpy(), batch.column("w").to_numpy()], axis=1)
    for h, w in np.unique(sizes, axis=0).tolist():
        mine = np.flatnonzero((sizes[:, 0] == h) & (sizes[:, 1] == w))
        step = max(1, 1_000_000 // max(h * w, 1))  # pixels of a round are held to a few MB
        for lo in range(0, len(mine), step):
            same = batch.take(pa.array(mine[lo : lo + step])) if len(mine) > step or len(mine) < len(batch) else batch
            stacks = [_rows(same.column(f"_{a}")) if f"_{a}" in same.schema.names else np.zeros((len(same), h * w), np.uint8) for a in arrays]
            given = {c: _rows(same.column(c)) for c in extra}
            first, which = distinct_rows([*stacks, *given.values()])
            tile, out = find(*[s[first].reshape(-1, h, w) for s in stacks], {c: v[first] for c, v in given.items()})
            if not len(tile):
                continue
            start = np.searchsorted(tile, np.arange(len(first) + 1))
            size = np.diff(start)[which]
            own = np.repeat(np.arange(len(which)), size)
            at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[which], size)
            whose = pa.array(own)
            columns = [same.column(k).take(whose) for k in keys]
            columns += [pa.array(np.asarray(out[c])[at]).cast(ARROW[t]) for c, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *names])


def per_stack(maps: DataFrame, keys: Sequence[str], schema: str, measure: Callable, extra: Sequence[str] = ()) -> DataFrame:
    """One row per tile: ``keys`` and the arrays ``measure(heat, dust, extra)``
    returns for a stack (n, h, w) of tiles of equal size."""

    def find(heat, dust, given):
        return np.arange(len(heat)), measure(heat.astype(float), dust > 0, given)

    return found_in_stacks(maps, keys, schema, find, extra=extra)


def top_cut(heat: np.ndarray, top_percent: float) -> np.ndarray:
    """Per tile: percentile of the positive values leaving the top share."""
    flat = np.sort(np.where(heat > 0, heat, np.inf).reshape(len(heat), -1), axis=1)
    n = np.isfinite(flat).sum(axis=1)
    at = np.maximum(n - 1, 0) * (1 - top_percent / 100.0)
    lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
    rows = np.arange(len(flat))
    low, high = flat[rows, lo], flat[rows, hi]
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, low + (high - low) * (at - lo), np.inf)


METRICS = "m_max double, m_top10 double, m_p99 double, m_mean double, hot_share double"


def metrics(heat: np.ndarray) -> dict[str, np.ndarray]:
    flat = heat.reshape(len(heat), -1)
    peak = flat.max(axis=1)
    k = min(10, flat.shape[1])
    top = np.partition(flat, flat.shape[1] - k, axis=1)[:, -k:].mean(axis=1) if flat.shape[1] >= 10 else peak
    positive = flat > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(positive, flat, 0).sum(axis=1) / positive.sum(axis=1)
    return {
        "m_max": peak, "m_top10": top, "m_p99": np.percentile(flat, 99, axis=1), "m_mean": mean,
        "hot_share": (flat * 2 >= peak[:, None]).mean(axis=1),
    }


def tile_metrics(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G09 inputs: peak, top-10 mean, 99th percentile, mean of the positive
    values, share of values at half the peak or more."""
    return per_stack(maps, keys, METRICS, lambda heat, dust, extra: metrics(heat))


SIDES = ("left", "right", "top", "bottom")


def _decay(heat: np.ndarray, sides: dict[str, np.ndarray], margin: int) -> np.ndarray:
    """Peak after over peak before the quadratic decay toward flagged sides."""
    n, h, w = heat.shape
    y, x = np.mgrid[:h, :w]
    depth = {"left": x, "right": w - 1 - x, "top": y, "bottom": h - 1 - y}
    out = heat.copy()
    for side in SIDES:
        share = np.where(depth[side] < margin, (depth[side] / max(margin - 1, 1)) ** 2, 1.0)
        out = np.where((sides[f"is_{side}"] == 1)[:, None, None], out * share, out)
    before, after = heat.reshape(n, -1).max(axis=1), out.reshape(n, -1).max(axis=1)
    flagged = sum(sides[f"is_{s}"] for s in SIDES) > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(~flagged, 1.0, np.where(before > 0, after / before, 0.0))


def tile_score(maps: DataFrame, largest: DataFrame | Callable, keys: list[str], cfg: dict | None = None) -> DataFrame:
    """Score after area, concentration, spread and side-decay stages.

    ``largest`` gives ``max_area`` per tile (largest component above half the
    metric), as a table or as a function of a stack, its dust and its metrics, which is
    measured in the same pass; ``maps`` carries is_left .. is_bottom.  Each stage has a switch.
    """
    c = {
        "metric": "m_max", "threshold": 30.0, "min_area": 10, "concentration": 2.0, "concentration_penalty": 0.5,
        "spread": 0.3, "spread_penalty": 0.5, "decay_margin": 3,
        "use_area": True, "use_concentration": True, "use_spread": True, "use_decay": True,
        **(cfg or {}),
    }
    margin = c["decay_margin"] if c["use_decay"] else 1
    area_of = largest if callable(largest) else None  # a table stays on the driver

    def measure(heat, dust, sides):
        out = {**metrics(heat), "f_decay": _decay(heat, sides, margin) if margin > 1 else np.ones(len(heat))}
        return {**out, "max_area": area_of(heat, dust, out[c["metric"]])} if area_of else out

    schema = METRICS + ", f_decay double" + (", max_area bigint" if area_of else "")
    m = per_stack(maps, keys, schema, measure, [f"is_{s}" for s in SIDES])
    if not area_of:
        m = m.join(largest.select(*keys, "max_area"), keys, "left")
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    area = conc = spread = F.lit(1.0)
    if c["use_area"]:
        small = F.coalesce("max_area", F.lit(0)) < c["min_area"]
        area = F.when((F.col(c["metric"]) >= c["threshold"]) & small, 0.5).otherwise(1.0)
    if c["use_concentration"] and c["concentration"] > 1:
        ratio = F.col("m_max") / F.col("m_mean")
        low = c["concentration_penalty"]
        conc = F.when(ratio < c["concentration"], low + (1 - low) * unit((ratio - 1) / (c["concentration"] - 1))).otherwise(1.0)
    if c["use_spread"] and c["spread"] < 1:
        over = unit((F.col("hot_share") - c["spread"]) / (1 - c["spread"]))
        spread = F.when((F.col("m_max") > 0) & (F.col("hot_share") > c["spread"]), 1 - (1 - c["spread_penalty"]) * over).otherwise(1.0)
    return m.withColumns({"f_area": area, "f_concentration": conc, "f_spread": spread}).withColumn(
        "final_score", F.col(c["metric"]) * F.col("f_area") * F.col("f_concentration") * F.col("f_spread") * F.col("f_decay")
    )


def overexposed(maps: DataFrame, keys: list[str], bright_mean: float = 200, bright: int = 230, share: float = 0.5) -> DataFrame:
    """Mean and bright share over all maps of a key (partial sums)."""

    def measure(heat, dust, extra):
        flat = heat.reshape(len(heat), -1)
        return {"s": flat.sum(axis=1), "n": np.full(len(flat), flat.shape[1]), "b": (flat > bright).sum(axis=1)}

    sums = per_stack(maps, keys, "s double, n bigint, b bigint", measure).groupBy(*keys).agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("b").alias("b")
    )
    mean, part = F.col("s") / F.col("n"), F.col("b") / F.col("n")
    return sums.select(
        *keys, mean.alias("mean_v"), part.alias("bright_share"), ((mean > bright_mean) & (part > share)).cast("int").alias("overexposed")
    )


def overexposed_crop(
    maps: DataFrame, keys: list[str], ground: int = 30, min_share: float = 0.2, mean: float = 200.0, bright: int = 200, bright_share: float = 0.65
) -> DataFrame:
    """Foreground share, mean and bright share of one crop."""

    def measure(heat, dust, extra):
        flat = heat.reshape(len(heat), -1)
        fg = flat > ground
        n = np.maximum(fg.sum(axis=1), 1)
        part, level = fg.mean(axis=1), np.where(fg, flat, 0).sum(axis=1) / n
        shine = (fg & (flat >= bright)).sum(axis=1) / n
        hit = (part >= min_share) & (level >= mean) & (shine >= bright_share) & fg.any(axis=1)
        return {"fg_share": part, "fg_mean": level, "fg_bright": shine, "overexposed": hit.astype(int)}

    return per_stack(maps, keys, "fg_share double, fg_mean double, fg_bright double, overexposed int", measure)


def heat_overlap(maps: DataFrame, keys: list[str], top_percent: float = 5.0) -> DataFrame:
    """Hot pixels against dust; coverage = inter / dust, IoU."""

    def measure(heat, dust, extra):
        hot = (heat > 0) & (heat >= top_cut(heat, top_percent)[:, None, None])
        count = lambda m: m.reshape(len(m), -1).sum(axis=1)
        return {"hot_px": count(hot), "dust_px": count(dust), "inter_px": count(hot & dust)}

    px = per_stack(maps, keys, "hot_px bigint, dust_px bigint, inter_px bigint", measure)
    union = F.col("hot_px") + F.col("dust_px") - F.col("inter_px")
    return px.withColumns(
        {
            "coverage": F.when(F.col("dust_px") > 0, F.col("inter_px") / F.col("dust_px")).otherwise(0.0),
            "iou": F.when(union > 0, F.col("inter_px") / union).otherwise(0.0),
        }
    )


def grey_histogram(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per grey value (0..255); a batch is counted before it leaves its
    task, so pixels are never shuffled."""

    def find(heat, given):
        n = len(heat)
        flat = heat.reshape(n, -1).astype(int)
        if flat.size and (flat.min() < 0 or flat.max() > 255):
            raise ValueError("grey values must lie in 0..255")
        counts = np.bincount((np.arange(n)[:, None] * 256 + flat).ravel(), minlength=n * 256).reshape(n, 256)
        tile, v = np.nonzero(counts)
        return tile, {"v": v, "cnt": counts[tile, v]}

    part = found_in_stacks(maps, keys, "v int, cnt bigint", find, ["heat"])
    return part.groupBy(*keys, "v").agg(F.sum("cnt").alias("cnt"))


def _best_cut(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Threshold and between-class variance of histograms (n, 256); of equal variances the least threshold."""
    v = np.flatnonzero(counts.any(axis=0))
    counts = counts[:, v]
    n0, s0 = counts.cumsum(axis=1), (counts * v).cumsum(axis=1)
    n, s = n0[:, -1:], s0[:, -1:]
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = s0 / n0 - (s - s0) / (n - n0)
        between = np.where(n > n0, n0.astype(float) * (n - n0) * spread * spread / (n.astype(float) * n), 0.0)
    between = np.where(counts > 0, np.round(between, 6), -1.0)
    best = between.argmax(axis=1)
    return v[best], between[np.arange(len(best)), best]


def otsu_of_sorted(maps: DataFrame, key: str) -> DataFrame:
    """G01 for maps that follow each other by ``key`` within their partition,
    each key in one of them: no shuffle and no rows per grey value.  One key's
    counts are held from batch to batch, so it may have any number of maps."""
    kind = maps.schema[key].dataType.simpleString()

    def rows(names: list, counts: np.ndarray) -> pa.RecordBatch:
        best, between = _best_cut(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, arrow_type[0]), pa.array(best.astype(np.int32)), pa.array(between)], names=[key, "threshold", "between"]
        )

    arrow_type: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_counts = [], np.zeros((0, 256), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            arrow_type[:] = [batch.column(key).type]
            names = batch.column(key).to_pylist()
            new = np.array([True, *[a != b for a, b in zip(names, names[1:])]])
            own, start = new.cumsum() - 1, np.flatnonzero(new)
            sizes = batch.column("h").to_numpy() * batch.column("w").to_numpy()
            counts = np.zeros((len(start), 256), np.int64)
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                heat = _rows(batch.column("heat") if len(mine) == len(batch) else batch.column("heat").take(pa.array(mine)))
                step = max(1, 1_000_000 // max(size, 1))  # pixels of a round are held to a few MB
                for lo in range(0, len(mine), step):
                    flat, whose = heat[lo : lo + step].astype(int), own[mine[lo : lo + step]]
                    if flat.size and (flat.min() < 0 or flat.max() > 255):
                        raise ValueError("grey values must lie in 0..255")
                    least = int(whose[0])
                    part = np.bincount(((whose - least)[:, None] * 256 + flat).ravel())
                    part = np.pad(part, (0, -len(part) % 256)).reshape(-1, 256)
                    counts[least : least + len(part)] += part
            firsts = [names[i] for i in start]
            if held and held[0] == firsts[0]:
                counts[0] += held_counts[0]
            elif held:
                yield rows(held, held_counts)
            if len(firsts) > 1:
                yield rows(firsts[:-1], counts[:-1])
            held, held_counts = firsts[-1:], counts[-1:]
        if held:
            yield rows(held, held_counts)

    return maps.select(key, "h", "w", "heat").mapInArrow(run, f"`{key}` {kind}, threshold int, between double")


def otsu(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Grey value with the greatest between-class variance.

    The window is over at most 256 grey values per key.
    """
    from pyspark.sql import Window as W

    h = grey_histogram(maps, keys)
    w = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    full = W.partitionBy(*keys)
    wv = F.col("v").cast("long") * F.col("cnt")
    c = h.select(
        *keys,
        "v",
        F.sum("cnt").over(w).alias("n0"),
        F.sum(wv).over(w).alias("s0"),
        F.sum("cnt").over(full).alias("n"),
        F.sum(wv).over(full).alias("s"),
    ).withColumn("n1", F.col("n") - F.col("n0"))
    spread = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / F.col("n1")
    between = F.when(
        F.col("n1") > 0,
        F.col("n0").cast("double") * F.col("n1") * spread * spread / (F.col("n").cast("double") * F.col("n")),
    ).otherwise(0.0)
    return (
        c.withColumn("between", F.round(between, 6))
        .groupBy(*keys)
        .agg(F.max(F.struct("between", (-F.col("v")).alias("neg"))).alias("b"))
        .select(*keys, (-F.col("b.neg")).alias("threshold"), F.col("b.between").alias("between"))
    )


def boundary_band(maps_pixels: DataFrame, mask_side: int, band: int) -> DataFrame:
    """Pixels whose square (Chebyshev) distance to the tile border is at
    most ``band``."""
    gap = F.least("px", "py", F.lit(mask_side - 1) - F.col("px"), F.lit(mask_side - 1) - F.col("py"))
    return maps_pixels.withColumn("in_band", (gap <= band).cast("int"))
