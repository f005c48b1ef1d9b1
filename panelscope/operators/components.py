"""Connected components of tile maps and the rules built on them (G ids).

The kernel labels all tiles of an Arrow batch at once in the task that read
them: tiles are rows, so there is no shuffle before it and no group to hold.
Everything after it is joins and aggregates over small component rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.operators import pictures as P

STATS = (
    "comp int, area bigint, x0 int, y0 int, x1 int, y1 int, cx double, cy double, peak double, peak_x int, peak_y int, "
    "dust_px bigint, dust_peak double, peak_on_dust int, border_px bigint, outline_px bigint, hull_area double, "
    "rect_long double, rect_short double"
)


def label_stack(mask: np.ndarray) -> np.ndarray:
    """8-neighbour labels of a stack (n, h, w) of masks; a label is the least
    flat index of its component, ``mask.size`` marks the background."""
    none = mask.size
    lab = np.where(mask, np.arange(none).reshape(mask.shape), none)
    while True:
        wide = np.full((mask.shape[0], mask.shape[1] + 2, mask.shape[2] + 2), none)
        wide[:, 1:-1, 1:-1] = lab
        new = lab
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                new = np.minimum(new, wide[:, dy : dy + mask.shape[1], dx : dx + mask.shape[2]])
        new = np.where(mask, new, none)
        jump = np.append(new.ravel(), none)  # follow a label to its own label
        new = jump[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def hull_points(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Convex hull of pixel centres, counter-clockwise."""
    pts = sorted(set(zip(xs.tolist(), ys.tolist())))
    if len(pts) < 3:
        return np.array(pts, dtype=float)

    def half(seq):
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), dtype=float)


def hull_measures(xs: np.ndarray, ys: np.ndarray) -> tuple[float, float, float]:
    """Hull area and the sides of the least-area rectangle around it."""
    h = hull_points(xs, ys)
    if len(h) < 3:
        length = float(np.hypot(*(h[-1] - h[0]))) if len(h) else 0.0
        return 0.0, length, 0.0
    nxt = np.roll(h, -1, axis=0)
    area = abs(float((h[:, 0] * nxt[:, 1] - nxt[:, 0] * h[:, 1]).sum())) / 2
    edge = nxt - h
    unit = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    along = h @ unit.T
    across = h @ np.stack([-unit[:, 1], unit[:, 0]])
    w, t = np.ptp(along, axis=0), np.ptp(across, axis=0)
    best = int(np.argmin(w * t))
    return area, float(max(w[best], t[best])), float(min(w[best], t[best]))


def _measure(mask: np.ndarray, heat: np.ndarray, dust: np.ndarray, shapes: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Tile number and measures of every component in a stack."""
    n, h, w = mask.shape
    lab = label_stack(mask).ravel()
    at = np.flatnonzero(mask)
    at = at[np.argsort(lab[at], kind="stable")]
    roots, start = np.unique(lab[at], return_index=True)
    if not len(roots):
        return np.zeros(0, int), {}
    size = np.diff(np.append(start, len(at)))
    own = np.repeat(np.arange(len(roots)), size)
    y, x = (at % (h * w)) // w, at % w
    v, d = heat.ravel()[at].astype(float), dust.ravel()[at] > 0
    wide = np.zeros((n, h + 2, w + 2), bool)
    wide[:, 1:-1, 1:-1] = mask
    inner = wide[:, :-2, 1:-1] & wide[:, 2:, 1:-1] & wide[:, 1:-1, :-2] & wide[:, 1:-1, 2:]
    low, high, add = np.minimum.reduceat, np.maximum.reduceat, np.add.reduceat
    peak = high(v, start)
    first = low(np.where(v == peak[own], at, mask.size), start)
    tile = roots // (h * w)
    comp = np.arange(len(roots)) - np.searchsorted(tile, tile)
    out = {
        "comp": comp, "area": size, "x0": low(x, start), "y0": low(y, start), "x1": high(x, start), "y1": high(y, start),
        "cx": add(x, start) / size, "cy": add(y, start) / size, "peak": peak, "peak_x": first % w, "peak_y": (first % (h * w)) // w,
        "dust_px": add(d.astype(int), start), "dust_peak": high(np.where(d, v, -1.0), start),
        "peak_on_dust": (dust.ravel()[first] > 0).astype(int),
        "border_px": add(((x == 0) | (y == 0) | (x == w - 1) | (y == h - 1)).astype(int), start),
        "outline_px": add((~inner.ravel()[at]).astype(int), start),
    }
    measures = np.zeros((len(roots), 3))
    if shapes:
        for k, (a, b) in enumerate(zip(start, start + size)):
            measures[k] = hull_measures(x[a:b], y[a:b])
    out["hull_area"], out["rect_long"], out["rect_short"] = measures.T
    return tile, out


def components(
    maps: DataFrame, keys: Sequence[str], hot: Callable, shapes: bool = False, extra: Sequence[str] = ()
) -> DataFrame:
    """One row per component of ``hot(heat, dust, extra)``.

    ``hot`` maps stacks (n, h, w) to a mask; see ``half_peak``, ``top_share``
    and ``beyond``.  Components are numbered in raster order; ``dust_peak`` is
    -1 without dust.
    """

    def find(heat, dust, given):
        heat, mask = heat.astype(float), dust > 0
        return _measure(hot(heat, mask, given), heat, mask, shapes)

    return P.found_in_stacks(maps, keys, STATS, find, extra=extra)


def half_peak(heat, dust, extra):
    """Positive pixels above half of the tile's peak."""
    return (heat > 0) & (heat > heat.max(axis=(1, 2), keepdims=True) * 0.5)


def top_share(percent: float) -> Callable:
    """Hottest share of the positive pixels of each tile."""
    return lambda heat, dust, extra: (heat > 0) & (heat >= P.top_cut(heat, percent)[:, None, None])


def beyond(level: float) -> Callable:
    return lambda heat, dust, extra: heat > level


def dusty(heat, dust, extra):
    return dust


def half_of(metric: str) -> Callable:
    """Pixels above half of a tile's metric (see ``pictures.tile_metrics``)."""
    return lambda heat, dust, extra: (heat > 0) & (heat > P.metrics(heat)[metric][:, None, None] * 0.5)


def max_area(maps: DataFrame, keys: Sequence[str], metric: str = "m_max") -> DataFrame:
    """Largest component above half of the metric that scores the tile (for G09), measured where the tile lies."""

    def find(heat, dust, given):
        heat = heat.astype(float)
        area = largest_above_half(heat, dust, P.metrics(heat)[metric])
        tile = np.flatnonzero(area)
        return tile, {"max_area": area[tile]}

    return P.found_in_stacks(maps, keys, "max_area bigint", find)


def largest_above_half(heat: np.ndarray, dust: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Size of the largest component of each tile above half of its ``level``."""
    lab = label_stack((heat > 0) & (heat > level[:, None, None] * 0.5)).ravel()
    roots, size = np.unique(lab[lab < heat.size], return_counts=True)
    out = np.zeros(len(heat), np.int64)
    np.maximum.at(out, roots // (heat.shape[1] * heat.shape[2]), size)
    return out


def bright_spots(maps: DataFrame, keys: Sequence[str], diff: int = 10, absolute: int = 200, min_area: int = 5) -> DataFrame:
    """``maps`` with a ``background`` array; score 1 when a component of
    bright pixels is large enough."""

    def hot(heat, dust, extra):
        ground = np.concatenate(extra["background"]).reshape(heat.shape)
        return (heat - ground > diff) | (heat > absolute)

    spots = components(maps, keys, hot, extra=["background"]).where(F.col("area") >= min_area)
    found = spots.groupBy(*keys).agg(F.count(F.lit(1)).alias("spots"), F.sum("area").alias("spot_px"))
    return maps.select(*keys).join(found, list(keys), "left").select(
        *keys, F.when(F.col("spots") > 0, 1.0).otherwise(0.0).alias("score"),
        F.coalesce("spots", F.lit(0)).alias("spots"), F.coalesce("spot_px", F.lit(0)).alias("spot_px"),
    )


def dust_particles(maps: DataFrame, keys: Sequence[str], area_min: int = 4, area_max: int = 5000) -> DataFrame:
    """Particles and scratches of the 0/1 array ``dust`` per tile."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    aspect = F.greatest(w, h) / (F.least(w, h) + 1e-5)
    kept = components(maps, keys, dusty).where(F.col("area").between(area_min, area_max))
    return kept.groupBy(*keys).agg(
        F.count_if(aspect <= 5).alias("particles"), F.count_if(aspect > 5).alias("scratches"), F.sum("area").alias("dust_area")
    )


def dust_regions(
    maps: DataFrame, keys: Sequence[str], top_percent: float = 5.0, threshold: float = 0.01, metric: str = "coverage",
    high_cov: float = 0.5, peak_share: float = 0.8, seed: tuple[Column, Column, int, float] | None = None, mask_first: bool = False,
) -> DataFrame:
    """Verdict of every hot region against the dust mask.

    ``seed`` (y, x, radius, least share of the tile peak) adds a disc to the
    hot pixels; ``mask_first`` blanks dust before the cut.
    """
    extra: list[str] = []
    if seed is not None:
        sy, sx, radius, share = seed
        maps = maps.withColumns({"_sy": sy.cast("int"), "_sx": sx.cast("int")})
        extra = ["_sy", "_sx"]

    def hot(heat, dust, given):
        base = np.where(dust, 0, heat) if mask_first else heat
        on = (base > 0) & (base >= P.top_cut(base, top_percent)[:, None, None])
        if given:
            y, x = np.mgrid[: heat.shape[1], : heat.shape[2]]
            away = (y - given["_sy"][:, None, None]) ** 2 + (x - given["_sx"][:, None, None]) ** 2
            on |= (away <= radius * radius) & (heat >= heat.max(axis=(1, 2), keepdims=True) * share)
        return on

    regions = components(maps, keys, hot, extra=extra)
    if metric == "iou":
        regions = regions.join(P.heat_overlap(maps, list(keys)).select(*keys, F.col("dust_px").alias("tile_dust")), list(keys))
        coverage = F.col("dust_px") / (F.col("area") + F.col("tile_dust") - F.col("dust_px"))
    else:
        coverage = F.col("dust_px") / F.col("area")
    rescued = (F.col("dust_px") > 0) & (F.col("dust_peak") / F.col("peak") >= peak_share)
    on_dust = F.col("peak_on_dust") == 1
    return regions.withColumn("coverage", coverage).withColumn(
        "is_dust",
        ((F.col("coverage") >= threshold) & (on_dust | rescued | (F.col("coverage") >= high_cov))).cast("int"),
    )


def region_verdict(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G15 per tile: real when any region is not dust; peak of the hottest."""
    real = F.when(
        F.col("is_dust") == 0, F.struct("peak", (-F.col("comp")).alias("neg"), "peak_x", "peak_y")
    )
    g = regions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("regions"), F.count_if(F.col("is_dust") == 0).alias("real_regions"),
        F.max("coverage").alias("max_coverage"), F.max(real).alias("m"),
    )
    return g.select(
        *keys, "regions", "real_regions", "max_coverage",
        F.coalesce(F.col("m.peak_x"), F.lit(-1)).alias("real_x"), F.coalesce(F.col("m.peak_y"), F.lit(-1)).alias("real_y"),
    )


VERDICT = "regions bigint, real_regions bigint, max_coverage double, real_x int, real_y int"


def tile_verdict(
    maps: DataFrame, keys: Sequence[str], top_percent: float = 5.0, threshold: float = 0.01, high_cov: float = 0.5, peak_share: float = 0.8,
    mask_coverage: bool = False,
) -> DataFrame:
    """``region_verdict`` of ``dust_regions`` by coverage, judged where the
    tile lies, without rows per region; a tile without a region has no row.

    ``mask_coverage`` adds the dust share of all positive pixels (G18), and a
    row with no regions for the tiles without one.
    """

    def find(heat, dust, given):
        heat, dust = heat.astype(float), dust > 0
        n = len(heat)
        own, m = _measure(top_share(top_percent)(heat, dust, given), heat, dust, False)
        out = {"regions": np.bincount(own, minlength=n), "real_regions": np.zeros(n, int), "max_coverage": np.zeros(n), "real_x": np.full(n, -1), "real_y": np.full(n, -1)}
        if len(own):
            coverage = m["dust_px"] / m["area"]
            rescued = (m["dust_px"] > 0) & (m["dust_peak"] / m["peak"] >= peak_share)
            is_dust = (coverage >= threshold) & ((m["peak_on_dust"] == 1) | rescued | (coverage >= high_cov))
            np.maximum.at(out["max_coverage"], own, coverage)
            real = np.flatnonzero(~is_dust)
            real = real[np.lexsort((m["comp"][real], -m["peak"][real], own[real]))]
            tile, first = np.unique(own[real], return_index=True)
            out["real_regions"] = np.bincount(own[real], minlength=n)
            out["real_x"][tile], out["real_y"][tile] = m["peak_x"][real[first]], m["peak_y"][real[first]]
        if mask_coverage:
            flat = (heat > 0).reshape(n, -1)
            out["mask_coverage"] = (flat & dust.reshape(n, -1)).sum(axis=1) / np.maximum(flat.sum(axis=1), 1)
            return np.arange(n), out
        tile = np.flatnonzero(out["regions"])
        return tile, {c: v[tile] for c, v in out.items()}

    return P.found_in_stacks(maps, keys, VERDICT + (", mask_coverage double" if mask_coverage else ""), find)


def two_stage(
    maps: DataFrame, keys: Sequence[str], feature_hot: Callable, feature_dust: float = 0.3, zone_dust: float = 0.5, min_area: int = 3,
    top_percent: float = 5.0, pad: int = 20,
) -> DataFrame:
    """Features (components of the mask ``feature_hot``) are dust by
    their own dust share or by that of the hot zone they lie in.

    A feature lies in each zone whose box, widened by ``pad`` pixels, holds its
    centre; it is judged in each, and clean in one is clean.  Both are found and
    judged where the tile lies, without rows per zone or feature; a tile without
    a feature in a zone, or without its keys, has no row.
    """
    def find(heat, dust, given):
        heat, dust = heat.astype(float), dust > 0
        zone_of, zones = _measure(top_share(top_percent)(heat, dust, given), heat, dust, False)
        tile, f = _measure(feature_hot(heat, dust, given), heat, dust, False)
        if not len(tile) or not len(zone_of):
            return np.zeros(0, int), {}
        large = f["area"] >= min_area
        tile, f = tile[large], {c: v[large] for c, v in f.items()}
        # a feature meets all zones of its tile
        low, high = np.searchsorted(zone_of, tile), np.searchsorted(zone_of, tile, "right")
        own = np.repeat(np.arange(len(tile)), high - low)
        zone = np.arange(len(own)) - np.repeat(np.cumsum(high - low) - (high - low) - low, high - low)
        cx, cy = f["cx"][own], f["cy"][own]
        inside = (cx >= zones["x0"][zone] - pad) & (cx <= zones["x1"][zone] + pad) & (cy >= zones["y0"][zone] - pad) & (cy <= zones["y1"][zone] + pad)
        share = np.full(len(tile), np.inf)
        np.minimum.at(share, own[inside], (zones["dust_px"] / zones["area"])[zone[inside]])
        judged = np.isfinite(share)
        clean = judged & (f["dust_px"] / f["area"] < feature_dust) & (share < zone_dust)
        n = len(heat)
        out = {"features": np.bincount(tile[judged], minlength=n), "clean_features": np.bincount(tile[clean], minlength=n), "best_x": np.full(n, -1), "best_y": np.full(n, -1)}
        best = np.flatnonzero(clean)
        best = best[np.lexsort((f["comp"][best], -f["area"][best], tile[best]))]
        first_of, first = np.unique(tile[best], return_index=True)
        for c in "xy":
            out[f"best_{c}"][first_of] = np.floor(f[f"c{c}"][best[first]])
        met = np.flatnonzero(out["features"])
        return met, {c: v[met] for c, v in out.items()}

    named = maps.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return P.found_in_stacks(named, keys, "features bigint, clean_features bigint, best_x int, best_y int", find)


def dust_decision(tiles: DataFrame, regions: DataFrame, stages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overexposed or dust-free tiles are real; dust without a map is
    dust, a map without a positive pixel is real; else the regions decide and,
    if all are dust, the second stage.

    ``tiles``: panel_overexposed, tile_dust, has_map, has_positive.
    """
    r = regions.select(*keys, "regions", "real_regions", "real_x", "real_y")
    s = stages.select(*keys, "clean_features", "best_x", "best_y")
    joined = tiles.join(r, list(keys), "left").join(s, list(keys), "left")
    by_regions, by_features = F.coalesce(F.col("real_regions") > 0, F.lit(False)), F.coalesce(F.col("clean_features") > 0, F.lit(False))
    return joined.withColumn(
        "decision",
        F.when(F.col("panel_overexposed") == 1, "real:overexposed")
        .when(F.col("tile_dust") == 0, "real:no_dust")
        .when(~F.col("has_map"), "dust:no_map")
        .when(~F.col("has_positive"), "real:no_response")
        .when(by_regions, "real:region")
        .when(by_features, "real:feature")
        .otherwise("dust"),
    ).withColumns(
        {
            "real_x": F.when(by_regions, F.col("real_x")).when(by_features, F.col("best_x")).otherwise(-1),
            "real_y": F.when(by_regions, F.col("real_y")).when(by_features, F.col("best_y")).otherwise(-1),
        }
    )


def edge_dust(maps: DataFrame, keys: Sequence[str], top_percent: float, threshold: float = 0.01) -> DataFrame:
    """Patchcore findings follow their regions (real without one); cv
    findings take the dust coverage of their mask inside the map."""
    judged = tile_verdict(maps, [*keys, "source_inspector"], top_percent, mask_coverage=True)
    return judged.withColumn(
        "is_dust",
        F.when(F.col("source_inspector") == "patchcore", (F.col("regions") > 0) & (F.col("real_regions") == 0))
        .otherwise(F.col("mask_coverage") >= threshold).cast("int"),
    )


def edge_components(
    maps: DataFrame, keys: Sequence[str], threshold: int, min_area: int, min_diff: int = 0, min_solidity: float = 0.0
) -> DataFrame:
    """Components of the difference map that are large, contrasted and
    solid enough; centre and box."""
    c = components(maps, keys, beyond(threshold), shapes=min_solidity > 0)
    solidity = F.when(F.col("hull_area") > 0, F.col("area") / F.col("hull_area")).otherwise(1.0)
    return c.where((F.col("area") >= min_area) & (F.col("peak") >= min_diff) & (solidity >= min_solidity)).select(
        *keys, "comp", "area", F.col("peak").cast("int").alias("max_diff"),
        "x0", "y0", (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"),
        F.col("cx").cast("int").alias("center_x"), F.col("cy").cast("int").alias("center_y"), solidity.alias("solidity"),
    )


def _line_runs(mask: np.ndarray, min_len: int, max_w: int, reach: int = 5) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Runs of lines of a stack (n, lines, places) with enough hot places after
    1-D closing, which fills gaps shorter than ``reach``; a run bridges one line."""
    n, lines, side = mask.shape
    at = np.arange(side)
    before = np.maximum.accumulate(np.where(mask, at, -side - reach), axis=2)
    after = np.minimum.accumulate(np.where(mask, at, 2 * side + reach)[:, :, ::-1], axis=2)[:, :, ::-1]
    count = (mask | (after - before <= reach)).sum(axis=2)
    good = np.flatnonzero((count >= min_len) & mask.any(axis=2))
    tile, line = good // lines, good % lines
    new = np.ones(len(good), bool)
    new[1:] = (tile[1:] != tile[:-1]) | (line[1:] - line[:-1] > 2)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(good)) - 1
    tile, first, last = tile[start], line[start], line[end] if len(start) else line[:0]
    fits = last - first + 1 <= max_w
    tile, first, last = tile[fits], first[fits], last[fits]
    if not len(tile):
        return tile, {}
    # a bridged line belongs to the run as well: take extents by range
    size = last - first + 1
    begin = np.cumsum(size) - size
    row = np.repeat(tile * lines + first - begin, size) + np.arange(size.sum())
    flat = mask.reshape(n * lines, side)[row]
    lo, hi = np.where(flat, at, side).min(axis=1), np.where(flat, at, -1).max(axis=1)
    return tile, {
        "first": first, "last": last, "lo": np.minimum.reduceat(lo, begin), "hi": np.maximum.reduceat(hi, begin),
        "area": np.add.reduceat(flat.sum(axis=1), begin),
    }


def thin_lines(maps: DataFrame, keys: Sequence[str], hot: Callable, min_len: int, max_w: int, vertical: bool = True) -> DataFrame:
    """Runs of columns (rows) with enough active pixels, at most ``max_w``
    wide; extent from the closed mask, area from the given one."""

    def find(heat, dust, given):
        mask = hot(heat.astype(float), dust > 0, given)
        return _line_runs(mask.transpose(0, 2, 1) if vertical else mask, min_len, max_w)

    runs = P.found_in_stacks(maps, keys, "first int, last int, lo int, hi int, area bigint", find)
    return runs.select(*keys, F.lit("v" if vertical else "h").alias("way"), "first", "last", "lo", "hi", "area")


def line_shape(maps: DataFrame, keys: Sequence[str], top_percent: float = 10.0, min_aspect: float = 3.0) -> DataFrame:
    """Side ratio of the least rectangle round the largest hot component."""
    c = components(maps, keys, top_share(top_percent), shapes=True)
    contour = F.col("area") - F.col("outline_px") / 2 - 1  # lattice area of the outline
    big = c.groupBy(*keys).agg(F.max(F.struct("area", (-F.col("comp")).alias("neg"), contour.alias("contour"), "rect_long", "rect_short")).alias("b"))
    aspect = F.when((F.col("b.contour") >= 10) & (F.col("b.rect_short") > 0), F.col("b.rect_long") / F.col("b.rect_short")).otherwise(0.0)
    return big.select(*keys, aspect.alias("aspect"), (aspect >= min_aspect).alias("is_line"))


def _peak_rows(heat: np.ndarray, dust: np.ndarray, dist: int, least: float, window: int) -> dict[str, np.ndarray]:
    """Local maxima of a stack and their dust measures."""
    n, h, w = heat.shape
    wide = np.full((n, h + 2 * dist, w + 2 * dist), -np.inf)
    wide[:, dist : dist + h, dist : dist + w] = heat
    top = heat >= least
    for dy in range(2 * dist + 1):
        for dx in range(2 * dist + 1):
            other = wide[:, dy : dy + h, dx : dx + w]
            earlier = (dy, dx) < (dist, dist)  # of equal values the first one stays
            top &= (heat > other) if earlier else (heat >= other)
    at = np.flatnonzero(top)
    tile, y, x = at // (h * w), (at % (h * w)) // w, at % w
    half = window // 2
    sums = np.zeros((n, h + 1, w + 1))
    sums[:, 1:, 1:] = (dust > 0).cumsum(axis=1).cumsum(axis=2)
    y0, y1 = np.maximum(0, y - half), np.minimum(h, y + half + 1)
    x0, x1 = np.maximum(0, x - half), np.minimum(w, x + half + 1)
    local = sums[tile, y1, x1] - sums[tile, y0, x1] - sums[tile, y1, x0] + sums[tile, y0, x0]
    grown, grown_dust = np.zeros(len(at), int), np.zeros(len(at), int)
    step = max(1, 4_000_000 // (h * w))
    for lo in range(0, len(at), step):  # peaks per round are held to the memory of a few maps
        part = slice(lo, lo + step)
        own = heat[tile[part]]
        mask = own >= own[np.arange(len(own)), y[part], x[part]][:, None, None] * 0.5
        lab = label_stack(mask & (own > 0))
        mine = lab == lab[np.arange(len(own)), y[part], x[part]][:, None, None]
        grown[part] = mine.sum(axis=(1, 2))
        grown_dust[part] = (mine & (dust[tile[part]] > 0)).sum(axis=(1, 2))
    return {
        "_tile": tile, "px": x, "py": y, "v": heat.ravel()[at], "in_dust": (dust.ravel()[at] > 0).astype(int),
        "local_share": local / ((y1 - y0) * (x1 - x0)), "grown_area": grown, "grown_share": grown_dust / np.maximum(grown, 1),
    }


def peaks(maps: DataFrame, keys: Sequence[str], min_dist: int = 2, least: float = 1.0, window: int = 11) -> DataFrame:
    """Local maxima of the map with the dust share of the window round
    each and of the region grown from it down to half of its value."""

    def find(heat, dust, given):
        found = _peak_rows(heat.astype(float), dust, min_dist, least, window)
        return found["_tile"], found

    schema = "px int, py int, v double, in_dust int, local_share double, grown_area bigint, grown_share double"
    return P.found_in_stacks(maps, keys, schema, find)


def shape_features(maps: DataFrame, keys: Sequence[str], hot: Callable, min_area: int = 1) -> DataFrame:
    """Aspect, solidity, extent, outline and border touch per component."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    r = lambda c: F.round(c, 4)
    return components(maps, keys, hot, shapes=True).where(F.col("area") >= min_area).select(
        *keys, "comp", "area",
        r(F.greatest(w, h) / F.least(w, h)).alias("aspect"),
        r(F.when(F.col("hull_area") > 0, F.col("area") / F.col("hull_area")).otherwise(0.0)).alias("solidity"),
        r(F.col("area") / (w * h)).alias("extent"),
        r(F.col("outline_px") / F.sqrt(F.col("area").cast("double"))).alias("outline_ratio"),
        r(F.col("border_px") / F.col("outline_px")).alias("border_touch"),
        F.col("peak").alias("max_diff"),
    )


# ---- components across the blocks of one picture -----------------------------


FRAGMENT = "area bigint, x0 int, y0 int, x1 int, y1 int"


def _border_runs(lab: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Runs of neighbouring hot pixels along the four sides of each block of a
    stack (side 0 left, 1 right, 2 top, 3 bottom), with their component's number."""
    n, h, w = mask.shape
    roots = np.unique(lab[mask])
    number = np.arange(len(roots)) - np.searchsorted(roots // (h * w), roots // (h * w))
    parts = []
    for side, cut in enumerate((np.s_[:, :, 0], np.s_[:, :, -1], np.s_[:, 0], np.s_[:, -1])):
        on = mask[cut]
        edge = np.zeros((n, 1), np.int8)
        step = np.diff(np.concatenate([edge, on.astype(np.int8), edge], axis=1), axis=1)
        tile, first = np.nonzero(step == 1)
        last = np.nonzero(step == -1)[1] - 1
        own = number[np.searchsorted(roots, lab[cut][tile, first])]
        parts.append((tile, np.full(len(tile), side), first, last, own))
    tile, side, first, last, own = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(tile, kind="stable")
    return tile[order], {"side": side[order], "first": first[order], "last": last[order], "comp": own[order]}


def _joined(frags: dict[str, np.ndarray], runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Components of whole pictures from the fragments of their blocks and the runs along block borders.

    ``pic`` numbers the pictures; blocks whose place or picture is not known
    (``at`` is false) touch no other.  ``bx``, ``by``, ``comp`` name the least fragment.
    """
    # places by rank, one more for those not known: names of blocks and fragments are single numbers
    xs, ys = (np.unique(np.concatenate([t[c][t[f"{c[1]}at"]] for t in (frags, runs)])) for c in ("bx", "by"))
    rank = lambda known, v, at: np.where(at, np.searchsorted(known, v), len(known))
    name = lambda pic, x, y: (pic * (len(xs) + 1) + x) * (len(ys) + 1) + y
    most = int(frags["comp"].max()) + 1
    block_of = lambda t: name(t["pic"], rank(xs, t["bx"], t["xat"]), rank(ys, t["by"], t["yat"]))
    own = block_of(frags) * most + frags["comp"]
    names, first, which = np.unique(own, return_index=True, return_inverse=True)
    which = which.ravel()
    root = np.arange(len(names))
    node = np.searchsorted(names, block_of(runs) * most + runs["comp"])
    a, b = [], []
    facing = np.flatnonzero(runs["at"] & (runs["side"] % 2 == 0))
    key = block_of(runs)[facing] * 4 + runs["side"][facing]
    facing = facing[np.argsort(key, kind="stable")]
    key = np.sort(key)
    # a run on the right or lower side meets the facing side of the next block, and of the blocks beside that one at its corners
    for side, along, end in ((1, "by", "h"), (3, "bx", "w")):
        for to in (0, -1, 1):
            on = runs["at"] & (runs["side"] == side)
            on &= (runs["first"] == 0) if to < 0 else (runs["last"] == runs[end] - 1) if to > 0 else True
            asked = np.flatnonzero(on)
            place = {c: runs[c][asked] + (to if c == along else 1) for c in ("bx", "by")}
            there = np.ones(len(asked), bool)
            for c, known in (("bx", xs), ("by", ys)):
                there &= np.isin(place[c], known)
            asked = asked[there]
            wanted = name(runs["pic"][asked], np.searchsorted(xs, place["bx"][there]), np.searchsorted(ys, place["by"][there])) * 4 + side - 1
            low, high = np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right")
            mine = np.repeat(asked, high - low)
            other = facing[np.arange(len(mine)) - np.repeat(np.cumsum(high - low) - (high - low) - low, high - low)]
            shift = to * runs[end][mine]
            met = (runs["first"][mine] - shift <= runs["last"][other] + 1) & (runs["first"][other] <= runs["last"][mine] - shift + 1)
            a.append(node[mine[met]])
            b.append(node[other[met]])
    a, b = np.concatenate(a), np.concatenate(b)
    while True:  # min label over the pairs, then follow labels
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    group = root[which]
    order = np.argsort(group, kind="stable")
    roots, start = np.unique(group[order], return_index=True)
    least = first[roots]
    out = {c: frags[c][least] for c in ("pic", "bx", "by", "at", "xat", "yat", "comp")}
    out["area"] = np.add.reduceat(frags["area"][order], start)
    for c, pick in (("x0", np.minimum), ("y0", np.minimum), ("x1", np.maximum), ("y1", np.maximum)):
        out[c] = pick.reduceat(frags[c][order], start)
    return out


def _place(batch: pa.RecordBatch, c: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of block places, 0 where it is null, and where it is not."""
    column = batch.column(c)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def panel_components(blocks: DataFrame, picture: str, hot: Callable, dealt: Sequence[str] = ()) -> DataFrame:
    """Components of a picture cut into blocks (bx, by, h, w, heat).

    Blocks of a picture follow each other in one task: they are labelled there,
    and their fragments are merged by the runs of their border pixels when the
    picture ends, so neither fragments nor runs are shuffled, and of a picture
    no more is held.  Blocks that lie by ``picture`` already, or by columns ``dealt`` which a
    picture has one value of, are not moved at all.  Blocks are of one size;
    ``root`` names the component's first fragment.
    """
    order = W.partitionBy(*dealt, picture).orderBy("by", "bx")
    # numbers of a picture's blocks: 1 begins the next one
    sent = blocks.select(picture, "bx", "by", "h", "w", "heat", F.row_number().over(order).alias("_no"))
    kind = blocks.schema[picture].dataType.simpleString()
    schema = f"`{picture}` {kind}, root struct<bx:int,by:int,comp:int>, area bigint, x0 int, y0 int, x1 int, y1 int"

    def find(heat, given):
        heat = heat.astype(float)
        none = np.zeros(heat.shape, bool)
        return _measure(hot(heat, none, {}), heat, none, False)

    def find_runs(heat, given):
        mask = hot(heat.astype(float), np.zeros(heat.shape, bool), {})
        return _border_runs(label_stack(mask), mask)

    def rows(batch: pa.RecordBatch, names: str, kernel: Callable) -> dict[str, np.ndarray]:
        """What ``kernel`` finds in the blocks of ``batch``, ``_row`` being the number of their picture."""
        found = list(P.rows_of_stacks(batch, ["_row", "_known", "bx", "by", "h", "w"], names, kernel, ["heat"]))
        table = pa.Table.from_batches(found).combine_chunks().to_batches() if found else []
        fields = [c.split()[0] for c in names.split(", ")]
        if not table:
            return {c: np.zeros(0, np.int64) for c in ["pic", "bx", "by", "h", "w", *fields]} | {c: np.zeros(0, bool) for c in ("at", "xat", "yat")}
        t = table[0]
        out = {c: t.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ["h", "w", *fields]}
        out["pic"] = t.column("_row").to_numpy()
        (out["bx"], out["xat"]), (out["by"], out["yat"]) = _place(t, "bx"), _place(t, "by")
        return out | {"at": out["xat"] & out["yat"] & t.column("_known").to_numpy(zero_copy_only=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # fragments and runs of pictures 0 and on, and the pictures' values
        values: list[pa.Array] = []
        for batch in batches:
            if not len(batch):
                continue
            begins = np.flatnonzero(batch.column("_no").to_numpy() == 1)
            known = sum(map(len, values))
            pic = known - 1 + np.cumsum(batch.column("_no").to_numpy() == 1)
            columns = [pa.array(pic), batch.column(0).is_valid(), *[batch.column(c) for c in ("bx", "by", "h", "w", "heat")]]
            numbered = pa.RecordBatch.from_arrays(columns, names=["_row", "_known", "bx", "by", "h", "w", "_heat"])
            frags = rows(numbered, "comp int, " + FRAGMENT, find)
            for corner, place, size in (("x0", "bx", "w"), ("x1", "bx", "w"), ("y0", "by", "h"), ("y1", "by", "h")):
                frags[corner] = frags[corner] + frags[place] * frags[size]
            values.append(batch.column(0).take(pa.array(begins)))
            held.append((frags, rows(numbered, "side int, first int, last int, comp int", find_runs)))
            last = known + len(begins) - 1
            if last > 0:
                # all pictures but the last one are whole
                (frags, runs), picture_values = _side_by_side(held), pa.concat_arrays(values)
                yield from written({c: v[frags["pic"] < last] for c, v in frags.items()}, {c: v[runs["pic"] < last] for c, v in runs.items()}, picture_values)
                held = [tuple({c: v[t["pic"] == last] - (last if c == "pic" else 0) if c not in ("at", "xat", "yat") else v[t["pic"] == last] for c, v in t.items()} for t in (frags, runs))]
                values = [picture_values.slice(last)]
        if held:
            yield from written(*_side_by_side(held), pa.concat_arrays(values))

    def written(frags: dict, runs: dict, values: pa.Array) -> Iterator[pa.RecordBatch]:
        if not len(frags["pic"]):
            return
        out = _joined(frags, runs)
        ints = lambda c, at: pa.array(out[c].astype(np.int32), mask=~out[at])
        always = pa.array(out["comp"].astype(np.int32))
        root = pa.StructArray.from_arrays([ints("bx", "xat"), ints("by", "yat"), always], ["bx", "by", "comp"])
        columns = [values.take(pa.array(out["pic"])), root, pa.array(out["area"])] + [ints(c, f"{c[0]}at") for c in ("x0", "y0", "x1", "y1")]
        yield pa.RecordBatch.from_arrays(columns, names=[picture, "root", "area", "x0", "y0", "x1", "y1"])

    return sent.mapInArrow(run, schema)


def _side_by_side(held: list) -> tuple[dict, dict]:
    return tuple({c: np.concatenate([h[i][c] for h in held]) for c in held[0][i]} for i in (0, 1))


def foreground_box(found: DataFrame, picture: str, min_area: int, largest: bool = False) -> DataFrame:
    """Box over the components larger than ``min_area``, or of the
    largest one; far sides are exclusive."""
    if largest:
        rows = found.groupBy(picture).agg(F.max(F.struct("area", "x0", "y0", "x1", "y1")).alias("m")).select(picture, "m.*")
    else:
        rows = found.where(F.col("area") > min_area)
    return rows.groupBy(picture).agg(
        F.min("x0").alias("rx1"), F.min("y0").alias("ry1"), (F.max("x1") + 1).alias("rx2"), (F.max("y1") + 1).alias("ry2")
    )


SIDES = ("top", "bottom", "left", "right")
CORNERS = (("tl", "top", "left"), ("tr", "top", "right"), ("br", "bottom", "right"), ("bl", "bottom", "left"))
BOUNDS = ("x1", "y1", "x2", "y2", "img_w", "img_h")


def _extremes(row: np.ndarray, t: np.ndarray, v: np.ndarray, first: np.ndarray, last: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Picture, place, least and greatest value of every ``step``-th place from ``first`` to before ``last``."""
    away = t - first[row]
    on = np.flatnonzero((away >= 0) & (t < last[row]))
    slot, rest = np.divmod(away[on].astype(np.int32), np.int32(step))
    row, slot, v = row[on][rest == 0], slot[rest == 0], v[on][rest == 0]
    width = int(slot.max()) + 1 if len(slot) else 1
    names, code = np.arange(len(first) * width), row * width + slot
    if len(names) > 4 * len(code):
        names, code = np.unique(code, return_inverse=True)
    lo, hi = np.full(len(names), np.inf), np.full(len(names), -np.inf)
    np.minimum.at(lo, code, v)
    np.maximum.at(hi, code, v)
    met = hi >= lo
    row = names[met] // width
    return row, (first[row] + names[met] % width * step).astype(float), lo[met], hi[met]


def _fit(row: np.ndarray, t: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, slope and intercept of the least-squares line per picture; not a number where there is none."""
    add = lambda w: np.bincount(row, w, n)
    count, st, sv = np.bincount(row, minlength=n), add(t), add(v)
    det = count * add(t * t) - st * st
    a = np.where(det != 0, count * add(t * v) - st * sv, np.nan) / np.where(det != 0, det, 1.0)
    return count, a, (sv - a * st) / np.maximum(count, 1)


def _line(row: np.ndarray, t: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_fit``, repeated once without points beyond three sigma if three or more stay."""
    count, a, b = _fit(row, t, v, n)
    r = v - (a[row] * t + b[row])
    some = np.maximum(count, 1)
    r_mean = np.bincount(row, r, n) / some
    sigma = np.sqrt(np.bincount(row, (r - r_mean[row]) ** 2, n) / some)
    near = np.abs(r) < 3.0 * sigma[row]
    count2, a2, b2 = _fit(row[near], t[near], v[near], n)
    use = (count2 >= 3) & ~np.isnan(a2)
    return count, np.where(use, a2, a), np.where(use, b2, b)


def panel_polygon(
    pixels: DataFrame, bounds: DataFrame | None, key: str, tile: int = 512, step: int = 50, margin: int = 20, tol: int = 50,
    min_share: float = 0.9, min_samples: int = 5,
) -> DataFrame:
    """Corners from four line fits over sampled columns and rows.

    ``pixels``: key, x, y of the foreground; ``bounds``: key, x1, y1, x2, y2,
    img_w, img_h.  A fit is repeated once without points beyond three sigma.
    Without ``bounds`` there is one row per picture, which carries them, and x
    and y are arrays: such pictures are fitted where they lie, without a shuffle.
    """
    if bounds is not None:
        # of the pixels only both ends of the sampled columns and rows leave their task: a group is one picture's outline
        p = pixels.join(bounds, key)
        on_col = (F.col("x") >= F.col("x1") + margin) & (F.col("x") < F.col("x2") - margin) & ((F.col("x") - F.col("x1") - margin) % step == 0)
        on_row = (F.col("y") >= F.col("y1") + margin) & (F.col("y") < F.col("y2") - margin) & ((F.col("y") - F.col("y1") - margin) % step == 0)
        cols = p.where(on_col).groupBy(key, "x").agg(F.array(F.min("y"), F.max("y")).alias("y")).select(key, "x", F.explode("y").alias("y"))
        rows = p.where(on_row).groupBy(key, "y").agg(F.array(F.min("x"), F.max("x")).alias("x")).select(key, F.explode("x").alias("x"), "y")
        outline = cols.unionByName(rows).groupBy(key).agg(F.collect_list(F.struct("x", "y")).alias("p"))
        pixels = outline.select(key, F.col("p.x").alias("x"), F.col("p.y").alias("y")).join(bounds, key)
    names = [f"{n}_{c}" for n, _, _ in CORNERS for c in ("x", "y")]

    def polygons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            box = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in BOUNDS}
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "y"))
            row = np.repeat(np.arange(n), batch.column("x").value_lengths().to_numpy(zero_copy_only=False))
            fits = {}
            for (low, high), t, v, c in ((SIDES[:2], x, y, "x"), (SIDES[2:], y, x, "y")):
                own, at, lo, hi = _extremes(row, t, v, box[f"{c}1"] + margin, box[f"{c}2"] - margin, step)
                fits[low], fits[high] = _line(own, at, lo, n), _line(own, at, hi, n)
            counts = np.stack([fits[s][0] for s in SIDES])
            out = {}
            with np.errstate(invalid="ignore"):
                for name, h, v in CORNERS:
                    (_, ha, hb), (_, va, vb) = fits[h], fits[v]
                    den = 1.0 - ha * va
                    cy = np.where(np.abs(den) >= 1e-9, ha * vb + hb, np.nan) / np.where(np.abs(den) >= 1e-9, den, 1.0)
                    out[f"{name}_x"], out[f"{name}_y"] = va * cy + vb, cy
                X, Y = (np.stack([out[f"{name}_{c}"] for name, _, _ in CORNERS]) for c in ("x", "y"))
                X2, Y2 = np.roll(X, -1, axis=0), np.roll(Y, -1, axis=0)
                good = (
                    (counts.min(axis=0) >= max(min_samples, 1))
                    & (X.min(axis=0) >= -tol) & (X.max(axis=0) <= box["img_w"] + tol) & (Y.min(axis=0) >= -tol) & (Y.max(axis=0) <= box["img_h"] + tol)
                    & (np.hypot(X2 - X, Y2 - Y).min(axis=0) >= tile)
                    & (np.abs((X * Y2 - X2 * Y).sum(axis=0)) / 2 >= (box["x2"] - box["x1"]) * (box["y2"] - box["y1"]) * min_share)
                )
            met = pa.array(np.flatnonzero(counts.any(axis=0)))
            columns = [batch.column(key), *[pa.array(out[c], from_pandas=True) for c in names], pa.array(good)]
            yield pa.RecordBatch.from_arrays([c.take(met) for c in columns], names=[key, *names, "valid"])

    kind = pixels.schema[key].dataType.simpleString()
    sent = pixels.select(key, "x", "y", *BOUNDS)
    return sent.mapInArrow(polygons, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in names) + ", valid boolean")


def select_tiles(tiles: DataFrame, maps_share: DataFrame, rects: DataFrame, min_share: float, key: str = "id") -> DataFrame:
    """Tiles over no mark rectangle and with enough foreground, with the
    reason of each dropped tile."""
    from panelscope.operators.regions import drop_overlapping

    boxed = tiles.select(key, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("width").alias("bw"), F.col("height").alias("bh"))
    free = drop_overlapping(boxed, rects, key).select(key, F.lit(1).alias("_free"))
    return (
        tiles.join(free, key, "left").join(maps_share, key, "left")
        .withColumn(
            "reason",
            F.when(F.col("_free").isNull(), "overlap").when(F.coalesce("fg_share", F.lit(0.0)) < min_share, "background").otherwise("kept"),
        )
        .drop("_free")
    )


def fuse(
    findings: DataFrame, heat: DataFrame, keys: Sequence[str], band: int, side: int, threshold: float, min_area: int = 1
) -> DataFrame:
    """Border findings (components) and the interior of the heat map.

    Findings are kept when a pixel of theirs or their centre lies in the band
    along the border, and grouped to one box; the patch score is taken over
    interior pixels only, with the area of its largest component.
    """
    gap = F.least(F.col("x0"), F.col("y0"), F.lit(side - 1) - F.col("x1"), F.lit(side - 1) - F.col("y1"))
    cv = findings.where(gap <= band).groupBy(*keys).agg(
        F.sum("area").alias("cv_area"), F.max("max_diff").alias("cv_max_diff"), F.min("x0").alias("bx0"), F.min("y0").alias("by0"),
        F.max("x1").alias("bx1"), F.max("y1").alias("by1"),
    )

    def inside(heat):
        y, x = np.mgrid[: heat.shape[1], : heat.shape[2]]
        gap = np.minimum(np.minimum(x, heat.shape[2] - 1 - x), np.minimum(y, heat.shape[1] - 1 - y))
        return np.where(gap > band, heat, 0)

    pc = P.per_stack(heat, list(keys), "pc_score double", lambda v, dust, extra: {"pc_score": inside(v).max(axis=(1, 2))})
    areas = components(heat, keys, lambda v, dust, extra: half_peak(inside(v), dust, extra)).groupBy(*keys).agg(F.max("area").alias("pc_area"))
    pc = pc.join(areas, list(keys), "left")
    joined = pc.join(cv, list(keys), "left")
    pc_hit = (F.col("pc_score") >= threshold) & (F.coalesce("pc_area", F.lit(0)) >= min_area)
    return joined.withColumn(
        "verdict",
        F.when(pc_hit & F.col("cv_area").isNotNull(), "both").when(pc_hit, "patchcore").when(F.col("cv_area").isNotNull(), "cv").otherwise("ok"),
    )
