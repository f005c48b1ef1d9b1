"""The k nearest bank rows of every query within its unit, without comparing all pairs.

Bank rows of a unit fall into cells around pivots, each to its nearest one; a
cell knows how far its rows reach.  A query first meets the cells nearest to it
that hold k rows together, which bounds its k-th distance.  By the triangle
inequality a further cell can hold a nearer row only if the distance to its
pivot less its reach is within that bound: only those meet the query then.
The answer is exact, whatever the pivots.

Cells larger than a block are several blocks, dealt by a hash of the id, on both
sides; a unit or a cell with a third of all rows is spread.  Block pairs meet in
one matrix product; what can be among the k best is measured pair by pair, so
results do not depend on how rows are dealt.  Pivots of a unit: the square root
of its bank rows, ``pivots`` at most, by hash order of the id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.operators.coreset import packed
from panelscope.session import cut_lineage

UNIT = ("lighting", "zone")
#: What rounding may add to a bound.
SLACK = 1e-9
#: Where no unit's bank has more rows, each is one block that its queries meet at once.
SMALL = 4096


class Found(NamedTuple):
    """near: sample_id, bank_id, distance, rank.  met: one row, the pairs compared and all pairs of queries and bank rows of a unit."""

    near: DataFrame
    met: DataFrame


def placed(x: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Rows whose Euclidean distance orders like ``metric``: for cosine unit vectors, where a null vector is at distance 1 of all
    (a direction of its own, another one on each ``side``)."""
    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    own = np.zeros((len(x), 2))
    own[norm[:, 0] == 0, side] = 1
    return np.hstack([unit, own])


def euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def best(ids: np.ndarray, x: np.ndarray, bank_ids: np.ndarray, y: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """sample_id, bank_id, distance of the k nearest rows of ``y`` to each of ``x``, ties to smaller ids."""
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    rough, slack = squares - 2 * x @ y.T, squares * SLACK
    cut = np.partition(rough + slack, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
    row, col = np.nonzero(rough - slack <= cut[:, None])
    exact = np.empty(len(row))
    for lo in range(0, len(row), 1 << 16):  # rows that occur often tie with all of their copies
        a, b = x[row[lo : lo + (1 << 16)]], y[col[lo : lo + (1 << 16)]]
        exact[lo : lo + (1 << 16)] = 1 - (a * b).sum(axis=1) if metric == "cosine" else np.sqrt(((a - b) ** 2).sum(axis=1))
    order = np.lexsort((bank_ids[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return pd.DataFrame({"sample_id": ids[row[keep]], "bank_id": bank_ids[col[keep]], "distance": exact[keep]})


def dealt(rows: DataFrame, by: Sequence[str], size: int) -> tuple[DataFrame, DataFrame]:
    """(blocks: ``by``, ids, vs; counts: ``by``, n) of rows (``by``, sample_id, v), about ``size`` rows a block."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64(F.lit(7), "sample_id"), F.ceil(F.col("n") / size)).alias("_part")
    grouped = rows.join(counts, list(by)).select(*by, part, F.struct("sample_id", "v").alias("_r")).groupBy(*by, "_part").agg(F.collect_list("_r").alias("_r"))
    return grouped.select(*by, F.col("_r.sample_id").alias("ids"), F.col("_r.v").alias("vs")), counts


def nearest(
    queries: DataFrame, bank: DataFrame, keys: Sequence[str] = UNIT, k: int = 1, metric: str = "l2", size: int = 1024, pivots: int = 64
) -> DataFrame:
    """sample_id, bank_id, distance, rank of the k nearest bank rows of every query, rank 1 the nearest.

    Rows without a vector take no part; a query whose unit has no bank row has
    no result; all bank rows, if there are fewer than k.
    """
    return nearest_with_pairs(queries, bank, keys, k, metric, size, pivots).near


def nearest_with_pairs(
    queries: DataFrame, bank: DataFrame, keys: Sequence[str] = UNIT, k: int = 1, metric: str = "l2", size: int = 1024, pivots: int = 64
) -> Found:
    """As ``nearest``, with the number of pairs that met."""
    keys = list(keys) or ["unit_of_all"]
    if keys == ["unit_of_all"]:
        queries, bank = queries.withColumn("unit_of_all", F.lit(0)), bank.withColumn("unit_of_all", F.lit(0))
    types = {x: queries.schema[x].dataType.simpleString() for x in keys}
    key_types = "".join(f"`{x}` {t}, " for x, t in types.items())

    def heads(row, many: int) -> dict:
        return {x: [getattr(row, x)] * many for x in keys}

    order = F.row_number().over(W.partitionBy("sample_id").orderBy("distance", "bank_id"))

    def ranked(near: DataFrame) -> DataFrame:
        return near.withColumn("rank", order).where(F.col("rank") <= k)

    totals = bank.where("vector IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bank"))
    if (totals.agg(F.max("n_bank")).first()[0] or 0) <= SMALL:

        def compare_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    x = placed(np.frombuffer(row.data).reshape(-1, row.dim), metric, 1)
                    yield best(np.asarray(row.ids), x, np.asarray(row.b_ids), placed(np.stack(row.b_vs), metric, 0), k, metric)

        whole = bank.where("vector IS NOT NULL").groupBy(*keys).agg(F.collect_list(F.struct("sample_id", F.col("vector").cast("array<double>").alias("v"))).alias("_b"))
        pairs = packed(queries, keys, "sample_id", size).join(whole.select(*keys, F.col("_b.sample_id").alias("b_ids"), F.col("_b.v").alias("b_vs")), keys)
        every = queries.where("vector IS NOT NULL").join(totals, keys).agg(F.coalesce(F.sum("n_bank"), F.lit(0)).alias("pairs_met"))
        near = pairs.select("ids", "dim", "data", "b_ids", "b_vs").mapInPandas(compare_all, "sample_id bigint, bank_id bigint, distance double")
        return Found(ranked(near), every.select("pairs_met", F.col("pairs_met").alias("pairs_of_units")))

    # pivots: a bounded sample of each unit
    by_hash = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("sample_id"), "sample_id"))
    drawn = bank.where("vector IS NOT NULL").select(*keys, "sample_id", F.col("vector").cast("array<double>").alias("v")).withColumn("_no", by_hash).where(F.col("_no") <= pivots)
    lists = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_no", "v"))).alias("_p"))
    centres = cut_lineage(lists.join(totals, keys).select(*keys, "n_bank", F.slice("_p.v", 1, F.ceil(F.sqrt("n_bank")).cast("int")).alias("pivots")), "pivots")

    def file_bank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = placed(np.frombuffer(row.data).reshape(-1, row.dim), metric, 0)
                away = euclid(x, placed(np.stack(row.pivots), metric, 0))
                cell = away.argmin(axis=1)
                yield pd.DataFrame({**heads(row, len(x)), "cell": cell, "sample_id": row.ids, "v": [v.tobytes() for v in x], "away": away[np.arange(len(x)), cell]})

    rows = packed(bank, keys, "sample_id", size).join(centres, keys).mapInPandas(file_bank, f"{key_types}cell int, sample_id bigint, v binary, away double")
    rows = cut_lineage(rows, "bank-cells")
    blocks, _ = dealt(rows, [*keys, "cell"], size)
    blocks = cut_lineage(blocks.withColumnsRenamed({"ids": "b_ids", "vs": "b_vs"}), "bank-blocks")
    cells = rows.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("reach"))
    stats = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "n", "reach"))).alias("cells"))

    def file_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = placed(np.frombuffer(row.data).reshape(-1, row.dim), metric, 1)
                no, n, reach = (np.array([c[f] for c in row.cells]) for f in ("cell", "n", "reach"))
                away = euclid(x, placed(np.stack(row.pivots), metric, 0)[no])
                near = np.argsort(away, axis=1, kind="stable")
                # the nearest cells, up to that which completes k rows
                before = np.cumsum(n[near], axis=1) - n[near]
                first = [no[c[b < k]] for c, b in zip(near, before)]
                least = np.maximum(away - reach[None], 0)
                yield pd.DataFrame({**heads(row, len(x)), "sample_id": row.ids, "v": [v.tobytes() for v in x], "first": first, "no": [no] * len(x), "least": list(least)})

    asked = packed(queries, keys, "sample_id", size).join(centres, keys).join(stats, keys)
    asked = cut_lineage(asked.mapInPandas(file_queries, f"{key_types}sample_id bigint, v binary, first array<int>, no array<int>, least array<double>"), "queries")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, y = (np.frombuffer(b"".join(vs)).reshape(len(ids), -1) for vs, ids in ((row.vs, row.ids), (row.b_vs, row.b_ids)))
                yield best(np.asarray(row.ids), x, np.asarray(row.b_ids), y, k, metric)

    def meet(wanted: Column) -> tuple[DataFrame, DataFrame]:
        """Queries with the cells ``wanted``: their k best there, and how many they are per cell."""
        ask, counts = dealt(asked.select(*keys, "sample_id", "v", F.explode(wanted).alias("cell")), [*keys, "cell"], size)
        pairs = ask.join(blocks, [*keys, "cell"]).select("ids", "vs", "b_ids", "b_vs")
        return ranked(pairs.mapInPandas(compare, "sample_id bigint, bank_id bigint, distance double")).drop("rank"), counts

    near, met_first = meet(F.col("first"))
    near = cut_lineage(near, "near")
    bound = F.max("distance") if metric != "cosine" else F.sqrt(2 * F.greatest(F.max("distance"), F.lit(0.0)))
    bounds = near.groupBy("sample_id").agg(F.when(F.count(F.lit(1)) >= k, bound).otherwise(F.lit(float("inf"))).alias("bound"))
    asked = asked.join(bounds, "sample_id")
    can = F.filter(F.arrays_zip("no", "least"), lambda c: (c["least"] * (1 - SLACK) - SLACK <= F.col("bound")) & ~F.array_contains("first", c["no"]))
    more, met_more = meet(F.transform(can, lambda c: c["no"]))
    met = met_first.unionByName(met_more).withColumnRenamed("n", "asked").join(cells, [*keys, "cell"]).agg(F.coalesce(F.sum(F.col("asked") * F.col("n")), F.lit(0)).alias("pairs_met"))
    every = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked")).join(centres, keys).agg(F.coalesce(F.sum(F.col("asked") * F.col("n_bank")), F.lit(0)).alias("pairs_of_units"))
    return Found(ranked(near.unionByName(more)), met.select("pairs_met", every.scalar().alias("pairs_of_units")))
