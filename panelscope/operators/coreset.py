"""Farthest-point picks (k-center) per unit, in rounds over blocks of vectors.

The picks are those of the plain method: first the row of least id, then again
and again the row farthest from all picks so far (ties to the smaller id).  A
round takes several of them at once.  Every unit's ``candidates`` farthest rows
and the one that follows them meet in one task.  There the plain method goes on
as long as its next pick stands before that following row: distances only fall,
so no row outside can stand before it either.  Then all blocks lower their
distances by the round's picks, in one matrix product per block.

A unit is as many blocks as its rows need, in the partitions that read them; a
unit with a third of all rows is spread like all rows.  One task holds a block
or the candidates of a unit.  Every round ends with tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.session import cut_lineage

#: What a picked row's distance becomes: behind all others.
TAKEN = -1.0


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x``; each depends on its own row only, so it is the same in any block."""
    return ((x - centre) ** 2).sum(axis=1)


def packed(df: DataFrame, keys: Sequence[str], key_id: str, size: int) -> DataFrame:
    """keys, ids, dim, data: vectors of a partition in blocks of at most ``size``, no shuffle; rows without a vector are left out."""
    key_types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(list(keys), sort=False, dropna=False) if keys else [((), batch)]
            rows = []
            for key, same in groups:
                for lo in range(0, len(same), size):
                    part = same.iloc[lo : lo + size]
                    data = np.stack(part["_v"].to_numpy()).astype(np.float64)
                    rows.append((*key, part["_id"].tolist(), data.shape[1], data.tobytes()))
            yield pd.DataFrame(rows, columns=[*keys, "ids", "dim", "data"])

    given = df.where("vector IS NOT NULL").select(*keys, F.col(key_id).alias("_id"), F.col("vector").alias("_v"))
    return given.mapInPandas(run, f"{key_types}ids array<bigint>, dim int, data binary")


def lowered(x: np.ndarray, far: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Least squared distance of each row to ``centres`` or, if less, ``far``.

    One matrix product finds which centres can be nearest; those are measured
    by ``squared``'s rule, so that results do not depend on the product.
    """
    squares = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None]
    rough, slack = squares - 2 * x @ centres.T, squares * 1e-9
    least = np.minimum(far, (rough + slack).min(axis=1))
    row, col = np.nonzero(rough - slack <= least[:, None])
    out = far.copy()
    for lo in range(0, len(row), 1 << 16):
        r, c = row[lo : lo + (1 << 16)], col[lo : lo + (1 << 16)]
        np.minimum.at(out, r, ((x[r] - centres[c]) ** 2).sum(axis=1))
    return out


def greedy(ids: np.ndarray, x: np.ndarray, far: np.ndarray, want: int, after: tuple[float, int] | None = None) -> list[int]:
    """Positions of the next picks, at most ``want``, while each stands before ``after`` (a distance and an id)."""
    order = np.argsort(ids, kind="stable")
    ids, x, far, picks = ids[order], x[order], far[order].copy(), []
    while len(picks) < min(want, len(ids)):
        at = int(far.argmax())
        if after is not None and (-far[at], ids[at]) >= (-after[0], after[1]):
            break
        picks.append(at)
        far = np.where(far == TAKEN, TAKEN, np.minimum(far, squared(x, x[at])))
        far[at] = TAKEN
    return order[picks].tolist()


def memory_bank(vectors: DataFrame, ratio: float = 0.1, keys: Sequence[str] = ("lighting", "zone"), candidates: int = 1024, size: int = 1024) -> DataFrame:
    """Keys, sample_id, vector, pick_no of the picks of every unit: ``ratio`` of its rows, one at least.

    Rows without a vector take no part; ids are unique within a unit.
    """
    keys = list(keys)
    key_types = "".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}, " for k in keys)
    blocks = packed(vectors, keys, "sample_id", size).withColumn("far", F.lit(None).cast("binary"))
    totals = blocks.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.sum(F.size("ids")) * F.lit(ratio))).cast("bigint").alias("left"))
    blocks = cut_lineage(blocks, "bank-blocks")
    blocks = blocks.join(cut_lineage(totals, "bank-units"), keys)

    def block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(row.data).reshape(-1, row.dim)
        return np.asarray(row.ids), x, np.full(len(x), np.inf) if row.far is None else np.frombuffer(row.far)

    def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, x, far = block(row)
                best = np.lexsort((ids, -far))[: candidates + 1]
                out = pd.DataFrame({"sample_id": ids[best], "distance": far[best], "left": row.left, "v": [x[i].tobytes() for i in best]})
                for k in reversed(keys):
                    out.insert(0, k, getattr(row, k))
                yield out[out["distance"] > TAKEN]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["distance", "sample_id"], ascending=[False, True], ignore_index=True)
        after = None
        if len(pdf) > candidates:
            after = (pdf["distance"].iloc[candidates], pdf["sample_id"].iloc[candidates])
            pdf = pdf.iloc[:candidates]
        x = np.stack([np.frombuffer(v) for v in pdf["v"]])
        order = greedy(pdf["sample_id"].to_numpy(), x, pdf["distance"].to_numpy(), int(pdf["left"].iloc[0]), after)
        return pdf.iloc[order].assign(place=range(1, len(order) + 1))[[*keys, "sample_id", "v", "place"]]

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fars = []
            for row in batch.itertuples(index=False):
                ids, x, far = block(row)
                far = np.where(far == TAKEN, TAKEN, lowered(x, far, np.stack([np.frombuffer(p["v"]) for p in row.picks])))
                far[np.isin(ids, [p["sample_id"] for p in row.picks])] = TAKEN
                fars.append(far.tobytes())
            yield batch.assign(far=fars, left=batch["left"] - batch["picks"].map(len), taken=batch["taken"] + batch["picks"].map(len)).drop(columns="picks")

    blocks, found = blocks.withColumn("taken", F.lit(0).cast("bigint")), None
    while True:
        top = blocks.mapInPandas(farthest, f"{key_types}sample_id bigint, distance double, left bigint, v binary")
        order = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("distance").desc(), "sample_id"))
        near = top.withColumn("_no", order).where(F.col("_no") <= candidates + 1).drop("_no")
        picks = cut_lineage(near.groupBy(*keys).applyInPandas(pick, f"{key_types}sample_id bigint, v binary, place bigint"), "bank-picks")
        if picks.isEmpty():
            break
        per_unit = picks.groupBy(*keys).agg(F.collect_list(F.struct("sample_id", "v")).alias("picks"))
        earlier = blocks.groupBy(*keys).agg(F.first("taken").alias("taken"))
        numbered = picks.join(earlier, keys).select(*keys, "sample_id", "v", (F.col("place") + F.col("taken")).alias("pick_no"))
        numbered = cut_lineage(numbered, "bank-numbered")
        found = numbered if found is None else found.unionByName(numbered)
        # a unit whose picks are complete leaves, one that gave none has no rows left
        with_picks = blocks.join(per_unit, keys)
        blocks = cut_lineage(with_picks.mapInPandas(lower, blocks.schema).where("left > 0"), "bank-blocks")
        if blocks.isEmpty():
            break

    schema = vectors.select(*keys, "sample_id", "vector").schema
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema.add("pick_no", "long"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=[np.frombuffer(v).tolist() for v in batch["v"]])[[*keys, "sample_id", "vector", "pick_no"]]

    out = found.mapInPandas(unpack, f"{key_types}sample_id bigint, vector array<double>, pick_no bigint")
    return out.withColumn("vector", F.col("vector").cast(schema["vector"].dataType.simpleString()))
