"""Hard negatives: rows of another label that score nearly as high with an anchor as its positives do.

A score is the integer inner product of floored vectors.  Anchors meet all rows
in blocks, twice.  The first meeting keeps each anchor's best rows of its own
label, the positives.  A positive's window of negatives reaches from ``low`` to
``high`` percent of its score, so windows overlap.  The positives' upper limits
cut the scores into disjoint slots: a negative is in the slot of the least
limit that it does not exceed.  In the second meeting blocks, then Spark's group
limit, keep the best few of each slot (anchor, slot).  Last, per anchor, the
slots from a positive's own one downwards, which are in falling order of score,
are read until enough rows are found: their best few within the limit above;
what lies below the lower limit falls away.  At most ``positives`` times
``negatives`` rows of an anchor meet in one place.

Blocks are dealt by a hash of the id and hold about ``block`` rows, sorted by
label, so that the first meeting multiplies equal labels only and a label with
a third of all rows is in all blocks alike.  Anchors go to the tasks about 8 MB
at a time, and a task keeps the best rows of all of its blocks: rows x anchors /
block x anchor block pairs are multiplied, none is moved.

Cases: rows with a null id, a null label, a null or empty vector or a component
that is null or not finite take no part, nor do vectors whose length is not the
most frequent one or whose scaled components leave the range of long.  Rows
that repeat an id count once, as the row of least (label, vector).  Ties go to
smaller ids.  A positive with a negative score, or whose window holds no whole
number, has no negatives.  Scores beyond the range of long count as its ends.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.llm.common import stored
from panelscope.llm.vectors import Best, from_bytes, in_passes, leaders, matrix, products, to_bytes, whole_vectors

#: Rows of a block, anchors of a block, about; anchors multiplied at once.
BLOCK, ANCHORS, AT_ONCE = 8192, 512, 64
POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score, in percent of the positive's.
LOW, HIGH = 50, 95


def window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score between ``low`` and ``high`` percent of each of ``score``."""
    s = score.astype(object)
    return np.array([-(-low * x // 100) for x in s], np.int64), np.array([high * x // 100 for x in s], np.int64)


def blocks_of(rows: DataFrame, size: int, total: int, *extra: str) -> DataFrame:
    """no, ids, labels, data and ``extra`` as lists: blocks of about ``size`` of ``rows`` (vec_id, label, v), by label and id."""
    kinds = dict(rows.dtypes)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        order = np.lexsort((group["vec_id"].to_numpy(), group["label"].to_numpy()))
        x = matrix(group["v"], group.num_rows)[order]
        group = group.take(pa.array(order))
        fields = [[key[0].as_py()], [group["vec_id"].to_pylist()], [group["label"].to_pylist()], [to_bytes(x)]] + [[group[c].to_pylist()] for c in extra]
        longs = pa.list_(pa.int64())
        types = [pa.int64(), longs, longs, pa.binary()] + [pa.list_(longs) if kinds[c].startswith("array") else longs for c in extra]
        return pa.Table.from_arrays([pa.array(f, t) for f, t in zip(fields, types)], names=["no", "ids", "labels", "data", *extra])

    dealt = rows.withColumn("no", F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(max(1, -(-total // size))).cast("long")))
    schema = "no bigint, ids array<bigint>, labels array<bigint>, data binary" + "".join(f", {c} array<{kinds[c]}>" for c in extra)
    return dealt.select("no", "vec_id", "label", "v", *extra).groupBy("no").applyInArrow(pack, schema)


class Side:
    """One block as arrays."""

    def __init__(self, row: dict, prefix: str, width: int):
        self.ids, self.labels = np.array(row[f"{prefix}ids"]), np.array(row[f"{prefix}labels"])
        self.x = from_bytes(row[f"{prefix}data"], len(self.ids), width)


def same_label(a: Side, b: Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor ids, ids, scores) of the ``k`` best rows of ``b`` with the label of each anchor of ``a``, itself excluded."""
    found = []
    for label in np.unique(a.labels):
        left, right = np.flatnonzero(a.labels == label), np.arange(*np.searchsorted(b.labels, [label, label + 1]))
        for i in range(0, len(left) if len(right) else 0, AT_ONCE):
            rows = left[i : i + AT_ONCE]
            s = products(a.x[rows], b.x[right])
            # those at or above the k + 1st highest: the anchor may be one of them
            cut = np.partition(s, max(0, len(right) - k - 1), axis=1)[:, max(0, len(right) - k - 1)]
            at, col = np.nonzero(s >= cut[:, None])
            other = a.ids[rows[at]] != b.ids[right[col]]
            at, col = at[other], col[other]
            best = leaders(at, s[at, col], b.ids[right[col]], k)
            found.append((a.ids[rows[at[best]]], b.ids[right[col[best]]], s[at[best], col[best]]))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.array([], np.int64) for c in range(3))


def other_label(a: Side, b: Side, limits: list[list[int]], least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor ids, slots, ids, scores) of the ``k`` best rows of ``b`` in each slot of each anchor of ``a``.

    ``limits``: an anchor's distinct upper limits, falling; ``least``: its least lower limit.
    """
    width = max(map(len, limits))
    upper = np.array([x + [np.iinfo(np.int64).min] * (width - len(x)) for x in limits], np.int64)
    found = []
    for i in range(0, len(a.ids), AT_ONCE):
        rows = np.arange(i, min(i + AT_ONCE, len(a.ids)))
        s = products(a.x[rows], b.x)
        at, col = np.nonzero((s <= upper[rows, :1]) & (s >= least[rows, None]) & (a.labels[rows, None] != b.labels[None]))
        score = s[at, col]
        slot = (score[:, None] <= upper[rows[at]]).sum(axis=1) - 1
        best = leaders(at * width + slot, score, b.ids[col], k)
        found.append((a.ids[rows[at[best]]], slot[best], b.ids[col[best]], score[best]))
    return tuple(np.concatenate([f[c] for f in found]) for c in range(4))


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, anchors: int = ANCHORS, most: int | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors, rows whose id is divisible by ``every``."""
    usable = whole_vectors(vectors, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label")).where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = stored(usable.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    n, n_asked, width = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
    width = width or 0
    bank = stored(blocks_of(rows, block, n), "blocks").select(F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("data").alias("b_data"))

    def best_positives(chunk: list[dict], blocks: Iterator[dict]) -> list[np.ndarray]:
        best, sides = Best(positives), [Side(row, "", width) for row in chunk]
        for row in blocks:
            other = Side(row, "b_", width)
            for side in sides:
                ids, others, scores = same_label(side, other, positives)
                best.add(ids, scores, others)
        found = best.columns()
        return [*found, *window(found[2], low, high)] if found else []

    def best_negatives(chunk: list[dict], blocks: Iterator[dict]) -> list[np.ndarray]:
        best, sides = Best(negatives), [(Side(row, "", width), row["limits"], np.array(row["least"])) for row in chunk]
        for row in blocks:
            other = Side(row, "b_", width)
            for side in sides:
                ids, slots, others, scores = other_label(side[0], other, *side[1:], negatives)
                best.add(np.stack([ids, slots]), scores, others)
        return best.columns()

    ask = stored(blocks_of(asked, anchors, n_asked), "anchors")
    near = in_passes(ask, bank, best_positives, "anchor_id bigint, positive_id bigint, positive_score bigint, low bigint, high bigint", most)
    order = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id"))
    chosen = stored(near.withColumn("no", order).where((F.col("no") <= positives) & (F.col("low") <= F.col("high"))).drop("no"), "positives")
    limits = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.reverse(F.array_sort(F.collect_set("high"))).alias("limits"), F.min("low").alias("least"))
    ask = stored(blocks_of(asked.join(limits, "vec_id"), anchors, n_asked, "limits", "least"), "limited-anchors")
    found = in_passes(ask, bank, best_negatives, "anchor_id bigint, slot bigint, negative_id bigint, negative_score bigint", most)
    place = F.row_number().over(W.partitionBy("anchor_id", "slot").orderBy(F.col("negative_score").desc(), "negative_id"))
    # falling scores, ties to smaller ids: the order in which slots are read downwards
    kept = found.withColumn("no", place).where(F.col("no") <= negatives).groupBy("anchor_id")
    slots = kept.agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("negative_score")).alias("s"), "negative_id"))).alias("slots"))
    own = (F.dense_rank().over(W.partitionBy("anchor_id").orderBy(F.col("high").desc())) - 1).alias("own")
    below = F.slice(F.filter("slots", lambda x: x["slot"] >= F.col("own")), 1, negatives)
    answers = chosen.select("*", own).join(slots, "anchor_id").select("anchor_id", "positive_id", "positive_score", "low", F.posexplode(below).alias("at", "x"))
    return answers.where(-F.col("x.s") >= F.col("low")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.negative_id").alias("negative_id"), "positive_score", (-F.col("x.s")).alias("negative_score")
    )


def relabelled(vectors: DataFrame) -> DataFrame:
    """``vectors`` whose label, where the id is divisible by 7, is the next of ten: what the query mines."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), w AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
  FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3
"""
