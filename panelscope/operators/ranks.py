"""Ranks, order statistics and score curves that survive one huge group.

A window over a whole key would put the key into one task.  Here a key is
first shrunk to its distinct values with counts (combined map-side), then cut
into value ranges, so one task sees one range of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64


def histogram(df: DataFrame, keys: Sequence[str], value: str, **measures: Column) -> DataFrame:
    """One row per (keys, value) with the summed ``measures``."""
    aggs = [F.sum(c.cast("long")).alias(n) for n, c in measures.items()]
    return df.groupBy(*keys, value).agg(*aggs)


def running_sums(
    hist: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], ascending: bool = True
) -> DataFrame:
    """Add ``before_<m>`` and ``upto_<m>``: sums over smaller (or, descending,
    larger) values of the key, without and with the row itself.

    ``hist`` holds each (keys, value) once.
    """
    keys = list(keys) or ["_all"]
    made_key = keys == ["_all"]
    if made_key:
        hist = hist.withColumn("_all", F.lit(0))
    cuts = hist.groupBy(*keys).agg(
        F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 2000).alias("_cuts")
    )
    tagged = hist.join(cuts, keys).withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")

    def way(c: str) -> Column:
        return F.col(c).asc() if ascending else F.col(c).desc()

    ranges_before = W.partitionBy(*keys).orderBy(way("_range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_range")
        .agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
        .select(
            *keys, "_range",
            *[F.coalesce(F.sum(f"_s_{m}").over(ranges_before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        )
    )
    inside = W.partitionBy(*keys, "_range").orderBy(way(value)).rowsBetween(W.unboundedPreceding, 0)
    out = tagged.select(
        *tagged.columns, *[F.sum(m).over(inside).alias(f"_i_{m}") for m in measures]
    ).join(offsets, [*keys, "_range"])
    for m in measures:
        out = out.withColumn(f"upto_{m}", F.col(f"_o_{m}") + F.col(f"_i_{m}")).withColumn(
            f"before_{m}", F.col(f"upto_{m}") - F.col(m)
        )
    drop = ["_range", *[f"_o_{m}" for m in measures], *[f"_i_{m}" for m in measures]]
    return out.drop(*drop, *(["_all"] if made_key else []))


def order_values_long(
    df: DataFrame, keys: Sequence[str], value: str, indexes: Sequence[Column], ascending: bool = True
) -> DataFrame:
    """Rows (keys, n, no, value): the value at each 0-based position of the
    sorted list of its key.

    ``indexes`` are expressions over ``n``, the row count of the key.  A value
    is emitted only for the positions it covers, so few rows leave the pass.
    """
    hist = histogram(df.where(F.col(value).isNotNull()), keys, value, cnt=F.lit(1))
    ranked = running_sums(hist, keys, value, ["cnt"], ascending)
    totals = hist.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    if keys:
        joined = ranked.join(totals, list(keys))
    else:
        joined = ranked.withColumn("n", totals.scalar())
    wanted = F.array(*[F.struct(F.lit(no).alias("no"), i.cast("long").alias("i")) for no, i in enumerate(indexes)])
    mine = F.filter(wanted, lambda w: (w["i"] >= F.col("before_cnt")) & (w["i"] < F.col("upto_cnt")))
    return joined.select(*keys, "n", value, F.inline(mine)).select(*keys, "n", "no", F.col(value).alias("value"))


def order_values(df: DataFrame, keys: Sequence[str], value: str, indexes: dict[str, Column], ascending: bool = True) -> DataFrame:
    """``order_values_long`` with one column per position."""
    long = order_values_long(df, keys, value, list(indexes.values()), ascending)
    picks = [F.max(F.when(F.col("no") == no, F.col("value"))).alias(name) for no, name in enumerate(indexes)]
    return long.groupBy(*keys).agg(F.first("n").alias("n"), *picks)


def quantiles_long(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Rows (keys, n, no, value) of exact linear quantiles."""
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in shares]
    ends = order_values_long(df, keys, value, [e for a in at for e in (F.floor(a), F.ceil(a))])
    q_no = F.expr("cast(no div 2 AS int)")
    share = F.element_at(F.array(*[F.lit(float(q)) for q in shares]), q_no + 1)
    pairs = ends.select(*keys, "n", q_no.alias("no"), (F.col("no") % 2).alias("end"), "value", ((F.col("n") - 1) * share).alias("at"))
    low = F.max(F.when(F.col("end") == 0, F.col("value")))
    high = F.max(F.when(F.col("end") == 1, F.col("value")))
    return pairs.groupBy(*keys, "n", "no", "at").agg(low.alias("lo"), high.alias("hi")).select(
        *keys, "n", "no", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("value")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact linear quantiles per key, as ``percentile`` defines them, without
    holding a key's values in one aggregation buffer."""
    long = quantiles_long(df, keys, value, list(shares.values()))
    picks = [F.max(F.when(F.col("no") == no, F.col("value"))).alias(name) for no, name in enumerate(shares)]
    return long.groupBy(*keys).agg(F.first("n").alias("n"), *picks)


def auroc(df: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """(wins + half ties) / (negatives * positives), 4 decimals; NULL when
    a side is empty.  ``positive`` is a 0/1 column."""
    hist = histogram(df, keys, score, pos=F.col(positive), neg=1 - F.col(positive))
    ranked = running_sums(hist, keys, score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    sides = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.round(F.when(sides > 0, wins / sides), 4).alias("auroc"),
    )


def average_precision(df: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Sum of precision times recall step over descending scores, equal
    scores taken together."""
    hist = histogram(df, keys, score, pos=F.col(positive), cnt=F.lit(1))
    ranked = running_sums(hist, keys, score, ["pos", "cnt"], ascending=False)
    step = F.col("pos") * (F.col("upto_pos").cast("double") / F.col("upto_cnt"))
    return ranked.groupBy(*keys).agg(
        F.round(F.when(F.sum("pos") > 0, F.sum(step) / F.sum("pos")), 6).alias("average_precision")
    )


def rank_cut(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Value at descending index max(0, int(n * share) - 1) per key."""
    indexes = {
        name: F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(s)).cast("long") - 1)
        for name, s in shares.items()
    }
    return order_values(df, keys, value, indexes, ascending=False)


def tie_rank(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average rank of each distinct value (1-based) with its tie count."""
    hist = histogram(df, keys, value, cnt=F.lit(1))
    return running_sums(hist, keys, value, ["cnt"]).select(
        *keys, value, F.col("cnt").alias("ties"), (F.col("before_cnt") + (F.col("cnt") + 1) / 2.0).alias("avg_rank")
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an
    aggregate (combined map-side) rather than a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def islands(df: DataFrame, keys: Sequence[str], pos: str, max_gap: int = 1) -> DataFrame:
    """Runs of positions whose steps are at most ``1 + max_gap``.

    Keys are columns or rows of one picture, so a window per key is bounded by
    the picture side.
    """
    w = W.partitionBy(*keys).orderBy(pos)
    start = (F.col(pos) - F.lag(pos).over(w)) > 1 + max_gap
    marked = df.withColumn("_start", F.coalesce(start, F.lit(True)).cast("int"))
    return marked.withColumn("run", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_start")


def top_k_mean(df: DataFrame, keys: Sequence[str], value: str, k: int = 10) -> DataFrame:
    """Mean of the k greatest values; the row limit is applied before the
    shuffle by the window group limit."""
    w = W.partitionBy(*keys).orderBy(F.col(value).desc())
    return (
        df.select(*keys, value)
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= k)
        .groupBy(*keys)
        .agg(F.avg(value).alias("top_mean"), F.count(F.lit(1)).alias("used"))
    )


def sym_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side; one shuffle."""
    both = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    )
    sides = both.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return sides.where("in_a <> in_b").select(*keys, F.when(F.col("in_a") == 1, "a").otherwise("b").alias("side"))
