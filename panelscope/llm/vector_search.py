"""Approximate nearest neighbours by a permutation index.

Pivots are far-apart vectors of a bounded sample.  Every vector is represented by its
nearest pivots in order.  Vectors are dealt into blocks by hash; a block posts
its vectors in one inverted file per pivot with the pivot's place.  A query
adds up, over the files of its own pivots, how far places are apart (Spearman's
footrule, absent pivots count as the place behind the last); the share
``rerank`` of a block with the least footrule is measured exactly.  Queries go
to the tasks about 8 MB at a time and meet the blocks of vectors there; a task
gives k rows per query at most.

Equal vectors are indexed once and carry their least k + 1 ids, which is all
that an answer can hold.

Cases: vectors that are null, zero, or hold a null or non-finite component take
no part, nor do those whose length is not the most frequent one (ties to the
shorter) or whose id is null; rows that repeat id and vector count once; ties go
to smaller ids; with fewer candidates all are returned; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.llm.common import discard, forget, stored
from panelscope.llm.vectors import Best, in_passes

#: Pivots, and the vectors (by hash order) they are taken from: each time the one farthest from those taken.
PIVOTS, SAMPLE = 256, 2048
#: Nearest pivots that represent a vector.
PLACES = 128
#: Share of a block that is measured exactly.
RERANK = 0.1
#: Vectors of a block, and queries of a block, about.
BLOCK, QUERIES = 4096, 512
NEIGHBOURS = 10


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    )
    lengths = fine.groupBy(F.size("v").alias("d")).count()
    best = lengths.orderBy(F.col("count").desc(), "d").limit(1).select("d")
    return fine.where(F.size("v") == best.scalar())


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def places(x: np.ndarray, pivots: np.ndarray, many: int = PLACES) -> np.ndarray:
    """The nearest pivots of each row, in order."""
    d = distances(x, pivots)
    many = min(many, len(pivots))
    near = np.argpartition(d, many - 1, axis=1)[:, :many]
    return np.take_along_axis(near, np.lexsort((near, np.take_along_axis(d, near, 1)), axis=1), 1)


def farthest_first(x: np.ndarray, many: int) -> np.ndarray:
    """At most ``many`` rows of ``x``, far apart; equal and very close ones give few pivots."""
    taken, far = [0], distances(x, x[:1])[:, 0]
    while len(taken) < min(many, len(x)):
        taken.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[taken[-1] :][:1])[:, 0])
    return x[taken]


def first_by_hash(distinct: DataFrame, n: int, many: int) -> DataFrame:
    """v of the ``many`` first of ``n`` rows (h, v) by a hash of h.

    Each task of a limited sort sends its first ``many`` rows to the driver: only rows
    below a hash that about twice as many stay under are sorted, or all if these are too few.
    """
    place = F.xxhash64(F.lit(3), "h")
    below = distinct.where(place <= min((1 << 63) - 1, (1 << 65) * many // max(n, 1) - (1 << 63)))
    if n > 2 * many and below.count() < many:
        # sorted by one task, which reads the first rows of the others
        below = stored(distinct.orderBy(place, "h").limit(many), "sampled-vectors")
    return below.orderBy(place, "h").select("v").limit(many)


class Block:
    """Vectors of one block with an inverted file per pivot."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray):
        self.x = x
        order = places(x, pivots)
        self.many = order.shape[1]
        # a pivot's file holds how far a vector's place is before the end, 0 where the pivot is absent
        weight = np.arange(self.many, 0, -1).astype(np.min_scalar_type(self.many))
        self.files = np.zeros((len(pivots), len(x)), weight.dtype)
        np.put_along_axis(self.files.T, order, weight[None], 1)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector to a query with the pivots ``order``."""
        n = self.many
        # two places differ by their weights less twice the smaller one; weights of all pivots add up to n (n + 1) / 2
        weight = np.arange(n, 0, -1).astype(self.files.dtype)
        return (n * (n + 1) - 2 * np.minimum(self.files[order], weight[:, None]).sum(axis=0, dtype=np.int32)).astype(np.int32)

    def search(self, q: np.ndarray, order: np.ndarray, share: float, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, exact distances) of the candidates of each query."""
        take = min(len(self.x), max(least, int(np.ceil(share * len(self.x)))))
        out = []
        for one, pivots in zip(q, order):
            f = self.footrule(pivots)
            rows = np.argpartition(f, take - 1)[:take] if take < len(f) else np.arange(len(f))
            out.append((rows, np.sqrt(((self.x[rows] - one) ** 2).sum(axis=1))))
        return out


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = NEIGHBOURS, pivots: int = PIVOTS, rerank: float = RERANK, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    rows = stored(usable(vectors), "vectors")
    # least ids first: k + 1, as the query's own may be among them; rows that repeat id and vector share a number
    equal = W.partitionBy("h", "v")
    low = F.dense_rank().over(equal.orderBy("vec_id"))
    once = rows.select(F.xxhash64("v").alias("h"), "v", "vec_id").withColumn("no", low).where(F.col("no") <= k + 1)
    # windows, as a grouping by ``v`` would move it again
    listed = once.select("h", "v", F.array_sort(F.collect_set("vec_id").over(equal)).alias("ids"), F.row_number().over(equal.orderBy("vec_id")).alias("no"))
    distinct = stored(listed.where("no = 1").drop("no"), "distinct-vectors")
    n = distinct.count()
    chosen = [r["v"] for r in first_by_hash(distinct, n, SAMPLE).collect()]
    if not chosen:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(farthest_first(np.array(chosen), pivots))

    def pack(df: DataFrame, ids: str, kind: str, size: int, total: int) -> DataFrame:
        """no, ids, data, order: blocks of about ``size`` rows by hash; one row each, with the pivots of its vectors."""
        blocks = max(1, -(-total // size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    row = batch.slice(r, 1).to_pylist()[0]
                    rows_ = sorted(row["rows"], key=lambda x: x["i"])
                    x = np.array([y["v"] for y in rows_])
                    yield pa.RecordBatch.from_pylist(
                        [{"no": row["no"], "ids": [y["i"] for y in rows_], "data": x.tobytes(), "pivots": places(x, shared.value).astype("<i4").tobytes()}],
                        pa.schema([("no", pa.int64()), ("ids", pa.list_(pa.list_(pa.int64())) if kind.startswith("array") else pa.list_(pa.int64())), ("data", pa.binary()), ("pivots", pa.binary())]),
                    )

        dealt = df.groupBy(F.pmod(F.xxhash64(F.lit(5), ids), F.lit(blocks)).alias("no")).agg(F.collect_list(F.struct(F.col(ids).alias("i"), "v")).alias("rows"))
        return dealt.mapInArrow(run, f"no bigint, ids array<{kind}>, data binary, pivots binary")

    asked = stored(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct(), "asked-vectors")
    discard(rows)
    ask = stored(pack(asked, "vec_id", "bigint", QUERIES, asked.count()).select("ids", "data", "pivots"), "queries")
    bank = stored(pack(distinct, "ids", "array<bigint>", block, n).select("ids", "data"), "vector-blocks")
    discard(distinct)
    forget(spark)
    width = len(chosen[0])

    def search(chunk: list[dict], blocks: Iterator[dict]) -> list[np.ndarray]:
        best = Best(k)
        queries = [(r["ids"], np.frombuffer(r["data"]).reshape(-1, width), np.frombuffer(r["pivots"], "<i4").reshape(len(r["ids"]), -1)) for r in chunk]
        for row in blocks:
            index, b_ids = Block(np.frombuffer(row["data"]).reshape(-1, width), shared.value), row["ids"]
            for ids, q, order in queries:
                out: list[tuple[int, int, float]] = []
                for query, (at, d) in zip(ids, index.search(q, order, rerank, 4 * k)):
                    near = np.argsort(d, kind="stable")
                    # k + 1 distances and all that tie with the last: the query itself may be one
                    near = near[d[near] <= d[near[min(k, len(near) - 1)]]]
                    found = sorted((d[i], v) for i in near.tolist() for v in b_ids[at[i]] if v != query)
                    out += [(query, v, float(s)) for s, v in found[:k]]
                if out:
                    query, v, score = zip(*out)
                    best.add(np.array(query, np.int64), -np.array(score), np.array(v, np.int64))
        found = best.columns()
        return [*found[:2], -found[2]] if found else []

    near = in_passes(ask, bank, search, "query_id bigint, vec_id bigint, score double", most)
    best = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    # an id may stand with several vectors
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: list[int], x: np.ndarray, every: int = 100, k: int = NEIGHBOURS) -> dict[int, list[tuple[int, float]]]:
    """Exact answer for tests and recall; ``x``: usable vectors."""
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            out[i] = [(v, float(s)) for s, v in sorted((s, v) for s, v in zip(d, ids) if v != i)[:k]]
    return out
