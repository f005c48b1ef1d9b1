"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the set of its shingles (five words, or all if it has fewer).
Darts are thrown at every element: a Poisson process over (weight, rank), each
dart with a coordinate, all a hash of the element alone.  Darts inside an
element's weight count; the earliest per coordinate is the signature.  Two
documents agree at a coordinate with the probability of their weighted Jaccard
similarity.  Ranks beyond a limit that covers all coordinates are never thrown,
so a signature costs about k log k darts, however long the text.

Equal sets are joined first and go on as one.  Documents that agree in all rows
of a band share a bucket.  In a bucket all are compared with one of them.  Where
the rest is in several components, its rows are searched exactly by their rare
shingles.  So no bucket is cut and none yields all its pairs.  A pair
is compared by signature and then by its whole sets of 32-bit shingle hashes.
At a similarity of 0.8, 32 bands of 4 rows miss a pair with a chance of 5e-8.

Cases: null and wordless texts are classes of their own; repeated rows and ids
are documents like any other; class_id is the least doc_id of the class (null if
it has none); an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.llm.common import WORD_BYTES, discard, few, forget, mix64, rows_of, slices, stored, whole
from panelscope.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Signatures that agree less than this are no candidates: at 0.8 a chance of 1e-8.
ESTIMATE = 0.6
#: Rows of a bucket that meet the others in one round of the exact search.
AT_ONCE = 16
#: Rows with the fewest rare shingles that meet the others of their buckets in its first round.
CENTRAL = 4
#: Cells of the shingle counts that order a set's shingles.
COUNTERS = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0x5851F42D4C957F2D
_MIXERS = mix64(np.arange(7, 7 + SHINGLE, dtype=np.uint64) * _STEP) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts, and where each text's words start (one more for the end)."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined.translate(WORD_BYTES), np.uint8)
    inside = raw != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    running = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)))])
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(raw))
    hashes = mix64((running[last] - running[first]) * inverse[first] + (last - first).astype(np.uint64))
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(first, starts)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted 64-bit shingle hashes of each text, each once."""
    words, starts = word_hashes(texts)
    total = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        total += words[j : j + len(total)] * _MIXERS[j]
    total = mix64(total)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(total[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix64((words[a:b] * _MIXERS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def dart_minhash(elements: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = COORDINATES) -> np.ndarray:
    """Signatures (documents x k, 32-bit) of weighted sets; rows of sets without weight are 0.

    ``elements``: 64-bit hashes; ``weights``: positive, 1 if left out.
    """
    n = len(elements)
    best = np.full(n * k, _NONE)
    size = np.array([len(e) for e in elements], np.int64)
    mass = size.astype(float) if weights is None else np.array([w.sum() for w in weights], float)
    todo, reach = np.flatnonzero(mass > 0), k * (log(k) + 3.5)
    while len(todo):
        _throw(best, todo, elements, weights, reach / mass[todo], k)
        open_cells = (best.reshape(n, k)[todo] == _NONE).any(axis=1)
        todo, reach = todo[open_cells], reach * 2
    return np.where(best == _NONE, np.uint64(0), best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, k)


def _throw(best: np.ndarray, docs: np.ndarray, elements: list[np.ndarray], weights: list[np.ndarray] | None, limit: np.ndarray, k: int) -> None:
    """Keeps the earliest dart per cell (document, coordinate) with a rank up to the document's limit."""
    seed = np.concatenate([elements[d] for d in docs])
    owner = np.repeat(docs, [len(elements[d]) for d in docs])
    most = np.repeat(limit, [len(elements[d]) for d in docs])
    share = None
    if weights is not None:  # unit cells of the weight axis, the last one in part
        weight = np.concatenate([weights[d] for d in docs]).astype(float)
        cells = np.ceil(weight).astype(np.int64)
        no = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        share = np.minimum(1.0, np.repeat(weight, cells) - no)
        seed, owner, most = np.repeat(seed, cells) + no.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), np.repeat(owner, cells), np.repeat(most, cells)
    rank, at = np.zeros(len(seed)), 0
    while len(seed):
        # a few darts one by one, then many at a time for the few elements that need them
        width = 1 if at < 6 else 32
        no = np.arange(at, at + width, dtype=np.uint64) * np.uint64(4)
        draw = mix64((seed[:, None] + (no + np.uint64(1)) * _STEP).ravel()).reshape(-1, width)
        ranks = rank[:, None] + np.cumsum(-np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)), axis=1)
        i, j = np.nonzero(ranks <= most[:, None])
        if len(i):
            other = mix64(seed[i] + (no[j] + np.uint64(2)) * _STEP)
            keep = slice(None)
            if share is not None:
                place = mix64(seed[i] + (no[j] + np.uint64(3)) * _STEP)
                keep = (place >> np.uint64(11)).astype(float) / float(1 << 53) < share[i]
            # rank first, then the dart's name: the least is the earliest dart
            packed = (ranks[i, j].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (other & np.uint64(0xFFFFFFFF))
            np.minimum.at(best, (owner[i] * k + (other >> np.uint64(32)).astype(np.int64) % k)[keep], packed[keep])
        live = ranks[:, -1] <= most
        seed, owner, most, rank, at = seed[live], owner[live], most[live], ranks[live, -1], at + width
        share = share[live] if share is not None else None


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64-bit bucket of each band, signed; the band's number is part of it."""
    parts = signatures.astype(np.uint64).reshape(-1, bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64)[None] * _STEP
    for r in range(rows):
        total = mix64((total + parts[:, :, r]).ravel()).reshape(total.shape[0] if r else -1, bands)
    return total.view(np.int64)


SKETCH = "doc_id bigint, text_hash bigint, high bigint, low bigint, n int, bands array<bigint>, signature binary, shingles binary"


def sketches(docs: DataFrame) -> DataFrame:
    """SKETCH rows: one per document, with a 128-bit key of its set."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int32()),
        ("bands", pa.list_(pa.int64())), ("signature", pa.binary()), ("shingles", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            sets = shingle_sets(rows_of(part))
            sizes = np.array([len(s) for s in sets], np.int32)
            signatures = dart_minhash(sets)
            bands = band_keys(signatures)
            key = np.array([[mix64(s).sum(dtype=np.uint64), mix64(s ^ _STEP).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())),
                pa.array([s.astype("<u2").tobytes() for s in signatures], pa.binary()),
                pa.array([(s >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary()),
            ], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SKETCH)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted arrays."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / max(1, len(both) - same)


def verified(pairs: DataFrame, rows: DataFrame, similarity: float, many: int) -> DataFrame:
    """Pairs (a, b) with at least ``similarity``; ``rows``: row, signature, shingles; ``pairs`` are about ``many``."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = pa.array((x == y).mean(axis=1) >= ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u4") for c in ("sa", "sb"))
                keep.append(jaccard(x, y) >= similarity)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    def with_both(p: DataFrame, column: str, n: int) -> DataFrame:
        one, two = (rows.select(F.col("row").alias(c), F.col(column).alias(f"s{c}")) for c in ("a", "b"))
        return few(few(p.join(one, "a"), n).join(two, "b").select("a", "b", "sa", "sb"), n)

    close = stored(with_both(few(pairs, many), "signature", many).mapInArrow(alike, "a bigint, b bigint"), "candidates")
    # sets are long: a pair counts as several rows
    return with_both(close, "shingles", 4 * close.count()).mapInArrow(exact, "a bigint, b bigint")


def prefixes(rows: DataFrame, similarity: float) -> DataFrame:
    """(bucket, row, n, place, rare): a bucket per shingle among the rarest of a row; n is the set's size, place the shingle's rank in it.

    ``rare`` is the share of the set up to its first shingle that others may have.

    Sets with at least ``similarity`` share one of their n - ceil(similarity n)
    + 1 first shingles in any order that all sets keep.  The order is by a
    count over all rows, so that common passages come last; counts are kept in
    COUNTERS cells by hash, where a clash only changes the order.
    """

    def tokens(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in whole(batches):
            total += np.bincount(np.concatenate(tokens(batch)) % COUNTERS, minlength=COUNTERS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    sets = rows.select("row", "shingles")
    cells = sets.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            out = []
            for row, one in zip(batch.column(0).to_pylist(), tokens(batch)):
                seen = shared.value[one % COUNTERS]
                order = np.lexsort((one, seen))[: len(one) - int(np.ceil(len(one) * similarity - 1e-6)) + 1]
                place = np.flatnonzero(seen[order] > 1)
                out.append({"row": row, "n": len(one), "at": [{"bucket": b, "place": p} for b, p in zip(one[order[place]].tolist(), (place + 1).tolist())]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("n", pa.int32()), ("at", pa.list_(pa.struct([("bucket", pa.int64()), ("place", pa.int32())])))]))

    found = sets.mapInArrow(first, "row bigint, n int, at array<struct<bucket:bigint,place:int>>")
    rare = (F.try_element_at("at", F.lit(1))["place"] / F.col("n")).alias("rare")
    return found.select("row", "n", rare, F.explode("at").alias("a")).select("a.bucket", "row", "n", "a.place", "rare")


def reachable(n: Column, place: Column, other: Column, similarity: float) -> Column:
    """Whether a set of ``n`` whose first common shingle is at ``place`` can be so similar to one of ``other`` elements."""
    return (n - place + 1) >= F.lit(similarity / (1 + similarity)) * (n + other) - 1e-6


def linked(rows: DataFrame, singles: DataFrame, similarity: float) -> tuple[DataFrame | None, DataFrame | None]:
    """(links (a, b), components (node, component)) among the ``singles`` (row) of ``rows``; None if there are none.

    ``rows`` (row, bands, signature, shingles) is a stored table: only the bands
    of the singles move, and signatures and sets move for rows that are in pairs.
    First each band's bucket is compared with its least row.  Rows of buckets
    whose rest is in several components go on to buckets by rare shingle, an
    exact search among them.  There, a few rows of a bucket meet all others that
    sizes and places allow, until every bucket is one component: first those
    nearest to what the bucket has in common, which join a group of edited copies
    in one round, then those of small components.
    """
    members = rows.select("row", "bands").join(singles, "row", "left_semi").select(F.explode("bands").alias("bucket"), "row")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1")
    active = stored(members.join(shared, "bucket").where("row <> first").select("bucket", "row", "first"), "buckets")
    many = active.count()
    if not many:
        return None, None
    # sets move once as a whole: those that share a bucket are put aside
    shares = active.select("row").union(active.select("first")).distinct()
    sets = stored(few(rows.select("row", "signature", "shingles").join(shares, "row", "left_semi"), 4 * many), "bucket-sets")
    forget(rows.sparkSession)
    links = stored(verified(active.select(F.col("row").alias("a"), F.col("first").alias("b")).distinct(), sets, similarity, many), "links")
    forget(rows.sparkSession)
    labels = components(links)
    some = _open_buckets(active.select("bucket", "row"), labels, many).select("row").distinct()
    shared_sets, sets = sets, stored(few(sets.join(some, "row", "left_semi"), 4 * many), "open-sets")
    discard(shared_sets)
    forget(rows.sparkSession)
    rest = stored(prefixes(sets, similarity), "prefixes")
    many = rest.count()
    for _ in range(2):  # rows that no other in the bucket can match leave it
        least = rest.groupBy("bucket").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        fits = reachable(F.col("n"), F.col("place"), F.greatest(F.col("least"), F.col("n") * F.lit(similarity)), similarity)
        rest = rest.join(least, "bucket").where(fits).select("bucket", "row", "n", "place", "rare")
    rest = _open_buckets(rest, labels, many)
    # the rows with the fewest rare shingles come first, the same in all buckets: what was edited from one text is like the least edited
    by, most = ["rare", "row"], CENTRAL
    while not rest.isEmpty():
        sizes = rest.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("rows"))
        order = F.row_number().over(W.partitionBy("bucket").orderBy(*by))
        chosen = rest.join(sizes, ["bucket", "component"]).withColumn("no", order).where(F.col("no") <= most)
        chosen = stored(few(chosen.select("bucket", F.struct("row", "n", "place", "component").alias("r")), many), "chosen")
        met = rest.join(chosen, "bucket").where((F.col("row") != F.col("r.row")) & (F.col("component") != F.col("r.component")))
        fits = reachable(F.col("n"), F.col("place"), F.col("r.n"), similarity) & reachable(F.col("r.n"), F.col("r.place"), F.col("n"), similarity)
        pairs = met.where(fits).select(F.greatest("row", "r.row").alias("a"), F.least("row", "r.row").alias("b")).distinct()
        found = stored(verified(pairs, sets, similarity, many), "links")
        forget(rows.sparkSession)
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
        left = rest.join(chosen.select("bucket", F.col("r.row").alias("row")), ["bucket", "row"], "left_anti")
        rest = _open_buckets(left.select("bucket", "row", "n", "place", "rare"), labels, many)
        # then members of the bucket's smallest components; they meet the other components only
        by, most = ["rows", "component", "row"], AT_ONCE
    discard(sets, active)
    return links, labels


def _open_buckets(members: DataFrame, labels: DataFrame, many: int) -> DataFrame:
    """``members`` (bucket, row, ...; at most ``many``) with their component, of the buckets that hold several components."""
    known = members.join(labels, F.col("row") == F.col("node"), "left").withColumn("component", F.coalesce("component", "row")).drop("node")
    several = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    return stored(few(known.join(several, "bucket"), many), "rest")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, n_links, text_hash, first (whether the row stands for its class); one row per document.

    n_links counts the links of the document's set to different sets that were verified to find the classes, not all there are.
    """
    rows = stored(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    many = rows.count()
    groups = stored(few(rows.where("n > 0").groupBy("high", "low").agg(F.min("row").alias("set_row")), many), "distinct-sets")
    narrow = rows.select("row", "doc_id", "text_hash", "high", "low", "n")
    members = narrow.join(groups, ["high", "low"], "left").select("row", "doc_id", "text_hash", F.when(F.col("n") > 0, F.col("set_row")).otherwise(F.col("row")).alias("set_row"))
    members = stored(few(members, many), "members")
    singles = groups.select(F.col("set_row").alias("row"))
    links, labels = linked(rows.select("row", "bands", "signature", "shingles"), singles, similarity)
    # what follows reads members, links and components only
    discard(rows)
    forget(rows.sparkSession)
    if links is None:
        per = members.withColumns({"class": F.col("set_row"), "n_links": F.lit(0).cast("long")})
    else:
        count = links.union(links.select("b", "a")).distinct().groupBy(F.col("a").alias("set_row")).agg(F.count(F.lit(1)).alias("n_links"))
        known = labels.select(F.col("node").alias("set_row"), F.col("component").alias("class")).join(count, "set_row", "left")
        per = members.join(known, "set_row", "left").withColumns({"class": F.coalesce("class", "set_row"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")})
    classes = per.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("head")
    )
    return per.join(classes, "class").select("doc_id", "class_id", "class_size", "n_links", "text_hash", (F.col("row") == F.col("head.row")).alias("first"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the least id; columns of ``docs``."""
    def keyed(df: DataFrame, text_hash: Column, *columns: Column) -> DataFrame:
        number = F.col("doc_id").cast("long")
        return df.select(*columns, F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("no_id"), text_hash.alias("hash"))

    heads = keyed(near_duplicates(docs, similarity).where("first"), F.col("text_hash")).distinct()
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    found = keyed(docs, F.xxhash64("text"), row).join(heads, ["id", "no_id", "hash"], "left_semi")
    # equal rows have equal heads: one of them stays; dealt as for the join, so rows move once
    one = F.row_number().over(W.partitionBy("id", "no_id", "hash").orderBy("hash"))
    return found.withColumn("no", one).where("no = 1").select("row.*")


def brute_force(texts: list[str | None], similarity: float = SIMILARITY) -> list[int]:
    """Plain reference for tests: class of each text as its least position."""
    sets = []
    for t in texts:
        ws = (t or "").encode().translate(WORD_BYTES).split()
        sets.append({tuple(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))} if ws else set())
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label
