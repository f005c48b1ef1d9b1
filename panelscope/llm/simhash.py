"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint holds the majority bits of the XXH64 values of its word
shingles.  Fingerprints at most ``RADIUS`` bits apart are linked, classes are
the connected components.  Documents with equal fingerprints are one node.

Covering masks: every bit position has a non-zero vector phi of RADIUS + 1 bits,
all of them used equally often.  The mask of a non-zero v keeps the positions
with <phi, v> = 1 (mod 2).  Two fingerprints differ in at most RADIUS positions;
some v is orthogonal to the phi of all of them, and under its mask they are
equal: every such pair meets in one of 2^(RADIUS + 1) - 1 tables.

Buckets of at most ``BUCKET`` fingerprints are compared in one task, which
gives one link per fingerprint to the least one it reaches.  All fingerprints
of larger buckets go another exact way: two of them are at most 2 bits apart
exactly if some value is within one bit of both, so each is filed under its 65
values within one bit, and those filed under one value (65 at most) are linked.
No bucket is cut, no pairs of a bucket are emitted.

Cases: null and empty texts have the fingerprint zero and are linked like any
other; fewer than three words: the whole sequence is the one shingle; repeated
rows stay, one result each; rows without id have a class as well, and a class
in which none has an id has a null component_id; an empty table gives no rows;
extra columns are ignored; texts are read whole, their shingles in runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.llm.common import release, rows_of, slices, stored
from panelscope.llm.graph import components

#: Words of a shingle; bits that linked fingerprints may differ in; seed of the hash.
SHINGLE, RADIUS, SEED = 3, 2, 42
BITS = 64
#: Fingerprints of a bucket that are compared with each other.
BUCKET = 64
#: Shingles hashed at once.
RUN = 1 << 15

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_of(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased ``text`` with single spaces between its words, and where words start and end there."""
    raw = np.frombuffer(text.translate(LOWER), np.uint8)
    space = SPACE[raw]
    # of a run of white space the first character stays
    keep = ~space
    keep[1:] |= ~space[:-1]
    flat = np.where(space, np.uint8(32), raw)[keep].tobytes().strip(b" ")
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    return flat, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(flat)]])


def fingerprint(text: bytes) -> int:
    """Bits set in over half of the hashes of the shingles of ``text``; 0 for a text without words."""
    flat, starts, ends = words_of(text)
    if not flat:
        return 0
    size = min(SHINGLE, len(starts))
    starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), RUN):
        spans = zip(starts[i : i + RUN].tolist(), ends[i : i + RUN].tolist())
        h = np.array([xxhash.xxh64_intdigest(flat[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f (the 64 bits as a bigint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f = np.array([fingerprint(t) for t in rows_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f)], names=["doc_id", "f"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, f bigint")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius + 1) - 1 masks; any ``radius`` positions are all outside one of them at least."""
    every = range(1, 1 << (radius + 1))
    phi = [every[i % len(every)] for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in every]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(members: np.ndarray) -> list[tuple[int, int]]:
    """(fingerprint, least one reached) among ``members`` of a bucket, for those that reach a smaller one."""
    apart = np.bitwise_count((members[:, None] ^ members[None]).view(np.uint64))
    label, near = np.arange(len(members)), apart <= RADIUS
    while True:
        after = np.where(near, label[None], len(members)).min(axis=1)
        if (after == label).all():
            return [(int(m), int(members[x])) for m, x in zip(members, label) if m != members[x]]
        label = after


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``nodes`` (f) whose components are those of all pairs within the radius."""
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("f").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(covering_masks())])
    filed = nodes.select("f", F.explode(tables).alias("b")).select("b.table", "b.key", "f")
    place = F.row_number().over(W.partitionBy("table", "key").orderBy("f"))
    # one more than are compared shows that a bucket is larger
    held = filed.withColumn("no", place).where(F.col("no") <= bucket + 1).groupBy("table", "key").agg(F.collect_list("f").alias("members"))
    buckets = stored(held.where(F.size("members") > 1), "buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for members in batch.column(0).to_pylist() for x in stars(np.array(sorted(members), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(2)], names=["a", "b"])

    found = buckets.where(F.size("members") <= bucket).select("members").mapInArrow(compare, "a bigint, b bigint")
    large = buckets.where(F.size("members") > bucket).select("table", "key")
    if large.isEmpty():
        return found
    crowded = filed.join(large, ["table", "key"], "left_semi").select("f").distinct()
    around = F.concat(F.array("f"), F.array(*[F.col("f").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)]))
    shared = crowded.select("f", F.explode(around).alias("m")).groupBy("m").agg(F.collect_list("f").alias("members")).where(F.size("members") > 1)
    least = shared.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b")
    return found.union(least)


def simhash_classes(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id of the component); one row per document."""
    rows = stored(fingerprints(docs), "fingerprints")
    nodes = stored(rows.groupBy("f").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    labels = components(stored(links(nodes.select("f"), bucket), "fingerprint-links"))
    known = nodes.join(labels, F.col("f") == F.col("node"), "left").select("f", "first", F.coalesce("component", "f").alias("component"))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = known.join(least, "component").select("f", "component_id")
    return rows.join(classes, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str, int | None]]:
    """Plain version for tests."""
    prints = []
    for _, text in docs:
        ws = [w.decode() for w in (text or "").encode().translate(LOWER).split()]
        grams = [" ".join(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))] if ws else []
        h = [xxhash.xxh64_intdigest(g, seed=SEED) for g in grams]
        prints.append(sum(1 << i for i in range(BITS) if 2 * sum(x >> i & 1 for x in h) > len(h)))
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= RADIUS and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min((d for (d, _), y in zip(docs, label) if y == x and d is not None), default=None) for x in set(label)}
    return [(d, f"{p:016x}", least[x]) for (d, _), p, x in zip(docs, prints, label)]
