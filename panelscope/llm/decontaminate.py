"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: a segment holds the postings (term, positions)
of a run of documents for the terms that test items use, and is one stored row.
Collection frequencies are summed over segments.  A query starts each window at
its rarest term's list and intersects it with the lists of the next rarest
terms, shifted by their offsets.  With exact offsets the matches are phrases;
with a tolerance they are proximity matches.

Cases: null or wordless texts are clean; items without words have no windows;
items that share an id count once; a null item id reads as ``null``; repeated
documents get a row each; empty tables are fine; extra columns are ignored.
The benchmark goes to each task in chunks of a checked size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.llm.common import fresh, rows_of, slices, stored, whole, words

WINDOW = 10
#: Bytes of item texts that one pass hands to each task.
CHUNK_BYTES = 16 << 20

SEGMENT = "doc_ids array<bigint>, hashes array<bigint>, n_words array<int>, terms array<int>, counts array<int>, gaps binary"
MATCHES = "doc_id bigint, text_hash bigint, n_words bigint, n_hit bigint, starts array<int>, ends array<int>, items array<string>, near array<string>"


def item_windows(items: list[tuple[str, bytes]], size: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Windows with the ids of the items that hold them."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            found.setdefault(tuple(ws[i : i + size]), set()).add(item)
    return {w: sorted(ids) for w, ids in found.items()}


def build_index(docs: DataFrame, terms: dict[bytes, int], key: str = "doc_id") -> DataFrame:
    """Segments of the positional index of ``docs`` for ``terms``; ``key`` is the integer that names a document."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("gaps", pa.binary())])
        for part in slices(batches):
            lengths, known = [], []
            for text in rows_of(part):
                ws = words(text)
                lengths.append(len(ws))
                known.append(np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws)))
            ids = np.concatenate(known)
            at = np.flatnonzero(ids >= 0)
            order = np.argsort(ids[at], kind="stable")
            at = at[order]
            used, counts = np.unique(ids[at], return_counts=True)
            gaps = np.diff(at, prepend=0)
            first = np.cumsum(counts) - counts
            gaps[first] = at[first]
            yield pa.RecordBatch.from_pylist(
                [{"doc_ids": part.column(0).to_pylist(), "hashes": part.column(2).to_pylist(), "n_words": lengths, "terms": used.tolist(), "counts": counts.tolist(), "gaps": gaps.astype("<i4").tobytes()}], schema
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, SEGMENT)


def query_plan(windows: dict[tuple[bytes, ...], list[str]], terms: dict[bytes, int], counts: dict[int, int]) -> list[tuple[np.ndarray, np.ndarray, list[list[str]]]]:
    """Per window length: term ids and offsets from the rarest on, and the items.  Windows with a term that never occurs are left out."""
    by_length: dict[int, list] = {}
    for window, ids in windows.items():
        numbers = [terms[w] for w in window]
        if all(n in counts for n in numbers):
            order = sorted(range(len(window)), key=lambda i: (counts[numbers[i]], i))
            by_length.setdefault(len(window), []).append(([numbers[i] for i in order], order, ids))
    return [(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]) for rows in by_length.values()]


class Segment:
    """Postings of one stored row as a sorted array of (term, position)."""

    def __init__(self, row: dict):
        self.doc_ids, self.hashes, self.n_words = row["doc_ids"], row["hashes"], np.array(row["n_words"], np.int64)
        self.ends = np.cumsum(self.n_words)
        self.size = int(self.n_words.sum())
        self.terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        self.stop = np.cumsum(counts)
        self.start = self.stop - counts
        total = np.cumsum(np.frombuffer(row["gaps"], "<i4").astype(np.int64))
        before = np.where(self.start > 0, total[np.maximum(self.start, 1) - 1], 0) if len(total) else np.zeros(0, np.int64)
        self.positions = total - np.repeat(before, counts)
        self.span = self.size + 1
        self.keys = np.repeat(self.terms, counts) * self.span + self.positions

    def list_bounds(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the lists of ``terms``, empty where the segment has none."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[k] == terms
        return np.where(there, self.start[k], 0), np.where(there, self.stop[k], 0)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, "right")

    def candidates(self, terms: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window number, position of its rarest term), at most about ``most`` at a time."""
        low, high = self.list_bounds(terms)
        for w in np.flatnonzero(high - low > most):
            for at in range(low[w], high[w], most):
                found = self.positions[at : min(high[w], at + most)]
                yield np.full(len(found), w), found
        count = np.where(high - low > most, 0, high - low)
        live, total = np.flatnonzero(count), np.cumsum(count)
        while len(live):
            base = total[live[0]] - count[live[0]]
            take = live[: max(1, int(np.searchsorted(total[live], base + most, "right")))]
            n = count[take]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(take, n), self.positions[np.repeat(low[take], n) + inner]
            live = live[len(take) :]

    def has(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term stands between two positions (both counted)."""
        low, high = np.maximum(low, 0), np.minimum(high, self.size)
        at = np.searchsorted(self.keys, terms * self.span + low)
        inside = at < len(self.keys)
        return inside & (self.keys[np.minimum(at, len(self.keys) - 1)] <= terms * self.span + high) & (low <= high)

    def phrases(self, terms: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of each exact occurrence."""
        length = terms.shape[1]
        for w, at in self.candidates(terms[:, 0]):
            start = at - offsets[w, 0]
            keep = (start >= 0) & (start + length <= self.size)
            w, start = w[keep], start[keep]
            for j in range(1, length):
                if not len(w):
                    break
                want = start + offsets[w, j]
                keep = self.has(terms[w, j], want, want)
                w, start = w[keep], start[keep]
            keep = self.doc_of(start) == self.doc_of(start + length - 1)
            yield w[keep], start[keep]

    def near(self, terms: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of the rarest term) where every other term stands within ``distance`` words in the document."""
        for w, at in self.candidates(terms[:, 0]):
            doc = self.doc_of(at)
            low, high = np.maximum(at - distance, self.ends[doc] - self.n_words[doc]), np.minimum(at + distance, self.ends[doc] - 1)
            for j in range(1, terms.shape[1]):
                if not len(w):
                    break
                keep = self.has(terms[w, j], low, high)
                w, at, low, high = w[keep], at[keep], low[keep], high[keep]
            yield w, at


def _pairs(docs: np.ndarray, windows: np.ndarray, items: list[list[str]], into: list[set]) -> None:
    for code in np.unique(docs * len(items) + windows).tolist():
        into[code // len(items)].update(items[code % len(items)])


def search(segments: DataFrame, windows: dict, terms: dict[bytes, int], near: int = 20) -> DataFrame:
    """Per document of the index: words, hit words and their runs, items found as phrases and in proximity."""
    counted = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("n"))
    counts = dict(counted.collect())  # at most one row per term of the benchmark chunk
    shared = segments.sparkSession.sparkContext.broadcast(query_plan(windows, terms, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
        for batch in whole(batches):
            for k in range(batch.num_rows):
                seg = Segment(batch.slice(k, 1).to_pylist()[0])
                n = len(seg.doc_ids)
                found: list[set] = [set() for _ in range(n)]
                close: list[set] = [set() for _ in range(n)]
                edge = np.zeros(seg.size + 1, np.int64)
                for ids, offsets, items in shared.value:
                    for w, start in seg.phrases(ids, offsets):
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + ids.shape[1], -1)
                        _pairs(seg.doc_of(start), w, items, found)
                    for w, at in seg.near(ids, near):
                        _pairs(seg.doc_of(at), w, items, close)
                hit = np.cumsum(edge[:-1]) > 0
                # runs of hit words; no run passes the end of its document
                turn = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                first = np.flatnonzero(turn == 1)
                last = np.flatnonzero(turn == -1)
                inner = seg.ends[:-1]
                split = inner[(inner > 0) & (inner < seg.size)]
                split = split[hit[split] & hit[split - 1]] if len(split) else split
                first, last = np.sort(np.concatenate([first, split])), np.sort(np.concatenate([last, split]))
                owner, begin = seg.doc_of(first), seg.ends - seg.n_words
                bounds = np.searchsorted(owner, np.arange(n + 1))
                rows = []
                for d in range(n):
                    s, e = first[bounds[d] : bounds[d + 1]] - begin[d], last[bounds[d] : bounds[d + 1]] - begin[d]
                    rows.append({"doc_id": seg.doc_ids[d], "text_hash": seg.hashes[d], "n_words": int(seg.n_words[d]), "n_hit": int((e - s).sum()), "starts": s.tolist(), "ends": e.tolist(), "items": sorted(found[d]), "near": sorted(close[d])})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return segments.mapInArrow(run, MATCHES)


def _chunks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Item texts in chunks of at most ``most`` bytes (one item at least), none left out."""
    chunk, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        data = row["t"].encode()
        if chunk and size + len(data) > most:
            yield chunk
            chunk, size = [], 0
        chunk.append((row["i"], data))
        size += len(data)
    yield chunk


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, near: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """MATCHES rows, one per document.  A benchmark beyond one chunk is searched chunk by chunk and the runs are merged."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= chunk_bytes:
        return _pass(docs, next(_chunks(benchmark, total + 1)), size, near)
    rows = stored(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    parts = None
    for chunk in _chunks(benchmark, chunk_bytes):
        part = _pass(rows, chunk, size, near, "row")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("text_hash").alias("text_hash"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
    )
    empty = F.array().cast("array<struct<starts:int,ends:int>>")

    def step(a, r):
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], r["ends"]).alias("ends"))))
        return F.when((F.size(a) > 0) & (r["starts"] <= F.try_element_at(a, F.lit(-1))["ends"]), joined).otherwise(F.concat(a, F.array(r)))

    union = merged.withColumn("runs", F.aggregate("runs", empty, step))
    return union.join(rows.select("row", "doc_id"), "row").select(
        "doc_id", "text_hash", "n_words", F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["ends"] - r["starts"]).alias("n_hit"),
        F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"), "items", "near",
    )


def _pass(docs: DataFrame, items: list[tuple[str, bytes]], size: int, near: int, key: str = "doc_id") -> DataFrame:
    windows = item_windows(items, size)
    terms = {w: i for i, w in enumerate(sorted({w for window in windows for w in window}))}
    segments = stored(build_index(docs, terms, key), "positional-index")
    return search(segments, windows, terms, near)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""
    return matches(docs, benchmark, **options).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near_items"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without a hit word; all columns.  Rows go by id and text, so clean rows of the same id or without one stay."""
    row_id, row_hash, bad_id, bad_hash = map(fresh, ("id", "hash", "bad_id", "bad_hash"))
    bad = matches(docs, benchmark, **options).where("n_hit > 0").select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    rows = docs.withColumns({row_id: F.col("doc_id").cast("long"), row_hash: F.xxhash64("text")})
    return rows.join(bad, F.col(row_id).eqNullSafe(F.col(bad_id)) & (F.col(row_hash) == F.col(bad_hash)), "left_anti").select(*docs.columns)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], size: int = WINDOW) -> list[tuple]:
    """Plain reference for tests: (doc_id, n_words, n_hit, n_items, sha)."""
    windows = item_windows([("null" if i is None else str(i), (t or "").encode()) for i, t in items], size)
    out = []
    for doc, text in docs:
        ws = words((text or "").encode())
        hit, ids = set(), set()
        for window, owners in windows.items():
            for i in range(len(ws) - len(window) + 1):
                if tuple(ws[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    ids.update(owners)
        out.append((doc, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return out


ORACLE = """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, array_to_string(ws[i : i + 9], ' ') AS win, least(len(ws), 10) AS n
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item_words WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc_words, lengths WHERE len(ws) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, w.item FROM doc_windows d JOIN item_windows w USING (win, n)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
