"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index of all words of the examples.

A bounded sample of labelled rows (``examples``), drawn per label so that a rare
one is there too, forms the index.  A vector has two fields, each TF-IDF of unit
length: all words, at (1 + ln of their count) times idf, and toxic-leaning terms.
The latter are words and word beginnings of 5 to 7 characters that stand out in
toxic examples, each in steps of how often it occurs (1, 2, 4, 8, 16 times) and
how often per 1,000 words (2, 5, 10, 20, 50); words hold ``PLAIN`` of the squared
length where both are there.  Inverse document frequencies cover all documents.

Examples lie in blocks of ``SIZE``, similar ones together.  Rare terms have
postings and are added up at once; a frequent term has a slice of weights per
block and the greatest weight of each block.  A block whose bound (rare part plus
greatest weights) is below the k-th best score known is skipped, so the result
is exact; all that may be among the k best are compared again in full precision.
Votes are weighted by nearness and calibrated by the examples' own leave-one-out
votes (isotonic regression, each label in its share of all labelled rows);
examples with the very terms of a text count with it.  Neighbours are the evidence.

Cases: null and empty texts, and texts that share no word with an example, get
the calibrated share of examples without words; without labels all scores are
0; a null id counts as held out; repeated documents get a row each, and equal
ones are one example; repeated labels of an id count once (toxic if any says
so); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm.common import rows_of, slices, stored, words
from panelscope.llm.language import remainder

#: About so many labelled rows form the index.
EXAMPLES = 12_000
#: Least G statistic of a term that counts more.
LEAST_G = 25.0
NEIGHBOURS = 25
#: A term of more than this share of the examples is frequent.
OFTEN = 1 / 24
#: Examples of a block.
SIZE = 128
#: Blocks with the highest bounds, scored first to learn how good the k-th best is.
FIRST = 4
#: Queries compared at once.
BLOCK = 256
#: Bound of the rounding errors of a similarity in single precision.
SLACK = 1e-5
#: Share of plain words in the squared length of a vector that has toxic-leaning terms too.
PLAIN = 0.1
COUNTS = (1, 2, 4, 8, 16)
RATES = (2, 5, 10, 20, 50)
THRESHOLD = 0.3


def bases(word: bytes) -> list[str]:
    """The word itself and its beginnings."""
    text = word.decode(errors="replace")
    return [text, *(f"{text[:k]}*" for k in (5, 6, 7) if len(text) > k)]


def steps(counts: dict, total: int) -> Iterator[tuple]:
    """(base, kind and step) of all steps that counts of bases reach in a text of ``total`` words."""
    for base, n in counts.items():
        for c in COUNTS:
            if n < c:
                break
            yield base, c
        for r in RATES:
            if n * 1000 < r * total:
                break
            yield base, -r


def count_bases(text: bytes, of: Callable[[bytes], Iterable[str]] = bases) -> tuple[Counter, int]:
    """How often each base of a text occurs, and its number of words."""
    ws = words(text)
    out: Counter = Counter()
    for w, n in Counter(ws).items():
        for base in of(w):
            out[base] += n
    return out, len(ws)


class Index(NamedTuple):
    """Examples' vectors by example; rare terms in postings, frequent ones in blocks with their greatest weights."""

    bounds: np.ndarray  # n + 1, of an example's terms
    terms: np.ndarray
    weights: np.ndarray
    row: np.ndarray  # row of a frequent term, or -1
    blocks: np.ndarray  # block, row, place in the block: weight
    most: np.ndarray  # row, block: greatest weight
    start: np.ndarray  # terms + 1, of a rare term's postings
    places: np.ndarray
    values: np.ndarray
    order: np.ndarray  # example at each place
    n: int


def build_index(vectors: list[tuple[np.ndarray, np.ndarray]], features: int) -> Index:
    """``vectors``: (features, unit weights) of each example."""
    n, sizes = len(vectors), np.array([len(v[0]) for v in vectors], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    at = np.concatenate([v[0] for v in vectors]).astype(np.int64) if n else np.zeros(0, np.int64)
    value = np.concatenate([v[1] for v in vectors]) if n else np.zeros(0)
    often = np.flatnonzero(np.bincount(at, minlength=features) > n * OFTEN)
    row = np.full(features, -1, np.int64)
    row[often] = np.arange(len(often))
    high, count = row[at] >= 0, -(-n // SIZE)
    dense = np.zeros((len(often), n), np.float32)
    dense[row[at[high]], doc[high]] = value[high]
    # similar examples next to each other: by the most similar of a few, then by that similarity
    few = dense[:, :: max(1, n // 64)].T @ dense if n else np.zeros((1, 0))
    order = np.lexsort((few.max(axis=0), few.argmax(axis=0)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    padded = np.zeros((len(often), count * SIZE), np.float32)
    padded[:, :n] = dense[:, order]
    blocks = np.ascontiguousarray(padded.reshape(len(often), count, SIZE).transpose(1, 0, 2))
    rare = np.flatnonzero(~high)
    rare = rare[np.argsort(at[rare], kind="stable")]
    start = np.searchsorted(at[rare], np.arange(features + 1))
    return Index(np.append(0, np.cumsum(sizes)), at.astype(np.int32), value, row, blocks, blocks.max(axis=2).T if count else np.zeros((len(often), 0), np.float32),
                 start, place[doc[rare]], value[rare].astype(np.float32), order, n)


def runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers of all ranges, one range after the other."""
    n = high - low
    ends = np.cumsum(n)
    out = np.repeat(low - ends + n, n)
    out += np.arange(len(out))
    return out


def nearest_of(index: Index, queries: list[tuple[np.ndarray, np.ndarray]], k: int, leave_out: list[int] | None = None, met: list[int] | None = None) -> Iterator[list[tuple[float, int]]]:
    """Per query (features, weights) the k most similar examples with a similarity above 0, best first, ties to smaller numbers; exact.

    ``met`` gets the number of blocks scored for each query.
    """
    wanted, count = np.zeros(len(index.row)), len(index.blocks)
    place = np.empty(index.n, np.int64)
    place[index.order] = np.arange(index.n)
    for base in range(0, len(queries), BLOCK):
        part = queries[base : base + BLOCK]
        often, score = np.zeros((len(part), index.blocks.shape[1]), np.float32), np.zeros((len(part), count, SIZE), np.float32)
        for i, (at, weight) in enumerate(part):
            row = index.row[at]
            often[i, row[row >= 0]] = weight[row >= 0]
            low, high = index.start[at], index.start[at + 1]
            there = runs(low, high)
            if len(there):
                add = np.repeat(weight, high - low)
                add *= index.values.take(there, mode="clip")
                score[i] = np.bincount(index.places.take(there, mode="clip"), add, count * SIZE).reshape(count, SIZE)
        bound = often @ index.most + score.max(axis=2, initial=0)
        skip = np.array([-1 if leave_out is None or leave_out[base + i] < 0 else place[leave_out[base + i]] for i in range(len(part))])
        done = np.zeros((len(part), count), bool)

        def kth(i: int) -> float:
            some = score[i][done[i]].ravel()
            own = skip[i] >= 0 and done[i, skip[i] // SIZE]
            return float(np.partition(some, len(some) - k - own)[len(some) - k - own]) - SLACK if len(some) >= k + own else 0.0

        np.put_along_axis(done, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        for b in np.flatnonzero(done.any(axis=0)):
            own = np.flatnonzero(done[:, b])
            score[own, b] += often[own] @ index.blocks[b]
        least = np.array([kth(i) for i in range(len(part))])
        for b in range(count):
            left = np.flatnonzero(~done[:, b] & (bound[:, b] + SLACK >= least))
            if len(left):
                score[left, b] += often[left] @ index.blocks[b]
                done[left, b] = True
        for i, (at, weight) in enumerate(part):
            if met is not None:
                met.append(int(done[i].sum()))
            may = (score[i] >= kth(i)) & (score[i] > 0) & done[i][:, None]
            if skip[i] >= 0:
                may[skip[i] // SIZE, skip[i] % SIZE] = False
            may = np.sort(index.order[np.flatnonzero(may.ravel())])
            wanted[at] = weight
            low, high = index.bounds[may], index.bounds[may + 1]
            there = runs(low, high)
            product = wanted.take(index.terms.take(there, mode="clip"), mode="clip")
            product *= index.weights.take(there, mode="clip")
            # a candidate has a term at least: its score is above 0
            exact = np.add.reduceat(product, np.cumsum(high - low) - (high - low)).round(12) if len(may) else np.zeros(0)
            wanted[at] = 0
            best = np.lexsort((may, -exact))[:k]
            yield [(s, m) for s, m in zip(exact[best].tolist(), may[best].tolist()) if s > 0]


def nearest(index: Index, at: np.ndarray, weight: np.ndarray, k: int, leave_out: int = -1) -> list[tuple[float, int]]:
    """``nearest_of`` one query."""
    return next(nearest_of(index, [(at, weight)], k, [leave_out]))


def vote(found: list[tuple[float, int]], toxic: np.ndarray) -> float:
    """Share of toxic neighbours, nearer ones counting more."""
    weight = np.array([1 / (1.05 - min(s, 1.0)) for s, _ in found])
    return float(weight @ toxic[[i for _, i in found]] / weight.sum())


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: upper ends of steps and their values."""
    weight = np.ones(len(x)) if weight is None else weight
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, upper end
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        if pools and pools[-1][2] == a:
            pools[-1] = [pools[-1][0] + b * c, pools[-1][1] + c, a]
        else:
            pools.append([b * c, c, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, end = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, end]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Dictionary:
    """Numbers of words from ``first`` on; packed while it travels."""

    def __init__(self, vocabulary: list[bytes], first: int):
        self.packed, self.size, self.first = zlib.compress(b"\n".join(vocabulary), 1), len(vocabulary), first

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "numbers"}

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(zlib.decompress(self.packed).split(b"\n"), self.first)}


class Calibration(NamedTuple):
    """What a vote says."""

    ends: np.ndarray
    values: np.ndarray
    without: float  # for texts that have no neighbour


class Model:
    """Examples; the index is made where it is used, once per worker."""

    def __init__(self, features: int, idf: np.ndarray, rows: list[dict]):
        self.features, self.idf = features, idf
        self.found = [unpacked(r["found"]) for r in rows]
        self.ids = [r["doc_id"] for r in rows]
        self.toxic = np.array([float(r["toxic"] > 0) for r in rows])
        self.weight = np.array([r["weight"] for r in rows])  # labelled rows that an example stands for

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    @cached_property
    def index(self) -> Index:
        return build_index([joined(f, self.idf, self.features) for f in self.found], len(self.idf))


def unit(at, idf: np.ndarray, times=1) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF vector of unit length; ``at`` ascends."""
    at = np.asarray(at, np.int64)
    w = idf[at] * (1 + np.log(times))
    return at, w / max(float(np.sqrt(w @ w)), 1e-12)


def unpacked(found: bytes) -> np.ndarray:
    """Two rows: terms, ascending, and how often each occurs."""
    return np.frombuffer(found, np.int32).reshape(2, -1)


def joined(found: np.ndarray, idf: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vector of toxic-leaning terms (numbers below ``features``) and words, ``PLAIN`` of it words."""
    at, times = found[0].astype(np.int64), found[1]
    cut = int(np.searchsorted(at, features))
    some, rest = unit(at[:cut], idf)[1], unit(at[cut:], idf, times[cut:])[1]
    if cut and cut < len(at):
        some, rest = some * np.sqrt(1 - PLAIN), rest * np.sqrt(PLAIN)
    return at, np.concatenate([some, rest])


def sample_labelled(docs: DataFrame, labels: DataFrame, examples: int) -> DataFrame:
    """doc_id, toxic, text, weight of about ``examples`` labelled rows that may be learned from.

    Half of them are toxic, or all toxic ones where there are fewer, and the
    other way round; ``weight`` is how many labelled rows one stands for.
    """
    able = labels.where((F.coalesce(remainder(F.col("doc_id"), 4), F.lit(2)) != 2) & F.col("toxic").isNotNull())
    one = able.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = one.agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(~(F.col("toxic") > 0)).alias("c")).first()

    def share(own: int, other: int) -> float:
        return min(1.0, max(examples / 2, examples - other) / max(1, own))

    part = F.when(F.col("toxic") > 0, share(total["t"], total["c"])).otherwise(share(total["c"], total["t"]))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 11) / F.lit(float(1 << 53))
    # hard bounds, far above what is drawn: of ids, and of different texts where ids repeat
    ids = stored(one.withColumn("part", part).where(draw < F.col("part")).orderBy(draw, "doc_id").limit(2 * examples), "toxicity-ids")
    key, order = F.xxhash64("text").alias("key"), F.xxhash64(F.lit(19), "doc_id", "key")
    rows = docs.select("doc_id", "text", key).join(F.broadcast(ids), "doc_id")
    keys = stored(rows.select("doc_id", "key").distinct().orderBy(order, "doc_id", "key").limit(2 * examples), "toxicity-keys")
    texts = rows.join(F.broadcast(keys), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"), F.first("part").alias("part"))
    return stored(texts.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text", (1 / F.col("part")).alias("weight")), "toxicity-examples")


def g_statistic(clean: Column, toxic: Column, n0: float, n1: float) -> Column:
    """Of a term in ``clean`` of ``n0`` and ``toxic`` of ``n1`` examples."""

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, every = n0 + n1, clean + toxic
    return 2 * (
        term(toxic, every * n1 / n) + term(clean, every * n0 / n) + term(n1 - toxic, (n - every) * n1 / n) + term(n0 - clean, (n - every) * n0 / n)
    )


def choose_features(sample: DataFrame, least: float = LEAST_G) -> list[tuple[str, int]]:
    """Steps that occur more in toxic examples, by G statistic.

    A step is in no more toxic examples than its base, and its G statistic is
    greatest where no clean one has it: bases that cannot reach ``least`` even
    so are left out before steps are counted.
    """

    def count_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for part in slices(batches):
            for text in rows_of(part):
                count.update(count_bases(text)[0].keys())
            if len(count) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["base", "toxic"])
                count = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["base", "toxic"])

    def rows(count: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.int32()), pa.array([v[0] for v in count.values()], pa.int64()), pa.array([v[1] for v in count.values()], pa.int64())],
            names=["base", "step", "clean", "toxic"],
        )

    total = sample.agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") > 0).alias("t")).first()
    n0, n1 = float(total["c"]), float(total["t"])
    if not n0 or not n1:
        return []
    some = sample.where("toxic > 0").select("text").mapInArrow(count_toxic, "base string, toxic bigint").groupBy("base").agg(F.sum("toxic").alias("b"))
    some = some.where(g_statistic(F.lit(0.0), F.col("b"), n0, n1) >= least - 1e-6)
    # bounded by the sample
    able = sample.sparkSession.sparkContext.broadcast(frozenset(some.select("base").toArrow().column(0).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple, list[int]] = {}
        wanted, known = able.value, {}

        def of(w: bytes) -> tuple:
            if w not in known:
                known[w] = tuple(b for b in bases(w) if b in wanted)
            return known[w]

        for part in slices(batches):
            for toxic, text in zip(part.column(0).to_pylist(), rows_of(part)):
                for step in steps(*count_bases(text, of)):
                    count.setdefault(step, [0, 0])[int(toxic > 0)] += 1
            if len(known) > 400_000:
                known.clear()
        yield rows(count)  # a few steps per base

    part = sample.select("toxic", "text").mapInArrow(run, "base string, step int, clean bigint, toxic bigint").groupBy("base", "step").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    best = part.where((F.col("b") / n1 > 2 * F.col("a") / n0) & (g_statistic(F.col("a"), F.col("b"), n0, n1) >= least))
    return sorted((r["base"], r["step"]) for r in best.select("base", "step").collect())


def vocabulary_of(sample: DataFrame) -> list[bytes]:
    """All words of the sample, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[bytes] = set()
        for part in slices(batches):
            found.update(*map(words, rows_of(part)))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(b"\n".join(sorted(found)), 1)], pa.binary())], names=["words"])

    # bounded by the sample
    parts = sample.select("text").mapInArrow(run, "words binary").toArrow().column(0).to_pylist()
    return sorted(set().union(*(zlib.decompress(p).split(b"\n") for p in parts)) - {b""})


def pack(found: np.ndarray) -> bytes:
    """``found`` in few bytes: gaps between terms, and counts."""
    both = found.copy()
    both[0, 1:] = np.diff(found[0])
    return zlib.compress(both.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    both = np.frombuffer(zlib.decompress(packed), np.int32).reshape(2, -1).copy()
    both[0] = np.cumsum(both[0])
    return both


def number_texts(docs: DataFrame, terms: Broadcast) -> DataFrame:
    """doc_id, held_out, found: each text read once, as a table of its packed terms; null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(*terms.value)
        for part in slices(batches):
            found = pa.array([pack(known.numbers(text)) for text in rows_of(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["doc_id", "held_out", "found"])

    held = (F.coalesce(remainder(F.col("doc_id"), 4), F.lit(2)) == 2).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long"), held, "text")
    return stored(rows.mapInArrow(run, "doc_id bigint, held_out boolean, found binary"), "toxicity-terms")


def inverse_frequencies(numbered: DataFrame, size: int) -> np.ndarray:
    """Over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size + 1, np.int64)
        for part in batches:
            for packed in part.column(0).to_pylist():
                count[unpack(packed)[0]] += 1
            count[size] += part.num_rows
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["feature", "n"])

    rows = numbered.select("found").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(size + 1)
    n[rows.column("feature").to_numpy()] = rows.column("n").to_numpy()
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 0.05


class Words:
    """A text's toxic-leaning steps and words: numbers and counts; what a word stands for is remembered."""

    def __init__(self, feature: dict, vocabulary: Dictionary):
        self.vocabulary, self.known = vocabulary.numbers, {}
        #: steps of each base: least count or, below 0, least rate, and number
        self.steps: dict[str, list[tuple[int, int]]] = {}
        for (base, step), k in feature.items():
            self.steps.setdefault(base, []).append((step, k))
        #: first characters of the bases: most words that come once begin with none of them
        self.heads = {base[:5].encode() for base in self.steps}

    def numbers(self, text: bytes) -> np.ndarray:
        ws = words(text)
        if len(self.known) > 400_000:
            self.known = {}
        counts: dict[str, int] = {}
        known, at, times, total = self.known, [], [], len(ws)
        for w, n in Counter(ws).items():
            found = known.get(w)
            if found is None:
                able = not w.isascii() or w[:5] in self.heads
                known[w] = found = self.vocabulary.get(w), tuple(b for b in bases(w) if b in self.steps) if able else ()
            k, own = found
            for b in own:
                counts[b] = counts.get(b, 0) + n
            if k is not None:
                at.append(k)
                times.append(n)
        for b, n in counts.items():
            for step, k in self.steps[b]:
                if n >= step if step > 0 else n * 1000 >= -step * total:
                    at.append(k)
                    times.append(1)
        both = np.array([at, times], np.int32)
        return both[:, both[0].argsort()]


def votes_of_examples(spark: SparkSession, shared: Broadcast, n: int, neighbours: int) -> np.ndarray:
    """Each example's vote without itself; NaN where nothing is near.  Workers vote in runs of examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in batches:
            own = part.column(0).to_pylist()
            vectors = [joined(model.found[i], model.idf, model.features) for i in own]
            votes = [vote(found, model.toxic) if found else float("nan") for found in nearest_of(model.index, vectors, neighbours, own)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(votes, pa.float64())], names=["id", "vote"])

    # bounded by the sample
    rows = spark.range(0, n, 1, max(1, min(64, n // 256))).mapInArrow(run, "id bigint, vote double").toArrow()
    out = np.full(n, np.nan)
    out[rows.column("id").to_numpy()] = rows.column("vote").to_numpy()
    return out


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> tuple[Broadcast, Broadcast, Calibration] | None:
    """Terms, model and what its votes say."""
    learned = learn_and_number(docs, labels, examples, neighbours)
    return learned and learned[:3]


def learn_and_number(docs: DataFrame, labels: DataFrame, examples: int, neighbours: int) -> tuple[Broadcast, Broadcast, Calibration, DataFrame] | None:
    """``learn``, and the table of ``number_texts``."""
    spark = docs.sparkSession
    sample = sample_labelled(docs, labels, examples)
    feature = {f: i for i, f in enumerate(choose_features(sample))}
    vocabulary = Dictionary(vocabulary_of(sample), len(feature))
    terms = spark.sparkContext.broadcast((feature, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(*terms.value)
        for part in slices(batches):
            found = pa.array([known.numbers(t).tobytes() for t in rows_of(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), found], names=["doc_id", "toxic", "weight", "found"])

    # bounded by the sample
    rows = sample.mapInArrow(run, "doc_id bigint, toxic int, weight double, found binary").toArrow().to_pylist()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["found"]))
    numbered = number_texts(docs, terms)
    idf = inverse_frequencies(numbered, len(feature) + vocabulary.size)
    none, some = [r for r in rows if not r["found"]], [r for r in rows if r["found"]]
    model = Model(len(feature), idf, some)
    shared, toxic, weight = spark.sparkContext.broadcast(model), model.toxic, model.weight
    own = votes_of_examples(spark, shared, len(some), neighbours)
    at = np.flatnonzero(~np.isnan(own))
    ends, values = isotonic(own[at], toxic[at], weight[at]) if len(at) else (np.zeros(1), np.zeros(1))
    without = (sum(r["weight"] * (r["toxic"] > 0) for r in none) + 0.5) / (sum(r["weight"] for r in none) + 5)
    return terms, shared, Calibration(ends, values, without), numbered


def scores_of(model: Model, says: Calibration, found: list[np.ndarray], neighbours: int) -> Iterator[tuple[float, list[int]]]:
    vectors = [joined(f, model.idf, model.features) for f in found]
    for near in nearest_of(model.index, vectors, neighbours):
        if near:
            k = min(int(np.searchsorted(says.ends, vote(near, model.toxic))), len(says.ends) - 1)
            value, same = float(says.values[k]), [i for sim, i in near if sim >= 1 - 1e-9]
            if same:
                # examples with the same terms say most, the vote counts as one more of them
                own = model.weight[same]
                value = float((own @ model.toxic[same] + own.mean() * value) / (own.sum() + own.mean()))
            yield value, [model.ids[i] for _, i in near[:3]]
        else:
            yield says.without, []


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples); one row per document."""
    learned = learn_and_number(docs, labels, examples, neighbours)
    if not learned:
        held = (F.coalesce(remainder(F.col("doc_id"), 4), F.lit(2)) == 2).alias("held_out")
        return docs.select(F.col("doc_id").cast("long"), held, F.lit(0.0).alias("score"), F.lit(int(threshold <= 0)).alias("predicted"), F.array().cast("array<bigint>").alias("evidence"))
    _, shared, says, numbered = learned
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, {}
        for part in slices(batches, "found"):
            found = part.column(2).to_pylist()
            keys = [hashlib.blake2b(f, digest_size=16).digest() for f in found]
            if len(seen) > 50_000:
                seen.clear()
            new = {k: unpack(f) for k, f in zip(keys, found) if k not in seen}
            seen.update(zip(new, scores_of(model, says, list(new.values()), neighbours)))
            results = [seen[k] for k in keys]
            scores = [min(1.0, max(0.0, s)) for s, _ in results]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([e for _, e in results], pa.list_(pa.int64()))],
                schema=schema,
            )

    return numbered.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, evidence array<bigint>")
