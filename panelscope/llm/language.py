"""Language identification: multinomial logistic regression on character n-grams.

Features are hashed character n-grams (1 to 4 letters, lower case, everything
but letters a space) weighted by term frequency and inverse document frequency,
scaled to a fixed sum.  Document frequencies cover all documents to learn from.
Weights are fitted on a bounded sample of different texts (``per_language``,
often copied ones likelier, one of every language at least) by
follow-the-regularised-leader with L1 and L2 penalties, so most are zero; a part
of the sample sets the temperature of the probabilities.

As a score is linear in the features, a text's logits are sums of table rows
over its positions; no text needs a sparse vector of its own.

Cases: null texts and texts without letters are ``und`` with score 0; without
anything to learn from all are; a null id counts as held out; repeated rows get
a row each; extra columns are ignored; long texts are read whole, in runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelscope.llm.common import fresh, slices, stored

SIZES = (1, 2, 3, 4)
#: Hash values per n-gram size.
WIDTH = 1 << 16
#: What a document's features add up to.
SCALE = 30.0
#: At most so many different texts of each language are fitted on.
PER_LANGUAGE = 400
UNKNOWN = "und"

_ASCII = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where the n-grams of each start and where they end.

    A space stands before a text and so many after it that no n-gram reaches the next.
    """
    low = [t.lower() for t in texts]
    joined = "".join(" " + t + " " * (max(SIZES) - 1) for t in low)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 128, _ASCII[np.minimum(code, 127)], code)
    sizes = np.array([len(t) for t in low], np.int64)
    starts = np.append(0, np.cumsum(sizes + max(SIZES)))[:-1]
    return code, starts, starts + sizes + 1


def grams(code: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram size the hash (uint16) of the n-gram that starts at each code point."""
    spread = code * _PRIMES[0]
    total = np.zeros(len(code), np.uint32)
    for n in range(len(SIZES)):
        shifted = np.zeros(len(code), np.uint32)
        shifted[: len(code) - n] = spread[n:]
        total = (total ^ (shifted + np.uint32(n))) * _PRIMES[n] + (total >> np.uint32(13))
        if n + 1 in SIZES:
            yield ((total ^ total >> np.uint32(15)) * _PRIMES[1] >> np.uint32(16)).astype(np.uint16)


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # per feature: idf, then idf times the weight of each language
    bias: np.ndarray
    temperature: float


def sums(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Row sums of ``table`` over all n-grams of each text."""
    code, starts, ends = letters(texts)
    out = np.zeros((len(texts), table.shape[1]))
    for n, h in enumerate(grams(code)):
        part = table[n * WIDTH : (n + 1) * WIDTH]
        for lo in range(0, len(texts), 64):
            hi = min(lo + 64, len(texts))
            a, b = starts[lo], ends[hi - 1]
            cuts = np.stack([starts[lo:hi], ends[lo:hi]], axis=1).ravel()[:-1] - a
            out[lo:hi] += np.add.reduceat(part[h[a:b]], cuts, axis=0)[::2]
    return out


def predict(texts: list[str], model: Model) -> np.ndarray:
    """Probability of each language."""
    s = sums(texts, model.table)
    logits = (s[:, 1:] * SCALE / np.maximum(s[:, :1], 1e-9) + model.bias) / model.temperature
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """How many documents hold each feature, last the number of documents.  The sums meet in rows per feature block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, documents = np.zeros(len(SIZES) * WIDTH, np.int64), 0
        for part in slices(batches, most=2 << 20):
            values = [t or "" for t in part.column(0).to_pylist()]
            code, starts, ends = letters(values)
            for n, h in enumerate(grams(code)):
                for i in range(len(values)):
                    one = np.sort(h[starts[i] : ends[i]], kind="stable")
                    count[n * WIDTH + one[np.concatenate([[True], one[1:] != one[:-1]])].astype(np.int64)] += 1
            documents += len(values)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, len(count))), pa.array(np.append(count[at], documents))], names=["feature", "n"])

    rows = texts.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # a row per feature at most
    out = np.zeros(len(SIZES) * WIDTH + 1)
    out[found["feature"].to_numpy()] = found["n"].to_numpy()
    return out


def vectors(sample: DataFrame, idf: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, values) of a bounded sample."""
    shared = sample.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            code, starts, ends = letters([t or "" for t in part.column(1).to_pylist()])
            rows, sizes = [], list(grams(code))
            for i, lang in enumerate(part.column(0).to_pylist()):
                at, tf = np.unique(np.concatenate([h[starts[i] : ends[i]].astype(np.int32) + n * WIDTH for n, h in enumerate(sizes)]), return_counts=True)
                value = tf * shared.value[at]
                rows.append({"lang": lang, "at": at.astype("<i4").tobytes(), "value": (value * SCALE / max(value.sum(), 1e-9)).astype("<f4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("at", pa.binary()), ("value", pa.binary())]))

    found = sample.select("lang", "text").mapInArrow(run, "lang string, at binary, value binary").orderBy("lang", F.md5("at")).collect()
    return [(r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["value"], "<f4")) for r in found]


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 3, alpha: float = 0.3, beta: float = 1.0,
        l1: float = 0.05, l2: float = 0.5, seed: int = 7) -> Model:
    """Weights from four fifths of the examples, temperature from the rest."""
    languages = sorted({e[0] for e in examples})
    no = {lang: k for k, lang in enumerate(languages)}
    order = np.random.default_rng(seed).permutation(len(examples))
    hold = set(order[::5].tolist()) if len(examples) >= 5 * len(languages) else set()
    z, n = (np.zeros((len(idf), len(languages)), np.float32) for _ in range(2))
    zb, nb = np.zeros(len(languages)), np.zeros(len(languages))

    def weights(z: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
        return np.where(np.abs(z) <= penalty, 0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))

    def update(z: np.ndarray, n: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
        return z + g - sigma * w, n + g * g

    def logits(at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ weights(z[at], n[at], l1) + weights(zb, nb, 0.0)

    for _ in range(epochs):
        for i in order.tolist():
            if i in hold:
                continue
            lang, at, x = examples[i]
            w, b = weights(z[at], n[at], l1), weights(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[no[lang]] -= 1
            z[at], n[at] = update(z[at], n[at], x[:, None] * p[None], w)
            zb, nb = update(zb, nb, p, b)
    held = [(no[examples[i][0]], logits(*examples[i][1:])) for i in sorted(hold)]

    def loss(t: float) -> float:
        s = np.array([x for _, x in held]) / t
        s -= s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), [k for k, _ in held]]).mean())

    grid = np.geomspace(0.25, 8, 61)
    temperature = float(min(grid, key=lambda t: (loss(t), t))) if held else 1.0
    w = weights(z, n, l1)
    return Model(languages, np.concatenate([idf[:, None], idf[:, None] * w], axis=1).astype(np.float32), weights(zb, nb, 0.0), temperature)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Model from the documents of ``docs`` (doc_id, text, lang, learn); None if there is nothing to learn from."""
    able = docs.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # every row draws; the least draw of a text's copies counts, so a text is the likelier the more copies it has
    able = able.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id", "text"), 11) / F.lit(float(1 << 53)))
    counts = able.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()  # a row per language
    if not counts:
        return None
    frequency = document_frequencies(able)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 0.05
    # about four times as many rows as wanted, then different texts in order of their draws
    most = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(r["least"], min(1.0, 4 * per_language / r["n"])))])
    drawn = able.where(F.col("draw") <= most[F.col("lang")]).groupBy("lang", F.xxhash64("text").alias("key")).agg(F.min(F.struct("draw", "text")).alias("one"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("one.draw", "key"))
    sample = stored(drawn.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "one.text"), "language-sample")
    return fit(vectors(sample, idf), idf)


def language_of(docs: DataFrame, per_language: int = PER_LANGUAGE, names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` plus those of ``names``, which ``docs`` must not have."""
    rest = F.coalesce(remainder(F.col("doc_id"), 3), F.lit(1))
    model = learn(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), (rest != 1).alias("learn")), per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own, able_name = docs.columns, fresh("able")
    plain = docs.withColumns({names[0]: rest == 1, able_name: F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))})
    kinds = (T.BooleanType(), T.StringType(), T.DoubleType())
    out = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            able = np.array(part.column(able_name).to_pylist(), bool)
            if shared.value is None:
                able[:] = False
            languages, scores = np.full(len(able), UNKNOWN, object), np.zeros(len(able))
            if able.any():
                texts = part.column("text").filter(pa.array(able)).to_pylist()
                p = predict(texts, shared.value)
                languages[able], scores[able] = np.array(shared.value.languages, object)[p.argmax(axis=1)], p.max(axis=1)
            kept = [part.column(c) for c in (*own, names[0])]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(languages.tolist(), pa.string()), pa.array(scores)], names=[*own, *names])

    return plain.mapInArrow(run, out)


def in_known_language(docs: DataFrame, least: float, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Rows of ``docs`` with a language of at least that probability."""
    names = fresh("held"), fresh("language"), fresh("score")
    known = language_of(docs, per_language, names)
    return known.where((F.col(names[1]) != UNKNOWN) & (F.col(names[2]) >= least)).select(*docs.columns)


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return language_of(docs.select("doc_id", "text", "lang"), per_language).drop("text", "lang")
