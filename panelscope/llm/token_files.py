"""Token ids in binary blocks: frequency-ranked ids, byte-aligned, control bytes apart.

1. Texts are encoded (a document's ids end with ``end_id``) and kept as a table.
2. Counts of all ids give ranks: the most frequent id is 0.
3. Documents are dealt by ranges of doc_id and sorted; each range is a shard of
   blocks.  A rank takes 1 to 4 bytes; four ranks share a control byte with
   their lengths.  A block row holds its control bytes, its data bytes and the
   ids and lengths of its documents; a block is the unit of reading.
4. Readers look lengths up in a table of 256 control bytes and gather bytes.

A text is encoded in pieces between ASCII white space, each different piece
once per task: the vocabularies drop white space and join no words across it.

Cases: null and empty texts have the end id alone; rows that share an id are
ordered by length and checksum; null ids come first; an empty table gives no
blocks; extra columns are ignored; a very long text may fill a block alone.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.llm.common import release, slices, whole
from panelscope.session import scratch_path

#: Pieces that a task remembers; then it starts anew.  More than the different ones of 16 MB of Parquet, so these are encoded once.
REMEMBERED = 600_000
#: Marks that may stand behind a word; no apostrophe, as that can start an ending such as 's.
MARKS = ".,;:!?*#$%&)"
BLOCK_IDS = 1 << 20

#: Lengths of four numbers by control byte; the first has the lowest two bits.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ``numbers``."""
    v = np.asarray(numbers, "<u4")
    lengths = (1 + (v > 0xFF) + (v > 0xFFFF).astype(np.int8) + (v > 0xFFFFFF)).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < lengths[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = lengths - 1
    c = codes.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    value = raw[at].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        value |= raw[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value & MASKS[lengths]


class Pieces:
    """Ids of texts by way of their different pieces.

    A piece of letters with marks behind it counts as two, as the vocabularies
    never join letters and marks; plain texts are put in lower case first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rules = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [rules["normalizer"] or {}]) if x]
        if "Lowercase" not in steps or not rules["pre_tokenizer"]:
            raise ValueError("pieces need a vocabulary that lowers case and cuts at white space")
        suffix, self.last = rules["model"].get("end_of_word_suffix"), None
        if suffix:  # the ids that end a word
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids_of(self, pieces: list[str]) -> tuple[list[int], np.ndarray]:
        """All ids, and how many each piece has.  Pieces of letters are encoded many at a time."""
        ids, sizes = [], []
        for lo in range(0, len(pieces), 256):
            part = pieces[lo : lo + 256]
            if self.last is not None and all(map(str.isalpha, part)):
                joined = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
                stop = np.flatnonzero(self.last[joined]) + 1
                if len(stop) == len(part) and stop[-1] == len(joined):  # else a letter fell apart: one by one
                    ids += joined
                    sizes.append(np.diff(stop, prepend=0))
                    continue
            one = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            ids += chain.from_iterable(one)
            sizes.append(np.fromiter(map(len, one), np.int64, len(one)))
        return ids, np.concatenate(sizes)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) + len(pieces) > REMEMBERED:
            self.forget()
        at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = [pieces[i] for i in np.flatnonzero(at < 0).tolist()]
        if new:
            letters = list(map(str.isalpha, new))
            new = [*compress(new, letters), *compress(new, map(not_, letters))]
            ids, sizes = self.ids_of(new)
            first = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, np.array(ids, self.kind)])
            self.known.update(zip(new, range(first, first + len(new))))
            at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        return at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has with its end id."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # a mark can join a letter in one case only, and special tokens have a case
        texts = pc.if_else(pc.match_substring_regex(texts, r"\p{M}|<\|"), texts, pc.ascii_lower(texts))
        cut = pc.ascii_split_whitespace(texts)
        ends = cut.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = cut.values[ends[0] : ends[-1]].dictionary_encode()
        whole = coded.dictionary
        head = pc.utf8_rtrim(whole, MARKS)
        split = pc.and_(pc.utf8_is_alpha(head), pc.not_equal(pc.binary_length(head), pc.binary_length(whole)))
        split = pc.and_not(split, pc.match_substring(head, "\u0130"))  # the one letter whose lower case ends with a mark
        tail = pc.if_else(split, pc.replace_substring_regex(whole, r"^\p{L}+", ""), "")
        both = pa.chunked_array([pc.if_else(split, head, whole), tail]).combine_chunks().dictionary_encode()
        number = self.numbers(both.dictionary.to_pylist())[both.indices.to_numpy(zero_copy_only=False)]
        pair = np.stack([number[: len(whole)], number[len(whole) :]], axis=1)
        number = pair[coded.indices.to_numpy(zero_copy_only=False)].reshape(-1)
        sizes = self.sizes[number]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.starts[number] - total[:-1], sizes) + np.arange(total[-1])]
        edges = total[2 * (ends - ends[0])]
        return np.insert(ids, edges[1:], end_id), np.diff(edges) + 1


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian bytes, 2 or 4 an id by vocabulary)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces_of(path)
        for part in slices(batches, most=8 << 20):  # the larger, the fewer pieces come again
            ids, sizes = known.encode(part.column(1), end_id)
            stop = np.cumsum(sizes)
            rows = [ids[a:b].tobytes() for a, b in zip((stop - sizes).tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(rows, pa.binary())], schema=schema)
        known.forget()  # the worker stays for other tasks, its memory is theirs
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def id_width(path: str) -> str:
    return pieces_of(path).kind.str


def id_counts(encoded: DataFrame, kind: str) -> DataFrame:
    """id, n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in whole(batches):
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=len(total))
            n[: len(total)] += total
            total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Writes ``ids`` (the encoded table), ``ranks`` (id, n, rank) and ``blocks`` below ``folder``."""
    spark, kind = docs.sparkSession, id_width(path)
    encode_documents(docs, path, end_id).write.option("compression", "zstd").parquet(f"{folder}/ids")
    encoded = spark.read.parquet(f"{folder}/ids")
    # one row per id of the vocabulary at most
    rank = F.row_number().over(W.orderBy(F.col("n").desc(), "id")) - 1
    id_counts(encoded, kind).withColumn("rank", rank.cast("long")).coalesce(1).write.parquet(f"{folder}/ranks")
    pairs = spark.read.parquet(f"{folder}/ranks").select("id", "rank").collect()
    ranks = np.zeros(max((r["id"] for r in pairs), default=0) + 1, np.uint32)
    ranks[[r["id"] for r in pairs]] = [r["rank"] for r in pairs]
    shared = spark.sparkContext.broadcast(ranks)
    schema = pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
        ("control", pa.binary()), ("data", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held, ids, sizes, raw = TaskContext.get().partitionId(), 0, 0, [], [], []

        def row() -> pa.RecordBatch:
            control, data = pack(shared.value[np.frombuffer(b"".join(raw), kind)])
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "n_ids": held, "doc_ids": ids, "sizes": sizes, "control": control, "data": data}], schema)

        for batch in whole(batches):
            for doc, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held + n > block_ids:
                    yield row()
                    block, held, ids, sizes, raw = block + 1, 0, [], [], []
                held += n
                ids.append(doc)
                sizes.append(n)
                raw.append(data)
        if held:
            yield row()

    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", F.crc32("ids")).select("doc_id", "n_tokens", "ids")
    blocks = "shard int, block int, n_ids bigint, doc_ids array<bigint>, sizes array<bigint>, control binary, data binary"
    ordered.mapInArrow(run, blocks).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded documents: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), in file order by start."""
    pairs = spark.read.parquet(f"{folder}/ranks").select("rank", "id").collect()
    table = np.zeros(len(pairs), "<u4")
    table[[r["rank"] for r in pairs]] = [r["id"] for r in pairs]
    shared = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{folder}/blocks")
    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row per task that wrote
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = per_shard.select("shard", before(W.orderBy("shard"), "n").alias("shard_start"))
    starts = blocks.select("shard", "block", "n_ids").withColumn("block_start", before(W.partitionBy("shard").orderBy("block"), "n_ids"))
    starts = starts.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("first"))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = shared.value[unpack(row["control"], row["data"], row["n_ids"])]
                sizes = np.array(row["sizes"], np.int64)
                start = np.cumsum(sizes) - sizes
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(start), pa.array(sizes), pa.array([ids[a : a + m].tobytes() for a, m in zip(start.tolist(), row["sizes"])], pa.binary()),
                ], schema=schema)

    decoded = blocks.select("shard", "block", "n_ids", "doc_ids", "sizes", "control", "data").mapInArrow(
        run, "shard int, block int, doc_id bigint, inside bigint, n_tokens bigint, ids binary"
    )
    digest = decoded.withColumn("ids_crc32", F.crc32("ids"))
    return digest.join(starts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids", "ids_crc32")


def token_digests(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from files written to the shared folder and read back."""
    folder = scratch_path(docs.sparkSession, "llm-token-files")
    write_files(docs, folder, path, end_id)
    return read_files(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def brute_force(docs: list[tuple[int, str | None]], path: str, end_id: int = 1) -> list[tuple]:
    """Plain reference for tests, ids must differ."""
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, []
    for doc, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
