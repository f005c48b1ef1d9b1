"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words between ASCII white space.  Each source gets a target (share
of all words by weight, at most ``cap`` times its size, the excess reshared).
Its documents stand in hashed order, one after the other and then once more
(``cap`` times in all): the source's stream.

The stream is cut into blocks of ``block_words``, permuted by a seeded bijection
of its own.  A source's block quota is exact: the blocks that come first in the
permutation are drawn, the last of them as far as the target goes.  A tree with
the output shards as leaves splits all quotas: each node draws from a
multivariate hypergeometric distribution how many blocks of each source go left.
The drawn blocks fall down the tree, so shards get disjoint blocks.  What is
taken of a document are its words inside drawn blocks, a piece per block; within
a shard pieces are ordered by hash.  An incomplete block at the end of a stream
comes last in the permutation.

Cases: null text has size 0; sources of size 0 get target 0; a null source is
a source of its own, last in order; null and repeated ids are rows like any
other (equal rows may swap places); an empty table gives an empty one; extra
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelscope.llm.common import stored

WHITE = r"\x20\x09-\x0D"
#: Tries of the rejection sampler; one fails with a chance below 3/4.
TRIES = 128
#: Steps of a walk back into a permutation's range; one more is needed with a chance below 1 / blocks ** 16.
WALK = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, source_no, source_size, target.

    With sources ordered by cap / weight, those before the water level are
    capped; the level follows from running sums, no rounds are needed.
    """
    if share > cap:
        raise ValueError("the share can't exceed the cap")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("source_no", number).withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    every = W.partitionBy(F.lit(1))
    order = every.orderBy("ratio", "source_no")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - before) / rest
    per = per.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("level", level)
    flat = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return per.withColumn("flat", flat).select(
        "source", "source_no", "source_size", F.least("most", F.coalesce(F.col("flat") * F.col("weight"), F.col("most"))).alias("target")
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, and named once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _log_factorial(n: Column) -> Column:
    def series(x: Column) -> Column:
        y = x * x
        return (x + 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + (F.lit(1 / 12) - (F.lit(1 / 360) - F.lit(1 / 1260) / y) / y) / x

    def value(m: Column) -> Column:
        return F.when(m <= 20, F.log(F.factorial(F.greatest(m, F.lit(0).cast("long")).cast("int")).cast("double"))).otherwise(_let(m.cast("double"), series))

    return _let(n.cast("long"), value)


def _uniform(*parts: Column) -> Column:
    """Strictly between 0 and 1."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + 0.5) / F.lit(float(1 << 53))


def hypergeometric(good: Column, bad: Column, draws: Column, *seed: Column) -> Column:
    """Exact draw: how many of ``draws`` come from ``good``.

    Rejection for log-concave laws (uniform hat around the mode, exponential
    tails), alike at every size; randomness is a hash of ``seed``.
    """
    def log_p(x: Column, p: Column) -> Column:
        good, bad, draws = p["good"], p["bad"], p["draws"]
        ways = _log_factorial(x) + _log_factorial(good - x) + _log_factorial(draws - x) + _log_factorial(bad - draws + x)
        return p["all"] - ways

    def sample(s: Column) -> Column:
        m, top, w = s["m"], s["top"], s["w"]
        peak = s["peak"]

        def attempt(state: Column, i: Column) -> Column:
            def judge(y: Column) -> Column:
                x = m + F.when(_uniform(*seed, i, F.lit(3)) < 0.5, -F.round(y)).otherwise(F.round(y)).cast("long")
                hat = _uniform(*seed, i, F.lit(2)) * F.least(F.lit(1.0), F.exp(w - peak * y))
                inside = lambda v: F.when((v >= s["lo"]) & (v <= s["hi"]) & (hat <= F.exp(log_p(v, s) - top)), v)
                return _let(x, inside)

            v = _uniform(*seed, i, F.lit(1))
            y = F.when(_uniform(*seed, i, F.lit(0)) <= w / (1 + w), v * w / peak).otherwise((w - F.log(v)) / peak)
            return F.when(state.isNotNull(), state).otherwise(_let(y, judge))

        return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("long"), attempt), m)

    def facts(p: Column) -> Column:
        good, bad, draws = p["good"], p["bad"], p["draws"]
        low, high = F.greatest(F.lit(0).cast("long"), draws - bad), F.least(draws, good)
        mode = F.least(high, F.greatest(low, F.floor((draws + 1) * ((good + 1) / (good + bad + 2))).cast("long")))
        every = _log_factorial(good) + _log_factorial(bad) + _log_factorial(draws) + _log_factorial(good + bad - draws) - _log_factorial(good + bad)
        start = F.struct(good.alias("good"), bad.alias("bad"), draws.alias("draws"), low.alias("lo"), high.alias("hi"), mode.alias("m"), every.alias("all"))

        def with_top(q: Column) -> Column:
            def with_peak(top: Column) -> Column:
                names = ("good", "bad", "draws", "lo", "hi", "m", "all")
                return F.struct(*[q[n].alias(n) for n in names], top.alias("top"), F.exp(top).alias("peak"), (1 + F.exp(top) / 2).alias("w"))

            return _let(_let(log_p(q["m"], q), with_peak), lambda r: F.when(r["lo"] >= r["hi"], r["lo"]).otherwise(sample(r)))

        return _let(start, with_top)

    given = F.struct(good.cast("long").alias("good"), bad.cast("long").alias("bad"), draws.cast("long").alias("draws"))
    return _let(given, facts)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Adds ``lefts``: per source the blocks that go left at nodes 1 .. shards - 1 (node n has children 2n, 2n + 1).

    ``quotas``: source_no, quota.  The sources of a mix are few, so the heap of
    node quotas is one row.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of 2")
    zero, root = F.lit(0).cast("long"), F.array_sort(F.collect_list(F.struct("source_no", "quota")))
    one = quotas.agg(F.transform(root, lambda x: x["quota"]).alias("root"), F.transform(root, lambda x: x["source_no"]).alias("numbers"))

    def left(ks: Column, node: Column) -> Column:
        total = F.aggregate(ks, zero, lambda a, k: a + k)
        start = F.struct(total.alias("rest"), F.floor(total / 2).cast("long").alias("want"), F.array().cast("array<bigint>").alias("xs"))

        def draw(state: Column, k: Column) -> Column:
            x = hypergeometric(k, state["rest"] - k, state["want"], F.lit(seed), node, F.size(state["xs"]))
            return _let(x, lambda v: F.struct((state["rest"] - k).alias("rest"), (state["want"] - v).alias("want"), F.concat(state["xs"], F.array(v)).alias("xs")))

        return F.aggregate(ks, start, draw, lambda s: s["xs"])

    def grow(heap: Column, node: Column) -> Column:
        ks = F.element_at(heap, node)
        both = _let(left(ks, node), lambda x: F.array(x, F.zip_with(ks, x, lambda a, b: a - b)))
        return F.concat(heap, both)

    inner = F.sequence(F.lit(1), F.lit(shards - 1)) if shards > 1 else F.array().cast("array<int>")
    heap = one.select("numbers", F.aggregate(inner, F.array("root"), grow).alias("heap"))
    lefts = F.transform(inner, lambda n: F.element_at(F.element_at(F.col("heap"), 2 * n), F.col("at") + 1))
    return heap.select("heap", F.posexplode("numbers").alias("at", "source_no")).select("source_no", lefts.alias("lefts"))


def permuted(block: Column, blocks: Column, *seed: Column) -> Column:
    """Place of ``block`` (0 .. ``blocks`` - 1) in a seeded permutation.

    A Feistel network over a grid of a x b places with a * b just above
    ``blocks``; places outside are permuted again, fewer than a of them in a row.
    """
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(blocks.cast("double")))).cast("long")
    sides = F.struct(a.alias("a"), F.greatest(F.lit(1), F.ceil(blocks / a)).cast("long").alias("b"))

    def network(s: Column, place: Column) -> Column:
        def turn(x: Column, i: Column) -> Column:
            odd = i % 2 == 1
            other = F.when(odd, x["r"]).otherwise(x["l"])
            add = F.shiftrightunsigned(F.xxhash64(*seed, i, other), 2)
            return F.struct(
                F.when(odd, F.pmod(x["l"] + add, s["a"])).otherwise(x["l"]).alias("l"), F.when(odd, x["r"]).otherwise(F.pmod(x["r"] + add, s["b"])).alias("r")
            )

        start = F.struct((place % s["a"]).alias("l"), F.floor(place / s["a"]).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, turn, lambda x: x["r"] * s["a"] + x["l"])

    def walk(s: Column) -> Column:
        again = lambda place, i: F.when((i > 0) & (place < blocks), place).otherwise(network(s, place))
        return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), block, again)

    return _let(sides, walk)


def _shard(rank: Column, lefts: Column, shards: int) -> Column:
    """Leaf that a source's block with this place in the permutation falls to."""
    start = F.struct(F.lit(1).alias("node"), rank.alias("rank"))

    def fall(s: Column, _: Column) -> Column:
        stay = F.element_at(lefts, s["node"])
        return F.when(s["rank"] < stay, F.struct((2 * s["node"]).alias("node"), s["rank"].alias("rank"))).otherwise(
            F.struct((2 * s["node"] + 1).alias("node"), (s["rank"] - stay).alias("rank"))
        )

    depth = shards.bit_length() - 1
    levels = F.sequence(F.lit(1), F.lit(depth)) if depth else F.array().cast("array<int>")
    return F.aggregate(levels, start, fall, lambda s: s["node"] - shards)


def decide(sized: DataFrame, shards: int = 16, block_words: int = 1024, seed: int = 42, weights: tuple[float, ...] = (5.0, 2.0, 1.0),
           share: float = 1.5, cap: int = 2, rows_per_bucket: int = 256) -> DataFrame:
    """Rows of ``sized`` (doc_id, source, size and others) plus source_size, target, taken, copies.

    ``copies``: array of (copy, first, words, shard) with words > 0: the pieces
    taken.  A row with ``many`` stands for so many equal ones; its figures are for
    each of them, with one piece per copy.
    The running sums go over hash buckets of a source, so one source with most
    rows is spread.
    """
    sized = sized if "many" in sized.columns else sized.withColumn("many", F.lit(1).cast("long"))
    sized = sized.withColumn("_all", F.col("size") * F.col("many"))
    buckets = min(1 << 16, sized.count() // rows_per_bucket + 1)
    targets = source_targets(sized.select("source", F.col("_all").alias("size")), weights, share, cap).withColumn("want", F.round("target").cast("long"))
    targets = targets.withColumn("quota", F.ceil(F.col("want") / block_words).cast("long"))
    tree = splitting_tree(targets.select("source_no", "quota"), shards, seed)
    # one row per source, as a table: what follows has a small plan
    per_source = stored(targets.join(tree, "source_no").drop("source_no"), "mix-sources")

    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    high = F.shiftrightunsigned(key, 33)
    placed = sized.withColumns({"_key": key, "_high": high, "_bucket": F.floor(high * buckets / F.lit(1 << 31)).cast("int")})
    sums = placed.groupBy("source", "_bucket").agg(F.sum("_all").alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_start", start).drop("_sum").alias("b")
    starts = starts.join(per_source.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))

    order = W.partitionBy("source", "_bucket").orderBy("_high", "_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum("_all").over(order), F.lit(0)))
    joined = inside.alias("d").join(
        starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._bucket") == F.col("s._bucket"))
    ).drop(F.col("s.source"), F.col("s._bucket"))
    zero = F.lit(0).cast("long")
    position = F.col("_start") + F.col("_inside")
    full = F.floor(cap * F.col("source_size") / block_words).cast("long")

    def pieces(copy: Column) -> Column:
        def of(low: Column) -> Column:
            high = low + F.col("_all")

            def piece(block: Column) -> Column:
                rank = F.when(block < full, permuted(block, full, F.lit(seed), F.col("source"))).otherwise(full)

                def drawn(rank: Column) -> Column:
                    words = F.least(F.lit(block_words).cast("long"), F.col("want") - rank * block_words)
                    start = F.greatest(low, block * block_words)
                    words = F.greatest(zero, F.least(high, block * block_words + words) - start)
                    return F.when(words > 0, F.struct(copy.alias("copy"), (start - low).alias("first"), words.alias("words"), _shard(rank, F.col("lefts"), shards).alias("shard")))

                return _let(rank, drawn)

            blocks = F.sequence(F.floor(low / block_words).cast("long"), F.floor((high - 1) / block_words).cast("long"))
            return F.filter(F.transform(blocks, piece), lambda p: p.isNotNull())

        return _let(position + copy * F.col("source_size"), of)

    def together(ps: Column) -> Column:
        words = F.floor(F.aggregate(ps, zero, lambda a, p: a + p["words"]) / F.col("many")).cast("long")
        one = F.array(F.struct(F.element_at(ps, 1)["copy"].alias("copy"), zero.alias("first"), words.alias("words"), F.element_at(ps, 1)["shard"].alias("shard")))
        return F.when((F.col("many") == 1) | (F.size(ps) == 0), ps).otherwise(F.filter(one, lambda p: p["words"] > 0))

    kept = F.flatten(F.transform(F.array(*[F.lit(c).cast("long") for c in range(cap)]), lambda c: _let(pieces(c), together)))
    nothing = F.filter(kept, lambda p: F.lit(False))
    out = joined.withColumn("copies", F.when(F.col("_all") > 0, kept).otherwise(nothing)).withColumn("taken", F.aggregate("copies", zero, lambda a, c: a + c["words"]))
    return out.drop("_all", "_key", "_high", "_bucket", "_start", "_inside", "want", "quota", "lefts")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, copies."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return decide(sized, **options).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, shards: int = 16, seed: int = 42, parts: int = 64, **options) -> DataFrame:
    """The mixed documents, dealt and ordered by shard; columns of ``docs``.

    A row is a piece of a document: all of it as it is, or the words inside a
    drawn block, single-spaced; n_chars follows where the table has it.  Rows that
    are equal in id, text and source share one decision.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")  # keeps extra columns apart from those made here
    key = F.xxhash64("doc_id", "text", "source").alias("key")
    sized = stored(docs.select(key, "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    units = sized.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("many"))
    taken = stored(decide(units, shards=shards, seed=seed, **options).where("taken > 0").select("key", "size", "copies"), "mix-taken")
    # the text moves twice: to its decision, then cut to its pieces to their shards, so no piece carries words outside it
    found = docs.select(row, key).join(taken, "key")
    clean = F.regexp_replace("row.text", f"^[{WHITE}]+", "")

    def cut(piece: Column, spoken: Column) -> Column:
        return F.array_join(F.slice(spoken, (piece["first"] + 1).cast("int"), piece["words"].cast("int")), " ")

    def cuts(spoken: Column) -> Column:
        return F.transform("copies", lambda p: F.struct(p["copy"].alias("copy"), p["first"].alias("first"), p["shard"].alias("shard"), F.when(p["words"] < F.col("size"), cut(p, spoken)).alias("cut")))

    # a text is split once for all its pieces, and not at all where each piece is the whole of it
    some = F.exists("copies", lambda p: p["words"] < F.col("size"))
    spoken = F.when(some, F.split(clean, f"[{WHITE}]+"))
    rows = found.select("row", "key", F.explode(_let(spoken, cuts)).alias("copy"))
    made = {"text": F.coalesce("copy.cut", "row.text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("copy.cut").isNotNull(), F.length("copy.cut")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    piece = F.struct(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]).alias("row")
    rows = rows.select(piece, F.col("copy.shard").alias("shard"), F.xxhash64(F.lit(seed + 1), "key", "copy.copy", "copy.first").alias("at"))
    # a shard's rows go to several tasks by hash, each of which sorts its own
    rows = rows.repartition("shard", F.pmod("at", F.lit(max(1, parts // shards)))).sortWithinPartitions("shard", "at")
    return rows.select("row.*")
