"""Hard negatives, covering SimHash and whitening against plain versions, and on odd rows."""

import random

import numpy as np
import pytest

from panelscope.llm import hard_negatives, simhash, whitening
from panelscope.llm.vectors import Best, products

VECTORS = "vec_id bigint, embedding array<double>, label int, v string, rank int, n bigint, no int, block string"


def vector_rows(n=260, d=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    out = []
    for i in range(n):
        label = int(rng.integers(5)) if i % 3 else 1  # a third of all rows
        out.append((i * 5, (centres[rng.integers(5)] * 0.5 + rng.normal(size=d) * 0.3).astype(np.float32).tolist(), label))
    x = out[7][1]
    odd = [(5000, None, 1), (5050, [1.0] * (d - 1) + [None], 1), (5100, [float("nan")] * d, 1), (5150, [float("inf")] + [0.0] * (d - 1), 2), (5200, x, None), (5250, [1.0, 2.0], 1),
           (5300, [], 1), (None, x, 1), (5350, [0.0] * d, 2), (5351, [0.0] * d, 3), (5400, x, 1), (5401, x, 2), (5402, x, 2), (5450, [-3.0] * d, 4), (-50, x, 0), (5500, [1e300] * d, 1)]
    return out + odd + [out[10], out[10], out[0]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2, 3, "b") for r in rows], VECTORS)


def usable(rows, d=6):
    return [r for r in rows if r[1] and len(r[1]) == d and all(c is not None and np.isfinite(c) and abs(256 * c) < 2**63 for c in r[1])]


# hard negatives

def plain_negatives(rows):
    once = {}
    for i, v, label in usable(rows):
        if i is not None and label is not None:
            once[i] = min(once.get(i, (label, v)), (label, v))
    x = {i: [int(np.floor(256 * c)) for c in v] for i, (_, v) in once.items()}
    out = []
    for a in x:
        if a % 50:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x[a], x[b])), b) for b in x if b != a)
        for s, p in [t for t in scores if once[t[1]][0] == once[a][0]][:5]:
            fits = [(-n, q) for n, q in scores if once[q][0] != once[a][0] and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, p, r + 1, q, -s, n) for r, (n, q) in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("block, anchors", [(8192, 512), (40, 7)])
def test_hard_negatives_match_a_plain_search(spark, block, anchors):
    rows = vector_rows()
    got = hard_negatives.hard_negatives(frame(spark, rows), block=block, anchors=anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows)
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_equal_rows(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(300)] + [(1000, [0.7, 0.6], 1)]
    got = hard_negatives.hard_negatives(frame(spark, rows), block=64, anchors=4).collect()
    assert sorted(map(tuple, got)) == plain_negatives_of_width(rows, 2)


def plain_negatives_of_width(rows, d):
    return plain_negatives([(i, v + [0.0] * (6 - d), label) for i, v, label in rows])


def test_hard_negatives_without_rows(spark):
    assert hard_negatives.hard_negatives(frame(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(frame(spark, [(0, [1.0], 1)])).count() == 0


def test_anchors_go_in_passes_and_not_with_each_block(spark):
    rows = vector_rows()
    got = hard_negatives.hard_negatives(frame(spark, rows), block=40, anchors=7, most=500)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # an anchor is not multiplied by the blocks, neither for a shuffle nor for the driver
    assert plan.count("MapInArrow") > 1 and " explode(" not in plan


def test_best_rows_are_kept_whatever_their_order():
    rng = np.random.default_rng(5)
    group, score, ids = rng.integers(0, 7, (2, 4000)), rng.integers(0, 50, 4000), rng.permutation(4000)
    best = Best(3, least=100)
    for i in range(0, 4000, 130):
        best.add(group[:, i : i + 130], score[i : i + 130], ids[i : i + 130])
        assert best.rows <= 2 * 49 * 3 + 100 + 130
    want = {}
    for a, b, s, i in zip(*group.tolist(), score.tolist(), ids.tolist()):
        want.setdefault((a, b), []).append((-s, i))
    assert sorted(zip(*[c.tolist() for c in best.columns()])) == sorted((*g, i, -s) for g, v in want.items() for s, i in sorted(v)[:3])
    assert Best(3).columns() == []


def test_products_are_exact():
    a, b = np.array([[2.0**60, 1.0], [3.0, -5.0]]), np.array([[4.0, 7.0], [2.0**61, 2.0]])
    assert products(a, b).tolist() == [[2**62 + 7, 2**63 - 1], [-23, 3 * 2**61 - 10]]


def test_windows_are_exact():
    low, high = hard_negatives.window(np.array([7, 0, -7, 2**62]), 50, 95)
    assert low.tolist() == [4, 0, -3, 2**61] and high.tolist() == [6, 0, -7, 95 * 2**62 // 100]


# covering SimHash

def test_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 400))]
        out.append(base)
        for _ in range(3):
            near = list(base)
            near[rng.randrange(len(near))] = word()
            out.append(near)
    plain = [" ".join(t) for t in out]
    return plain + [None, "", " \t\n", "One", "one\x0b two", "one two", "ONE  two\nThree", "one two three", "é ß 世界 Ä", plain[0].upper(), plain[4].replace(" ", " \n "), "a\x1cb c d", "x " * 30000]


def classes(spark, docs, **more):
    return spark.createDataFrame([(i, t, "f", 1, "m") for i, t in docs], "doc_id bigint, text string, f string, key int, node string").transform(lambda d: simhash.simhash_classes(d, **more))


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash_matches_brute_force(spark, bucket):
    docs = list(enumerate(texts())) + [(3, texts()[3]), (None, texts()[8]), (None, "only one of its kind")]
    got = classes(spark, docs, bucket=bucket)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = simhash.brute_force(docs)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert len({w[2] for w in want}) < len(docs) - 30


def test_fingerprint_by_hand():
    import xxhash

    assert simhash.fingerprint(b"One  TWO three") == xxhash.xxh64_intdigest("one two three", 42)
    assert simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("bucket", [64, 4, 1])
def test_links_of_crowded_fingerprints(spark, bucket):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    values = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(12)) for b in base for _ in range(60)} | {0, 3, 12, 7}
    values = sorted(simhash.signed(v) for v in values)
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "f bigint"), bucket).collect()]

    def groups(pairs):
        label = {v: v for v in values}
        for a, b in pairs:
            old, new = label[a], label[b]
            label = {v: new if x == old else x for v, x in label.items()} if old != new else label
        return {frozenset(v for v in values if label[v] == x) for x in label.values()}

    every = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    assert groups(found) == groups(every)


def test_simhash_of_no_rows(spark):
    assert classes(spark, []).count() == 0
    assert [tuple(r) for r in classes(spark, [(None, None), (4, "")]).collect()] == [(None, "0" * 16, 4), (4, "0" * 16, 4)]


# whitening

def plain_whitening(rows, many=4):
    from fractions import Fraction

    fine = [(i, [int(np.floor(256 * c)) for c in v]) for i, v, _ in usable(rows)]
    fit = [list(v) for v in {tuple(v) for _, v in fine}]
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    c = [[Fraction(n * v[i] - s[i], n) for i in range(d)] for v in fit]
    cov = np.array([[float(sum(x[i] * x[j] for x in c) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:many], vectors[:, ::-1][:, :many]
    white = {i: np.array([float(Fraction(n * a - b, n)) for a, b in zip(v, s)]) @ vectors / np.sqrt(values) for i, v in fine}
    return n, {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in fine}, white, values / np.trace(cov)


def test_whitening_matches_a_plain_one(spark):
    rows = [r for r in vector_rows() if r[0] is not None]
    got = whitening.whiten(frame(spark, rows)).collect()
    n, deviation, white, share = plain_whitening(rows)
    assert len(got) == 4 * len(usable(rows))
    assert {r["n"] for r in got} == {n} and all(r["deviation"] == deviation[r["vec_id"]] == int(r["deviation_text"]) for r in got)
    for k in range(4):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        sign = 1 if sum(mine[i]["whitened"] * white[i][k] for i in white) > 0 else -1
        assert max(abs(mine[i]["whitened"] - sign * white[i][k]) for i in white) < 1e-9
        assert all(abs(r["explained"] / share[k] - 1) < 1e-9 for r in mine.values())
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_far_from_zero(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (1e9 + rng.integers(-3, 4, size=3)).tolist(), 1) for i in range(60)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len({r["component"] for r in got}) == 3 and got[0]["identity_error"] < 1e-9
    huge = [(i, [float(rng.integers(-(2**50), 2**50)) for _ in range(3)], 1) for i in range(20)]
    got = whitening.whiten(frame(spark, huge)).collect()
    assert got[0]["deviation"] is None and int(got[0]["deviation_text"]) > 2**63 and got[0]["identity_error"] < 1e-9


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 3.0], 1), (None, [1.0, 3.0], 1)])).collect()
    assert [(r["component"], r["n"], round(abs(r["whitened"]), 9), r["explained"]) for r in got] == [(1, 2, 1.0, 1.0)] * 3
