"""Hard negatives against a comparison of all pairs, and bounds against true scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import SF
from textlens.llm.negatives import (
    MOST,
    Best,
    angles,
    block_reach,
    bounds,
    hard_negatives,
    lengths,
    references,
    scores,
    take_negatives,
    take_positives,
    Anchors,
    Block,
)

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, positives=5, negatives=3, every=50):
    kept = set()
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(math.floor(256 * x) for x in vector)
        if sum(float(x) * x for x in whole) < MOST:
            kept.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, whole))
    out = []
    for anchor in kept:
        if anchor[0] % every:
            continue
        scored = [(-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1]) for r in kept if r[0] != anchor[0] and len(r[2]) == len(anchor[2])]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2] == anchor[1]][:positives]:
            fit = [s for s in scored if s[2] != anchor[1] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(anchor[0], positive, rank + 1, s[1], -p, -s[0]) for rank, s in enumerate(fit[:negatives])]
    return sorted(out)


def made(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    frame = frame.withColumn("score", F.lit("x")).withColumn("dims", F.lit(1)).withColumn("rank", F.lit("r")).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(frame, **options).select(*NAMES).collect())


def rows_of(n, dims, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    return [(i, i % labels, (centres[i % labels] * (i % 4) / 3 + rng.normal(size=dims) * 0.7).tolist()) for i in range(n)]


def test_given(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], [float(x) for x in r["embedding"]]) for r in frame.collect()]
    got = sorted(tuple(r) for r in hard_negatives(frame).select(*NAMES).collect())
    assert got == brute(rows) and got


def test_odd_rows(spark):
    rows = rows_of(260, 6, 1)
    rows += rows[:40]  # repeated rows
    rows += [(300 + i, i % 3, [0.25, 0.5, -1.0, 0.0, 0.0, 0.125]) for i in range(120)]  # ties
    rows += [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (550, 1, None), (600, 1, []), (650, 1, [None, 1.0, 1.0, 1.0, 1.0, 1.0])]
    rows += [(700, 1, [float("nan")] * 6), (750, 1, [float("inf")] * 6), (800, 1, [0.0] * 6), (850, 2, [1e300] * 6), (900, 1, [1.0, 2.0]), (901, 1, [2.0, 1.0]), (902, 2, [1.0, 1.0])]
    rows += [(100, 2, [3.0, 1.0, 0.0, 1.0, 2.0, 0.5])]  # another row of an anchor's id
    got = made(spark, rows)
    assert got == brute(rows)
    assert any(r[0] == 900 for r in got)
    assert made(spark, rows, chunk_bytes=600) == got


def test_hot_label(spark):
    rows = [(i, 0 if i % 3 else i % 10, v) for i, (_, _, v) in enumerate(rows_of(600, 5, 2))]
    assert made(spark, rows) == brute(rows)


def test_empty(spark):
    assert made(spark, []) == [] and made(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for dims in (1, 2, 8, 64):
        vectors = rng.integers(-900, 900, (300, dims))
        vectors[:3] = 0
        vectors[3:9] = vectors[9]
        vectors[10] = -vectors[9]
        norms = lengths(vectors)
        directions = references(vectors[:50].astype(float), 16)
        turned = angles(vectors, norms, directions)
        for i in range(0, 60):
            true = vectors @ vectors[i]
            low, high = bounds(turned[i], norms[i], turned, norms)
            assert (low <= true).all() and (true <= high).all()
            assert (scores(vectors, norms, vectors[i], norms[i]) == true).all()
        block = Block(0, np.arange(300), vectors, norms, turned)
        low, high = block_reach(Anchors(np.arange(60), np.zeros(60, int), vectors[:60], norms[:60], turned[:60]), block)
        true = vectors[:60] @ vectors.T
        assert (low <= true.min(axis=1)).all() and (true.max(axis=1) <= high).all()


def test_few_are_scored():
    """With vectors in tight groups most rows are passed over by their angles."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    vectors = np.floor(256 * (centres[np.arange(2400) % 12] + rng.normal(size=(2400, 32)) * 0.05)).astype(np.int64)
    norms = lengths(vectors)
    turned = angles(vectors, norms, references(vectors[:200].astype(float)))
    asked = Anchors(np.arange(24), np.arange(24) % 12, vectors[:24], norms[:24], turned[:24], np.full((24, 1), 1 << 40), np.full((24, 1), 1 << 41))
    seen = {"pairs": 0, "scored": 0}
    for label in range(12):
        at = np.arange(label, 2400, 12)
        take_positives(asked, Block(label, at, vectors[at], norms[at], turned[at]), Best(24, 5), seen)
        take_negatives(asked, Block(label, at, vectors[at], norms[at], turned[at]), Best(24, 3), seen)
    assert seen["pairs"] == 24 * 2400 and seen["scored"] < 0.1 * seen["pairs"]


@pytest.mark.parametrize("score", [-(10**15), 0, 10**15])
def test_best(score):
    best = Best(2, 3)
    best.offer(0, np.array([5, 3]), np.array([score, score]))
    assert best.limit(0) == -np.inf and best.limit(1) == -np.inf
    best.offer(0, np.array([4, 1]), np.array([score, score + 1]))
    assert best.limit(0) == score and best.id[0].tolist() == [1, 3, 4]
