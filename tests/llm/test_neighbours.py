import numpy as np

from textlens.llm import neighbours
from tests.llm.data import documents


def brute(rows, k, every):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, np.float64)
    out = {}
    for q, v in usable.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in usable.items() if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def check(df, every, least):
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 10, every)
    got = {}
    for r in sorted(neighbours.nearest(df, 10, every).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.score, r.vec_id))
    assert all(len(got.get(q, [])) == len(near) for q, near in want.items()) and set(got) <= set(want)
    found = sum(len({i for _, i in got.get(q, [])} & {i for _, i in near}) for q, near in want.items())
    assert found >= least * sum(map(len, want.values()))
    for q, own in got.items():
        assert own == sorted(own)


def test_recall_on_given_vectors(spark):
    check(documents(spark, "embeddings", "/root/testdata/sf0.1"), 100, 0.99)


def test_odd_vectors_and_many_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(250)] + [(i + 2000, [1.0] * 7 + [1.0 + i]) for i in range(5)]
    rows += [(None, [1.0] * 8), (401, None), (402, []), (403, [0.0] * 8), (404, [float("nan")] * 8), (410, [float("inf")] * 8), (420, [None] * 8), (430, [1.0, 2.0])]
    rows += [(440, [0.0, -0.0, 1.0] + [0.0] * 5), (450, [-0.0, 0.0, 1.0] + [0.0] * 5), (440, [0.0, -0.0, 1.0] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS no", "3 AS dims", "4 AS ids")
    check(df, 10, 1.0)
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(few).collect()] == [(100, 1, 1)]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    base, queries, centre = rng.normal(size=(2000, 32)), rng.normal(size=(50, 32)), np.full(32, 0.1)
    turn = neighbours.rotation(32)
    low, high = neighbours.bounds(*neighbours.encode(base, centre, turn), queries, centre, turn)
    exact = ((queries[:, None] - base[None]) ** 2).sum(axis=2)
    assert ((low <= exact) & (exact <= high)).mean() > 0.97
