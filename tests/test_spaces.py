import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.operators import space as sp
from textlens.operators.communities import communities, modularity
from textlens.operators.graph import choose_alpha, hop_distances, infinity_hop, k_hop_graph
from textlens.operators.similarity import most_similar_batch, similarity_pairs
from textlens.operators.vocab import ordered_word_counts, token_rows, vocabulary


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(3).normal(size=(60, 6))


@pytest.fixture(scope="module")
def space(spark, vectors):
    rows = [(i, f"w{i}", v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "idx bigint, word string, vec array<double>").cache()


def cosines(vectors):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return units @ units.T


def test_most_similar(space, vectors):
    near = cosines(vectors)[4]
    near[4] = -np.inf
    order = np.argsort(-near)
    got = sp.most_similar(space, "w4", 5).collect()
    assert [r.idx for r in got] == order[:5].tolist()
    assert [r.similarity for r in got] == pytest.approx(near[order[:5]].tolist())
    assert sp.most_similar(space, "w4", None).count() == 59
    assert sp.most_similar(space, "w4", 1000).count() == 59
    assert sp.most_similar(space, "unknown", 5).count() == 0


@pytest.mark.parametrize("block_rows", [7, 20, 30, 1000])
def test_blocks_do_not_matter(space, vectors, block_rows):
    near = cosines(vectors)
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60) if near[i, j] >= 0.4}
    pairs = similarity_pairs(space, 0.4, block_rows).collect()
    assert len(pairs) == len(expected) and {(r.src, r.dst) for r in pairs} == expected
    assert all(r.weight == pytest.approx(near[r.src, r.dst]) for r in pairs)
    np.fill_diagonal(near, -np.inf)
    batch = most_similar_batch(space, space, 3, block_rows=block_rows).collect()
    assert {(r.query, r["rank"]): r.idx for r in batch} == {
        (i, n + 1): j for i in range(60) for n, j in enumerate(np.argsort(-near[i])[:3].tolist())
    }


def test_threshold_is_monotone(space):
    low = {(r.src, r.dst) for r in infinity_hop(space, 0.3).collect()}
    assert {(r.src, r.dst) for r in infinity_hop(space, 0.5).collect()} <= low


def test_pca_equals_eigenvectors(space, vectors):
    shifted = vectors - vectors.mean(axis=0)
    sphere = shifted / np.linalg.norm(shifted, axis=1, keepdims=True)
    centred = sphere - sphere.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov(sphere.T))
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(6)])
    scores, ratios = sp.fit_pca(space, components=3)
    got = np.array([r.scores for r in scores.orderBy("idx").collect()])
    assert got == pytest.approx((centred @ axes)[:, :3], abs=1e-9)
    assert ratios == pytest.approx((values / values.sum())[:3])
    cov = {(r.i, r.j): r.cov for r in sp.covariance(sp.spherize(space)).collect()}
    assert np.array([[cov[i, j] for j in range(6)] for i in range(6)]) == pytest.approx(np.cov(sphere.T))
    xyz = sp.project_words(scores, [0, 2]).orderBy("idx").collect()
    assert np.array([(r.x, r.y) for r in xyz]) == pytest.approx(got[:, [0, 2]])
    alone = sp.isolate(space, scores, "w4", 5).collect()
    assert len(alone) == 6 and {r.idx: r.similarity for r in alone}[4] == 1.0
    with pytest.raises(ValueError):
        sp.project_words(scores, [0])


def test_search_and_analogy(space):
    assert [r.word for r in sp.search_words(space, "W5").collect()] == ["w5", *[f"w5{i}" for i in range(10)]]
    report = sp.search_report(space, "w", 7).collect()
    assert len(report) == 7 and {r.matches for r in report} == {60}
    near = [r.word for r in sp.analogy(space, "w1", "w2", "w3", 4).collect()]
    assert len(near) == 4 and not {"w1", "w2", "w3"} & set(near)


def path_edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src bigint, dst bigint, weight double")


def test_hops(spark):
    edges = path_edges(spark, [(0, 1), (1, 2), (2, 3), (0, 4), (3, 4), (7, 8)])
    assert {r.idx: r.hop for r in hop_distances(edges, 0).collect()} == {0: 0, 1: 1, 4: 1, 2: 2, 3: 2}
    assert {r.idx for r in hop_distances(edges, 0, 1).collect()} == {0, 1, 4}


def test_k_hop_graph_grows_with_k(space):
    edges = [{(r.src, r.dst) for r in k_hop_graph(space, "w4", k, 0.5).collect()} for k in (1, 2)]
    assert edges[0] <= edges[1]
    with pytest.raises(ValueError):
        choose_alpha(space, "w4", 0.9999)


def test_planted_communities_are_found(spark):
    rng = np.random.default_rng(1)
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.7 if a // 10 == b // 10 else 0.03)]
    edges = path_edges(spark, pairs)
    found = communities(edges).cache()
    planted = spark.range(40).select(F.col("id").alias("idx"), F.floor(F.col("id") / 10).alias("community"))
    groups = {}
    for row in found.collect():
        groups.setdefault(row.community, set()).add(row.idx // 10)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())
    assert all(name == min(r.idx for r in found.collect() if r.community == name) for name in groups)
    assert modularity(edges, found).first()[0] == pytest.approx(modularity(edges, planted).first()[0])
