import math

import numpy as np
import pytest

from textlens.llm import dedup
from textlens.llm.components import components
from tests.llm.data import given_and_odd, odd_documents


def word_sets(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent):
    sets = [(i, word_sets(t, k)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                label[high] = low
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_components_agree_with_all_pairs(spark, k):
    docs = given_and_odd(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = dedup.near_duplicates(docs, k, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, 80)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_chains_and_many_near_copies(spark):
    """Variants of one text, most of them not near each other, and a chain whose ends are far apart."""
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        words[(i * 7) % 80] = f"v{i}"
        if i % 3 == 0:
            words[(i * 11 + 40) % 80] = f"u{i}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(100)]
    rows += [(1000 + i, " ".join(chain[i * 4 : i * 4 + 60] + [f"d{j}" for j in range(i * 4)][-40:])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs, 4, 80).collect())
    assert got == sorted(brute(rows, 4, 80))


def test_empty_table(spark):
    assert dedup.near_duplicates(odd_documents(spark, empty=True), 4, 80).count() == 0


def test_bounds_follow_the_posterior():
    """The fewest matches are where the tail of the Beta posterior, integrated numerically, passes the miss chance."""
    grid = np.linspace(0.5 / 20000, 1 - 0.5 / 20000, 20000)
    for n, m in dedup.least_matches(0.8, 1e-4).items():
        def tail(k):
            density = k * np.log(grid) + (n - k) * np.log(1 - grid)
            density = np.exp(density - density.max())
            return density[grid >= 0.8].sum() / density.sum()

        assert tail(m) >= 1e-4 * 0.9 and (m == 0 or tail(m - 1) < 1e-4 * 1.1)
        assert not math.isnan(tail(m))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(139, 50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, **{i: 50 for i in range(100, 140)}}


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Small blocks and no rounds with heads: all pairs of a bucket are compared tile by tile."""
    monkeypatch.setattr(dedup, "BLOCK", 16)
    monkeypatch.setattr(dedup, "CHUNK", 4)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(160):
        words = [f"b{j}" for j in range(100)]
        for at in rng.choice(100, rng.integers(0, 7), False):
            words[at] = f"v{i}.{at}"
        rows.append((i * 3 - 200, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows, 4, 80))
    for heads in (0, 1, 3):
        monkeypatch.setattr(dedup, "HEADS", heads)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs, 4, 80).collect()) == want
