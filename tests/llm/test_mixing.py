from collections import defaultdict

import numpy as np
import pytest

from textlens.llm import mixing
from tests.llm.data import given_and_odd, odd_documents


def brute(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest, goal, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return goal


def words(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("sf", [None, "0.01"])
def test_targets_and_taken(spark, sf):
    docs = given_and_odd(spark) if sf is None else spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += words(r.text)
    goal = brute(dict(sizes))
    got = mixing.mixture(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), words(r.text)) for r in rows)
    source = {r.doc_id: r.source for r in rows if r.doc_id is not None} | {None: "a"}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs).collect()))
    assert mixing.mixture(odd_documents(spark, empty=True)).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 3000):
        sizes, chances = rng.integers(1, 20000, n), np.full(n, 0.37)
        out = mixing.flight(sizes, chances)
        assert out.sum() == pytest.approx(chances.sum()) and (out * sizes).sum() == pytest.approx((chances * sizes).sum())
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2


def test_rounds_of_small_groups(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else "b", 1 + i * i % 97) for i in range(900)]
    units = spark.createDataFrame(rows, "unit long, source string, size long").selectExpr("*", "0.4D AS chance")
    out = mixing.choose(units, group=50).collect()
    assert sorted(r.unit for r in out) == list(range(900))
    for source in ("hot", "b"):
        own = [r for r in out if r.source == source]
        assert sum(r.chance for r in own) == pytest.approx(0.4 * len(own)) and sum(1e-9 < r.chance < 1 - 1e-9 for r in own) <= 2
        assert sum(r.chance * r.size for r in own) == pytest.approx(0.4 * sum(r.size for r in own))


def test_documents_come_whole(spark):
    docs = given_and_odd(spark)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    given = {tuple(r) for r in docs.collect()}
    mixed = [tuple(r) for r in out.collect()]
    assert set(mixed) <= given and len(mixed) > 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_repeated_rows_share_their_copies(spark):
    rows = [(None, f"same words here {i % 2}", "hot") for i in range(600)] + [(i, f"own {i} " * (1 + i % 9), "hot") for i in range(300)]
    docs = spark.createDataFrame([(*r, "k") for r in rows + [(1000 + i, "b " * 40, None) for i in range(50)]], "doc_id long, text string, source string, unit string")
    size, goal = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        size[r.source] += words(r.text)
    counts = defaultdict(int)
    for r in mixing.mix_documents(docs).collect():
        goal[r.source] += words(r.text)
        counts[r] += 1
    want = brute(dict(size))
    assert all(abs(goal[s] - want[s]) <= 80 for s in want)
    rate = want["hot"] / size["hot"]
    for i in range(2):
        taken = counts[None, f"same words here {i}", "hot", "k"]
        assert abs(taken - 300 * rate) <= 1


def test_one_id_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing.choose, "__defaults__", (40,))
    rows = [(None if i % 3 else 7, "s" if i % 2 else None, "w " * (i % 37) + str(i)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixture(docs).collect()
    assert len(got) == 900 and all(0 <= r.taken <= 2 * r.size for r in got)
    for target in {r.target for r in got}:
        assert abs(sum(r.taken for r in got if r.target == target) - target) <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs.repartition(7)).collect()))
