"""As-of joins against a search through all rows."""

import random

import pytest

from textlens.operators.asof import asof_join


def brute(left, right):
    out = []
    for key, at, name in left:
        fits = [r for r in right if None not in (key, at, r[0], r[1]) and r[0] == key and r[1] <= at]
        best = max(fits, key=lambda r: (r[1], r[2]), default=None)
        out.append((key, at, name, best and best[1], best and best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_rows", [1 << 20, 20, 3])
def test_asof(spark, slice_rows):
    """Hot series over many ranges, ranges without a row of the other side, ties, nulls and repeated rows."""
    rng = random.Random(5)
    keys = ["hot"] * 8 + ["a", "b", None]
    left = [(rng.choice(keys), rng.choice([None, *range(200)]), f"l{i % 150}") for i in range(300)]
    right = [(rng.choice(keys), rng.choice([None, *range(20, 60), *range(150, 160)]), rng.randrange(50)) for i in range(200)]
    right += right[:20]
    one = spark.createDataFrame(left, "key string, at int, name string")
    two = spark.createDataFrame(right, "key string, since int, name int").withColumnRenamed("name", "what")
    got = asof_join(one, two, "at", "since", by=["key"], slice_rows=slice_rows)
    assert got.columns == ["key", "at", "name", "since", "what"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(left, right)


def test_one_series_and_empty_tables(spark):
    one = spark.createDataFrame([(i,) for i in range(0, 100, 3)], "at int")
    two = spark.createDataFrame([(i, i * 10) for i in range(10, 90, 7)], "since int, what int")
    got = asof_join(one, two, "at", "since", slice_rows=10).orderBy("at").collect()
    assert [r["what"] for r in got] == [max((i * 10 for i in range(10, 90, 7) if i <= at), default=None) for at in range(0, 100, 3)]
    assert [r["what"] for r in asof_join(one, two.limit(0), "at", "since").collect()] == [None] * 34
    assert asof_join(one.limit(0), two, "at", "since").collect() == []
