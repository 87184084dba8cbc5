"""Shards: best fit against a plain search, whole groups, near equal sizes, gapless slots."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.data import given_and_odd, odd_documents
from textlens.llm.shards import CRATES, TIERS, Rooms, best_fit, crates, near_equal, shard, shard_groups


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for size in sizes:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fits:
            _, at = min(fits)
        else:
            at = len(rooms)
            rooms.append(capacity)
        rooms[at] -= size
        out.append(at)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(1, 100))
def test_best_fit(sizes, capacity):
    sizes.sort(reverse=True)
    assert best_fit(sizes, capacity) == plain_best_fit(sizes, capacity)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=150))
def test_rooms(steps):
    rooms, held = Rooms(), set()
    for number, (add, value) in enumerate(steps):
        if add:
            rooms.add(value, number)
            held.add((value, number))
        else:
            found = rooms.tightest(value)
            assert found == min((h for h in held if h[0] >= value), default=None)
            if found:
                rooms.drop(*found)
                held.remove(found)

    def depth(node):
        return 0 if node is None else 1 + max(depth(node.left), depth(node.right))

    assert depth(rooms._root) <= 2 * np.log2(len(held) + 2)


def totals(sizes, places, shards):
    out = np.zeros(shards, np.int64)
    np.add.at(out, places, sizes)
    return out


def test_near_equal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 16, 17, 500, 4000):
        sizes = sorted(rng.integers(1, 5000, n).tolist(), reverse=True)
        places = near_equal(sizes, 16)
        assert len(places) == n and all(0 <= p < 16 for p in places)
        if n >= 500:
            sums = totals(sizes, places, 16)
            assert sums.max() - sums.min() < 0.01 * sums.mean()
    hot = [10**6, *sizes]
    sums = totals(hot, near_equal(hot, 16), 16)
    assert sums[0] == 10**6 or near_equal(hot, 16)[0] == 0
    assert sums[1:].max() - sums[1:].min() < 0.01 * sums[1:].mean()


def test_crates_are_few():
    rng = np.random.default_rng(2)
    for top in (10, 2000, 100000):
        sizes = sorted(rng.integers(1, top, 5000).tolist(), reverse=True)
        capacity = max(1, sum(sizes) // 200)
        made = crates(sizes, capacity)
        assert len(made) == len(sizes) and set(made) == set(range(max(made) + 1))
        assert max(made) < TIERS * (2 * 201 + 1)


def checked(rows, shards=16):
    """Contract of the result against the texts."""
    by_text, counts = {}, {}
    for r in rows:
        assert by_text.setdefault(r["text"], r["shard"]) == r["shard"]
        raw = None if r["text"] is None else r["text"].encode()
        assert r["size"] == (0 if raw is None else len(raw)) + 1
        assert r["text_crc32"] == (None if raw is None else zlib.crc32(raw))
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in counts.values())


def joined(frame, **options):
    """Rows with their text: the checksum and the size name it in these tables."""
    texts = {}
    for r in frame.select("text").distinct().collect():
        raw = None if r["text"] is None else r["text"].encode()
        key = (None, 1) if raw is None else (zlib.crc32(raw), len(raw) + 1)
        assert key not in texts
        texts[key] = r["text"]
    got = [r.asDict() for r in shard(frame, **options).collect()]
    return [{**r, "text": texts[r["text_crc32"], r["size"]]} for r in got]


@pytest.mark.parametrize("group", [1 << 14, 64])
def test_documents(spark, group):
    frame = given_and_odd(spark).withColumn("shard", F.lit("s")).withColumn("slot", F.lit(1)).withColumn("a", F.lit(1))
    rows = joined(frame, group=group)
    assert len(rows) == frame.count()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in rows) == sorted((r[0] is None, r[0], len((r[1] or "").encode()) + 1) for r in frame.select("doc_id", "text").collect())
    checked(rows)


def test_rounds_stay_even(spark):
    """Groups dealt over many cells, packed in two rounds."""
    sizes = spark.range(60000).select(F.col("id").alias("a"), F.lit(1).cast("long").alias("b"), (F.pmod(F.xxhash64("id"), F.lit(3000)) + 1).alias("bytes"))
    got = sizes.join(shard_groups(sizes, group=4096), ["a", "b"]).groupBy("shard").agg(F.sum("bytes").alias("n"), F.count("*").alias("rows")).collect()
    sums = np.array([r["n"] for r in got])
    assert len(got) == 16 and sum(r["rows"] for r in got) == 60000
    assert sums.max() - sums.min() < 0.01 * sums.mean() and CRATES * 16 < 4096


def test_hot_text(spark):
    """A text that holds a third of all rows stays whole, the others are even."""
    frame = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 20)).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))).alias("text"))
    rows = joined(frame)
    checked(rows)
    sums = totals([r["size"] for r in rows], [r["shard"] for r in rows], 16)
    assert np.sort(sums)[:-1].max() - sums.min() <= 0.02 * sums.mean()


def test_empty(spark):
    assert shard(odd_documents(spark, empty=True)).collect() == []
