"""Shards of near equal size from indivisible groups: best-fit decreasing through a balanced tree, in rounds."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import stored
from textlens.operators.joins import lookup_join
from textlens.operators.ranking import global_index

SHARDS = 16
#: Most items that one task packs, on average where they are dealt by hash.
GROUP = 1 << 14
#: A crate holds 1 / CRATES of a shard; the smallest groups of each cell, 1 / FINER of its bytes, fill crates of 1 / FINER
#: of that size, and so on for TIERS sizes, so that small crates are there to even the shards out.
CRATES, FINER, TIERS = 128, 16, 3


class Rooms:
    """Bins by their remaining room: a balanced search tree (AA) of (room, bin)."""

    class _Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key: tuple[int, int]) -> None:
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self) -> None:
        self._root: Rooms._Node | None = None

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room that still takes ``size``, the first of equals."""
        node, best = self._root, None
        while node is not None:
            if node.key[0] >= size:
                node, best = node.left, node.key
            else:
                node = node.right
        return best

    def add(self, room: int, bin_: int) -> None:
        self._root = self._added(self._root, (room, bin_))

    def drop(self, room: int, bin_: int) -> None:
        self._root = self._dropped(self._root, (room, bin_))

    @staticmethod
    def _skewed(node):
        left = node.left
        if left is not None and left.level == node.level:
            node.left, left.right = left.right, node
            return left
        return node

    @staticmethod
    def _parted(node):
        right = node.right
        if right is not None and right.right is not None and right.right.level == node.level:
            node.right, right.left = right.left, node
            right.level += 1
            return right
        return node

    def _added(self, node, key):
        if node is None:
            return self._Node(key)
        if key < node.key:
            node.left = self._added(node.left, key)
        else:
            node.right = self._added(node.right, key)
        return self._parted(self._skewed(node))

    def _dropped(self, node, key):
        if node is None:
            return None
        if key < node.key:
            node.left = self._dropped(node.left, key)
        elif key > node.key:
            node.right = self._dropped(node.right, key)
        elif node.left is None and node.right is None:
            return None
        elif node.left is None:
            near = node.right
            while near.left is not None:
                near = near.left
            node.key, node.right = near.key, self._dropped(node.right, near.key)
        else:
            near = node.left
            while near.right is not None:
                near = near.right
            node.key, node.left = near.key, self._dropped(node.left, near.key)
        low = min(node.left.level if node.left else 0, node.right.level if node.right else 0) + 1
        if low < node.level:
            node.level = low
            if node.right is not None and node.right.level > low:
                node.right.level = low
        node = self._skewed(node)
        if node.right is not None:
            node.right = self._skewed(node.right)
            if node.right.right is not None:
                node.right.right = self._skewed(node.right.right)
        node = self._parted(node)
        if node.right is not None:
            node.right = self._parted(node.right)
        return node


def best_fit(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each of ``sizes``, which fall: the one with the least room that takes it, or else a new one.

    A size over the capacity has a bin for itself.
    """
    rooms, used, bins = Rooms(), 0, []
    least = sizes[-1] if sizes else 0
    for size in sizes:
        spot = rooms.tightest(size)
        if spot is None:
            spot, used = (capacity, used), used + 1
        else:
            rooms.drop(*spot)
        if spot[0] - size >= least:
            rooms.add(spot[0] - size, spot[1])
        bins.append(spot[1])
    return bins


def near_equal(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each of ``sizes``, which fall, for the least capacity at which best fit needs no more than ``shards``.

    A size that is no less than an even share of what it and the smaller ones leave for each shard has one for itself.
    """
    first, rest = 0, sum(sizes)
    while first < len(sizes) and shards - first > 1 and sizes[first] * (shards - first) >= rest:
        rest -= sizes[first]
        first += 1
    left, small = shards - first, sizes[first:]
    if not small:
        return list(range(first))
    low = max(-(-rest // left), small[0])
    best, high, gap = best_fit(small, low), low, 1
    while max(best) >= left:
        low, high, gap = high + 1, high + gap, gap * 2
        best = best_fit(small, high)
    while low < high:
        middle = (low + high) // 2
        bins = best_fit(small, middle)
        if max(bins) < left:
            best, high = bins, middle
        else:
            low = middle + 1
    return [*range(first), *[first + b for b in best]]


def crates(sizes: Sequence[int], capacity: int) -> list[int]:
    """The crate of each of ``sizes``, which fall: best fit with smaller crates for the smallest sizes."""
    total, start, made, out = sum(sizes), 0, 0, []
    for tier in range(TIERS):
        stop, after = len(sizes), total // FINER ** (tier + 1)
        if tier < TIERS - 1:
            below = 0
            while stop > start and below + sizes[stop - 1] <= after:
                stop -= 1
                below += sizes[stop]
        bins = best_fit(sizes[start:stop], max(1, capacity // FINER**tier))
        out += [made + b for b in bins]
        made += max(bins, default=-1) + 1
        start = stop
    return out


_DEALT = "a bigint, b bigint, cell bigint, bin bigint, bytes bigint"


def _arranged(table: pa.Table) -> pa.Table:
    return table.sort_by([("bytes", "descending"), ("a", "ascending"), ("b", "ascending")])


def shard_groups(groups: DataFrame, shards: int = SHARDS, group: int = GROUP) -> DataFrame:
    """(a, b, shard) of every row of ``groups`` (a, b, bytes), which has each pair (a, b) once.

    While there are more than ``group`` items, they are dealt by hash into cells and packed there into crates, which are
    the items of the next round. At most 2 * TIERS * (CRATES * shards + cells) crates come of a round, so that few rounds
    reach a number that one task packs into the shards; with a smaller ``group`` they end when none is packed any more.
    """
    items, rounds = groups.select("a", "b", "bytes"), []
    total, count = items.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    capacity = max(1, (total or 0) // (shards * CRATES))

    def fill(table: pa.Table) -> pa.Table:
        table = _arranged(table)
        return table.set_column(3, "bin", pa.array(crates(table["bytes"].to_pylist(), capacity), pa.int64()))

    def spread(table: pa.Table) -> pa.Table:
        table = _arranged(table)
        return table.select(["a", "b"]).append_column("shard", pa.array(near_equal(table["bytes"].to_pylist(), shards), pa.int32()))

    before = None
    while count > group and count != before:
        before = count
        cell = F.pmod(F.xxhash64("a", "b"), F.lit(-(-count // group)))
        dealt = items.select("a", "b", cell.alias("cell"), F.lit(0).cast("bigint").alias("bin"), "bytes")
        rounds.append(stored(dealt.groupBy("cell").applyInArrow(fill, _DEALT), "crates"))
        items = stored(rounds[-1].groupBy(F.col("cell").alias("a"), F.col("bin").alias("b")).agg(F.sum("bytes").alias("bytes")), "items")
        count = items.count()
    found = stored(items.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(spread, "a bigint, b bigint, shard int"), "shards")
    for dealt in reversed(rounds):
        inside = lookup_join(dealt.select("a", "b", "cell", "bin"), found.toDF("cell", "bin", "shard"), ["cell", "bin"])
        found = stored(inside.select("a", "b", "shard"), "shards")
    return found


def shard(documents: DataFrame, shards: int = SHARDS, group: int = GROUP) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null) for every row of ``documents``.

    size is the bytes of the text plus one; shards have near equal sums of sizes. Rows of equal texts are a group and
    share a shard; null texts are one group, apart from empty ones, and have a null checksum. A group larger than an even
    share of what is left has a shard for itself, and the others stay even among the rest. Fewer groups than shards leave
    shards empty. Slots count the rows of a shard from 0 in order of doc_id (null first). Repeated rows each have a slot.
    Only sizes, checksums and hashes of texts are moved, however long the texts are. An empty table gives an empty table;
    other columns are ignored.
    """
    text = F.col("text").cast("binary")
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("text", F.col("text").isNull()).alias("a"),
        F.xxhash64(F.lit(1), "text", F.length(text)).alias("b"),
    )
    rows = stored(rows, "sizes")
    groups = stored(rows.groupBy("a", "b").agg(F.sum("size").alias("bytes")), "groups")
    placed = lookup_join(rows, shard_groups(groups, shards, group), ["a", "b"])
    order = [F.col("shard").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc_nulls_first(), F.col("size").asc()]
    ranked = global_index(placed.select("doc_id", "size", "text_crc32", "shard"), order, "place")
    starts = ranked.groupBy("shard").agg(F.min("place").alias("start"))
    return ranked.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
