"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import map_columns, small_side, stored
from textlens.llm.components import components

BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-6
#: Documents of one side of a tile of pairs, and of one block of a bucket.
CHUNK, BLOCK = 64, 1024
#: Rounds in which the members of a bucket are compared with one head, before all that is left is compared.
HEADS = 3
_MIX = 0x9E3779B97F4A7C15


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word k-grams of a text (the whole sequence if it has fewer words), sorted."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(k, n)
    rolled = one[: n - width + 1] + np.uint64(width)
    for j in range(1, width):
        rolled = rolled * np.uint64(_MIX) + one[j : n - width + 1 + j]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(32)
    return np.unique(rolled)


def text_key(text: bytes | None) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split()))


def _families() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(hashes: np.ndarray, families: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minimum of each hash family over a set."""
    a, b = families
    top = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(top), 1024):
        np.minimum(low, (top[start : start + 1024] * a + b).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature; the band's number is part of it."""
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ rows[:, j]) * np.uint64(_MIX)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """After n compared hashes, the fewest matches at which similarity may still reach ``threshold``.

    Under a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), so the chance of a similarity of at
    least t is P(Binomial(n + 1, t) <= m). A pair is pruned when that is under ``miss``.
    """
    out = {}
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key (of the word sequence), bands and signature of every document."""

    def make(part: dict[str, list]) -> dict[str, object]:
        families = _families()
        sets = [shingles(text, k) for text in part["text"]]
        lows = [signature(s, families) for s in sets]
        return {
            "doc_id": part["doc_id"],
            "n_shingles": [len(s) for s in sets],
            "key": [text_key(text) for text in part["text"]],
            "bands": [band_keys(low) for low in lows],
            "signature": [low.tobytes() for low in lows],
        }

    narrow = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_columns(narrow, "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>, signature binary", make)


def prune(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that the posterior bounds do not rule out, comparing signatures batch by batch."""
    need = least_matches(threshold)

    def make(part: dict[str, list]) -> dict[str, object]:
        n = len(part["a"])
        left = np.frombuffer(b"".join(part["sa"]), np.uint32).reshape(n, -1)
        right = np.frombuffer(b"".join(part["sb"]), np.uint32).reshape(n, -1)
        alive, matches = np.arange(n), np.zeros(n, np.int64)
        for stop, least in need.items():
            matches[alive] += (left[alive, stop - BATCH : stop] == right[alive, stop - BATCH : stop]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        return {"a": np.array(part["a"], np.int64)[alive], "b": np.array(part["b"], np.int64)[alive]}

    both = pairs.join(marks.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
    both = both.join(marks.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    return map_columns(both.select("a", "b", "sa", "sb"), "a bigint, b bigint", make, rows=4096)


def in_tiles(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as tiles (tile, a, b) of lists: about `CHUNK` partners of one ``a`` are a tile."""
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.lit(1))
    dealt = pairs.join(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
    dealt = dealt.withColumn("tile", F.xxhash64("a", F.pmod(F.xxhash64("b"), chunks)))
    return dealt.groupBy("tile").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))


def confirm(tiles: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among the pairs of ``tiles`` whose full shingle sets satisfy 100 * intersection >= percent * union.

    The texts of a tile come sorted behind its pairs, each once, so a task holds the sets of one tile however many pairs
    a document has. Pairs that links of the same tile already join are passed over.
    """
    nodes = stored(tiles.select("tile", F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")), "nodes")
    ids = stored(nodes.select(F.col("node").alias("doc_id")).distinct(), "ids")
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(small_side(ids), "doc_id", "left_semi")
    texts = nodes.join(texts.withColumnRenamed("doc_id", "node"), "node")
    none = F.lit(None).cast("array<bigint>")
    rows = texts.select("tile", "node", "text", none.alias("a"), none.alias("b"))
    rows = rows.union(tiles.select("tile", F.lit(None).cast("bigint"), F.lit(None).cast("binary"), "a", "b"))
    rows = rows.repartition("tile").sortWithinPartitions("tile", F.col("node").asc_nulls_first())

    def links(ones: list[int], twos: list[int], sets: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        found, root = [], {i: i for i in sets}

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for a, b in zip(ones, twos, strict=True):
            one, two = sets.get(a), sets.get(b)
            if one is None or two is None or top(a) == top(b) or 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
                continue
            common = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * common >= percent * (len(one) + len(two) - common):
                found.append((a, b))
                root[top(a)] = top(b)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ones, twos, sets = None, [], [], {}
        for batch in batches:
            found = []
            for tile, node, text, a, b in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if tile != now:
                    found += links(ones, twos, sets)
                    now, ones, twos, sets = tile, [], [], {}
                if node is None:
                    ones, twos = ones + a, twos + b
                else:
                    sets[node] = shingles(text, k)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found = links(ones, twos, sets)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def compare_all(left: DataFrame, faces: DataFrame, threshold: float) -> DataFrame:
    """Tiles of the pairs of different components within each bucket of ``left`` (band, node, label) that the posterior
    bounds leave. Pairs are compared block by block inside tasks and only the survivors leave them.

    A component with many members in a bucket fills blocks of its own, which are not compared with each other. Two
    documents are compared in the first band they share and in no other.
    """
    need = least_matches(threshold)
    counted = left.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    cells = counted.withColumn("cell", F.when(F.col("n") >= BLOCK // 2, F.col("label")))
    sizes = cells.groupBy("band", "cell").agg(F.sum("n").alias("n")).withColumn("of", F.ceil(F.col("n") / BLOCK))
    blocks = sizes.select("band", "cell", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("at"))
    blocks = blocks.select("band", "cell", F.xxhash64("band", "cell", "at").alias("block"))
    one, two = blocks.toDF("band", "c1", "b1"), blocks.toDF("band", "c2", "b2")
    pairs = one.join(two, "band").filter("b1 <= b2 AND NOT (c1 IS NOT NULL AND c2 IS NOT NULL AND c1 = c2)")
    ends = F.when(F.col("b1") == F.col("b2"), F.array("b1")).otherwise(F.array("b1", "b2"))
    tiles = stored(pairs.select(F.xxhash64("b1", "b2").alias("tile"), F.posexplode(ends).alias("side", "block")), "tiles")
    dealt = left.join(cells.select("band", "label", "cell"), ["band", "label"])
    dealt = dealt.join(sizes.select("band", F.col("cell").alias("c"), "of"), "band").filter(F.col("cell").eqNullSafe(F.col("c")))
    dealt = dealt.withColumn("block", F.xxhash64("band", "cell", F.pmod(F.xxhash64("node"), F.col("of"))))
    rows = dealt.join(faces, "node").join(tiles, "block").select("tile", "side", "band", "node", "label", "signature")
    rows = rows.repartition("tile").sortWithinPartitions("tile", "side")

    def survivors(tile: list[tuple]) -> Iterator[tuple[list[int], list[int]]]:
        side = np.array([r[1] for r in tile])
        node, label = np.array([r[3] for r in tile], np.int64), np.array([r[4] for r in tile], np.int64)
        marks = np.frombuffer(b"".join(r[5] for r in tile), np.uint32).reshape(len(tile), -1)
        keys = np.stack([band_keys(m) for m in marks])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        same, band = side.max() == 0, tile[0][2]
        own = (keys[0] == band).argmax()
        for begin in range(0, len(left), CHUNK):
            part = left[begin : begin + CHUNK]
            x, y = np.nonzero(label[part][:, None] != label[right][None])
            x, y = part[x], right[y]
            if same:
                x, y = x[x < y], y[x < y]
            first = ~(keys[x, :own] == keys[y, :own]).any(axis=1)
            x, y = x[first], y[first]
            matches = np.zeros(len(x), np.int64)
            for stop, least in need.items():
                matches += (marks[x, stop - BATCH : stop] == marks[y, stop - BATCH : stop]).sum(axis=1)
                on = matches >= least
                x, y, matches = x[on], y[on], matches[on]
            for group in np.unique(y // CHUNK):
                here = y // CHUNK == group
                yield node[x[here]].tolist(), node[y[here]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def finish() -> Iterator[pa.RecordBatch]:
            found = list(survivors(held)) if held else []
            names = [held[0][0] + i for i in range(len(found))] if held else []
            names = [(n + (1 << 63)) % (1 << 64) - (1 << 63) for n in names]
            parts = [names, [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, kinds, strict=True)], ["tile", "a", "b"])

        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if held and row[0] != held[0][0]:
                    yield from finish()
                    held = []
                held.append(row)
        yield from finish()

    return rows.mapInArrow(run, "tile bigint, a array<bigint>, b array<bigint>")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents`` (doc_id, text; other columns are ignored).

    Documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles (words are lower-cased in
    A-Z; a text of fewer words is one shingle). component_id is the smallest doc_id that links reach.
    Null, empty and blank texts have no shingle and no link: they are their own component. Rows with equal words are one
    class. Rows that share a doc_id are one document for the links. A row without doc_id links with nothing: its
    component_id is null and it is kept. An empty table gives an empty table.

    Classes of equal texts are found first, so exact copies never meet. In a band's bucket members are compared with one
    head, then again with other heads as long as that merges components and much is left to compare; what is left
    between different components of a bucket is then compared in full, so no candidate pair is lost.
    """
    marks = stored(signatures(documents, k), "signatures")
    usable = marks.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("key").agg(F.min("doc_id").alias("node")), "classes")
    nodes = usable.join(classes, "key").filter("doc_id = node").select("node", "bands", "signature")
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = stored(keyed.join(shared.select("band"), "band").distinct(), "members")
    involved = members.select("node").distinct()
    faces = stored(nodes.join(involved, "node").select("node", "signature"), "faces")

    found: DataFrame | None = None
    label = members.select("node").distinct().withColumn("label", F.col("node"))
    left, rounds, last = members.withColumn("label", F.col("node")), 0, False
    while not last:
        mixed = left.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        left = stored(left.join(mixed.select("band"), "band"), "left")
        sizes = left.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band")
        sizes = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        rows, pairs = sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not rows:
            break
        last = rounds >= HEADS or pairs <= 2 * rows
        if last:
            kept = stored(compare_all(left, faces, percent / 100), "survivors")
        else:
            order = F.col("node") if not rounds else F.xxhash64("node", F.lit(rounds))
            heads = left.groupBy("band").agg(F.min_by(F.struct("node", "label"), order).alias("head"))
            tried = left.join(heads, "band").filter("label <> head.label").select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
            kept = stored(in_tiles(stored(prune(tried, faces, percent / 100), "survivors")), "tiles")
        fresh = stored(confirm(kept, documents, k, percent), "links")
        rounds += 1
        if fresh.isEmpty():
            if not last:
                rounds = HEADS
            continue
        found = fresh if found is None else found.union(fresh)
        label = components(found)
        left = left.drop("label").join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    reached = label if found is not None else None
    out = marks.select("doc_id", "n_shingles", "key").join(classes, "key", "left")
    out = out.withColumn("own", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")))
    if reached is not None:
        out = out.join(reached.withColumnRenamed("node", "own"), "own", "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("bigint"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "own", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
