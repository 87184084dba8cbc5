"""Hard negatives: angles to reference directions bound scores, and only rows whose bounds reach a window are scored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.common import stored
from textlens.operators.joins import lookup_join
from textlens.session import scratch_path

#: Components are floor(SCALE * x).
SCALE = 256
#: Reference directions, and the bounded sample of vectors that they are picked from.
DIRECTIONS, SAMPLE = 16, 4096
#: Vectors of a block, about; bytes of anchors that are sent to all tasks at once, about.
BLOCK, ANCHOR_BYTES = 4096, 32 << 20
#: What angles may be off by rounding, in radians; relative and absolute slack of a bound of a score.
ANGLE_SLACK, SLACK = 1e-6, 1e-6
#: Squared lengths stay below this, so that every score fits in 64 bits.
MOST = float(1 << 62)
_LOWEST = np.iinfo(np.int64).min


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dims, vec of whole numbers) of the rows that take part, repeated rows once."""
    rows = embeddings.select("vec_id", "label", "embedding").filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.filter(finite).select("vec_id", label.cast("bigint").alias("label"), scaled.alias("vec"))
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.filter(length < MOST).select("vec_id", "label", F.size("vec").alias("dims"), F.transform("vec", lambda x: x.cast("bigint")).alias("vec"))
    return rows.distinct()


def lengths(vectors: np.ndarray) -> np.ndarray:
    real = vectors.astype(np.float64)
    return np.sqrt((real * real).sum(axis=1))


def angles(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of vectors (rows) to the directions, those of a zero vector right."""
    cosines = (vectors.astype(np.float64) @ directions.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def references(sample: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors of a sample, each the one whose nearest direction so far is farthest."""
    norms = lengths(sample)
    units = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.eye(sample.shape[1])[:count]
    picked, near = [0], units @ units[0]
    while len(picked) < min(count, len(units)) and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, units @ units[picked[-1]])
    return units[picked]


def bounds(own: np.ndarray, norm: float, others: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of scores from angles alone, by the triangle inequality of angles.

    Two vectors at angles x and y to a direction enclose an angle between |x - y| and the less of x + y and 2 pi - x - y.
    Bounds are widened by what rounding of angles and products may lose.
    """
    least = np.abs(others - own).max(axis=1).astype(np.float64) - 2 * ANGLE_SLACK
    both = (others + own).astype(np.float64)
    most = np.minimum(both, 2 * np.pi - both).min(axis=1) + 2 * ANGLE_SLACK
    product = norms * norm
    slack = product * SLACK + 1
    return product * np.cos(np.clip(most, 0, np.pi)) - slack, product * np.cos(np.clip(least, 0, np.pi)) + slack


def scores(vectors: np.ndarray, norms: np.ndarray, vector: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products of whole numbers; in floating point where these stay below 2^53."""
    if len(vectors) and norms.max() * norm < 1 << 52:
        return (vectors.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    return vectors @ vector


class Best:
    """The best scores so far for each of many askers: higher first, ties by smaller id."""

    def __init__(self, askers: int, k: int) -> None:
        self.score, self.id = np.full((askers, k), _LOWEST, np.int64), np.zeros((askers, k), np.int64)
        self.known, self.k = np.zeros(askers, np.int64), k

    def limit(self, asker: int) -> float:
        """What a score must reach to be among the best."""
        return float(self.score[asker, -1]) if self.known[asker] >= self.k else -np.inf

    def offer(self, asker: int, ids: np.ndarray, found: np.ndarray) -> None:
        n = self.known[asker]
        ids, found = np.concatenate([self.id[asker, :n], ids]), np.concatenate([self.score[asker, :n], found])
        order = np.lexsort((ids, -found))[: self.k]
        self.known[asker] = len(order)
        self.id[asker, : len(order)], self.score[asker, : len(order)] = ids[order], found[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asker, place = np.nonzero(np.arange(self.k)[None] < self.known[:, None])
        return asker, self.id[asker, place], self.score[asker, place]


@dataclass
class Block:
    """Vectors of one label, with their lengths and angles."""

    label: int
    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray


@dataclass
class Anchors:
    """Anchors of one number of dimensions. ``low`` and ``high`` are the windows of each anchor's positives."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def block_reach(anchors: Anchors, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of each anchor with all of a block, from the ranges of the block's angles and lengths."""
    first, last = block.angles.min(axis=0), block.angles.max(axis=0)
    apart = np.maximum(np.maximum(first - anchors.angles, anchors.angles - last), 0).max(axis=1).astype(np.float64) - 2 * ANGLE_SLACK
    ahead = (anchors.angles + last).astype(np.float64)
    behind = 2 * np.pi - (anchors.angles + first).astype(np.float64)
    most = np.minimum(ahead, behind).min(axis=1) + 2 * ANGLE_SLACK
    high, low = np.cos(np.clip(apart, 0, np.pi)), np.cos(np.clip(most, 0, np.pi))
    small, large = anchors.norms * block.norms.min(), anchors.norms * block.norms.max()
    slack = large * SLACK + 1
    return np.minimum(low * small, low * large) - slack, np.maximum(high * small, high * large) + slack


def take_positives(anchors: Anchors, block: Block, best: Best, seen: dict[str, int]) -> None:
    """Offer the rows of a block to the anchors of its label, as far as their bounds reach the best ones known."""
    _, reach = block_reach(anchors, block)
    for a in np.flatnonzero(anchors.labels == block.label).tolist():
        seen["pairs"] += len(block.ids)
        if reach[a] < best.limit(a):
            continue
        low, high = bounds(anchors.angles[a], anchors.norms[a], block.angles, block.norms)
        other = block.ids != anchors.ids[a]
        sure = low[other]
        limit = max(best.limit(a), np.partition(sure, -best.k)[-best.k] if len(sure) >= best.k else -np.inf)
        here = np.flatnonzero(other & (high >= limit))
        seen["scored"] += len(here)
        if len(here):
            best.offer(a, block.ids[here], scores(block.vectors[here], block.norms[here], anchors.vectors[a], anchors.norms[a]))


def take_negatives(anchors: Anchors, block: Block, best: Best, seen: dict[str, int]) -> None:
    """Offer the rows of a block to the windows of the anchors of other labels that their bounds overlap."""
    floor, reach = block_reach(anchors, block)
    windows = anchors.low.shape[1]
    for a in np.flatnonzero(anchors.labels != block.label).tolist():
        asking = [(w, max(float(anchors.low[a, w]), best.limit(a * windows + w)), float(anchors.high[a, w])) for w in range(windows)]
        asking = [(w, low, high) for w, low, high in asking if low <= high]
        seen["pairs"] += len(block.ids)
        asking = [(w, low, high) for w, low, high in asking if reach[a] >= low and floor[a] <= high]
        if not asking:
            continue
        low, high = bounds(anchors.angles[a], anchors.norms[a], block.angles, block.norms)
        wanted = np.zeros(len(block.ids), bool)
        for _, least, most in asking:
            wanted |= (high >= least) & (low <= most)
        here = np.flatnonzero(wanted & (block.ids != anchors.ids[a]))
        if not len(here):
            continue
        seen["scored"] += len(here)
        found = scores(block.vectors[here], block.norms[here], anchors.vectors[a], anchors.norms[a])
        for w, _, _ in asking:
            fit = np.flatnonzero((found >= anchors.low[a, w]) & (found <= anchors.high[a, w]))
            if len(fit):
                best.offer(a * windows + w, block.ids[here[fit]], found[fit])


def packed(rows: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """The rows as blocks of one label and one nearest direction: ids, vectors, lengths and angles as bytes.

    Blocks of about `BLOCK` rows; a label that owns most rows fills many.
    """
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def nearest(dims: pa.Array, vectors: pa.Array) -> pa.Array:
        sizes = dims.to_numpy()
        out = np.zeros(len(sizes), np.int32)
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            found = vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, d)
            out[at] = angles(found, lengths(found), shared.value.get(d, np.eye(d)[:DIRECTIONS])).argmin(axis=1)
        return pa.array(out)

    near = stored(rows.withColumn("near", F.arrow_udf(nearest, "int")("dims", "vec")), "rows")
    cells = near.groupBy("dims", "label", "near").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("of"))
    dealt = lookup_join(near, stored(cells, "cells"), ["dims", "label", "near"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), F.col("of")))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        d = table["dims"][0].as_py()
        vectors = table["vec"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        norms = lengths(vectors)
        turned = angles(vectors, norms, shared.value.get(d, np.eye(d)[:DIRECTIONS]))
        row = [d, table["label"][0].as_py(), table["vec_id"].to_numpy().tobytes(), vectors.tobytes(), norms.tobytes(), turned.tobytes()]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["dims", "label", "ids", "vectors", "norms", "angles"])

    schema = "dims int, label bigint, ids binary, vectors binary, norms binary, angles binary"
    return stored(dealt.groupBy("dims", "label", "near", "part").applyInArrow(pack, schema), "blocks")


def _scan(blocks: DataFrame, anchors: dict[int, Anchors], take, k: int, windows: int) -> DataFrame:
    """(dims, asker, id, score, pairs, scored): the best of each task for every anchor and window. Only the anchors are sent, and what tasks find.

    pairs and scored, the counts of rows met and of rows scored, stand on one row of a task.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        seen = {"pairs": 0, "scored": 0}
        for batch in batches:
            for i in range(batch.num_rows):
                dims, label, ids, vectors, norms, turned = (batch.column(j)[i].as_py() for j in range(6))
                asking = shared.value.get(dims)
                if asking is None:
                    continue
                ids = np.frombuffer(ids, np.int64)
                block = Block(
                    label, ids, np.frombuffer(vectors, np.int64).reshape(len(ids), -1), np.frombuffer(norms), np.frombuffer(turned, np.float32).reshape(len(ids), -1)
                )
                take(asking, block, best.setdefault(dims, Best(len(asking.ids) * windows, k)), seen)
        for dims, found in best.items():
            asker, ids, score = found.rows()
            n = len(asker)
            counts = [np.r_[seen.pop(name, 0), np.zeros(max(n - 1, 0), np.int64)][:n].astype(np.int64) for name in ("pairs", "scored")]
            parts = [np.full(n, dims, np.int32), asker.astype(np.int64), ids, score, *counts]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], ["dims", "asker", "id", "score", "pairs", "scored"])

    return blocks.mapInArrow(run, "dims int, asker bigint, id bigint, score bigint, pairs bigint, scored bigint")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("dims", "asker").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def anchor_arrays(table: pa.Table, directions: dict[int, np.ndarray]) -> dict[int, Anchors]:
    """The anchors of a chunk, by dimensions, in order of their ids."""
    out = {}
    for dims in sorted(set(table["dims"].to_pylist())):
        part = table.filter(pc.equal(table["dims"], dims)).sort_by([("vec_id", "ascending"), ("label", "ascending")])
        vectors = part["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        norms = lengths(vectors)
        turned = angles(vectors, norms, directions.get(dims, np.eye(dims)[:DIRECTIONS]))
        out[dims] = Anchors(part["vec_id"].to_numpy(), part["label"].to_numpy(), vectors, norms, turned)
    return out


def mined(anchors: dict[int, Anchors], blocks: DataFrame, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors of one chunk."""
    spark = blocks.sparkSession
    near = stored(_top(_scan(blocks, anchors, take_positives, positives, 1), positives), "positives")
    table = near.select("dims", "asker", "id", "score", "rank").toArrow()
    wanted = []
    for dims, asking in anchors.items():
        part = table.filter(pc.equal(table["dims"], dims))
        asker, place, score = part["asker"].to_numpy(), part["rank"].to_numpy() - 1, part["score"].to_numpy()
        # Windows without a positive are empty. Python's whole numbers do not overflow.
        asking.low, asking.high = np.ones((len(asking.ids), positives), np.int64), np.zeros((len(asking.ids), positives), np.int64)
        asking.low[asker, place] = [-(-least * s // 100) for s in score.tolist()]
        asking.high[asker, place] = [most * s // 100 for s in score.tolist()]
        ends = pa.array(np.full(len(asker), dims, np.int32)), pa.array(asker * positives + place), pa.array(asking.ids[asker]), part["id"], part["score"]
        wanted.append(pa.table(list(ends), ["dims", "asker", "anchor_id", "positive_id", "positive_score"]))
    found = _top(_scan(blocks, anchors, take_negatives, negatives, positives), negatives)
    named = found.select("dims", "asker", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    asked = spark.createDataFrame(pa.concat_tables(wanted))
    return named.join(asked, ["dims", "asker"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    embeddings: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, least: int = 50, most: int = 95, chunk_bytes: int = ANCHOR_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose vec_id is divisible by ``every``.

    Components become floor(256 * x), a score is the inner product of whole numbers. An anchor's positives are its
    ``positives`` best rows of the same label, with another vec_id; for each, the best ``negatives`` rows of other labels
    (and another vec_id) are returned whose score is at least ``least`` and at most ``most`` percent of the positive's. Higher scores come
    first, ties by smaller vec_id. With fewer rows all are returned.

    Rows without vec_id or label, with a null or empty vector, or with a null or non-finite component take no part, nor do
    vectors of a squared length of 2^62 or more after scaling, whose scores 64 bits could not hold. Zero vectors score 0.
    Repeated rows count once; rows of one vec_id that differ are rows of their own, equal in rank. Vectors of different
    lengths never meet. An empty table gives an empty table; other columns are ignored.

    Vectors are stored in blocks of one label and one nearest direction. Anchors are sent in chunks of about
    ``chunk_bytes`` to all blocks, which are read and not shuffled; a block, then a row, is passed over when its angles show
    that no score can reach a window or the best known ones.
    """
    spark = embeddings.sparkSession
    rows = stored(usable(embeddings), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id", "vec")).limit(SAMPLE).select("dims", "vec").toArrow()
    sizes = np.array(sample["dims"].to_pylist(), np.int64)
    directions = {}
    for dims in np.unique(sizes).tolist():
        found = sample.filter(pa.array(sizes == dims))["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        directions[dims] = references(found.astype(np.float64))
    blocks = packed(rows, directions)

    asked = rows.filter(F.col("vec_id") % every == 0)
    width = asked.agg(F.sum(F.col("dims") * 8 + DIRECTIONS * 4 + positives * (32 + negatives * 16) + 64)).first()[0] or 0
    chunks = max(1, -(-width // chunk_bytes))
    path = scratch_path(spark, "negatives")
    asked = stored(asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(chunks)).cast("int")), "anchors")
    for chunk in range(chunks):
        anchors = anchor_arrays(asked.filter(F.col("chunk") == chunk).drop("chunk").toArrow(), directions)
        if anchors:
            mined(anchors, blocks, positives, negatives, least, most).write.parquet(f"{path}/chunk={chunk}")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not width:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*[c.split()[0] for c in schema.split(", ")])
