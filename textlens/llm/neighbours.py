"""Nearest neighbours: randomly rotated one-bit codes choose candidates by error bounds, exact distances decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.llm.common import map_columns, stored

#: Bits of a code for each dimension; the rotation maps vectors into that many dimensions.
BITS = 8
#: Width of the error bound in standard deviations of the estimate.
SIGMAS = 2.5
#: Vectors of a block of candidates and of queries; vectors whose mean serves as centre and whose exact distances give a
#: first limit for each query (the one bounded sample here).
BLOCK, QUERIES, SAMPLE = 4096, 256, 8192


def rotation(dims: int) -> np.ndarray:
    """Orthonormal rows that carry ``dims`` dimensions into the dimensions of the code."""
    bits = -(-dims * BITS // 8) * 8
    square = np.random.default_rng(dims).normal(size=(bits, bits))
    return np.linalg.qr(square)[0][:dims]


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors about the centre, the inner product of each with its own code, and
    the lengths."""
    moved = vectors - centre
    length = np.sqrt((moved * moved).sum(axis=1))
    turned = (moved / np.where(length > 0, length, 1)[:, None]) @ turn
    own = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(turned > 0, axis=1), np.where(length > 0, own, 1), length


def bounds(codes: np.ndarray, own: np.ndarray, length: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances, queries by candidates."""
    bits = turn.shape[1]
    moved = queries - centre
    reach = np.sqrt((moved * moved).sum(axis=1))
    turned = ((moved / np.where(reach > 0, reach, 1)[:, None]) @ turn).astype(np.float32)
    signs = np.unpackbits(codes, axis=1).astype(np.float32)
    inner = (2 * (turned @ signs.T) - turned.sum(axis=1, keepdims=True)) / np.sqrt(bits)
    scale = 2 * reach[:, None] * length[None]
    middle = reach[:, None] ** 2 + length[None] ** 2 - scale * (inner / own)
    error = scale * (SIGMAS * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(bits - 1)) + 1e-5 * (1 + reach[:, None] ** 2 + length[None] ** 2)
    return middle - error, middle + error


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) of the vectors that take part; a negative zero becomes zero."""
    rows = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).filter(finite & F.exists("vec", lambda x: x != 0))


def vector_classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Different vectors as (no, vec, dims, ids), ids the k + 1 smallest vec_ids that have it, and (vec_id, no) of the ids
    that ask. Copies are found by two hashes of the vector, so a vector with very many copies is searched once."""
    keyed = rows.select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = keyed.select("vec_id", "h1", "h2").distinct().withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    ids = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = keyed.groupBy("h1", "h2").agg(F.first("vec").alias("vec"))
    numbered = vectors.join(ids, ["h1", "h2"]).withColumn("no", F.monotonically_increasing_id())
    return stored(numbered.withColumn("dims", F.size("vec")), "classes"), keyed


def sampled(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions the sampled vectors."""
    sample = classes.orderBy(F.xxhash64("h1", "h2")).limit(SAMPLE).select("dims", "vec").toArrow()
    out: dict[int, list] = {}
    for dims, vec in zip(sample["dims"].to_pylist(), sample["vec"].to_pylist(), strict=True):
        out.setdefault(dims, []).append(vec)
    return {dims: np.array(found) for dims, found in sorted(out.items())}


def first_limits(asking: DataFrame, sample: Broadcast, k: int) -> DataFrame:
    """Adds ``limit``, the k-th smallest squared distance to a sampled vector: no nearest one is farther."""

    def limits(vectors: pa.Array) -> pa.Array:
        out = []
        for vector in vectors.to_pylist():
            others = sample.value.get(len(vector), np.empty((0, len(vector))))
            apart = ((others - np.array(vector)) ** 2).sum(axis=1)
            out.append(float(np.partition(apart, k - 1)[k - 1]) if len(apart) >= k else float("inf"))
        return pa.array(out, pa.float64())

    return asking.withColumn("limit", F.arrow_udf(limits, "double")("vec"))


def candidates(classes: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """Pairs (q, c) of class numbers whose lower bound is within the k-th smallest upper bound of the query.

    Blocks of query vectors meet blocks of codes; a pair of blocks is one row, so memory stays the same at any size and
    only codes, not vectors, are sent to each block of queries.
    """
    samples = sampled(classes)
    middles = {dims: found.mean(axis=0) for dims, found in samples.items()}
    asking = first_limits(asking, classes.sparkSession.sparkContext.broadcast(samples), k)
    spread = max(1, -(-asking.count() // QUERIES))
    block = F.pmod(F.xxhash64("no"), F.lit(spread)).cast("int")
    groups = asking.groupBy("dims", block.alias("block")).agg(F.collect_list(F.struct("no", "limit", "vec")).alias("asked"))
    groups = groups.select("dims", "block", F.col("asked.no").alias("qs"), F.col("asked.limit").alias("limits"), F.flatten("asked.vec").alias("queries"))

    def centre(dims: int) -> np.ndarray:
        return middles.get(dims, np.zeros(dims))

    schema = "dims int, ids binary, codes binary, own binary, length binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(batches):
        for batch in batches:
            numbers, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dims in np.unique(sizes).tolist():
                turn = rotation(dims)
                here = np.flatnonzero(sizes == dims)
                for start in range(0, len(here), BLOCK):
                    at = here[start : start + BLOCK]
                    vectors = batch.column(2).take(pa.array(at)).flatten().to_numpy().reshape(-1, dims)
                    codes, own, length = encode(vectors, centre(dims), turn)
                    parts = [[dims], [numbers[at].tobytes()], [codes.tobytes()], [own.tobytes()], [length.tobytes()]]
                    kinds = [pa.int32(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, kinds, strict=True)], names)

    packed = stored(classes.select("no", "dims", "vec").mapInArrow(pack, schema), "codes")
    met = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).join(groups, ["dims", "block"])

    def make(part: dict[str, list]) -> dict[str, object]:
        found = []
        for i, dims in enumerate(part["dims"]):
            turn = rotation(dims)
            queries = np.array(part["queries"][i]).reshape(-1, dims)
            ids = np.frombuffer(part["ids"][i], np.int64)
            codes = np.frombuffer(part["codes"][i], np.uint8).reshape(len(ids), -1)
            own, length = np.frombuffer(part["own"][i]), np.frombuffer(part["length"][i])
            low, high = bounds(codes, own, length, queries, centre(dims), turn)
            most = np.array(part["limits"][i]) * (1 + 1e-9)
            if len(ids) > k:
                most = np.minimum(most, np.partition(high, k - 1, axis=1)[:, k - 1])
            rows, columns = np.nonzero(low <= most[:, None])
            found.append((np.array(part["qs"][i], np.int64)[rows], ids[columns], low[rows, columns], high[rows, columns]))
        return {name: np.concatenate([f[j] for f in found]) for j, name in enumerate(("q", "c", "low", "high"))}

    near = map_columns(met.select("dims", "qs", "limits", "queries", "ids", "codes", "own", "length"), "q bigint, c bigint, low double, high double", make, rows=8)
    near = stored(near, "bounds")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("high", "c"))
    limits = near.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("q").agg(F.max("high").alias("most"), F.count(F.lit(1)).alias("n"))
    return near.join(limits, "q").filter((F.col("low") <= F.col("most")) | (F.col("n") < k)).select("q", "c")


def rerank(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds the exact Euclidean distance of each pair in double precision."""

    def distance(one: pa.Array, two: pa.Array) -> pa.Array:
        lengths = one.value_lengths().to_numpy()
        squares = (one.flatten().to_numpy() - two.flatten().to_numpy()) ** 2
        return pa.array(np.sqrt(np.add.reduceat(squares, np.cumsum(lengths) - lengths)) if len(lengths) else [], pa.float64())

    both = pairs.join(classes.select(F.col("no").alias("c"), F.col("vec").alias("b")), "c")
    both = both.join(classes.select(F.col("no").alias("q"), F.col("vec").alias("a")), "q")
    return both.select("q", "c", F.arrow_udf(distance, "double")("a", "b").alias("score"))


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` nearest rows found for each row whose vec_id is divisible by
    ``every``, by Euclidean distance, ties to the smaller vec_id; all rows but the query's own are candidates.

    Vectors that are null, empty or zero, or hold null or non-finite values, and rows without vec_id take no part.
    Equal vectors are searched once. A repeated row counts once; vectors of other lengths are never near. With fewer
    than ``k`` candidates all are returned, an empty table gives an empty table; other columns are ignored.
    """
    rows = usable(embeddings)
    classes, keyed = vector_classes(rows, k)
    asks = keyed.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    asks = stored(asks.join(classes.select("h1", "h2", "no"), ["h1", "h2"]).select("query_id", "no"), "asks")
    asking = classes.join(asks.select("no").distinct(), "no", "left_semi").select("no", "dims", "vec")
    scored = stored(rerank(candidates(classes, asking, k + 1), classes), "scored")
    ids = scored.join(classes.select(F.col("no").alias("c"), "ids"), "c")
    order = Window.partitionBy("q").orderBy("score", F.col("ids")[0])
    best = ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).drop("place")
    named = asks.join(best, asks["no"] == best["q"]).select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return named.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
