"""Word-vector spaces: rows of ``idx, word, vec``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.vector import cosine, doubles, subtract, unit
from textlens.operators.joins import lookup_join
from textlens.session import materialise

ORIGIN_ROWS = 1024  # vectors whose mean is the origin of the products of `moments`


def mean_vector(vec: Column) -> Column:
    """Aggregate: the per-dimension mean of an array column, combined before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(vec))))


def get_vector(space: DataFrame, word: str) -> DataFrame:
    return space.filter(F.col("word") == word)


def find_vector(space: DataFrame, word: str) -> tuple[int, list[float]] | None:
    """Index and vector of one word, or None."""
    row = get_vector(space, word).select("idx", doubles(F.col("vec")).alias("vec")).first()
    return None if row is None else (row["idx"], row["vec"])


def unit_vectors(space: DataFrame) -> DataFrame:
    return space.withColumn("vec", unit(F.col("vec")))


def centroid(space: DataFrame) -> DataFrame:
    """One row: the mean vector."""
    return space.agg(mean_vector(F.col("vec")).alias("vec"))


def centred(space: DataFrame) -> DataFrame:
    """Shift every vector by the centroid."""
    placed = space.withColumn("_center", centroid(space).scalar())
    return placed.withColumn("vec", subtract(F.col("vec"), F.col("_center"))).drop("_center")


def spherize(space: DataFrame) -> DataFrame:
    """Shift by the centroid, then scale every vector to length one."""
    return unit_vectors(centred(space))


def moments(space: DataFrame, branches: int = 64) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, their mean and their sample covariance, in one scan.

    Each partition reduces its rows to their sum and one matrix of products, about an origin near the mean (that of a bounded
    sample) so that nothing cancels. Matrices are merged in a tree, as rows of arrays: partitions into ``branches`` first,
    then these. Only the result, whose size is that of the dimensions squared, reaches the driver.
    """
    rows = space.filter(F.col("vec").isNotNull()).select(doubles(F.col("vec")).alias("vec"))
    origin = rows.limit(ORIGIN_ROWS).agg(mean_vector(F.col("vec")).alias("vec")).first()["vec"]
    if origin is None:
        return 0, np.empty(0), np.empty((0, 0))
    dims = len(origin)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last column sums up ones, so that its row holds the sums of all dimensions and the number of rows.
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            if batch.num_rows:
                block = np.hstack([matrix(batch.column("vec")) - origin, np.ones((batch.num_rows, 1))])
                total += block.T @ block
        ends = np.arange(0, (dims + 1) ** 2 + 1, dims + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1), pa.int32()), pa.ListArray.from_arrays(ends, total.ravel())], ["i", "row"])

    parts = rows.mapInArrow(products, "i int, row array<double>").withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(branches)))
    summed = vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")
    merged = parts.groupBy("i", "branch").agg(summed).groupBy("i").agg(summed)
    total = np.array([r["row"] for r in merged.orderBy("i").collect()])
    count, sums = total[-1, -1], total[-1, :-1]
    scatter = total[:-1, :-1] - np.outer(sums, sums) / count
    return int(count), np.array(origin) + sums / count, scatter / max(count - 1, 1)


def covariance(space: DataFrame) -> DataFrame:
    """Sample covariance of the dimensions: rows ``i, j, cov``, from one scan (see `moments`)."""
    _, _, cov = moments(space)
    rows = [(i, row.tolist()) for i, row in enumerate(cov)]
    spread = space.sparkSession.createDataFrame(rows, "i int, row array<double>")
    return spread.select("i", F.posexplode("row").alias("j", "cov"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


@dataclass(frozen=True)
class Components:
    """Principal components: the mean, one loading vector per column and the variance along each, falling."""

    mean: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray

    @property
    def ratios(self) -> list[float]:
        total = self.variances.sum()
        return (self.variances / total if total > 0 else np.zeros_like(self.variances)).tolist()


def principal_components(space: DataFrame) -> Components:
    """All components of a space, from its covariance. Every component is turned so that its loading of largest size is
    positive."""
    _, mean, cov = moments(space)
    if not len(mean):
        return Components(mean, cov, mean)
    variances, loadings = np.linalg.eigh(cov)
    variances, loadings = np.maximum(variances[::-1], 0.0), loadings[:, ::-1]
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    return Components(mean, loadings * signs, variances)


def component_scores(space: DataFrame, found: Components, components: int) -> DataFrame:
    """``idx, word, scores``: the centred vectors on the leading components; words without a vector are left out."""
    mean, loadings = found.mean, np.ascontiguousarray(found.loadings[:, :components])

    def scores(vectors: pa.Array) -> pa.Array:
        made = (matrix(vectors) - mean) @ loadings if len(vectors) else np.empty((0, loadings.shape[1]))
        ends = np.arange(len(vectors) + 1, dtype=np.int32) * made.shape[1]
        return pa.ListArray.from_arrays(ends, made.ravel())

    held = space.filter(F.col("vec").isNotNull())
    return held.select("idx", "word", F.arrow_udf(scores, "array<double>")(doubles(F.col("vec"))).alias("scores"))


def fit_pca(space: DataFrame, components: int = 10, spherized: bool = True) -> tuple[DataFrame, list[float]]:
    """Scores (``idx, word, scores``) on the leading components and their shares of the variance.

    The space, spherized by default, is stored once, scanned once for the components and once for the scores.
    """
    base = materialise((spherize(space) if spherized else space).select("idx", "word", "vec"), "space")
    found = principal_components(base)
    return component_scores(base, found, components), found.ratios[:components]


def explained_variance(spark_space: DataFrame, ratios: Sequence[float], chosen: Sequence[int] = ()) -> DataFrame:
    """Rows ``component, ratio, chosen_total``: the share of each component and of the chosen set."""
    total = float(sum(ratios[i] for i in chosen))
    rows = F.array(*[F.lit(r) for r in ratios])
    one = spark_space.sparkSession.range(1)
    return one.select(F.posexplode(rows).alias("component", "ratio"), F.lit(total).alias("chosen_total"))


def project_words(scores: DataFrame, components: Sequence[int] = (0, 1)) -> DataFrame:
    """Two or three components as coordinates ``x, y[, z]`` of every word."""
    if len(components) not in (2, 3):
        raise ValueError("choose two or three components")
    axes = [F.get("scores", F.lit(c)).alias(axis) for axis, c in zip("xyz", components)]
    return scores.select("idx", "word", *axes)


def search_words(space: DataFrame, query: str) -> DataFrame:
    """Words that contain the query in lower case, in order of their index."""
    return space.filter(F.contains("word", F.lit(query.lower()))).select("idx", "word").orderBy("idx")


def search_report(space: DataFrame, query: str, shown: int = 100) -> DataFrame:
    """The first hits of a search, each with the number of all hits."""
    hits = search_words(space, query)
    return hits.limit(shown).withColumn("matches", hits.agg(F.count(F.lit(1))).scalar())


def _nearest(space: DataFrame, vector: Sequence[float], k: int | None, without: Iterable[int]) -> DataFrame:
    target = F.array(*[F.lit(float(x)) for x in vector])
    left_out = list(without)
    others = space.filter(~F.col("idx").isin(*left_out)) if left_out else space
    scored = others.select("idx", "word", cosine(F.col("vec"), target).alias("similarity"))
    # a zero vector is near to nothing
    ranked = scored.filter(F.col("similarity").isNotNull()).orderBy(
        F.col("similarity").desc(), F.col("idx").asc()
    )
    return ranked.limit(k) if k else ranked


def most_similar(space: DataFrame, word: str, k: int | None = 10) -> DataFrame:
    """The ``k`` nearest words by cosine, the word itself excluded; all words without ``k``, none for an
    unknown word. One scan that keeps k rows per task.
    """
    found = find_vector(space, word)
    if found is None:
        return space.select("idx", "word", F.lit(0.0).alias("similarity")).filter(F.lit(False))
    return _nearest(space, found[1], k, [found[0]])


def most_similar_to_vector(space: DataFrame, vector: Sequence[float], k: int | None = 10) -> DataFrame:
    return _nearest(space, vector, k, [])


def analogy(space: DataFrame, a: str, b: str, c: str, k: int | None = 10) -> DataFrame:
    """Words nearest to ``a - b + c``, the three words excluded."""
    found = [find_vector(space, word) for word in (a, b, c)]
    if any(f is None for f in found):
        return space.select("idx", "word", F.lit(0.0).alias("similarity")).filter(F.lit(False))
    (ia, va), (ib, vb), (ic, vc) = found
    return _nearest(space, [x - y + z for x, y, z in zip(va, vb, vc)], k, [ia, ib, ic])


def isolate(space: DataFrame, scores: DataFrame, word: str, k: int = 100, components: Sequence[int] = (0, 1)) -> DataFrame:
    """The neighbours of a word and the word itself with similarity 1, with their coordinates."""
    itself = get_vector(space, word).select("idx", "word", F.lit(1.0).alias("similarity"))
    return most_similar(space, word, k).unionByName(itself).join(project_words(scores, components), ["idx", "word"])


def space_stats(space: DataFrame) -> DataFrame:
    return space.agg(F.count(F.lit(1)).alias("points"), F.max(F.size("vec")).alias("dimensions"))


def cosine_pairs(pairs: DataFrame, space: DataFrame) -> DataFrame:
    """Cosine of the words ``a`` and ``b`` (indices) of each row."""
    left = space.select(F.col("idx").alias("a"), F.col("vec").alias("_u"))
    right = space.select(F.col("idx").alias("b"), F.col("vec").alias("_v"))
    joined = lookup_join(lookup_join(pairs, left, ["a"]), right, ["b"])
    return joined.withColumn("similarity", cosine(F.col("_u"), F.col("_v"))).drop("_u", "_v")


