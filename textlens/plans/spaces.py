"""Queries over word-vector spaces."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions.vector import dot, norm
from textlens.operators.similarity import most_similar_batch
from textlens.operators.space import (
    analogy,
    centroid,
    cosine_pairs,
    covariance,
    explained_variance,
    fit_pca,
    get_vector,
    isolate,
    most_similar,
    project_words,
    search_report,
    search_words,
    space_stats,
    spherize,
    unit_vectors,
)
from textlens.plans import inputs
from textlens.plans.inputs import BUCKET_SPACES, SPACE
from textlens.plans.registry import plan, rounded, rounded_sql
from textlens.session import scratch_path
from textlens.sources.spaces import load_space, load_space_files, save_space, save_space_files

_LONG = """SELECT idx, unnest(range(len(vec))) AS dim, unnest(vec) AS value FROM {source}"""


def _long(space: DataFrame) -> DataFrame:
    """One row per word and dimension."""
    rows = space.select("idx", F.posexplode("vec").alias("dim", "value"))
    return rows.withColumn("value", rounded(F.col("value").cast("double")))


@plan("embedding_scan", f"WITH {SPACE}, long AS ({_LONG.format(source='space')}) SELECT idx, dim, {rounded_sql('value')} AS value FROM long")
def _embedding_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "space")
    save_space(inputs.space(spark, sf_dir), path)
    return _long(load_space(spark, path))


@plan(
    "embedding_files",
    f"""WITH {SPACE}, long AS (SELECT idx, word, unnest(range(len(vec))) AS dim, unnest(vec) AS value FROM space)
    SELECT idx, word, dim, {rounded_sql('value')} AS value FROM long""",
)
def _embedding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The space written as a matrix and a file of words, and read back by stretches of bytes."""
    path = scratch_path(spark, "space-files").removeprefix("file:")
    os.makedirs(path)
    save_space_files(inputs.space(spark, sf_dir), f"{path}/vectors.npy", f"{path}/words.txt")
    rows = load_space_files(spark, f"{path}/vectors.npy", f"{path}/words.txt")
    rows = rows.select("idx", "word", F.posexplode("vec").alias("dim", "value"))
    return rows.withColumn("value", rounded(F.col("value").cast("double")))


@plan(
    "get_vector",
    f"""WITH {SPACE}, one AS (SELECT * FROM space WHERE word = 'w7'), long AS ({_LONG.format(source='one')})
    SELECT idx, dim, {rounded_sql('value')} AS value FROM long""",
)
def _get_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(get_vector(inputs.space(spark, sf_dir), "w7"))


@plan(
    "cosine_pair",
    f"""WITH {SPACE}, pairs AS (SELECT idx AS a, (idx * 3 + 1) % (SELECT count(*) FROM space) AS b FROM space)
    SELECT a, b, {rounded_sql('list_cosine_similarity(u.vec, v.vec)')} AS similarity
    FROM pairs JOIN space u ON u.idx = a JOIN space v ON v.idx = b""",
)
def _cosine_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = inputs.space(spark, sf_dir)
    size = space.agg(F.count(F.lit(1))).scalar()
    pairs = space.select(F.col("idx").alias("a"), ((F.col("idx") * 3 + 1) % size).alias("b"))
    return cosine_pairs(pairs, space).select("a", "b", rounded(F.col("similarity")).alias("similarity"))


_UNIT = "list_transform({vec}, lambda x: x / sqrt(list_dot_product({vec}, {vec})))"


@plan(
    "unit_vectors",
    f"""WITH {SPACE}, units AS (SELECT idx, {_UNIT.format(vec='vec')} AS vec FROM space), long AS ({_LONG.format(source='units')})
    SELECT idx, dim, {rounded_sql('value')} AS value FROM long""",
)
def _unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(unit_vectors(inputs.space(spark, sf_dir)))


_CENTRED = f"""long AS MATERIALIZED ({_LONG.format(source='space')}),
mean AS MATERIALIZED (SELECT dim, avg(value) AS value FROM long GROUP BY dim),
shifted AS MATERIALIZED (SELECT l.idx, l.dim, l.value - m.value AS value FROM long l JOIN mean m ON m.dim = l.dim)"""
_SPHERIZED = _CENTRED + """,
spherized AS MATERIALIZED (
  SELECT s.idx, s.dim, s.value / n.length AS value FROM shifted s
  JOIN (SELECT idx, sqrt(sum(value * value)) AS length FROM shifted GROUP BY idx) n ON n.idx = s.idx)"""


@plan("centroid", f"WITH {SPACE}, {_CENTRED} SELECT dim, {rounded_sql('value')} AS value FROM mean")
def _centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = centroid(inputs.space(spark, sf_dir)).select(F.posexplode("vec").alias("dim", "value"))
    return mean.select("dim", rounded(F.col("value")).alias("value"))


@plan("spherize", f"WITH {SPACE}, {_SPHERIZED} SELECT idx, dim, {rounded_sql('value')} AS value FROM spherized")
def _spherize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spherize(inputs.space(spark, sf_dir)))


@plan(
    "pca_covariance",
    f"""WITH {SPACE}, {_SPHERIZED},
    again AS MATERIALIZED (SELECT s.idx, s.dim, s.value - m.value AS value FROM spherized s
      JOIN (SELECT dim, avg(value) AS value FROM spherized GROUP BY dim) m ON m.dim = s.dim)
    SELECT a.dim AS i, b.dim AS j, {rounded_sql('sum(a.value * b.value) / (count(*) - 1)', 9)} AS cov
    FROM again a JOIN again b ON a.idx = b.idx GROUP BY 1, 2""",
)
def _pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = covariance(spherize(inputs.space(spark, sf_dir)))
    return products.select("i", "j", rounded(F.col("cov"), 9).alias("cov"))


@plan("pca_scores")
def _pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = fit_pca(inputs.space(spark, sf_dir))
    return scores.select("idx", "word", F.posexplode("scores").alias("component", "score"))


_AGAIN = f"""WITH {SPACE}, {_SPHERIZED},
    again AS MATERIALIZED (SELECT s.idx, s.dim, s.value - m.value AS value FROM spherized s
      JOIN (SELECT dim, avg(value) AS value FROM spherized GROUP BY dim) m ON m.dim = s.dim)"""


@plan(
    "pca_products",
    f"""{_AGAIN} SELECT a.idx, {rounded_sql('sum(a.value * a.value)', 9)} AS square, {rounded_sql('sum(a.value * b.value)', 9)} AS product
    FROM again a JOIN again b ON b.idx = 0 AND b.dim = a.dim GROUP BY a.idx""",
)
def _pca_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components together turn the space without changing lengths or products."""
    scores, _ = fit_pca(inputs.space(spark, sf_dir), components=1 << 16)
    first = scores.filter("idx = 0").select(F.col("scores").alias("_first"))
    return scores.crossJoin(F.broadcast(first)).select("idx", rounded(dot(F.col("scores"), F.col("scores")), 9).alias("square"), rounded(dot(F.col("scores"), F.col("_first")), 9).alias("product"))


@plan(
    "pca_scatter",
    f"""{_AGAIN}, cov AS (
      SELECT a.dim AS i, b.dim AS j, sum(a.value * b.value) / (count(*) - 1) AS cov FROM again a JOIN again b ON a.idx = b.idx GROUP BY 1, 2)
    SELECT {rounded_sql('sum(CASE WHEN i = j THEN cov END)', 9)} AS variance, {rounded_sql('sum(cov * cov)', 9)} AS squares,
           CAST(count(DISTINCT i) AS BIGINT) AS uncorrelated FROM cov""",
)
def _pca_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores' own covariance: its diagonal has the whole variance, in falling order, and all else is zero."""
    scores, _ = fit_pca(inputs.space(spark, sf_dir), components=1 << 16)
    cov = covariance(scores.select(F.col("scores").alias("vec")))
    own = cov.filter("i = j").agg(F.sum("cov").alias("variance"), F.sum(F.col("cov") * F.col("cov")).alias("squares"))
    other = cov.groupBy("i").agg(F.max(F.when(F.col("i") != F.col("j"), F.abs("cov")).otherwise(0.0)).alias("rest"))
    apart = other.filter("rest < 1e-9").agg(F.count(F.lit(1)).alias("uncorrelated"))
    return own.crossJoin(apart).select(rounded(F.col("variance"), 9).alias("variance"), rounded(F.col("squares"), 9).alias("squares"), "uncorrelated")


@plan("pca_variance")
def _pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = inputs.space(spark, sf_dir)
    _, ratios = fit_pca(space)
    return explained_variance(space, ratios, [0, 1, 2])


@plan("project_words")
def _project_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = fit_pca(inputs.space(spark, sf_dir), components=3)
    return project_words(scores, [0, 1, 2])


@plan(
    "isolate_words",
    f"""WITH {SPACE}, near AS (
      SELECT s.idx, s.word, list_cosine_similarity(q.vec, s.vec) AS similarity FROM space s JOIN space q ON q.word = 'w0' AND s.idx <> q.idx
      ORDER BY similarity DESC, s.idx LIMIT 100)
    SELECT idx, word, {rounded_sql('similarity')} AS similarity FROM near UNION ALL SELECT idx, word, 1.0 FROM space WHERE word = 'w0'""",
)
def _isolate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of an isolated neighbourhood, each with two coordinates."""
    space = inputs.space(spark, sf_dir)
    scores, _ = fit_pca(space, components=2)
    shown = isolate(space, scores, "w0").filter("x IS NOT NULL AND y IS NOT NULL")
    return shown.select("idx", "word", rounded(F.col("similarity")).alias("similarity"))


@plan("isolate")
def _isolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = inputs.space(spark, sf_dir)
    scores, _ = fit_pca(space, components=2)
    return isolate(space, scores, "w0")


@plan("search_words", f"WITH {SPACE} SELECT idx, word FROM space WHERE contains(word, lower('W1'))")
def _search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_words(inputs.space(spark, sf_dir), "W1")


@plan(
    "search_report",
    f"""WITH {inputs.VOCAB}, hits AS (SELECT idx, word FROM vocab WHERE contains(word, 'th'))
    SELECT idx, word, (SELECT count(*) FROM hits) AS matches FROM hits ORDER BY idx LIMIT 100""",
)
def _search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_report(inputs.vocab(spark, sf_dir), "TH")


@plan("space_stats", f"WITH {SPACE} SELECT count(*) AS points, CAST(max(len(vec)) AS BIGINT) AS dimensions FROM space")
def _space_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space_stats(inputs.space(spark, sf_dir))


@plan(
    "most_similar",
    f"""WITH {SPACE}, near AS (
    SELECT s.idx, s.word, list_cosine_similarity(q.vec, s.vec) AS similarity FROM space q JOIN space s ON s.idx <> q.idx WHERE q.word = 'w0')
    SELECT idx, word, {rounded_sql('similarity')} AS similarity FROM near ORDER BY near.similarity DESC, idx LIMIT 10""",
)
def _most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = most_similar(inputs.space(spark, sf_dir), "w0", 10)
    return near.select("idx", "word", rounded(F.col("similarity")).alias("similarity"))


@plan(
    "zero_vector",
    f"""WITH {SPACE}, near AS (
    SELECT s.idx, list_cosine_similarity(q.vec, s.vec) AS similarity FROM space q JOIN space s ON s.idx <> q.idx WHERE q.word = 'w0')
    SELECT idx, {rounded_sql('similarity')} AS similarity FROM near""",
)
def _zero_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words by nearness in a space that also holds a zero vector, which is near to nothing."""
    space = inputs.space(spark, sf_dir)
    zero = space.filter("idx = 0").select(F.lit(-1).cast("bigint").alias("idx"), F.lit("nothing").alias("word"), F.transform("vec", lambda x: x * 0).alias("vec"))
    near = most_similar(space.unionByName(zero), "w0", None)
    return near.select("idx", rounded(F.col("similarity")).alias("similarity"))


_RANKED = f"""{BUCKET_SPACES}, near AS (
  SELECT q.bucket, q.idx AS query, s.idx, list_cosine_similarity(q.vec, s.vec) AS similarity
  FROM spaces q JOIN spaces s ON s.bucket = q.bucket AND s.idx <> q.idx),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket, query ORDER BY similarity DESC, idx) AS rank FROM near)"""


@plan("most_similar_batch", f"WITH {_RANKED} SELECT bucket, query, idx, {rounded_sql('similarity')} AS similarity, rank FROM ranked WHERE rank <= 5")
def _most_similar_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = inputs.spaces_by_bucket(spark, sf_dir)
    near = most_similar_batch(spaces, spaces, 5, ["bucket"])
    return near.withColumn("similarity", rounded(F.col("similarity")))


@plan(
    "first_last_neighbours",
    f"""WITH {_RANKED} SELECT bucket, query, idx, {rounded_sql('similarity')} AS similarity, rank FROM ranked
    WHERE rank <= 20 AND query IN (3, 17) AND bucket IN ((SELECT min(bucket) FROM spaces), (SELECT max(bucket) FROM spaces))""",
)
def _first_last_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = inputs.spaces_by_bucket(spark, sf_dir)
    ends = spaces.agg(F.array(F.min("bucket"), F.max("bucket"))).scalar()
    chosen = spaces.filter(F.array_contains(ends, F.col("bucket")))
    near = most_similar_batch(chosen.filter(F.col("word").isin("w3", "w17")), chosen, 20, ["bucket"])
    return near.withColumn("similarity", rounded(F.col("similarity")))


@plan(
    "analogy",
    f"""WITH {SPACE}, goal AS (
      SELECT list_transform(range(1, len(a.vec) + 1), lambda i: a.vec[i] - b.vec[i] + c.vec[i]) AS vec
      FROM space a, space b, space c WHERE a.word = 'w1' AND b.word = 'w2' AND c.word = 'w3'),
    near AS (SELECT idx, word, list_cosine_similarity(goal.vec, space.vec) AS similarity FROM space, goal WHERE word NOT IN ('w1', 'w2', 'w3'))
    SELECT idx, word, {rounded_sql('similarity')} AS similarity FROM near ORDER BY near.similarity DESC, idx LIMIT 10""",
)
def _analogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = analogy(inputs.space(spark, sf_dir), "w1", "w2", "w3")
    return near.select("idx", "word", rounded(F.col("similarity")).alias("similarity"))


@plan("vector_norms", f"WITH {SPACE} SELECT idx, {rounded_sql('sqrt(list_dot_product(vec, vec))')} AS length FROM space")
def _vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.space(spark, sf_dir).select("idx", rounded(norm(F.col("vec"))).alias("length"))
