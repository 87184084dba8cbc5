"""Queries over skip-gram training data and learned spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.operators.noise import DIGITS, alias_samples
from textlens.operators.skipgram import (
    learning_rate,
    line_progress,
    loss_log,
    negative_samples,
    sgns_loss,
    skipgram_pairs,
    subsample,
    training_pairs,
)
from textlens.operators.train import STEPS, space_of, train_by_bucket, train_embeddings
from textlens.operators.vocab import encode, negative_distribution, ordered_word_counts, token_rows, vocabulary
from textlens.plans import inputs
from textlens.plans.corpus import ENCODED, NEGATIVES
from textlens.plans.inputs import CORPUS, SEED, VOCAB, hash_sql, uniform_sql
from textlens.plans.registry import plan, rounded, rounded_sql
from textlens.session import materialise

WINDOW = 3
BATCH = 256


def _by_offset(pairs: DataFrame) -> DataFrame:
    """Pairs summed up per target and distance, which shows every pair's effect in few rows."""
    offset = (F.col("context_pos") - F.col("pos")).alias("offset")
    return pairs.groupBy("target", offset).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("context") + 2) * (F.col("line_id") % 1009 + 1)).alias("mark")
    )


_BY_OFFSET = """SELECT a.idx AS target, b.pos - a.pos AS "offset", count(*) AS n,
CAST(sum((b.idx + 2) * (a.line_id % 1009 + 1)) AS BIGINT) AS mark"""


@plan(
    "skipgram_pairs",
    f"""WITH {ENCODED} {_BY_OFFSET} FROM coded a JOIN coded b
    ON a.line_id = b.line_id AND b.pos <> a.pos AND b.pos BETWEEN a.pos - {WINDOW} AND a.pos + {WINDOW} GROUP BY 1, 2""",
)
def _skipgram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(inputs.corpus(spark, sf_dir), inputs.vocab(spark, sf_dir))
    return _by_offset(skipgram_pairs(coded, WINDOW))


@plan(
    "skipgram_dynamic",
    f"""WITH {ENCODED}, ranged AS (SELECT line_id, pos, idx, {WINDOW} - {hash_sql('line_id', 'pos')} % {WINDOW} AS r FROM coded)
    {_BY_OFFSET} FROM ranged a JOIN coded b
    ON a.line_id = b.line_id AND b.pos <> a.pos AND b.pos BETWEEN a.pos - a.r AND a.pos + a.r GROUP BY 1, 2""",
)
def _skipgram_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(inputs.corpus(spark, sf_dir), inputs.vocab(spark, sf_dir))
    return _by_offset(skipgram_pairs(coded, WINDOW, seed=SEED))


SUBSAMPLED = VOCAB + f""",
sampled AS MATERIALIZED (
  SELECT t.line_id, v.idx, row_number() OVER (PARTITION BY t.line_id ORDER BY t.pos) - 1 AS pos
  FROM tokens t JOIN vocab v ON v.word = t.word WHERE {uniform_sql('t.line_id', 't.pos')} < v.sample_prob)"""


@plan(
    "subsample",
    f"WITH {SUBSAMPLED} SELECT line_id, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos) AS seq FROM sampled GROUP BY line_id",
)
def _subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = subsample(inputs.corpus(spark, sf_dir), inputs.vocab(spark, sf_dir), SEED)
    return kept.select("line_id", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))


@plan(
    "training_pairs",
    f"""WITH {SUBSAMPLED},
    timed AS (SELECT line_id, (row_number() OVER (ORDER BY line_id) - 1) / (SELECT count(*) FROM corpus) AS progress FROM corpus),
    ranged AS (SELECT line_id, pos, idx, {WINDOW} - {hash_sql('line_id', 'pos')} % {WINDOW} AS r FROM sampled),
    pairs AS (
      SELECT a.line_id, a.idx AS target, b.idx AS context, row_number() OVER (ORDER BY a.line_id, a.pos, b.pos) - 1 AS nth
      FROM ranged a JOIN sampled b ON a.line_id = b.line_id AND b.pos <> a.pos AND b.pos BETWEEN a.pos - a.r AND a.pos + a.r),
    whole AS (SELECT * FROM pairs WHERE nth < (SELECT count(*) // {BATCH} * {BATCH} FROM pairs))
    SELECT nth // {BATCH} AS batch, count(*) AS n, CAST(sum(target) AS BIGINT) AS targets, CAST(sum(context * 31) AS BIGINT) AS contexts,
           {rounded_sql('min(progress)', 9)} AS first_progress, {rounded_sql('max(progress)', 9)} AS last_progress
    FROM whole JOIN timed ON timed.line_id = whole.line_id GROUP BY 1""",
)
def _training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = training_pairs(inputs.corpus(spark, sf_dir), inputs.vocab(spark, sf_dir), SEED, WINDOW, BATCH)
    return pairs.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("target").alias("targets"),
        F.sum(F.col("context") * 31).alias("contexts"),
        rounded(F.min("progress"), 9).alias("first_progress"),
        rounded(F.max("progress"), 9).alias("last_progress"),
    )


@plan(
    "lr_schedule",
    f"""WITH {CORPUS}, timed AS (
    SELECT line_id, (row_number() OVER (ORDER BY line_id) - 1) / (SELECT count(*) FROM corpus) AS t FROM corpus)
    SELECT line_id, {rounded_sql('greatest(0.025 * (1 - t) + 1e-4 * t, 1e-4)', 9)} AS learning_rate FROM timed""",
)
def _lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = line_progress(inputs.corpus(spark, sf_dir))
    return timed.select("line_id", rounded(learning_rate(F.col("progress")), 9).alias("learning_rate"))


_DRAWS = f"""draws AS (
  SELECT d.doc_id, j.draw, d.doc_id * 7 % 500 AS context, {uniform_sql('d.doc_id', 'j.draw')} AS u
  FROM documents d, (SELECT unnest(range(5)) AS draw) j)"""


def _drawn(spark: SparkSession, sf_dir: str, exclude: bool) -> DataFrame:
    noise = negative_distribution(inputs.vocab(spark, sf_dir))
    pairs = inputs.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7 % 500).alias("context"))
    return negative_samples(pairs, noise, 5, SEED, ["doc_id"], exclude).select("doc_id", "draw", "context", "negative")


@plan(
    "negative_samples",
    f"""WITH {NEGATIVES}, {_DRAWS} SELECT d.doc_id, d.draw, d.context, n.idx AS negative
    FROM draws d JOIN noise n ON d.u >= n.low AND d.u < n.high""",
)
def _negative_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir, False)


@plan(
    "negative_samples_excluding",
    f"""WITH {NEGATIVES}, {_DRAWS}, scaled AS (
      SELECT d.doc_id, d.draw, d.context, c.low, c.high - c.low AS width, d.u * (1.0 - (c.high - c.low)) AS v
      FROM draws d JOIN noise c ON c.idx = d.context),
    moved AS (SELECT doc_id, draw, context, CASE WHEN v >= low THEN v + width ELSE v END AS u FROM scaled)
    SELECT m.doc_id, m.draw, m.context, n.idx AS negative FROM moved m JOIN noise n ON m.u >= n.low AND m.u < n.high""",
)
def _negative_samples_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir, True)


# The alias table by running totals: what words below the mean lack and words above it have over, in whole numbers.
_ALIAS = f"""{NEGATIVES},
whole AS MATERIALIZED (SELECT idx, CAST(w * 1000000000 AS HUGEINT) AS w FROM weights),
mass AS (SELECT sum(w) AS total, CAST(count(*) AS HUGEINT) AS n FROM whole),
light AS MATERIALIZED (
  SELECT idx, w * n AS own, CAST(sum(total - w * n) OVER (ORDER BY idx) AS HUGEINT) AS lacking, total
  FROM whole, mass WHERE w * n < total),
heavy AS MATERIALIZED (
  SELECT idx, CAST(sum(w * n - total) OVER (ORDER BY idx) AS HUGEINT) AS over, lead(idx) OVER (ORDER BY idx) AS next, total
  FROM whole, mass WHERE w * n >= total),
-- Of words with equal totals the first one counts.
fillers AS (SELECT over, min(idx) AS idx FROM heavy GROUP BY over),
needs AS (SELECT lacking, lacking - (total - own) AS before, idx, own, total FROM light),
slots AS MATERIALIZED (
  SELECT i.idx, CAST(i.own AS DOUBLE) / CAST(i.total AS DOUBLE) AS keep, h.idx AS other
  FROM needs i ASOF JOIN fillers h ON i.before <= h.over
  UNION ALL
  SELECT h.idx, CASE WHEN l.lacking IS NULL OR next IS NULL THEN 1.0
                     ELSE CAST(h.total - l.lacking + h.over AS DOUBLE) / CAST(h.total AS DOUBLE) END, coalesce(next, h.idx)
  FROM heavy h ASOF LEFT JOIN (SELECT DISTINCT lacking FROM light) l ON h.over < l.lacking)"""
_LOOK = f"""JOIN slots s ON s.idx = CAST('0x' || substr(d.digest, 1, {DIGITS}) AS BIGINT) % (SELECT count(*) FROM slots)"""
_HIT = f"""CASE WHEN CAST('0x' || substr(d.digest, {DIGITS + 1}, {DIGITS}) AS BIGINT) < s.keep * {16**DIGITS}.0 THEN s.idx ELSE s.other END"""
_KEYED = f"""keyed AS (
  SELECT doc_id, draw, doc_id * 7 % 500 AS context, '{SEED}|' || doc_id || '|' || draw AS key
  FROM documents, (SELECT unnest(range(5)) AS draw))"""


def _drawn_by_alias(spark: SparkSession, sf_dir: str, exclude: bool) -> DataFrame:
    pairs = inputs.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7 % 500).alias("context"))
    drawn = alias_samples(pairs, materialise(inputs.vocab(spark, sf_dir)), 5, SEED, ["doc_id"], exclude)
    return drawn.select("doc_id", "draw", "context", "negative")


@plan(
    "negative_samples_alias",
    f"""WITH {_ALIAS}, {_KEYED}, d AS (SELECT *, md5(key || '|0') AS digest FROM keyed)
    SELECT doc_id, draw, context, {_HIT} AS negative FROM d {_LOOK}""",
)
def _negative_samples_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn_by_alias(spark, sf_dir, False)


@plan(
    "negative_samples_alias_excluding",
    f"""WITH RECURSIVE {_ALIAS}, {_KEYED}, tries(doc_id, draw, context, key, attempt, negative) AS (
      SELECT doc_id, draw, context, key, 0, {_HIT} FROM (SELECT *, md5(key || '|0') AS digest FROM keyed) d {_LOOK}
      UNION ALL
      SELECT doc_id, draw, context, key, attempt, {_HIT}
      FROM (SELECT doc_id, draw, context, key, attempt + 1 AS attempt, md5(key || '|' || (attempt + 1)) AS digest
            FROM tries WHERE negative = context) d {_LOOK})
    SELECT doc_id, draw, context, negative FROM tries WHERE negative <> context""",
)
def _negative_samples_alias_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn_by_alias(spark, sf_dir, True)


@plan(
    "sgns_loss",
    f"""WITH {inputs.SPACE}, size AS (SELECT count(*) AS n FROM space),
    words AS (
      SELECT idx AS key, idx AS target, (idx * 7 + 1) % n AS word, 1 AS label FROM space, size
      UNION ALL
      SELECT idx, idx, (idx * 13 + draw * 5 + 2) % n, 0 FROM space, size, (SELECT unnest(range(3)) AS draw)),
    logits AS (
      SELECT key, target, words.word, words.label, list_dot_product(p.vec, list_reverse(o.vec)) + o.idx * 0.001 AS x
      FROM words JOIN space p ON p.idx = target JOIN space o ON o.idx = words.word),
    losses AS (SELECT *, CASE WHEN label = 1 THEN -x ELSE x END AS y FROM logits)
    SELECT key, target, word, CAST(label AS BIGINT) AS label, {rounded_sql('greatest(y, 0) + ln(1 + exp(-abs(y)))')} AS loss FROM losses""",
)
def _sgns_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = inputs.space(spark, sf_dir)
    n = space.agg(F.count(F.lit(1))).scalar()
    weights = space.select(
        "idx",
        F.col("vec").cast("array<double>").alias("proj"),
        F.reverse(F.col("vec").cast("array<double>")).alias("out"),
        (F.col("idx") * F.lit(0.001)).alias("bias"),
    )
    true = space.select(F.col("idx").alias("key"), F.col("idx").alias("target"), ((F.col("idx") * 7 + 1) % n).alias("context"))
    draws = true.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(2))))
    false = draws.select("key", "target", ((F.col("key") * 13 + F.col("draw") * 5 + 2) % n).alias("negative"))
    return sgns_loss(true, false, weights, ["key"]).withColumn("loss", rounded(F.col("loss")))


@plan(
    "loss_log",
    f"""SELECT event_id // 100 AS log_window, {rounded_sql('avg(value)')} AS average_loss,
    {rounded_sql('max_by(1.0 / (event_id + 1), event_id)', 9)} AS learning_rate FROM events GROUP BY 1""",
)
def _loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = inputs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.lit(1.0) / (F.col("event_id") + 1)).alias("learning_rate")
    )
    log = loss_log(steps, 100)
    return log.select(
        "log_window", rounded(F.col("average_loss")).alias("average_loss"), rounded(F.col("learning_rate"), 9).alias("learning_rate")
    )


@plan("train_embeddings")
def _train_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = materialise(inputs.corpus(spark, sf_dir), "lines")
    vocab = vocabulary(materialise(ordered_word_counts(token_rows(lines)), "counts"))
    weights, _ = train_embeddings(lines, vocab, dim=32, window=2, seed=SEED)
    space = space_of(weights)
    return space.select("idx", "word", F.posexplode("vec").alias("dim", "value"))


@plan("embeddings_by_bucket")
def _embeddings_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One space per month of the corpus, all trained in the same rounds."""
    spaces, _ = train_by_bucket(inputs.corpus(spark, sf_dir), dim=16, window=2, seed=SEED)
    return spaces.select("bucket", "idx", "word", F.posexplode("vec").alias("dim", "value"))


@plan("training_log")
def _training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss per round of each month's training, from the records of its steps."""
    _, records = train_by_bucket(inputs.corpus(spark, sf_dir), dim=8, window=2, seed=SEED)
    return loss_log(records, STEPS, by=["bucket"])
