"""Inputs of the registered queries: the given tables read as posts, corpora, spaces and series.

Each Spark input has a twin in SQL of the same name, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions.contractions import CONTRACTIONS
from textlens.functions.text import normalise
from textlens.operators.vocab import ordered_word_counts, token_rows, vocabulary

SEED = 42
PHRASES = ["climate change", "change denial"]
MAX_TOKENS, MIN_FREQUENCY = 5000, 2  # of the capped vocabulary, which is a feature of its own
TAILS = {
    0: " see https://t.co/ab12",
    1: " via @user7",
    2: " Climate Change denial",
    3: " soooooo good!!!!!!",
    4: " I'm sure they don't know",
    5: " state-of-the-art #topic",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tail() -> Column:
    tail = F
    for rest, words in TAILS.items():
        tail = tail.when(F.col("doc_id") % 7 == rest, F.lit(words))
    return tail.otherwise(F.lit(""))


def month_of(number: Column) -> Column:
    return F.add_months(F.lit("2018-02-01").cast("date"), (number % 25).cast("int"))


def as_posts(documents: DataFrame, *keep: str) -> DataFrame:
    """Documents as posts: the whole text with a tail that has links, handles, phrases and so on."""
    return documents.select(
        F.col("doc_id").alias("id"),
        F.concat("text", _tail()).alias("text"),
        (F.col("n_chars") > 280).alias("truncated"),
        "lang",
        F.col("source").alias("source_file"),
        month_of(F.col("doc_id")).alias("bucket"),
        "n_chars",
        *keep,
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_posts(table(spark, sf_dir, "documents"))


_CASE = " ".join(f"WHEN {rest} THEN '{words.replace(chr(39), chr(39) * 2)}'" for rest, words in TAILS.items())
POSTS = f"""posts AS (
  SELECT doc_id AS id, text || CASE doc_id % 7 {_CASE} ELSE '' END AS text, n_chars > 280 AS truncated, lang,
         source AS source_file, strftime(DATE '2018-02-01' + to_months(CAST(doc_id % 25 AS INT)), '%Y-%m-%d') AS bucket, n_chars
  FROM documents)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English posts as normalised lines: ``line_id, bucket, source_file, text``."""
    english = posts(spark, sf_dir).filter(F.col("lang") == "en")
    lines = english.select(F.col("id").alias("line_id"), "bucket", "source_file", "text")
    return normalise(lines, "text", phrases=PHRASES)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_MAP = "MAP {" + ", ".join(f"{sql_text(k)}: {sql_text(v)}" for k, v in CONTRACTIONS.items()) + "}"
_LINK = r"(?i)(https?://[a-z0-9][a-z0-9-]*\.\S{2,}|www\.[a-z0-9][a-z0-9-]*\.\S{2,})"
_PHRASE = "(?i)" + "|".join(PHRASES)


def newlines_sql(t: str) -> str:
    return f"translate({t}, chr(10) || chr(13), ' ')"


def ascii_sql(t: str) -> str:
    return rf"regexp_replace({t}, '[^\x00-\x7F]', '', 'g')"


def links_sql(t: str) -> str:
    return f"regexp_replace({t}, '{_LINK}', '', 'g')"


def phrases_sql(t: str) -> str:
    return (
        f"coalesce(list_aggregate(flatten(list_transform(list_zip(regexp_split_to_array({t}, '{_PHRASE}'), "
        f"regexp_extract_all({t}, '{_PHRASE}')), lambda z: [z[1], coalesce(replace(z[2], ' ', '_'), '')])), "
        "'string_agg', ''), '')"
    )


def handles_sql(t: str) -> str:
    return rf"regexp_replace({t}, '@\S+', '', 'g')"


def runs_sql(t: str) -> str:
    same = " AND ".join(f"ch[i-{back}] = x" for back in (1, 2, 3))
    kept = f"list_filter(ch, lambda x, i: NOT (i > 3 AND x <> chr(10) AND {same}))"
    return f"coalesce(list_transform([string_split({t}, '')], lambda ch: array_to_string({kept}, ''))[1], '')"


def contractions_sql(t: str) -> str:
    full = f"({_MAP})[lower(p)]"
    written = f"CASE WHEN p[1] <> lower(p[1]) THEN upper({full}[1]) || {full}[2:] ELSE {full} END"
    return (
        f"coalesce(array_to_string(list_transform(regexp_extract_all({t}, '[A-Za-z]+(?:''[A-Za-z]+)*|[^A-Za-z]+'), "
        f"lambda p: CASE WHEN contains(p, '''') THEN coalesce({written}, p) ELSE p END), ''), '')"
    )


def hyphens_sql(t: str) -> str:
    return rf"regexp_replace({t}, '([\p{{L}}\p{{N}}_]+)-([\p{{L}}\p{{N}}_]+)', '\1_\2', 'g')"


def strip_sql(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def tokens_sql(t: str) -> str:
    marks = sql_text("!\"$%&'()*+,-./:;<=>?@[\\]^`{|}~")
    return rf"list_filter(regexp_split_to_array(lower(translate({t}, {marks}, '')), '\s+'), lambda w: w <> '')"


def normalise_sql(source: str, result: str, keep: str) -> str:
    """The chain of steps as one CTE per step, from ``source`` to ``result``."""
    steps = [newlines_sql, ascii_sql, links_sql, phrases_sql, handles_sql, runs_sql, contractions_sql, hyphens_sql, strip_sql]
    ctes, last = [], source
    for number, step in enumerate(steps):
        name = result if step is strip_sql else f"{result}_{number}"
        ctes.append(f"{name} AS MATERIALIZED (SELECT {keep}, {step('text')} AS text FROM {last})")
        last = name
    return ",\n".join(ctes)


CORPUS = (
    POSTS
    + ",\nenglish AS (SELECT id AS line_id, bucket, source_file, text FROM posts WHERE lang = 'en'),\n"
    + normalise_sql("english", "corpus", "line_id, bucket, source_file")
)
TOKENS = (
    CORPUS
    + f""",
worded AS MATERIALIZED (SELECT line_id, bucket, {tokens_sql('text')} AS words FROM corpus),
tokens AS MATERIALIZED (SELECT line_id, bucket, unnest(words) AS word, unnest(range(len(words))) AS pos FROM worded)"""
)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(corpus(spark, sf_dir), ["line_id", "bucket"])


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_word_counts(tokens(spark, sf_dir))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the corpus."""
    return vocabulary(counts(spark, sf_dir))


def capped_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(counts(spark, sf_dir), MAX_TOKENS, MIN_FREQUENCY)


COUNTS = TOKENS + """,
counts AS MATERIALIZED (SELECT word, count(*) AS freq, min(line_id * 1000000 + pos) AS first_seen FROM tokens GROUP BY word)"""
_VOCAB = (
    COUNTS
    + """,
ranked AS (SELECT word, freq, row_number() OVER (ORDER BY freq DESC, first_seen) - 1 AS idx FROM counts),
cut AS (SELECT word, idx, freq FROM ranked WHERE <cut>),
vocab AS MATERIALIZED (
  SELECT word, idx, freq,
         least((sqrt(freq / total / 1e-3) + 1) * (1e-3 / (freq / total)), 1.0) AS sample_prob
  FROM cut, (SELECT CAST(sum(freq) AS DOUBLE) AS total FROM cut))"""
)
VOCAB = _VOCAB.replace("<cut>", "true")
CAPPED_VOCAB = _VOCAB.replace("<cut>", f"idx < {MAX_TOKENS} AND freq >= {MIN_FREQUENCY}")


def uniform_sql(*keys: str, seed: int = SEED) -> str:
    joined = " || '|' || ".join([f"'{seed}'", *[f"CAST({key} AS VARCHAR)" for key in keys]])
    return f"(CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT) / 4294967296.0)"


def hash_sql(*keys: str, seed: int = SEED) -> str:
    joined = " || '|' || ".join([f"'{seed}'", *[f"CAST({key} AS VARCHAR)" for key in keys]])
    return f"CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT)"


def space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table as one space."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("idx"), F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vec")
    )


def spaces_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table as ten spaces over the same words."""
    rows = table(spark, sf_dir, "embeddings")
    number = F.floor(F.col("vec_id") / 10).cast("bigint")
    return rows.select(
        (F.col("vec_id") % 10).alias("bucket"),
        number.alias("idx"),
        F.concat(F.lit("w"), number.cast("string")).alias("word"),
        F.col("embedding").alias("vec"),
    )


SPACE = """space AS (SELECT vec_id AS idx, 'w' || vec_id AS word, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""
BUCKET_SPACES = """spaces AS (
  SELECT vec_id % 10 AS bucket, vec_id // 10 AS idx, 'w' || (vec_id // 10) AS word, CAST(embedding AS DOUBLE[]) AS vec
  FROM embeddings)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with four logits and a label made from their numbers."""
    return with_logits(posts(spark, sf_dir)).withColumn("label", (F.col("n_chars") % 4).cast("int"))


def with_logits(texts: DataFrame, key: str = "id", size: str = "n_chars") -> DataFrame:
    i, n = F.col(key), F.col(size)
    return texts.withColumn(
        "logits",
        F.array(
            (i % 7) / F.lit(2.0) - F.lit(1.5),
            (n % 5) / F.lit(2.0) - F.lit(1.0),
            (i * 3 % 11) / F.lit(4.0) - F.lit(1.25),
            (n * 7 % 13) / F.lit(4.0) - F.lit(1.75),
        ),
    )


SCORED = (
    POSTS
    + """,
logits AS (
  SELECT id, bucket, n_chars, n_chars % 4 AS label,
         [(id % 7) / 2.0 - 1.5, (n_chars % 5) / 2.0 - 1.0, (id * 3 % 11) / 4.0 - 1.25, (n_chars * 7 % 13) / 4.0 - 1.75]::DOUBLE[] AS logits
  FROM posts),
scored AS MATERIALIZED (
  SELECT *, list_position(logits, list_max(logits)) - 1 AS class,
         ([-1, 0, 2, 1])[list_position(logits, list_max(logits))] AS stance, 1 / (1 + exp(-list_max(logits))) AS confidence
  FROM logits)"""
)
