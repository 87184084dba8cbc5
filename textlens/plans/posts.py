"""Queries over posts: scanning, cleaning, sampling and the streaming form of cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.operators.clean import (
    clean_posts,
    clean_projection,
    expand_reposts,
    language_filter,
    processing_summary,
    valid_posts,
)
from textlens.operators.sampling import sample_per_group, split_dataset
from textlens.plans.inputs import POSTS, SEED, hash_sql, month_of, posts, table, uniform_sql
from textlens.plans.registry import plan, shown, shown_sql
from textlens.session import scratch_path
from textlens.sources.lines import bucket_from_path, label_by_name
from textlens.sources.posts import count_bad_rows, parse_posts, scan_cleaned, scan_posts, write_posts
from textlens.streaming.jobs import run_available, stream_clean, stream_rows

OUT = ["id", "text", "truncated", "lang", "created_at", "quote_count", "reply_count", "retweet_count", "favorite_count"]


def _created(number: Column) -> Column:
    return F.date_format(F.timestamp_add("DAY", number % 700, F.lit("2018-02-01 10:20:30").cast("timestamp")), "EEE MMM dd HH:mm:ss")


def _fields(documents: DataFrame) -> DataFrame:
    """Documents with the attributes of a post, some of them null or zero."""
    i, n = F.col("doc_id"), F.col("n_chars")
    return documents.select(
        i.alias("id"),
        "text",
        F.when(i % 4 != 0, n > 280).alias("truncated"),
        F.when(i % 19 != 0, F.col("lang")).alias("lang"),
        F.concat(_created(i), F.lit(" +0000 "), F.date_format(F.date_add(F.lit("2018-02-01").cast("date"), (i % 700).cast("int")), "yyyy")).alias("created_at"),
        (i % 3).alias("quote_count"),
        F.when(i % 2 == 0, n % 4).alias("reply_count"),
        (n % 5).alias("retweet_count"),
        F.lit(0).cast("bigint").alias("favorite_count"),
        F.col("source").alias("source_file"),
    )


def _inner(*columns: str) -> Column:
    """The inside of a JSON object with the columns that are not null."""
    body = F.to_json(F.struct(*columns))
    return F.nullif(F.substring(body, 2, 1 << 30).substr(F.lit(1), F.length(body) - 2), F.lit(""))


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts as JSON: every fifth reposts its successor; some lack a key or have ``delete``."""
    fields = _fields(table(spark, sf_dir, "documents"))
    nested = fields.select((F.col("id") - 1).alias("id"), F.to_json(F.struct(*OUT)).alias("_original"))
    rows = fields.join(nested.filter(F.col("id") % 5 == 0), "id", "left")
    i = F.col("id")
    pieces = F.concat_ws(
        ",",
        _inner("id"),
        F.when(i % 13 == 0, F.lit(None)).when(i % 17 == 0, F.lit('"text":null')).otherwise(_inner("text")),
        F.when(i % 11 == 0, F.lit('"delete":{"status":1}')),
        _inner(*OUT[2:]),
        F.concat(F.lit('"retweeted_status":'), F.col("_original")),
    )
    return rows.select("id", F.concat(F.lit("{"), pieces, F.lit("}")).alias("value"), "source_file")


RAW = """fields AS (
  SELECT doc_id AS id, text, CASE WHEN doc_id % 4 <> 0 THEN n_chars > 280 END AS truncated,
         CASE WHEN doc_id % 19 <> 0 THEN lang END AS lang,
         strftime(TIMESTAMP '2018-02-01 10:20:30' + to_days(CAST(doc_id % 700 AS INT)), '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
         doc_id % 3 AS quote_count, CASE WHEN doc_id % 2 = 0 THEN n_chars % 4 END AS reply_count,
         n_chars % 5 AS retweet_count, CAST(0 AS BIGINT) AS favorite_count, source AS source_file
  FROM documents),
raw AS (
  SELECT f.id, CASE WHEN f.id % 13 <> 0 AND f.id % 17 <> 0 THEN f.text END AS text, f.truncated, f.lang, f.created_at,
         f.quote_count, f.reply_count, f.retweet_count, f.favorite_count, f.source_file, o.id AS original_id,
         f.id % 13 <> 0 AS has_text, f.id % 11 = 0 AS has_delete
  FROM fields f LEFT JOIN fields o ON o.id = f.id + 1 AND f.id % 5 = 0),
valid AS (SELECT * FROM raw WHERE has_text AND NOT has_delete AND lang IN ('en', 'fr')),
expanded AS (
  SELECT o.id, o.text, o.truncated, o.lang, o.created_at, o.quote_count, o.reply_count, o.retweet_count, o.favorite_count,
         v.source_file, TRUE AS is_original
  FROM valid v JOIN fields o ON o.id = v.original_id
  UNION ALL
  SELECT id, text, truncated, lang, created_at, quote_count, reply_count, retweet_count, favorite_count, source_file, FALSE
  FROM valid),
cleaned AS (
  SELECT id, text, coalesce(truncated, FALSE) AS truncated, lang, created_at, nullif(quote_count, 0) AS quote_count,
         nullif(reply_count, 0) AS reply_count, nullif(retweet_count, 0) AS retweet_count,
         nullif(favorite_count, 0) AS favorite_count, is_original
  FROM expanded WHERE is_original OR id % 5 <> 0 OR id NOT IN (SELECT id FROM raw WHERE original_id IS NOT NULL))"""
_COLUMNS = ", ".join(shown_sql(name) for name in OUT)


def _shown() -> list[Column]:
    return [shown(name) for name in OUT]



@plan(
    "scan_posts",
    f"WITH {RAW} SELECT {_COLUMNS}, {shown_sql('original_id')}, has_text, has_delete FROM raw",
)
def _scan_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = raw_json(spark, sf_dir), scratch_path(spark, "raw-posts")
    third = F.col("id") % 3
    rows.filter(third == 0).select("value").write.option("compression", "bzip2").text(f"{path}/one-per-line")
    for rest, gap in ((1, ""), (2, "\n")):
        lists = rows.filter(third == rest).groupBy(F.floor(F.col("id") / 100)).agg(F.collect_list("value").alias("all"))
        lists = lists.select(F.concat(F.lit("[" + gap), F.array_join("all", "," + gap), F.lit(gap + "]")).alias("value"))
        lists.write.option("compression", "bzip2").option("maxRecordsPerFile", 1).text(f"{path}/lists-{rest}")
    found = scan_posts(spark, path)
    found = found.withColumn("original_id", F.col("retweeted_status.id"))
    return found.select(*_shown(), shown("original_id"), "has_text", "has_delete")


@plan("bad_rows", f"WITH {RAW} SELECT CAST(count(*) FILTER (id % 10 = 3) AS BIGINT) AS bad_rows FROM raw")
def _bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts of which every tenth lost its first character."""
    broken = F.when(F.col("id") % 10 == 3, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    rows = raw_json(spark, sf_dir).select(broken.alias("value"), F.lit("all").alias("source_file"))
    return count_bad_rows(rows).agg(F.sum("bad_rows").alias("bad_rows"))


@plan("valid_filter", f"WITH {RAW} SELECT id, lang, text FROM valid")
def _valid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_posts(parse_posts(raw_json(spark, sf_dir)), ["en", "fr"]).select("id", "lang", "text")


@plan("lang_filter", f"WITH {POSTS} SELECT id, lang, bucket FROM posts WHERE lang = 'en'")
def _lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_filter(posts(spark, sf_dir)).select("id", "lang", "bucket")


@plan(
    "clean_projection",
    f"""WITH {RAW}, projected AS (
    SELECT id, text, coalesce(truncated, FALSE) AS truncated, lang, created_at, nullif(quote_count, 0) AS quote_count,
    nullif(reply_count, 0) AS reply_count, nullif(retweet_count, 0) AS retweet_count, nullif(favorite_count, 0) AS favorite_count
    FROM fields) SELECT {_COLUMNS} FROM projected""",
)
def _clean_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_projection(_fields(table(spark, sf_dir, "documents"))).select(*_shown())


@plan("repost_expand", f"WITH {RAW} SELECT id, text, is_original, source_file FROM expanded")
def _repost_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_posts(parse_posts(raw_json(spark, sf_dir)), ["en", "fr"])
    return expand_reposts(valid, keep_reposts=True).select("id", "text", "is_original", "source_file")


@plan("clean_posts", f"WITH {RAW} SELECT {_COLUMNS}, is_original FROM cleaned")
def _clean_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_posts(parse_posts(raw_json(spark, sf_dir)), ["en", "fr"]).select(*_shown(), "is_original")


@plan("stream_clean", f"WITH {RAW} SELECT {_COLUMNS}, is_original FROM cleaned")
def _stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "arriving")
    raw_json(spark, sf_dir).select("value").write.text(path)
    return run_available(stream_clean(stream_rows(spark, path, "*.txt"), ["en", "fr"])).select(*_shown(), "is_original")


@plan("posts_roundtrip", f"WITH {POSTS} SELECT bucket, id, text, lang FROM posts WHERE text IS NOT NULL")
def _posts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cleaned")
    write_posts(posts(spark, sf_dir), path)
    return scan_cleaned(spark, path).select("bucket", "id", "text", "lang")


@plan(
    "processing_summary",
    f"""WITH {POSTS}, per_file AS (
    SELECT bucket, source_file, sum(strlen(text)) AS rb, count(*) AS rp,
           sum(CASE WHEN lang = 'en' THEN strlen(text) ELSE 0 END) AS cb, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS cp
    FROM posts GROUP BY ALL)
    SELECT coalesce(bucket, 'total') AS bucket, GROUPING(bucket) = 1 AS is_total, count(*) AS files, CAST(sum(rb) AS BIGINT) AS raw_bytes, CAST(sum(cb) AS BIGINT) AS clean_bytes,
           CAST(sum(rp) AS BIGINT) AS raw_posts, CAST(sum(cp) AS BIGINT) AS clean_posts
    FROM per_file GROUP BY ROLLUP (bucket)""",
)
def _processing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = posts(spark, sf_dir).withColumn("bytes", F.octet_length("text").cast("bigint"))
    summary = processing_summary(raw, language_filter(raw))
    return summary.withColumn("bucket", F.coalesce(F.col("bucket").cast("string"), F.lit("total")))


@plan(
    "bucket_from_path",
    """SELECT doc_id, strftime(DATE '2018-02-01' + to_months(CAST(doc_id % 25 AS INT)), '%Y-%m-%d') AS bucket FROM documents""",
)
def _bucket_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("/data/2011_01/0000"), (F.col("doc_id") % 10).cast("string"), F.lit("-"),
            F.date_format(month_of(F.col("doc_id")), "yyyy_MM"), F.lit("_part"), F.col("doc_id").cast("string"),
        ).alias("path"),
    )
    return named.select("doc_id", bucket_from_path(F.col("path")).alias("bucket"))


@plan(
    "labelled_scan",
    """SELECT d.doc_id, md5(d.text) AS text_md5, 'c' || (quality + 2 * toxic) AS class,
    dense_rank() OVER (ORDER BY 'c' || (quality + 2 * toxic)) - 1 AS label
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def _labelled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("c"), (F.col("quality") + 2 * F.col("toxic")).cast("string")).alias("class")
    )
    texts = table(spark, sf_dir, "documents").join(label_by_name(named), "doc_id")
    return texts.select("doc_id", F.md5("text").alias("text_md5"), "class", "label")


@plan(
    "sample_proportion",
    f"""WITH {POSTS} SELECT id, source_file FROM (
    SELECT id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY {hash_sql('id')}, id) AS nth,
           count(*) OVER (PARTITION BY source_file) AS n FROM posts) WHERE nth <= floor(n * 0.3)""",
)
def _sample_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_per_group(posts(spark, sf_dir).select("id", "source_file"), "source_file", ["id"], SEED, proportion=0.3)


@plan(
    "sample_k",
    f"""WITH {POSTS} SELECT bucket, id FROM (
    SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY {hash_sql('id')}, id) AS nth FROM posts) WHERE nth <= 7""",
)
def _sample_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_per_group(posts(spark, sf_dir).select("bucket", "id"), "bucket", ["id"], SEED, size=7)


@plan(
    "split_dataset",
    f"""SELECT doc_id, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.1 + 0.9 * 0.2 THEN 'validation' ELSE 'train' END AS part
    FROM (SELECT doc_id, {uniform_sql('doc_id')} AS u FROM labels)""",
)
def _split_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_dataset(table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"], SEED, validation=0.2, test=0.1)
