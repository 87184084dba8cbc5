"""Raw and cleaned posts as JSON, in two layouts: one list per file, or one object per line."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textlens.functions.text import SPACES
from textlens.session import qualified
from textlens.sources.archive import read_json_files, storage_of

# The fields of a post.
FIELDS = {
    "truncated": "boolean",
    "lang": "string",
    "created_at": "string",
    "coordinates": "struct<type: string, coordinates: array<double>>",
    "place": "variant",
    "quote_count": "bigint",
    "reply_count": "bigint",
    "retweet_count": "bigint",
    "favorite_count": "bigint",
}
PLAIN = ", ".join(["id: bigint", "text: string"] + [f"{name}: {kind}" for name, kind in FIELDS.items()])
# As a variant a key that is present with null differs from a missing key.
RAW = ", ".join(
    ["id: variant", "text: variant", "`delete`: variant"] + [f"{name}: {kind}" for name, kind in FIELDS.items()]
)
RAW_SCHEMA = f"array<struct<{RAW}, retweeted_status: struct<{PLAIN}>>>"


def read_text_files(spark: SparkSession, path: str | list[str], glob: str = "*.bz2", whole_files: bool = False) -> DataFrame:
    """Rows ``value, source_file`` of all matching files below ``path``; compressed files are unpacked.

    Lines are read in parallel, also within one bz2 file; with ``whole_files`` a file is one row. ``path`` may be a
    list of files.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.text(path, wholetext=whole_files).select("value", F.col("_metadata.file_path").alias("source_file"))


def split_whole_files(files: DataFrame) -> DataFrame:
    """Whole files to rows: a list stays one row, other files become one row per line."""
    content = F.regexp_replace("value", f"^[{SPACES}]+|[{SPACES}]+$", "")
    is_list = F.startswith("value", F.lit("[")) & F.endswith("value", F.lit("]"))
    rows = F.when(is_list, F.array("value")).otherwise(F.split("value", "\n"))
    return files.withColumn("value", content).select(F.explode(rows).alias("value"), "source_file")


def printed_lists(lines: DataFrame) -> list[str]:
    """Files that hold a list printed over several lines: a line opens a list and does not close it."""
    value = F.regexp_replace("value", f"^[{SPACES}]+|[{SPACES}]+$", "")
    opens = F.startswith(value, F.lit("[")) & ~F.endswith(value, F.lit("]"))
    found = lines.filter(opens).select("source_file").distinct().orderBy("source_file")
    return [row[0] for row in found.collect()]  # names of files, of which the driver lists all anyway


def parse_posts(rows: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Posts of JSON rows; a row is an object or a list of objects. Rows that are no JSON are left out; ``seen`` then
    counts them (``bad_rows``) beside all rows (``rows``) in the same pass.

    Adds ``has_id``, ``has_text``, ``has_delete``: whether the key is present, null values included.
    """
    posts = F.from_json("value", RAW_SCHEMA)
    read = rows.select("source_file", posts.alias("posts"), (F.trim("value") != "").alias("_filled"))
    if seen is not None:
        bad = F.col("posts").isNull() & F.col("_filled")
        read = read.observe(seen, F.count_if(bad).alias("bad_rows"), F.count(F.lit(1)).alias("rows"))
    parsed = read.select("source_file", F.explode("posts").alias("post"))
    return parsed.select(
        F.expr("try_variant_get(post.id, '$', 'bigint')").alias("id"),
        F.expr("try_variant_get(post.text, '$', 'string')").alias("text"),
        *[F.col(f"post.{name}").alias(name) for name in FIELDS],
        F.col("post.retweeted_status").alias("retweeted_status"),
        F.col("post.id").isNotNull().alias("has_id"),
        F.col("post.text").isNotNull().alias("has_text"),
        F.col("post.delete").isNotNull().alias("has_delete"),
        "source_file",
    )


def scan_posts(
    spark: SparkSession, path: str, glob: str = "*.bz2", whole_files: bool | None = None, seen: Observation | None = None
) -> DataFrame:
    """Parsed raw posts of all matching files: one object per line, a list on one line, or a list over several.

    Each file is unpacked once: its beginning tells its layout, and the entries of a list are read one by one
    (`read_json_files`; one task reads a file). ``whole_files`` gives the layout of all files instead: False reads lines,
    also within one bz2 file in parallel, True reads whole files. In a storage that only Spark knows, or with alternatives
    in braces in ``glob``, the files with a list over several lines are found by reading all lines first. ``seen`` counts
    rows that are no JSON, as in `parse_posts`.
    """
    place = qualified(spark, path)
    if whole_files is None and "{" not in glob and storage_of(place) is not None:
        return parse_posts(read_json_files(spark, place, glob), seen)
    rows = read_text_files(spark, path, glob, bool(whole_files))
    if whole_files:
        return parse_posts(split_whole_files(rows), seen)
    printed = printed_lists(rows) if whole_files is None else []
    if printed:
        files = spark.createDataFrame([(name,) for name in printed], "source_file string")
        whole = split_whole_files(read_text_files(spark, [unquote(name) for name in printed], "*", True))
        rows = rows.join(files, "source_file", "left_anti").select("value", "source_file").unionByName(whole)
    return parse_posts(rows, seen)


def count_bad_rows(rows: DataFrame) -> DataFrame:
    """Rows per file that are neither empty nor JSON."""
    bad = F.from_json("value", RAW_SCHEMA).isNull() & (F.trim("value") != "")
    return rows.groupBy("source_file").agg(F.count_if(bad).alias("bad_rows"))


def created_timestamp(created_at: Column) -> Column:
    """``Wed Jun 06 20:07:10 +0000 2018`` as a timestamp; the weekday is not needed."""
    return F.try_to_timestamp(F.substring(created_at, 5, 30), F.lit("MMM dd HH:mm:ss Z yyyy"))


def with_bucket(posts: DataFrame) -> DataFrame:
    """Add ``created_ts`` and the month ``bucket``."""
    dated = posts.withColumn("created_ts", created_timestamp(F.col("created_at")))
    return dated.withColumn("bucket", F.trunc("created_ts", "month"))


def write_posts(posts: DataFrame, path: str, by: str | None = "bucket", form: str = "parquet") -> None:
    """Cleaned posts as parquet or JSON lines, in one folder per ``by``."""
    writer = posts.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).format(form).save(path)


def scan_cleaned(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Cleaned posts that have a text."""
    reader = spark.read.option("recursiveFileLookup", False)
    if form == "json":
        fields = ", ".join(f"{name} {kind}" for name, kind in {"id": "bigint", "text": "string", **FIELDS}.items())
        reader = reader.schema(f"{fields}, bucket date")
    return reader.format(form).load(path).filter(F.col("text").isNotNull())
