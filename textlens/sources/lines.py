"""Text files: corpora, labelled texts, survey tables and the dates in their paths."""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5
from unicodedata import category
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.session import exists, materialise, qualified

TASK_BYTES, BATCH_BYTES = 16 << 20, 4 << 20  # text files that a task reads, and holds at once


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All lines of the files: ``text, source_file``."""
    return spark.read.text(list(paths)).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_file"))


def write_lines(corpus: DataFrame, path: str) -> None:
    """One text per line."""
    corpus.select("text").write.mode("errorifexists").text(path)


def bucket_from_path(path: Column) -> Column:
    """First day of the month named ``YYYY_MM`` or ``YYYY-MM`` in the last part of a path, else null."""
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    year, month = (F.regexp_extract(name, r"(?<![0-9])([0-9]{4})[_-]([0-9]{2})(?![0-9])", n) for n in (1, 2))
    return F.to_date(F.when(year != "", F.concat_ws("-", year, month, F.lit("01"))))


def read_labelled_folders(spark: SparkSession, path: str) -> DataFrame:
    """One text per file, one folder per class (``<class>`` or ``class=<class>``): ``text, class, label``; classes are
    numbered by name.

    In a file system that tasks see as a folder they read the files themselves, as Spark's reader starts anew for each
    file, and class names are known from the list of files alone. Elsewhere Spark's reader is used.
    """
    scheme, _, place = qualified(spark, path).partition(":")
    folder = "/" + place.lstrip("/")
    if scheme != "file" or re.search(r"[*?\[\]{}\\]", path) or not os.path.isdir(folder):
        return label_by_name(_class_of(_read_files(spark, path)))
    files = materialise(_listed(spark, folder), "files")
    size, cores = files.agg(F.sum("size")).first()[0] or 0, spark.sparkContext.defaultParallelism
    dealt = files.repartition(max(2 * cores, size // TASK_BYTES), "folder", "name")
    read = dealt.select("folder", "name", "parent").mapInArrow(_read_named, "value binary, parent string")
    return label_by_name(_class_of(read.withColumn("value", F.col("value").cast("string"))), named=files.select(_class().alias("class")))


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    """``value, parent`` of the files below a path by Spark's reader."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select("value", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("parent"))


def _class_of(files: DataFrame) -> DataFrame:
    """``text, class`` of ``value, parent``."""
    return files.select(F.regexp_replace("value", "\\x00$", "").alias("text"), _class().alias("class"))


def _class() -> Column:
    return F.regexp_replace("parent", "^class=", "")


def _hidden(name: str) -> bool:
    """Names that Spark's reader passes over."""
    hides = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return hides and not name.startswith(("_common_metadata", "_metadata"))


def _in_path(name: str) -> str:
    """A name as it stands in the path that Spark gives a file."""

    def plain(c: str) -> bool:
        if c.isascii():
            return c.isalnum() or c in "-_.!~*'():@&=+$,;"
        return category(c) not in ("Zs", "Zl", "Zp", "Cc")

    return "".join(c if plain(c) else quote(c, safe="") for c in name)


def _listed(spark: SparkSession, top: str) -> DataFrame:
    """``folder, name, parent, size`` of the text files below a folder. The driver finds the folders, tasks list them."""
    folders, at = [top], 0
    while at < len(folders):
        with os.scandir(folders[at]) as entries:
            folders.extend(entry.path for entry in entries if entry.is_dir() and not _hidden(entry.name))
        at += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                with os.scandir(os.fsdecode(folder)) as entries:
                    found = [(os.fsencode(e.name), e.stat().st_size) for e in entries if e.name.endswith(".txt") and not _hidden(e.name) and e.is_file()]
                # Spark's reader passes over empty files.
                found = [file for file in found if file[1]]
                for begin in range(0, len(found), 1 << 14):
                    part = found[begin : begin + (1 << 14)]
                    same = [pa.array([x] * len(part), kind) for x, kind in ((folder, pa.binary()), (_in_path(os.path.basename(os.fsdecode(folder))), pa.string()))]
                    names, sizes = pa.array([name for name, _ in part], pa.binary()), pa.array([size for _, size in part], pa.int64())
                    yield pa.RecordBatch.from_arrays([same[0], names, same[1], sizes], ["folder", "name", "parent", "size"])

    named = spark.createDataFrame(pa.table({"folder": pa.array([os.fsencode(folder.rstrip("/") or "/") for folder in folders], pa.binary())}))
    dealt = named.repartition(min(len(folders), 4 * spark.sparkContext.defaultParallelism), "folder")
    return dealt.mapInArrow(run, "folder binary, name binary, parent string, size bigint")


def _read_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole files, in batches of a bounded size."""

    def made(texts: list, parents: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(parents, pa.string())], ["value", "parent"])

    texts, parents, held = [], [], 0
    for batch in batches:
        for folder, name, parent in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "parent")), strict=True):
            with open(os.path.join(folder, name), "rb") as file:
                texts.append(file.read())
            parents.append(parent)
            held += len(texts[-1])
            if held > BATCH_BYTES:
                yield made(texts, parents)
                texts, parents, held = [], [], 0
    yield made(texts, parents)


def label_by_name(texts: DataFrame, name: str = "class", named: DataFrame | None = None) -> DataFrame:
    """Add ``label``: the place of the class among all class names (those of ``named``, if given) in order."""
    names = (texts if named is None else named).agg(F.array_sort(F.collect_set(name))).scalar()
    return texts.withColumn("label", (F.array_position(names, F.col(name)) - 1).cast("int"))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """The CSV form ``sentiment,message,tweetid``: ``text, sentiment``."""
    table = spark.read.schema("sentiment int, message string, tweetid bigint")
    rows = table.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col("message").alias("text"), "sentiment")


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """Small CSV files ``year,prop``: ``entity, year, prop``. The entity is the folder ``entity=<name>`` that a file lies in,
    or else the name of the file."""
    rows = spark.read.schema("year int, prop double").option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    folder = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), "/entity=([^/]*)/[^/]*$", 1)
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*)\.csv$", 1)
    return rows.select(F.when(folder != "", folder).otherwise(name).alias("entity"), "year", "prop")


def write_survey(survey: DataFrame, path: str) -> None:
    """``entity, year, prop`` as CSV files that `read_survey` reads, in a folder per entity."""
    survey.select("entity", "year", "prop").write.partitionBy("entity").option("header", True).csv(path)


def write_labelled_folders(texts: DataFrame, path: str) -> None:
    """``text, class`` as one file per text and a folder per class, as `read_labelled_folders` reads them.

    In a file system that tasks see as a folder they write the files themselves: Spark's writer starts two processes
    for each file there and moves each by the driver. Elsewhere Spark's writer is used.
    """
    rows = texts.select("text", "class").filter(F.col("text").isNotNull() & F.col("class").isNotNull())
    scheme, _, place = qualified(texts.sparkSession, path).partition(":")
    if scheme != "file":
        rows.write.partitionBy("class").option("maxRecordsPerFile", 1).option("lineSep", "\x00").text(path)
        return
    if exists(texts.sparkSession, path):
        raise FileExistsError(path)
    os.makedirs(folder := "/" + place.lstrip("/"))
    named = rows.select(F.col("text").cast("binary").alias("text"), F.col("class").cast("string").alias("class"))
    named.mapInArrow(_file_writer(folder), "files bigint").agg(F.sum("files")).first()


def _class_folder(name: str) -> str:
    """The folder that Spark's writer gives a class."""
    return "class=" + (re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name) or "__HIVE_DEFAULT_PARTITION__")


def _file_writer(folder: str) -> Callable:
    """Each text into a file named by its partition, its content and how often that came before: a task that runs again
    writes the same files, in whatever order its rows come. A file has its name only when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, folders = TaskContext.get().partitionId(), Counter(), {}
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"tasks do not see {folder}")
        draft = os.path.join(folder, f"_{uuid.uuid4().hex}")
        for batch in batches:
            for text, name in zip(*(batch.column(c).to_pylist() for c in ("text", "class")), strict=True):
                if name not in folders:
                    folders[name] = os.path.join(folder, _class_folder(name))
                    os.makedirs(folders[name], exist_ok=True)
                key = (name, md5(text, usedforsecurity=False).hexdigest())
                with open(draft, "wb") as out:
                    out.write(text + b"\0")
                os.replace(draft, os.path.join(folders[name], f"part-{part:05d}-{key[1]}-{seen[key]}.txt"))
                seen[key] += 1
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    return run
