"""Vocabularies and word-vector spaces as tables."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO, TextIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.operators.joins import lookup_join
from textlens.operators.ranking import running_total
from textlens.session import materialise

READ = 1 << 20  # bytes read at once
ROWS = 1024  # vectors handed on at once
STRETCH = 4096  # words written by one task at once
_COUNTED = [("number", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("lines", pa.int64()), ("whole", pa.bool_())]
_KINDS = "number bigint, start bigint, stop bigint, lines bigint, whole boolean"
_STRETCH = "start bigint, stop bigint, first bigint"


def save_vocabulary(vocab: DataFrame, counts: DataFrame, path: str) -> None:
    """The ranked vocabulary and the raw counts, which also hold the words that were cut."""
    vocab.write.mode("errorifexists").parquet(f"{path}/vocabulary")
    counts.write.mode("errorifexists").parquet(f"{path}/counts")


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/counts")


def save_space(space: DataFrame, path: str) -> None:
    space.select("idx", "word", "vec").write.mode("errorifexists").parquet(path)


def load_space(spark: SparkSession, path: str, idx: str = "idx", word: str = "word", vec: str = "vec") -> DataFrame:
    """A stored space; other column names are mapped to ``idx, word, vec``."""
    return spark.read.parquet(path).select(F.col(idx).alias("idx"), F.col(word).alias("word"), F.col(vec).alias("vec"))


def open_shared(path: str) -> BinaryIO:
    """A file of the shared storage for reading in bytes: a path, or an address such as ``s3://`` or ``hdfs://``."""
    if ":/" not in path:
        return open(path, "rb")
    storage, name = fs.FileSystem.from_uri(path)
    return storage.open_input_file(name)


def _ranges(spark: SparkSession, size: int, count: int) -> DataFrame:
    """``number, start, stop`` of ``count`` stretches of ``size`` bytes, a task each."""
    number = F.col("id")
    cuts = [F.floor(at * F.lit(size) / F.lit(count)).cast("bigint") for at in (number, number + 1)]
    return spark.range(0, count, 1, count).select(number.alias("number"), cuts[0].alias("start"), cuts[1].alias("stop"))


def line_offsets(spark: SparkSession, path: str, partitions: int) -> list[tuple[int, int, int]]:
    """``start, stop, first`` of stretches of a text file: ``first`` is the number of the first line that begins in one.

    The stretches are read once, in parallel; the driver gets two numbers of each.
    """
    with open_shared(path) as file:
        size = file.seek(0, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                with open_shared(path) as file:
                    at, lines, last = row["start"], 0, b"\n"
                    file.seek(at)
                    while at < row["stop"]:
                        block = file.read(min(READ, row["stop"] - at))
                        at, lines, last = at + len(block), lines + block.count(b"\n"), block[-1:]
                found.append({**row, "lines": lines, "whole": last == b"\n"})
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema(_COUNTED))

    # One row for each of the tasks that read the file.
    counted = _ranges(spark, size, max(1, min(partitions, size))).mapInArrow(count, _KINDS).orderBy("number").collect()
    out, before, whole = [], 0, True
    for row in counted:
        out.append((row.start, row.stop, before + (not whole)))
        before, whole = before + row.lines, row.whole
    return [*out, (size, size, before + (not whole))]


def load_space_files(spark: SparkSession, weights: str, words: str, partitions: int | None = None) -> DataFrame:
    """A space from a ``.npy`` matrix and a text file with one word per line, both in a shared folder.

    The word file is cut into stretches of bytes whose first line numbers are counted first, so every task begins at its
    own lines, and maps the rows of the matrix that belong to them. Empty lines are words. It is an error if the numbers
    of lines and rows differ.
    """
    rows = np.load(weights, mmap_mode="r").shape[0]
    *stretches, (_, _, lines) = line_offsets(spark, words, partitions or spark.sparkContext.defaultParallelism)
    if lines != rows:
        raise ValueError(f"{words} has {lines} lines for {rows} vectors")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.load(weights, mmap_mode="r")
        for batch in batches:
            for start, stop, first in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                with open_shared(words) as file:
                    if start:
                        file.seek(start - 1)
                        file.readline()
                    while names := [line for _ in range(ROWS) if file.tell() < stop and (line := file.readline())]:
                        block = np.asarray(held[first : first + len(names)], dtype=np.float32)
                        ends = np.arange(0, block.size + 1, block.shape[1], dtype=np.int32)
                        ids = pa.array(range(first, first + len(names)), pa.int64())
                        texts = pa.array([name.rstrip(b"\r\n").decode() for name in names], pa.string())
                        first += len(names)
                        vectors = pa.ListArray.from_arrays(ends, block.ravel())
                        yield pa.RecordBatch.from_arrays([ids, texts, vectors], ["idx", "word", "vec"])

    dealt = spark.createDataFrame(stretches, _STRETCH)
    return dealt.repartition(max(1, len(stretches)), "start").mapInArrow(read, "idx bigint, word string, vec array<float>")


def save_space_files(space: DataFrame, weights: str, words: str) -> None:
    """A space as a ``.npy`` matrix and a file of words, one a line, both new files in a folder that all tasks share.

    Indices count from 0 without a gap, and words hold no line ends. Words lie in stretches in order of index, whose bytes are counted first; then every
    task writes its rows and words where they belong, and a task that runs again writes the same.
    """
    stored = materialise(space.select("idx", "word", F.col("vec").cast("array<float>").alias("vec")))
    unfit = F.count_if(F.col("word").isNull() | F.col("vec").isNull() | F.col("word").rlike("[\\r\\n]"))
    rows, low, high, wide, thin, bad = stored.agg(
        F.count(F.lit(1)), F.min("idx"), F.max("idx"), F.max(F.size("vec")), F.min(F.size("vec")), unfit
    ).first()
    if not rows or (low, high) != (0, rows - 1) or wide != thin or bad:
        raise ValueError("indices must count from 0 without a gap, vectors be of one length and words of one line")
    stretch = F.floor(F.col("idx") / STRETCH).cast("bigint").alias("stretch")
    sizes = stored.groupBy(stretch).agg(F.sum(F.octet_length("word") + 1).alias("bytes"))
    places = running_total(sizes, "stretch", "bytes", "place").select("stretch", F.col("place").cast("bigint").alias("place"))
    np.lib.format.open_memmap(weights, mode="w+", dtype=np.float32, shape=(rows, wide)).flush()
    with open(words, "xb"):
        pass
    # A task gathers whole stretches of a fixed number of rows.
    dealt = lookup_join(stored.withColumn("stretch", F.floor(F.col("idx") / STRETCH).cast("bigint")), places, ["stretch"])

    def write(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches).sort_by("idx")
        first, place = part.column("idx")[0].as_py(), part.column("place")[0].as_py()
        block = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
        held = np.load(weights, mmap_mode="r+")
        held[first : first + len(part)] = block
        held.flush()
        with open(words, "r+b") as file:
            file.seek(place)
            file.write(b"".join(word.encode() + b"\n" for word in part.column("word").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64())], ["written"])

    dealt.groupBy("stretch").applyInArrow(write, "written bigint").agg(F.sum("written")).collect()


class _StateReader:
    """Reads a JSON text piece by piece; only one value is held at a time."""

    def __init__(self, file: TextIO) -> None:
        self.file, self.text, self.at = file, "", 0
        self.decoder = json.JSONDecoder()

    def more(self, size: int = 1 << 16) -> bool:
        block = self.file.read(size)
        self.text, self.at = self.text[self.at :] + block, 0
        return bool(block)

    def peek(self) -> str:
        """The next character that is no space."""
        while True:
            while self.at < len(self.text) and self.text[self.at].isspace():
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                raise ValueError("the state ends in the middle")

    def skip(self, char: str) -> bool:
        """Whether ``char`` comes next; it is passed over."""
        found = self.peek() == char
        self.at += found
        return found

    def need(self, char: str) -> None:
        if not self.skip(char):
            raise ValueError(f"the state has no {char!r} where one must be")

    def value(self) -> object:
        self.peek()
        size = 1 << 16
        while True:
            try:
                found, end = self.decoder.raw_decode(self.text, self.at)
            except json.JSONDecodeError:
                end = None
            # A number cut off where reading stopped, as in "0." or "1e", may go on.
            if end is not None and end < len(self.text) and self.text[end] in ",:]} \t\r\n":
                self.at = end
                return found
            if not self.more(size):
                if end is None:
                    raise ValueError("the state is no JSON")
                self.at = end
                return found
            size *= 2

    def items(self, opened: str, closed: str) -> Iterator[tuple[object, object]]:
        """Name (or null) and value of each entry of a list or an object."""
        self.need(opened)
        if self.skip(closed):
            return
        while True:
            name = None
            if opened == "{":
                name = self.value()
                self.need(":")
            yield name, self.value()
            if self.skip(closed):
                return
            self.need(",")

    def fields(self) -> Iterator[tuple[str, int, object, object]]:
        """Field, place, name and value of the entries of all lists and objects of a state; other fields are left out."""
        self.need("{")
        while not self.skip("}"):
            field = self.value()
            self.need(":")
            opened = self.peek()
            if opened in "[{":
                for place, (name, value) in enumerate(self.items(opened, "]" if opened == "[" else "}")):
                    yield field, place, name, value
            else:
                self.value()
            self.skip(",")


_STATE = "field string, place bigint, word string, freq bigint, chance double"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``field, place, word, freq, chance`` of a saved JSON state, which one task reads piece by piece: JSON cannot be
    read from the middle, but is never held whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(field: str, place: int, name: object, value: object) -> dict[str, object]:
            word = value if field == "_words" else name
            return {
                "field": field,
                "place": place,
                "word": word,
                "freq": value if field == "_counter" else None,
                "chance": value if field == "_sampling_table" else None,
            }

        kinds = pa.schema([("field", pa.string()), ("place", pa.int64()), ("word", pa.string()), ("freq", pa.int64()), ("chance", pa.float64())])
        for batch in batches:
            for _ in range(batch.num_rows):
                with io.TextIOWrapper(open_shared(path), encoding="utf-8") as file:
                    known = (f for f in _StateReader(file).fields() if f[0] in ("_words", "_sampling_table", "_counter"))
                    while rows := [row(*f) for f in islice(known, 8192)]:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return spark.range(0, 1, 1, 1).mapInArrow(read, _STATE)


def load_tokenizer_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and raw counts from a saved JSON state; words are counted in order of first appearance.

    The state is read once and stored as rows.
    """
    state = materialise(read_state(spark, path))
    counts = state.filter("field = '_counter'").select("word", "freq", F.col("place").alias("first_seen"))
    words = state.filter("field = '_words'").select("word", F.col("place").alias("idx"))
    chances = state.filter("field = '_sampling_table'").select(F.col("place").alias("idx"), F.col("chance").alias("sample_prob"))
    vocab = words.join(chances, "idx", "left").join(counts, "word").select("word", "idx", "freq", "sample_prob")
    return vocab, counts.withColumn("first_seen", F.col("first_seen").cast("decimal(38,0)"))
