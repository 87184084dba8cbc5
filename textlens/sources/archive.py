"""A data source for archives of compressed JSON files, each unpacked once: its beginning tells its layout."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 20  # unpacked bytes read at once
ROWS = 4096  # most rows handed on at once
MOST = 32 << 20  # packed bytes of the files of one task, unless one file is larger
OPENING = 1 << 18  # bytes that opening a file counts as
_GAPS = " \t\r\n,"
_NO_ADDRESS = re.compile(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]')  # characters that addresses write as codes
_KINDS = pa.schema([("value", pa.string()), ("source_file", pa.string())])


def storage_of(path: str) -> tuple[fs.FileSystem, str, str] | None:
    """Storage, path within it and prefix of its addresses; None if the storage is not known here. Paths are taken as they
    are, as Spark takes them: a per cent sign is one."""
    scheme, _, own = path.rpartition(":/") if "://" not in path else path.partition("://")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath("/" + own.lstrip("/") if scheme else path), "file:"
    try:
        found, own = fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe="/:@"))
    except (pa.ArrowException, OSError, ValueError):
        return None
    in_bucket = scheme in ("s3", "s3a", "gs")  # their paths begin with the bucket
    return found, own, f"{scheme}://" if in_bucket else path[: path.index("/", len(scheme) + 3)]


def text_blocks(file: BinaryIO) -> Iterator[str]:
    """The text of a file in pieces that end with a line, or where a line is longer than a block, with a character."""
    rest = b""
    while block := file.read(BLOCK):
        rest += block
        cut = rest.rfind(b"\n") + 1
        if not cut:  # no line ends here: cut before the last character, which may go on
            cut = max(len(rest) - 4, 0)
            while cut and rest[cut] & 0xC0 == 0x80:
                cut -= 1
        yield rest[:cut].decode("utf-8", "replace")
        rest = rest[cut:]
    yield rest.decode("utf-8", "replace")


def json_rows(blocks: Iterator[str]) -> Iterator[str]:
    """Rows of a file: the entries of a list, or the lines of a file that does not begin with a list.

    Of a list at most one entry and one block are held. A line on which an entry cannot be read is a row as it is, and
    reading goes on behind it; one more list may follow on a list.
    """
    text = ""
    for block in blocks:
        text += block
        if text.strip():
            break
    if text.lstrip("\ufeff" + _GAPS).startswith("["):
        yield from _entries(text.lstrip("\ufeff"), blocks)
    else:
        yield from _lines(text, blocks)


def _lines(text: str, blocks: Iterator[str]) -> Iterator[str]:
    held = [text]  # pieces of a line that is longer than a block
    for block in blocks:
        if held[-1].endswith("\n"):
            yield from "".join(held).replace("\r\n", "\n").split("\n")[:-1]
            held = []
        held.append(block)
    yield from "".join(held).replace("\r\n", "\n").split("\n")


def _entries(text: str, blocks: Iterator[str]) -> Iterator[str]:
    decode, at, inside, ended = json.JSONDecoder().raw_decode, 0, False, False

    def more(least: int) -> None:
        nonlocal text, at, ended
        parts = [text[at:]]
        while least > 0 and not ended:
            block = next(blocks, None)
            ended = block is None
            parts.append(block or "")
            least -= len(parts[-1])
        text, at = "".join(parts), 0

    while True:
        while at < len(text) and text[at] in _GAPS:
            at += 1
        if at == len(text):
            if ended:
                return
            more(1)
            continue
        if text[at] == "]" and inside or text[at] == "[" and not inside:
            inside, at = text[at] == "[", at + 1
            continue
        while True:
            broken = text[at] not in "{["
            if not broken:
                try:
                    _, end = decode(text, at)
                    break
                except json.JSONDecodeError as error:
                    # An entry that is cut off at the end of the text is read once more has come.
                    broken = ended or not (error.msg.startswith("Unterminated string") or error.pos >= len(text) - 8)
                except RecursionError:
                    broken = True
            end = text.find("\n", at)
            if broken and end >= 0:
                break
            if ended:
                end = len(text)
                break
            more(len(text) - at)
        yield text[at:end].rstrip("\r")
        at = end


@dataclass
class Files(InputPartition):
    names: list[str]


class JsonFiles(DataSource):
    """Rows ``value, source_file`` of all matching files below a path; ``value`` is an entry of a list or a line."""

    @classmethod
    def name(cls) -> str:
        return "json_files"

    def schema(self) -> str:
        return "value string, source_file string"

    def reader(self, schema: object) -> DataSourceReader:
        return JsonFilesReader(dict(self.options))


class JsonFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob = options["path"], options.get("pathglobfilter", options.get("pathGlobFilter", "*"))
        self.tasks = int(options.get("tasks", 8))

    def partitions(self) -> list[InputPartition]:
        """Files dealt out by size, as far as possible to all cores; a file is unpacked by one task."""
        storage, root, _ = storage_of(self.path)
        found = storage.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == fs.FileType.Directory:
            infos = [i for i in storage.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
        else:
            infos = [found]
        # As elsewhere, names that begin with a dot or an underscore, of files or folders, are no data.
        shown = [i for i in infos if not any(p[:1] in (".", "_") for p in i.path[len(root) :].split("/"))]
        files = sorted((i.path, i.size + OPENING) for i in shown if fnmatch(i.base_name, self.glob))
        most = min(MOST, sum(size for _, size in files) // self.tasks + 1)
        out, names, held = [], [], 0
        for name, size in files:
            if names and held + size > most:
                out.append(Files(names))
                names, held = [], 0
            names.append(name)
            held += size
        return [*out, Files(names)] if names or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        storage, _, prefix = storage_of(self.path)
        for name in partition.names:
            address = prefix + _NO_ADDRESS.sub(lambda found: quote(found[0]), name)
            with storage.open_input_stream(name, compression="detect") as file:
                values, held = [], 0
                for value in json_rows(text_blocks(file)):
                    values.append(value)
                    held += len(value)
                    if len(values) >= ROWS or held >= BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([address] * len(values))], schema=_KINDS)
                        values, held = [], 0
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([address] * len(values))], schema=_KINDS)


def read_json_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``value, source_file`` of all files below ``path`` in a storage that `storage_of` knows."""
    spark.dataSource.register(JsonFiles)
    reader = spark.read.format("json_files").option("pathGlobFilter", glob)
    return reader.option("tasks", spark.sparkContext.defaultParallelism).load(path)
