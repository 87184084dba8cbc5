"""Merkle manifest of a dataset: a persistent tree whose versions copy only the ancestors of a changed leaf."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import map_columns, stored
from textlens.operators.joins import lookup_join
from textlens.operators.ranking import global_index

#: Children of a node; levels of a block, so that a block has FAN ** LEVELS = 4,096 leaves.
FAN, LEVELS = 8, 4
#: A tampered copy exists of every row whose crc32 of the decimal doc_id is divisible by this.
TAMPERED = 3

_PATH = "array<struct<at: int, others: binary>>"
_BLOCK = "tree string, block bigint, size bigint, ids array<bigint>, names binary, changed binary, root binary"
_MANIFEST = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"
)


class Node(NamedTuple):
    """An immutable node: versions of a tree share the nodes that are the same."""

    name: bytes
    children: tuple[Node, ...] = ()


def hashed(names: Sequence[bytes]) -> bytes:
    """Name of the node over ``names``, digests as hexadecimal text."""
    return sha256(b"".join(names)).hexdigest().encode()


def over(children: Sequence[Node]) -> Node:
    return Node(hashed([child.name for child in children]), tuple(children))


def height(size: int) -> int:
    """Levels above ``size`` leaves until one node remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def build(names: Sequence[bytes], levels: int) -> Node:
    """The tree of ``levels`` levels over at most FAN ** levels leaves."""
    nodes = [Node(name) for name in names]
    for _ in range(levels):
        nodes = [over(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
    return nodes[0]


def replaced(node: Node, place: int, levels: int, name: bytes) -> Node:
    """The version of a tree in which the leaf at ``place`` is ``name``: its ancestors are copied, all else is shared."""
    if not levels:
        return Node(name)
    at, rest = divmod(place, FAN ** (levels - 1))
    children = list(node.children)
    children[at] = replaced(children[at], rest, levels - 1, name)
    return over(children)


def siblings(node: Node, place: int, levels: int) -> list[tuple[int, list[bytes]]]:
    """From the leaf upwards, its ancestor's place among its run and the names of the others."""
    steps = []
    for level in reversed(range(levels)):
        at, place = divmod(place, FAN**level)
        steps.append((at, [c.name for i, c in enumerate(node.children) if i != at]))
        node = node.children[at]
    return steps[::-1]


def copies(node: Node, place: int, levels: int) -> list[bytes]:
    """Names of the ancestors of a leaf, from its parent upwards."""
    names = []
    for level in reversed(range(levels)):
        names.append(node.name)
        at, place = divmod(place, FAN**level)
        node = node.children[at]
    return names[::-1]


def _split(packed: bytes) -> list[bytes]:
    text = packed.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _raw(names: Sequence[bytes]) -> bytes:
    return bytes.fromhex(b"".join(names).decode())


def leaves(documents: DataFrame) -> DataFrame:
    """tree (of the language), doc_id, name of the leaf and of its tampered copy (the same where none exists), 32 bytes each."""
    fields = documents.select("doc_id", *[F.col(c).cast("string").cast("binary").alias(c) for c in ("source", "lang", "n_chars", "text")])

    def field(value: bytes | None) -> bytes:
        return b"-" if value is None else b"%d:%b" % (len(value), value)

    def make(part: dict[str, list]) -> dict[str, object]:
        names, changed = [], []
        for doc_id, text, *rest in zip(*[part[c] for c in ("doc_id", "text", "source", "lang", "n_chars")], strict=True):
            key = None if doc_id is None else b"%d" % doc_id
            head = sha256(b"".join(map(field, (key, *rest))))
            names.append(head.copy())
            names[-1].update(field(text))
            if key is not None and zlib.crc32(key) % TAMPERED == 0:
                head.update(field(text and text.lower()))
                changed.append(head.digest())
            else:
                changed.append(names[-1].digest())
        # An absent language comes before all others.
        trees = ["" if lang is None else "+" + lang.decode() for lang in part["lang"]]
        return {"tree": trees, "doc_id": part["doc_id"], "name": [n.digest() for n in names], "changed": changed}

    return map_columns(fields, "tree string, doc_id bigint, name binary, changed binary", make)


def _single(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _packer(levels: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        size = table["size"][0].as_py()
        names = [n.hex().encode() for n in table["name"].to_pylist()]
        root = build(names, min(levels, height(size)))
        changed = b"".join(table["changed"].to_pylist())
        row = [table["tree"][0].as_py(), table["block"][0].as_py(), size, table["id"].to_pylist(), _raw(names), changed, _raw([root.name])]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

    return pack


def grow(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The stored blocks of each stage and the roots (tree, name) of the trees over ``nodes`` (tree, place, size, id, name, changed).

    ``place`` counts the leaves of a tree from 0, ``size`` is their number. A block of FAN ** levels aligned leaves is one
    row; its root is a leaf of the next stage, until each tree is one block.
    """
    width, stages, roots = FAN**levels, [], None
    while True:
        dealt = nodes.withColumn("block", F.floor(F.col("place") / width).cast("bigint"))
        packed = stored(dealt.groupBy("tree", "block").applyInArrow(_packer(levels), _BLOCK), "blocks")
        stages.append(packed)
        size = F.ceil(F.col("size") / width).cast("bigint")
        none = F.lit(None).cast("bigint").alias("id")
        upper = packed.select("tree", F.col("block").alias("place"), size.alias("size"), none, F.col("root").alias("name"), F.col("root").alias("changed"))
        done = upper.filter("size = 1").select("tree", "name")
        roots = done if roots is None else roots.union(done)
        nodes = upper.filter("size > 1")
        if nodes.isEmpty():
            return stages, roots


def _paths(levels: int):
    """Of blocks with the path above them, the path above each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _single(batch):
                names, depth = _split(row["names"]), min(levels, height(row["size"]))
                tree, n = build(names, depth), len(names)
                own = [[{"at": at, "others": _raw(others)} for at, others in siblings(tree, i, depth)] for i in range(n)]
                first = row["block"] * FAN**levels
                parts = [[row["tree"]] * n, list(range(first, first + n)), [row["subroot"]] * n, [row["root"]] * n, [o + row["path"] for o in own]]
                steps = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))
                kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), steps]
                yield pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], ["tree", "place", "subroot", "root", "path"])

    return run


def _manifest(levels: int):
    """Of blocks with the path above them, proof and version of each leaf.

    A version copies the ancestors within its block; above, it goes on along the block's path, whose nodes all versions share.
    """

    def rows(row: dict) -> Iterator[tuple]:
        names, changed, depth = _split(row["names"]), _split(row["changed"]), min(levels, height(row["size"]))
        tree, root, subroot = build(names, depth), row["root"].hex(), row["subroot"].hex()
        path = [(step["at"], _split(step["others"])) for step in row["path"]]
        shared = b"".join(b"".join(others) for _, others in path)
        for place, (doc_id, name, new) in enumerate(zip(row["ids"], names, changed, strict=True)):
            proof = sha256(b"".join(b"".join(others) for _, others in siblings(tree, place, depth)) + shared).hexdigest()
            version = replaced(tree, place, depth, new)
            copied = copies(version, place, depth)
            top = version.name
            for at, others in path:
                top = hashed([*others[:at], top, *others[at:]])
                copied.append(top)
            made = None if new == name else [c.decode() for c in copied]
            yield doc_id, name.decode(), subroot, root, proof, top.decode(), top.decode() == root, made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
        names = [c.split()[0] for c in _MANIFEST.split(", ")]
        for batch in batches:
            for row in _single(batch):
                columns = zip(*rows(row), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def descend(stages: Sequence[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The blocks of the first stage with subroot, root and path, from what is above each tree (tree, subroot, root, path)."""
    width, upper = FAN**levels, None
    for number, packed in reversed(list(enumerate(stages))):
        blocks = packed.select("tree", "block", "size", "ids", "names", "changed")
        rows = blocks.filter(F.col("size") <= width).join(above, "tree").select(*blocks.columns, "subroot", "root", "path")
        if upper is not None:
            inner = upper.withColumnRenamed("place", "block")
            rows = rows.union(blocks.filter(F.col("size") > width).join(inner, ["tree", "block"]).select(*rows.columns))
        if not number:
            return rows
        upper = stored(rows.mapInArrow(_paths(levels), f"tree string, place bigint, subroot binary, root binary, path {_PATH}"), "paths")
    raise ValueError("no stage")


def manifest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and copied for every row of ``documents``.

    A leaf names doc_id, source, lang, n_chars and text. Leaves of one lang in order of doc_id are a tree of runs of `FAN`;
    the roots of the trees in order of lang are the leaves of one more, whose root is ``root``. Every row for which a
    tampered copy exists (text in lower case) makes a version of the tree; ``copied`` are the nodes that the version does
    not share, from the parent of the leaf to the root, null where the leaf is the same. folded_root is the version's root.

    Null fields are told from empty ones, a null lang is a tree of its own, the first; a null doc_id comes first and is
    never tampered. Rows of one doc_id are ordered by leaf; repeated rows are leaves of their own. Texts are read whole,
    one at a time, and only their digests are sorted; very long ones cost memory for themselves alone. An empty table
    gives an empty table; other columns are ignored. Trees grow by blocks of FAN ** levels leaves, however many rows a
    lang has, and no task or driver holds more than a block and the path above it.
    """
    found = stored(leaves(documents), "leaves")
    placed = global_index(found, [F.col("tree").asc(), F.col("doc_id").asc_nulls_first(), F.col("name").asc(), F.col("changed").asc()])
    starts = stored(placed.groupBy("tree").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("size")), "starts")
    nodes = lookup_join(placed, starts, ["tree"])
    nodes = nodes.select("tree", (F.col("idx") - F.col("start")).alias("place"), "size", F.col("doc_id").alias("id"), "name", "changed")
    stages, roots = grow(nodes, levels)

    ranked = stored(global_index(stored(roots, "subroots"), [F.col("tree").asc()], "place"), "ranked")
    size = ranked.agg(F.count(F.lit(1))).scalar()
    tops = ranked.select(F.lit("top").alias("tree"), "place", size.alias("size"), F.lit(None).cast("bigint").alias("id"), "name", F.col("name").alias("changed"))
    upper, root = grow(tops, levels)
    first = root.select("tree", F.col("name").alias("subroot"), F.col("name").alias("root"), F.array().cast(_PATH).alias("path"))
    blocks = descend(upper, first, levels).mapInArrow(_paths(levels), f"tree string, place bigint, subroot binary, root binary, path {_PATH}")
    above = stored(ranked.join(blocks.select("place", "root", "path"), "place").select("tree", F.col("name").alias("subroot"), "root", "path"), "above")
    return descend(stages, above, levels).mapInArrow(_manifest(levels), _MANIFEST)


def versions(made: DataFrame) -> DataFrame:
    """The copied nodes of a stored `manifest` as rows: doc_id, level (from 1, the parent of the leaf) and name."""
    rows = made.filter(F.col("copied").isNotNull())
    return rows.select("doc_id", F.posexplode("copied").alias("_at", "name")).select("doc_id", (F.col("_at") + 1).alias("level"), "name")
