"""Manifests against a plain tree, and versions that share what they did not change."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.data import given_and_odd, odd_documents
from textlens.llm.merkle import build, copies, height, manifest, replaced, siblings, versions


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def lowered(text):
    return text and text.encode().lower().decode()


def climb(names):
    """Levels of a tree, from the leaves to the root."""
    levels = [names]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def walk(levels, place, name, proof):
    for level in levels[:-1]:
        start = place // 8 * 8
        run = level[start : start + 8]
        others = run[: place - start] + run[place - start + 1 :]
        proof += others
        name = H(*run[: place - start], name, *run[place - start + 1 :])
        place //= 8
    return name


def brute(rows):
    trees = {}
    for row in rows:
        own = leaf(row, row["text"])
        tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
        new = leaf(row, lowered(row["text"])) if tampered else own
        trees.setdefault(row["lang"], []).append(((row["doc_id"] is not None, row["doc_id"] or 0), own, new, row["doc_id"]))
    langs = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {lang: climb([r[1] for r in sorted(trees[lang])]) for lang in langs}
    top = climb([built[lang][-1][0] for lang in langs])
    out = []
    for number, lang in enumerate(langs):
        for place, (_, own, new, doc_id) in enumerate(sorted(trees[lang])):
            proof = []
            folded = walk(top, number, walk(built[lang], place, new, proof), proof)
            out.append((doc_id, own, built[lang][-1][0], top[-1][0], H(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def made(frame, levels):
    rows = manifest(frame, levels).drop("copied").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_documents(spark, levels):
    """Every height of blocks gives the same trees, those of one, a few and hundreds of leaves."""
    frame = given_and_odd(spark).withColumn("block", F.lit("b")).withColumn("size", F.lit("z")).withColumn("root", F.lit(0))
    lang = F.when(F.col("doc_id") == 1, F.lit(None)).when(F.col("doc_id") == 2, F.lit("")).when(F.col("doc_id") == 3, F.lit("é")).otherwise(F.col("lang"))
    frame = frame.withColumn("lang", lang).withColumn("n_chars", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")))
    frame = frame.union(frame.filter("doc_id % 10 = 0"))  # repeated rows
    rows = [r.asDict() for r in frame.collect()]
    assert made(frame, levels) == brute(rows)


def test_many_langs(spark):
    """More languages than a node has children."""
    frame = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 70).cast("string")).alias("lang"), F.lit("S").alias("source"), F.lit(3).alias("n_chars"), F.lit("Abc").alias("text"))
    assert made(frame, 1) == brute([r.asDict() for r in frame.collect()])


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_small(spark, n):
    frame = odd_documents(spark).filter("doc_id >= 100").orderBy("doc_id").limit(n)
    assert made(frame, 4) == brute([r.asDict() for r in frame.collect()])


def test_versions(spark):
    """A version that differs names each copied node once; tampering shows, unless the text has no capitals."""
    frame = given_and_odd(spark)
    whole = manifest(frame, 2).cache()
    sizes = {r["lang"]: r["count"] for r in frame.groupBy("lang").count().collect()}
    langs = {r["doc_id"]: r["lang"] for r in frame.select("doc_id", "lang").collect()}
    for r in whole.collect():
        assert (r["copied"] is None) == r["verified"] == (r["folded_root"] == r["root"])
        if r["copied"]:
            assert len(r["copied"]) == height(sizes[langs[r["doc_id"]]]) + height(len(sizes)) and r["copied"][-1] == r["folded_root"]
    rows = versions(whole)
    assert rows.count() == sum(len(r["copied"]) for r in whole.filter("copied IS NOT NULL").collect()) > 0


def test_nodes_are_shared():
    names = [H(str(i)).encode() for i in range(500)]
    tree = build(names, height(500))
    new = replaced(tree, 321, height(500), b"x" * 64)
    assert new.name != tree.name and build([*names[:321], b"x" * 64, *names[322:]], 3).name == new.name
    shared = sum(a is b for a, b in zip(tree.children, new.children))
    assert shared == len(tree.children) - 1 and len(copies(new, 321, 3)) == 3
    assert [len(o) for _, o in siblings(tree, 499, 3)] == [3, 6, 7]
