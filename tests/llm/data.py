"""Small tables with every odd case, and the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, score double, unit long, copies long"


def documents(spark: SparkSession, name: str = "documents", sf: str = SF) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def odd_texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, blanks, long texts, repeated rows, near copies, other scripts."""
    long = " ".join(f"w{i * i % 977} x{i % 13}" for i in range(6000))
    near = " ".join(f"n{i}" for i in range(60))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", "b"), (4, "one", None), (5, "One two THREE", None), (6, "one two three", "a"),
        (7, near, "a"), (8, near.replace("n30", "zz"), "b"), (9, near.upper(), "b"), (10, near + " tail", "a"), (11, long, "c"),
        (12, long + " end", "c"), (None, near, "a"), (13, "under the MIT license. CC-BY nc cc by nc", "a"), (13, "under the MIT license. CC-BY nc cc by nc", "a"),
        (14, "é" * 5000, "é"), (15, "naïve Ünïcode 😀😀 ſtraße İstanbul ΣΑΣ", "\U0001f600"), (16, "abcdefghij" * 700, "b"), (17, "aaaa " * 50, "b"),
        (18, "<|endoftext|>x<|startoftext|>" + "y" * 900 + "<|endoftext|>", "b"), (19, "à b̧́ ́c  d e\x85f", "b"), (20, "1234567890" * 90, "b"),
    ]
    rows += [(100 + i, "same words again and again in this text", "hot") for i in range(40)]
    return rows


def odd_documents(spark: SparkSession, empty: bool = False) -> DataFrame:
    rows = [] if empty else [(i, t, "en", s, None if t is None else len(t), "k", "l", 0.5, 1, 2) for i, t, s in odd_texts()]
    return spark.createDataFrame(rows, DOCUMENTS)


def given_and_odd(spark: SparkSession) -> DataFrame:
    """The given documents with ids moved out of the way, and the odd ones."""
    rows = documents(spark).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", "'k' AS key", "'l' AS label", "0.5D AS score", "1L AS unit", "2L AS copies")
    return rows.union(odd_documents(spark))
