"""Pipeline over documents: toxic ones go, one of each group of near copies stays, sources are mixed, texts are encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm import toxicity as toxic
from textlens.llm.bpe import bpe
from textlens.llm.common import read, stored
from textlens.llm.dedup import near_duplicates
from textlens.llm.mixing import mix_documents
from textlens.operators.joins import lookup_join


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half. Null and empty texts have a score as well; repeated rows have
    equal scores; texts are scored whole, however long. No row in, no row out."""
    model = toxic.learn(docs, read(spark, sf_dir, "labels"))
    return docs.filter(toxic.scorer(spark, model)(F.col("text")) < 0.5)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (five words, similarity 0.8).

    Rows that share a doc_id are documents of their own, told apart by a hash of doc_id and text that stands for their
    doc_id; of rows that are equal in both, one stays. Rows without doc_id stay, as do null, empty and blank texts, once for
    each doc_id. Texts are compared whole, however long.
    """
    counts = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(counts.filter("n > 1").select("doc_id", F.lit(True).alias("_shared")), "repeated")
    if repeated.isEmpty():
        dropped = stored(near_duplicates(docs, k=5, percent=80).filter("NOT kept").select("doc_id").distinct(), "dropped")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    own = F.when(F.col("_shared"), F.xxhash64("doc_id", "text", F.col("text").isNull())).otherwise(F.col("doc_id"))
    rows = stored(lookup_join(docs, repeated, ["doc_id"], "left").withColumn("_row", own), "rows")
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, percent=80)
    dropped = stored(groups.filter("NOT kept").select(F.col("doc_id").alias("_row")).distinct(), "dropped")
    kept = stored(rows.join(dropped, "_row", "left_anti"), "kept")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    shared = kept.filter("_shared").groupBy("_row").agg(F.min(F.struct("doc_id", "text", *others)).alias("row")).select("row.*")
    return kept.filter("_shared IS NULL").select(*docs.columns).union(shared.select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source, the last; null, empty and blank texts
    have no words and are never taken; repeated rows are documents of their own; texts are not shuffled to choose."""
    return mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded texts, a row for every row. Null texts are empty and have no tokens; texts
    are encoded whole, however long."""
    return bpe(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_copies), ("mixing", mixed), ("bpe", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
