"""One query for each operator, over its whole table, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textlens.llm import sql
from textlens.llm.bpe import bpe
from textlens.llm.chat import END, TURN, chat_format
from textlens.llm.common import read
from textlens.llm.dedup import near_duplicates
from textlens.llm.licenses import license_scan
from textlens.llm.merkle import manifest
from textlens.llm.mixing import mixture
from textlens.llm.negatives import hard_negatives
from textlens.llm.neighbours import nearest
from textlens.llm.shards import shard
from textlens.llm.token_counts import token_counts
from textlens.llm.toxicity import toxicity
from textlens.llm.urls import url_filter
from textlens.llm.winnow import fingerprint_edits


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(
        [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string"
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat_format(rows, public_tokenizers.path("byte_bpe_50k.json")).drop("n_tokens", "n_loss_tokens")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents")).drop("copied")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash, op2_toxicity, op3_winnowing, op4_chat, op5_licenses, op6_urls, op7_tokens, op8_mixing, op9_neighbours, op10_bpe,
        op11_negatives, op12_shards, op13_merkle,
    )
}

ORACLES: dict[str, str] = {
    "op1_minhash": sql.near_duplicates(),
    "op4_chat": sql.chat(TURN, END),
    "op11_negatives": sql.NEGATIVES,
    "op13_merkle": sql.merkle(),
}
