import duckdb
import pandas as pd
import public_tokenizers
import pytest

from tests.llm.data import SF, odd_documents
from tests.llm.test_chat import ODD
from textlens.llm import chat, sql
from textlens.llm.dedup import near_duplicates
from textlens.llm.queries import ORACLES, QUERIES
from textlens.plans.check import difference, tables


@pytest.mark.parametrize("name", ["op1_minhash", "op4_chat"])
def test_given_tables(spark, name):
    assert difference(QUERIES[name](spark, SF).toPandas(), tables(SF).execute(ORACLES[name]).df()) is None


def test_odd_conversations(spark):
    frame = pd.DataFrame(ODD, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    expected = con.execute(sql.chat(chat.TURN, chat.END)).df().query("conv_id != -1")
    rows = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    got = chat.chat_format(rows, public_tokenizers.path("byte_bpe_50k.json")).drop("n_tokens", "n_loss_tokens")
    assert difference(got.filter("conv_id IS NOT NULL").toPandas(), expected[expected.conv_id.notna()].astype({"conv_id": "int64"})) is None


def test_odd_documents(spark):
    rows = odd_documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", rows.toPandas())
    assert difference(near_duplicates(rows, k=4).toPandas(), con.execute(sql.near_duplicates()).df()) is None
