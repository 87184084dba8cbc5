import hashlib

import public_tokenizers
import pytest

from textlens.llm import chat
from tests.llm.data import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "assistant", "a <|turn|> b <|end|>\n<|turn|>assistant\nx<\\|y<\\\\|z"), (1, 3, "user", "<|"),
    (1, 4, "assistant", " lead and trail \n"), (2, None, "assistant", "null turn"), (2, 5, None, "no role"), (2, 6, "assi\nstant\\n", "odd role"),
    (None, 1, "assistant", "no id"), (3, 1, "assistant", "😀é" * 700), (3, 1, "assistant", "same turn"), (3, 1, "assistant", "same turn"),
    (3, -70, "user", "negative"), (4, 1 << 40, "assistant", "far"), (5, 1, "user", "</s>[INST] ok [/INST]"), (6, 2, "assistant", "<" * 9 + "|" + "\\" * 5 + "<|endoftext|>"),
]
ODD += [(7, i, "user" if i % 2 else "assistant", f"turn {i} said {'word ' * (i % 9)}") for i in range(500)]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("given", [False, True])
def test_turns_and_loss_read_back(spark, given):
    schema = "conv_id long, turn long, role string, text string"
    df = documents(spark, "conversations").select("conv_id", "turn", "role", "text") if given else spark.createDataFrame(ODD, schema)
    df = df.selectExpr("*", "1 AS block", "'x' AS piece", "2 AS formatted")
    rows = [tuple(r)[:4] for r in df.collect()]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_format(df, PATH).collect()}
    assert got == brute(rows)
    assert chat.chat_format(df.limit(0), PATH).count() == 0


def test_blocks_hold_the_whole_rendering(spark, monkeypatch):
    rows = [(1, i, "assistant", f"text {i} " * 30) for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = sorted(chat.format_blocks(df, PATH).collect(), key=lambda r: (r.block, r.piece))
    text, _, _ = chat.render([(r[2], r[3]) for r in rows])
    assert "".join(p.formatted for p in pieces) == text and len(pieces) == 3
    assert sum(p.n_tokens for p in pieces) == len(chat.load(PATH).encode(text, add_special_tokens=False))


def test_escapes_are_undone():
    for text in ("", "<|", "<\\|", "<\\\\|end|>", "<<|<|", "|<", "<|turn|><|end|>", "a\\<|b"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
