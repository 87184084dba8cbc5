import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from textlens.llm import bpe
from tests.llm.data import given_and_odd, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_documents(spark):
    docs, tokenizer = given_and_odd(spark), library()
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        said = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert bpe.bpe(odd_documents(spark, empty=True), PATH).count() == 0


def test_unsplit_text_in_small_parts():
    """Long runs cut into short parts and joined give what the library gives for the whole."""
    codec, tokenizer, rng = bpe.Codec(PATH, leaf=9), library(), random.Random(4)
    alphabets = ["ab", "etaoinshrdlu", "aeéèêñ", "the and ing er on".replace(" ", ""), "!?#.", "日本語", "\u0301a😀"]
    for trial in range(600):
        text = "".join(rng.choice(rng.choice(alphabets) if trial % 3 else alphabets[trial % len(alphabets)]) for _ in range(rng.randrange(1, 400)))
        assert codec.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids, text
    for text in ("a" * 1000, "ha" * 500, "supercalifragilistic" * 60, "x" * 7 + "<|endoftext|>" * 3 + "y" * 30, "don't'll" * 20, "9" * 50):
        assert codec.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_odd_characters():
    codec, tokenizer, rng = bpe.Codec(PATH), library(), random.Random(9)
    pool = [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "\u0301", "\u0338", "e", "E", "Å", "ﬀ", "İ", "ß", "Σ", "1", "½", "'", "s", "!", "<|endoftext|>", "\u1100", "\u1161", "😀", "\0", "\ud7a3"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        made, said = codec.encode(text)
        assert np.frombuffer(made, "<u4").tolist() == ids and said == tokenizer.decode(ids, skip_special_tokens=False), repr(text)


def test_pieces_of_words(monkeypatch):
    """Words cut between letters and marks, and words forgotten in between, give what the library gives for the text."""
    monkeypatch.setattr(bpe, "MEMO", 50)
    codec, tokenizer, rng = bpe.Codec(PATH), library(), random.Random(8)
    parts = [*"aAbÉéßÿÀ.,'!<|>/ſİΣςﬁ1²=ñÑ \n\t", "é", "'S", "'ll", "̸", "<|endoftext|>", "<|ENDOFTEXT|>", "y" * 70]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == (np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)), text
