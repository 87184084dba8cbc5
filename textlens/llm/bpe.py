"""BPE encoding and decoding of whole texts; long unsplit text is encoded in parts that are joined exactly."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textlens.llm.common import map_columns, process_cache

#: Characters of a part of unsplit text, and tokens on each side of a join in the first window.
LEAF, WINDOW = 512, 4
#: Words whose tokens a Python worker remembers before it forgets those not seen since the last time; results do not depend on it.
MEMO = 100_000
#: Letters that lower-casing and composition treat one by one.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
LETTERS = re.compile(f"[{LATIN}]+")
#: What lies between spaces and line ends; and the same, cut also between such letters and the ASCII mark after them, where
#: the tokenizer always splits (outside of special tokens).
WORDS = re.compile(r"[^ \n]+")
PIECES = re.compile(rf"[{LATIN}]++(?=[ \n!-/:-@\[-`{{-~]|\Z)|[^ \n]+")


class Codec:
    """Encodes as the tokenizer at ``path`` does without added special tokens, and decodes by joining its pieces.

    Text falls apart at spaces and line ends, which the tokenizer drops and no piece, mark or special token crosses; such a
    word is encoded once and remembered. In a word of over `LEAF` characters any run that the tokenizer does not split
    goes by `unsplit`.
    """

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        self.leaf = leaf
        self.path = path
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.suffix = self.whole.model.end_of_word_suffix or ""
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.names = {i: piece for piece, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.known: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.earlier: tuple[dict[str, bytes], dict[str, str]] = ({}, {})

    @cached_property
    def bare(self) -> tuple[Tokenizer, Tokenizer]:
        """The merges alone, for the end of a word and for parts before it; loaded only where a text needs them."""
        with open(self.path, encoding="utf-8") as file:
            spec = json.load(file)
        alone = {**spec, "normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None}
        inner = {**alone, "model": {**spec["model"], "end_of_word_suffix": None}}
        return Tokenizer.from_str(json.dumps(alone)), Tokenizer.from_str(json.dumps(inner))

    def ids(self, word: str) -> list[int]:
        """Token ids of a text without spaces and line ends."""
        if len(word) <= self.leaf:
            return self.whole.encode(word, add_special_tokens=False).ids
        out, at = [], 0
        for match in self.special.finditer(word) if self.special else ():
            out += [*self.plain(word[at : match.start()]), self.whole.token_to_id(match[0])]
            at = match.end()
        return out + self.plain(word[at:])

    def plain(self, text: str) -> list[int]:
        norm = self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text
        runs = [piece for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(norm)]
        out: list[int] = []
        short: list[str] = []
        for run in [*runs, None]:
            if run is not None and len(run) <= self.leaf:
                short.append(run)
                continue
            out += [i for e in self.bare[0].encode_batch(short, add_special_tokens=False) for i in e.ids]
            short = []
            if run is not None:
                out += self.unsplit(run)
        return out

    def unsplit(self, run: str) -> list[int]:
        """Tokens of one run of the tokenizer's byte characters: its parts are encoded side by side, then joined by twos."""
        parts = [run[i : i + self.leaf] for i in range(0, len(run), self.leaf)]
        pieces = [e.ids for e in self.bare[1].encode_batch(parts[:-1], add_special_tokens=False)]
        pieces.append(self.bare[0].encode(parts[-1], add_special_tokens=False).ids)
        while len(pieces) > 1:
            ends = [i + 2 >= len(pieces) for i in range(0, len(pieces), 2)]
            pieces = [self.joined(pieces[i], pieces[i + 1], end) if i + 1 < len(pieces) else pieces[i] for i, end in zip(range(0, len(pieces), 2), ends, strict=True)]
        return pieces[0]

    def joined(self, left: list[int], right: list[int], end: bool) -> list[int]:
        """Tokens of the text of ``left`` and ``right`` together; ``end``: the word ends with it.

        The text of the last tokens of one and the first of the other is encoded again. If its first token is what ``left``
        had there and its last what ``right`` had, then all neighbouring tokens of the result are neighbours in some
        encoding, which makes the result the encoding of the whole; otherwise the window doubles.
        """
        width = WINDOW
        while True:
            a, b = left[-width:], right[:width]
            closed = end and width >= len(right)
            text = "".join(self.names[i] for i in [*a, *b])
            if closed and self.suffix:
                text = text.removesuffix(self.suffix)
            new = self.bare[0 if closed else 1].encode(text, add_special_tokens=False).ids
            if (width >= len(left) or new[0] == a[0]) and (width >= len(right) or new[-1] == b[-1]):
                return left[:-width] + new + right[width:]
            width *= 2

    def word(self, word: str) -> tuple[bytes, str]:
        """Ids as little-endian numbers, and the decoded text, of a text without spaces and line ends."""
        if word.isascii() and word.isalpha() and word.islower() and len(word) <= self.leaf:
            ids = [token.id for token in self.whole.model.tokenize(word)]
        else:
            ids = self.ids(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])

    def learn(self, word: str) -> None:
        """Remembers what `word` gives; a word of upper and lower case shares it with its lower case."""
        if word in self.earlier[0]:
            self.known[word], self.shown[word] = self.earlier[0][word], self.earlier[1][word]
            return
        lower = word.lower() if LETTERS.fullmatch(word) else word
        if lower != word:
            if lower not in self.known:
                self.learn(lower)
            self.known[word], self.shown[word] = self.known[lower], self.shown[lower]
        else:
            self.known[word], self.shown[word] = self.word(word)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids of a text as little-endian numbers, and the text that decoding them gives."""
        text = text or ""
        words = (WORDS if self.special and self.special.search(text) else PIECES).findall(text)
        ids = list(map(self.known.get, words))
        new = {word for word, found in zip(words, ids, strict=True) if found is None} if None in ids else ()
        for word in new:
            self.learn(word)
        if new:
            ids = list(map(self.known.get, words))
        made = b"".join(ids), " ".join(filter(None, map(self.shown.get, words)))
        for word in new:
            if len(word) > 64:
                del self.known[word], self.shown[word]
        if len(self.known) > MEMO:
            self.earlier, self.known, self.shown = (self.known, self.shown), {}, {}
        return made


def load(path: str) -> Codec:
    cache = process_cache()
    if ("bpe", path) not in cache:
        cache["bpe", path] = Codec(path)
    return cache["bpe", path]


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit numbers) and decoded text of every row of ``documents``."""

    def make(part: dict[str, list]) -> dict[str, object]:
        made = [load(path).encode(text) for text in part["text"]]
        return {"doc_id": part["doc_id"], "ids": [m[0] for m in made], "decoded": [m[1] for m in made]}

    return map_columns(documents.select("doc_id", "text"), "doc_id bigint, ids binary, decoded string", make, rows=256)


def bpe(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``documents``.

    Null and empty texts have no tokens and decode to the empty text. Repeated rows are encoded each; an empty table gives
    an empty table; other columns are ignored. ``path`` is a tokenizer file present on every machine.
    """

    def make(part: dict[str, list]) -> dict[str, object]:
        made = [load(path).encode(text) for text in part["text"]]
        return {
            "doc_id": part["doc_id"],
            "n_tokens": [len(ids) // 4 for ids, _ in made],
            "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids, _ in made],
            "decoded_sha256": [hashlib.sha256(text.encode()).hexdigest() for _, text in made],
        }

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_columns(documents.select("doc_id", F.col("text")), schema, make, rows=256)
