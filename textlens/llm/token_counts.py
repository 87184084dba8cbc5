"""Token counts: greedy longest-match word pieces, counted by an automaton that never builds the pieces."""

from __future__ import annotations

import base64
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import map_columns, process_cache

#: Words whose count is remembered by a Python worker before it forgets them all, and bytes of the longest of them; results
#: do not depend on it.
MEMO, MEMO_BYTES = 100_000, 64


class PieceCounter:
    """Number of pieces of a word under greedy longest match, in time linear in the word.

    ``heads`` are the pieces that may begin a word, ``tails`` those that may go on. Both are one trie, the tails below a
    root of their own. Where no edge goes on from a node, the failure link leads to the node of what remains after its
    longest pieces are taken off, and ``popped`` is how many those are. A word that cannot be cut into pieces counts 1,
    the unknown token.
    """

    def __init__(self, heads: set[bytes], tails: set[bytes]) -> None:
        self.edges: list[dict[int, int]] = [{}, {}]
        self.final = [False, False]
        for root, pieces in ((0, heads), (1, tails)):
            for piece in pieces:
                node = root
                for byte in piece:
                    following = self.edges[node].get(byte)
                    if following is None:
                        following = self.edges[node][byte] = len(self.edges)
                        self.edges.append({})
                        self.final.append(False)
                    node = following
                if piece:
                    self.final[node] = True
        size = len(self.edges)
        self.link, self.popped = [-1] * size, [0] * size
        waiting = deque((root, byte, child) for root in (0, 1) for byte, child in self.edges[root].items())
        while waiting:
            parent, byte, node = waiting.popleft()
            if self.final[node]:
                self.link[node], self.popped[node] = 1, 1
            else:
                at, count = self.link[parent], self.popped[parent]
                while at >= 0 and byte not in self.edges[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = self.edges[at][byte], count
            waiting.extend((node, b, child) for b, child in self.edges[node].items())

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node, total = 0, 0
        for byte in word:
            following = edges[node].get(byte)
            while following is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                following = edges[node].get(byte)
            node = following
        while node > 1:
            total += popped[node]
            node = link[node]
        return total if node == 1 else 1 if word else 0


class Memo(dict):
    def __init__(self, counter: PieceCounter) -> None:
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        n = self.counter.count(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces of a vocabulary of ranks (base64 and number by line): those with a leading space begin words, the rest go on."""
    with open(path, "rb") as file:
        pieces = {base64.b64decode(line.split()[0]) for line in file if line.strip()}
    heads = {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1 and p[1:].strip() == p[1:]}
    return heads, {p for p in pieces if p.strip() == p}


def load(path: str) -> Memo:
    cache = process_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = Memo(PieceCounter(*vocabulary(path)))
    return cache["pieces", path]


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens for every row: words are runs other than space and the characters 9 to 13, and each is
    cut greedily into the longest pieces of the vocabulary at ``path`` (a file on every machine).

    Null, empty and blank texts have 0 words and 0 tokens; a word that cannot be cut counts as one unknown token. Texts and
    words count whole, however long; of long words no count is remembered. Repeated rows count each; an empty table gives an empty table; other columns are ignored.
    """

    def make(part: dict[str, list]) -> dict[str, object]:
        counts = load(path)
        words = [(text or b"").split() for text in part["text"]]
        return {"doc_id": part["doc_id"], "n_words": [len(w) for w in words], "n_tokens": [sum(map(counts.__getitem__, w)) for w in words]}

    narrow = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_columns(narrow, "doc_id bigint, n_words bigint, n_tokens bigint", make, rows=256)
