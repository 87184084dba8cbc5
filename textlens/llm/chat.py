"""Chat formatting: whole conversations as one text, with a loss mask aligned to token offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer, processors

from textlens.llm.common import process_cache

TURN, END = "<|turn|>", "<|end|>"
#: Turns that are rendered and encoded together: those whose number has the same quotient by this.
BLOCK = 64
#: Characters after which a rendered piece is encoded, so that one turn number with very many rows is no large text.
PIECE = 1 << 20
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""Every ``<``, backslashes and ``|`` get one backslash more, so that no control string stands in the result."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(rows: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[bool]]:
    """Turns (role, text) as one text, where each escaped text lies in it, and whether it counts for the loss."""
    out, spans, learnt, at = [], [], [], 0
    for role, text in rows:
        name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
        said = escape(text)
        start = at + len(TURN) + len(name) + 1
        out.append(f"{TURN}{name}\n{said}{END}\n")
        spans.append((start, start + len(said)))
        learnt.append(role == "assistant")
        at += len(out[-1])
    return "".join(out), spans, learnt


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Turns of a rendered text: the inverse of `render`."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        head, _, said = piece.partition("\n")
        role = re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(head))
        turns.append((role, unescape(said[: said.rindex(END)])))
    return turns


def load(path: str) -> Tokenizer:
    """The tokenizer at ``path`` with the two control strings as special tokens and offsets that keep white space."""
    cache = process_cache()
    if ("chat", path) not in cache:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.add_special_tokens([TURN, END])
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        cache["chat", path] = tokenizer
    return cache["chat", path]


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of token spans inside turn spans, as (turn span, token, start, stop).

    Both are sorted, so for every turn span two binary searches give its first and last token; tokens that reach beyond
    a span are cut at it. Several tokens may cover one character (its bytes).
    """
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    counts = np.maximum(np.searchsorted(offsets[:, 0], spans[:, 1], "left") - first, 0)
    own = np.repeat(np.arange(len(spans)), counts)
    tokens = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[own]
    return own, tokens, np.maximum(offsets[tokens, 0], spans[own, 0]), np.minimum(offsets[tokens, 1], spans[own, 1])


def masked_text(formatted: str, encoding: Encoding, spans: list[tuple[int, int]], learnt: list[bool]) -> tuple[list[str], int]:
    """Texts under the loss mask, unescaped, one for each stretch of touching token parts, and the number of tokens."""
    chosen = np.array([s for s, yes in zip(spans, learnt, strict=True) if yes and s[1] > s[0]], np.int64).reshape(-1, 2)
    if not len(chosen):
        return [], 0
    own, tokens, starts, stops = loss_mask(np.array(encoding.offsets, np.int64).reshape(-1, 2), chosen)
    apart = np.flatnonzero((own[1:] != own[:-1]) | (starts[1:] > stops[:-1])) + 1
    begins, ends = np.concatenate([[0], apart]), np.concatenate([apart, [len(own)]]) - 1
    return [unescape(formatted[starts[a] : stops[b]]) for a, b in zip(begins, ends, strict=True)], len(np.unique(tokens))


def format_blocks(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Rendered pieces of all conversations with their loss texts, in order of (conv_id, block, piece).

    Rows of a conversation are ordered by turn (null first), then role and text. They are dealt out by conversation and
    block of turn numbers, so that a conversation with very many turns is encoded by many tasks; a cut between turns
    changes no token, as control strings are special tokens. Null texts and roles are empty.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("bigint").alias("block"),
    )
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    schema = "conv_id bigint, block bigint, piece int, formatted string, n_tokens bigint, n_loss_tokens bigint, loss_texts array<string>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)

        def finish(groups: list[tuple]) -> pa.RecordBatch:
            made = [(key, piece, *render(turns)) for key, piece, turns in groups]
            encodings = encoder.encode_batch([m[2] for m in made], add_special_tokens=False)
            out = []
            for (key, piece, text, spans, learnt), encoding in zip(made, encodings, strict=True):
                said, masked = masked_text(text, encoding, spans, learnt)
                out.append((*key, piece, text, len(encoding), masked, said))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

        ready, key, piece, turns, chars, total = [], None, 0, [], 0, 0
        for batch in batches:
            for conv, _, role, text, block in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if turns and ((conv, block) != key or chars > PIECE):
                    ready.append((key, piece, turns))
                    piece, turns, total, chars = piece + 1 if (conv, block) == key else 0, [], total + chars, 0
                    if total > PIECE or len(ready) >= 512:
                        yield finish(ready)
                        ready, total = [], 0
                if (conv, block) != key:
                    key, piece = (conv, block), 0
                turns.append((role, text))
                chars += len(text)
        if turns:
            ready.append((key, piece, turns))
        if ready:
            yield finish(ready)

    return rows.mapInArrow(run, schema)


def digests(blocks: DataFrame) -> DataFrame:
    """One row for each conversation from its rendered pieces, read in order without holding a conversation."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    rows = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, state = False, None, None
        for batch in batches:
            done = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                if not started or row[0] != conv:
                    if started:
                        done.append(close(conv, state))
                    started, conv, state = True, row[0], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in read_back(row[3]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in row[6]:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4:] = [state[4] + len(row[3]), state[5] + row[4], state[6] + row[5]]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)
        if started:
            last = close(conv, state)
            yield pa.RecordBatch.from_arrays([pa.array([last[i]], k) for i, k in enumerate(kinds)], names)

    def close(conv: int | None, state: list) -> tuple:
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:])

    return rows.mapInArrow(run, schema)


def chat_format(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of all formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_tokens, n_loss_tokens, read back from the rendered text and its mask.

    Null texts and roles are empty; repeated rows are turns of their own; rows without conv_id are one conversation with
    a null id; an empty table gives an empty table; other columns are ignored.
    """
    return digests(format_blocks(conversations, tokenizer))
