"""Toxic text: a convolutional classifier over hashed words, trained in numpy, with a threshold for each language."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlens.llm.common import map_columns, process_cache, stored

#: Most labelled texts of each class that a fit sees, those of the smallest hashes: the one bounded sample here.
FIT_PER_CLASS = 3000
#: Most words of that sample, by 8 bytes a word in the driver; a text of more than the 64th part is not learnt from.
FIT_WORDS = 1 << 25
BUCKETS = 1 << 16
WIDTH, FILTERS, SPANS = 12, 12, (1, 2, 3)
PREFIX = 4
EPOCHS, BATCH, RATE = 5, 32, 0.05
BLOCK = 1 << 16
#: Words that a Python worker remembers before it forgets them all, and bytes of the longest of them.
MEMO, MEMO_BYTES = 100_000, 64
#: Bytes of a text cut into words at once, and bytes of texts scored at once.
PIECE = 1 << 20
#: Frequent words by which a text shows its language (fixed lists); a text without any is of the last group.
COMMON = {
    "en": "the and of to in is that with was for",
    "de": "der die und das ist nicht mit von zu den",
    "fr": "le les et des est une dans pour pas du",
    "es": "el los que y del las por con una en",
}
GROUPS = len(COMMON) + 1
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Words(dict):
    """Packed code of a word: bucket of the word, bucket of its first characters, language group."""

    def __init__(self) -> None:
        self.group = {}
        for i, words in enumerate(COMMON.values()):
            for word in words.split():
                self.group.setdefault(word.encode(), i)

    def __missing__(self, word: bytes) -> int:
        start = word.decode("utf-8", "replace")[:PREFIX].encode()
        whole, part = zlib.crc32(word) % (BUCKETS - 1) + 1, zlib.crc32(b"^" + start) % (BUCKETS - 1) + 1
        code = whole | part << 20 | self.group.get(word, GROUPS - 1) << 40
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = code
        return code


def encode(text: bytes | None) -> np.ndarray:
    """Packed codes of all words of a text."""
    cache = process_cache()
    if "toxicity_words" not in cache:
        cache["toxicity_words"] = Words()
    data, parts, at = (text or b"").translate(_TABLE), [np.empty(0, np.int64)], 0
    while at < len(data):
        stop = data.find(b" ", at + PIECE)
        stop = len(data) if stop < 0 else stop
        parts.append(np.fromiter(map(cache["toxicity_words"].__getitem__, data[at:stop].split()), np.int64))
        at = stop
    return np.concatenate(parts)


def language(codes: np.ndarray) -> int:
    """Group whose frequent words a text has most often, ties to the first; the last group if none."""
    counts = np.bincount(codes >> 40, minlength=GROUPS)[: GROUPS - 1]
    return int(counts.argmax()) if counts.any() else GROUPS - 1


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x WIDTH; row 0 is the padding and stays zero
    filters: list[np.ndarray]  # per span: span x WIDTH x FILTERS
    bias: np.ndarray  # spans x FILTERS
    weights: np.ndarray  # spans x FILTERS
    offset: float
    thresholds: np.ndarray  # one logit for each language group

    def features(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Highest response of every filter within each text; ``words`` (2 columns) are the texts one after another,
        each followed by padding, ``starts`` where they begin."""
        top = np.full((len(starts), len(SPANS), FILTERS), -np.inf, np.float32)
        n = len(words)
        ends = np.concatenate([starts[1:], [n]])
        reaching = np.zeros(n, bool)  # windows that would reach into the next text
        for j in range(1, SPANS[-1]):
            reaching[ends - j] = True
        for begin in range(0, n, BLOCK):
            stop = min(n, begin + BLOCK)
            reach = min(n, stop + SPANS[-1] - 1)
            x = self.table[words[begin:reach, 0]] + self.table[words[begin:reach, 1]]
            first = np.searchsorted(starts, begin, "right") - 1
            cuts = starts[first : np.searchsorted(starts, stop)]
            cuts = np.maximum(cuts - begin, 0)
            for i, span in enumerate(SPANS):
                z = x[: stop - begin] @ self.filters[i][0]
                for j in range(1, span):
                    part = x[j : stop - begin + j] @ self.filters[i][j]
                    z[: len(part)] += part
                z += self.bias[i]
                z[reaching[begin:stop]] = -np.inf
                best = np.maximum.reduceat(z, cuts, axis=0)
                np.maximum(top[first : first + len(cuts), i], best, out=top[first : first + len(cuts), i])
        return top

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        words, starts = lay_out(texts)
        return (self.features(words, starts) * self.weights).sum(axis=(1, 2)).astype(np.float64) + self.offset

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        own = self.thresholds[[language(t) for t in texts]]
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - own, -30, 30)))


def lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pairs of all texts one after another, each followed by padding, and where each begins.

    The first window of padding counts as one of the text, so that a text without words has responses too."""
    pad = np.zeros(SPANS[-1], np.int64)
    joined = np.concatenate([x for t in texts for x in (t, pad)])
    starts = np.cumsum([0, *[len(t) + len(pad) for t in texts[:-1]]])
    return np.stack([joined & 0xFFFFF, joined >> 20 & 0xFFFFF], axis=1), starts


def log_odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed log odds of label 1 given that a text holds a bucket: the first coordinate before training."""
    seen = np.zeros((2, BUCKETS))
    for text, label in zip(texts, labels, strict=True):
        seen[label, np.unique(np.concatenate([text & 0xFFFFF, text >> 20 & 0xFFFFF]))] += 1
    rate = (seen + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1)
    odds = np.where(seen.sum(axis=0) > 0, np.log(rate[1] / rate[0]), 0)
    odds[0] = 0
    return odds


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Train on encoded texts and their labels (0 or 1); the thresholds stay 0."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32)
    table[:, 0] = 0.25 * log_odds(texts, labels)
    table[0] = 0
    filters = [rng.normal(0, 0.3 / span, (span, WIDTH, FILTERS)).astype(np.float32) for span in SPANS]
    for kernel in filters:
        kernel[:, 0, 0] = 1.0 / len(kernel)
    model = Model(table, filters, np.zeros((len(SPANS), FILTERS), np.float32), rng.normal(0, 0.1, (len(SPANS), FILTERS)).astype(np.float32), -1.0, np.zeros(GROUPS))
    model.weights[:, 0] = 1.0
    past = {"table": np.full(BUCKETS, 1e-3, np.float32), "bias": 1e-3, "weights": 1e-3, "offset": 1e-3, **{i: 1e-3 for i in range(len(SPANS))}}

    def step(name: object, gradient: np.ndarray) -> np.ndarray:
        past[name] = past[name] + gradient * gradient
        return RATE * gradient / np.sqrt(past[name])

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            words, starts = lay_out([texts[i] for i in chosen])
            words = np.concatenate([words, np.zeros((SPANS[-1], 2), words.dtype)])
            ends = np.array([*starts[1:], len(words) - SPANS[-1]]) - (SPANS[-1] - 1)
            x = model.table[words[:, 0]] + model.table[words[:, 1]]
            tops, peaks = [], []
            for i, span in enumerate(SPANS):
                z = sum(x[j : len(words) - SPANS[-1] + j] @ model.filters[i][j] for j in range(span)) + model.bias[i]
                at = np.array([a + z[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
                peaks.append(at)
                tops.append(np.take_along_axis(z, at, axis=0))
            top = np.stack(tops, axis=1)
            logit = (top * model.weights).sum(axis=(1, 2)) + model.offset
            wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]) / len(chosen)
            down = wrong[:, None, None] * model.weights
            changes, ids = [], []
            for i, span in enumerate(SPANS):
                grown = np.zeros_like(model.filters[i])
                for j in range(span):
                    at = peaks[i] + j
                    grown[j] = np.einsum("bfd,bf->df", x[at], down[:, i])
                    back = down[:, i, :, None] * model.filters[i][j].T[None]
                    for column in (0, 1):
                        ids.append(words[at, column].ravel())
                        changes.append(back.reshape(-1, WIDTH))
                model.filters[i] -= step(i, grown)
            model.weights -= step("weights", (wrong[:, None, None] * top).sum(axis=0))
            model.bias -= step("bias", down.sum(axis=0))
            model.offset -= float(step("offset", wrong.sum()))
            rows, where = np.unique(np.concatenate(ids), return_inverse=True)
            change = np.zeros((len(rows), WIDTH), np.float32)
            np.add.at(change, where, np.concatenate(changes).astype(np.float32))
            past["table"][rows] += (change**2).mean(axis=1)
            change *= RATE / np.sqrt(past["table"][rows])[:, None]
            change[rows == 0] = 0
            model.table[rows] -= change
    return model


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """Cut of most right answers, each class counting alike; in the middle of the widest gap among equals."""
    order = np.argsort(logits)
    z, y = logits[order], labels[order]
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    gain = np.concatenate([[0], np.cumsum(np.where(y == 0, weight, -weight))])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gaps = np.diff(edges)
    at = max(np.flatnonzero(gain >= gain.max() - 1e-9), key=lambda i: gaps[i])
    return float((edges[at] + edges[at + 1]) / 2)


def calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray, least: int = 15) -> None:
    """Set the threshold of each language group on texts kept from training; a group with under ``least`` texts of
    either class takes the threshold of all."""
    if not len(texts) or len(set(labels.tolist())) < 2:
        return
    logits, groups = model.logits(texts), np.array([language(t) for t in texts])
    model.thresholds[:] = best_cut(logits, labels)
    for group in range(GROUPS):
        own = groups == group
        if np.bincount(labels[own], minlength=2).min() >= least:
            model.thresholds[group] = best_cut(logits[own], labels[own])


def learn(documents: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS, words: int = FIT_WORDS) -> Model:
    """A model from labelled documents whose crc32(doc_id) mod 5 is not 0: at most ``per_class`` of each class and ``words``
    words in all, those of the smallest hash of doc_id. Of these, remainder 1 sets the thresholds and the rest trains.
    Of rows that share a doc_id one is learnt from, and no text of more than the 64th part of ``words``.

    Labels other than 0 and 1, null ids and labels without a document do not count. Without any label the model scores
    every text alike, below one half.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").alias("y"), fold.alias("fold"))
    usable = usable.filter("fold <> 0")
    picked = None
    for label in (0, 1):
        some = usable.filter(F.col("y") == label).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    found = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")

    def make(part: dict[str, list]) -> dict[str, object]:
        return {"doc_id": part["doc_id"], "y": part["y"], "fold": part["fold"], "codes": [encode(t).tobytes() for t in part["text"]]}

    coded = map_columns(found.select("doc_id", "text", "y", "fold"), "doc_id bigint, y int, fold int, codes binary", make, rows=64)
    coded = coded.filter(F.octet_length("codes") <= 8 * words // 64).groupBy("doc_id", "y", "fold").agg(F.min("codes").alias("codes"))
    coded = stored(coded, "coded")
    # At most per_class rows of each class, so one window holds them.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "y").rowsBetween(Window.unboundedPreceding, 0)
    sizes = coded.select("doc_id", "y", F.sum(F.octet_length("codes")).over(order).alias("total")).filter(F.col("total") <= 8 * words)
    sample = coded.join(F.broadcast(sizes.select("doc_id", "y")), ["doc_id", "y"]).toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    texts = [np.frombuffer(b, np.int64) for b in sample["codes"].to_pylist()]
    ys, folds = np.array(sample["y"].to_pylist(), np.int64), np.array(sample["fold"].to_pylist(), np.int64)
    train, held = np.flatnonzero(folds != 1), np.flatnonzero(folds == 1)
    if not len(train):
        train = held
    model = fit([texts[i] for i in train], ys[train])
    calibrate(model, [texts[i] for i in held], ys[held])
    return model


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to its score; null and empty texts get that of no words."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        scores, codes, size = [], [], 0
        for text in texts:
            codes.append(encode(text.as_py()))
            size += 8 * len(codes[-1])
            if len(codes) == 256 or size >= PIECE:
                scores.extend(shared.value.scores(codes))
                codes, size = [], 0
        return pa.array([*scores, *shared.value.scores(codes)], pa.float64())

    score = F.arrow_udf(run, "double")
    return lambda text: score(text.cast("binary"))


def toxicity(documents: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) for every row of ``documents``.

    Only the text enters a score; its language is judged from its own frequent words. held_out marks rows whose crc32 of
    doc_id as text leaves 0 modulo 5, whose labels are never used; without doc_id it is false. Null and empty texts are
    scored as texts without words; texts are scored whole, however long. Repeated rows are scored each; an empty table gives
    an empty table.
    """
    model = learn(documents, labels, per_class)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scored = documents.select("doc_id", held.alias("held_out"), scorer(documents.sparkSession, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
