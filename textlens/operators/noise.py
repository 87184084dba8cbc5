"""Noise words drawn inside the row from an alias table that is sent to all tasks."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.operators.joins import BROADCAST_BYTES, table_bytes
from textlens.operators.skipgram import negative_samples
from textlens.operators.vocab import negative_distribution, noise_weights

DIGITS = 12  # hexadecimal digits of each of the two numbers of a draw
SPAN = 16**DIGITS


def alias_table(weights: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of slot i: the share of it that word i keeps, and the word that has the rest.

    Slots of words below the mean weight are filled up in order by the words above it. Which word fills a slot follows from
    running totals of what is lacking and of what is over, in whole numbers, so the table gives every word its weight
    exactly but for the last rounding of a share.
    """
    n, total = len(weights), sum(weights)
    light = [i for i, w in enumerate(weights) if w * n < total]
    heavy = [i for i, w in enumerate(weights) if w * n >= total]
    lacking = list(accumulate(total - weights[i] * n for i in light))
    over = list(accumulate(weights[i] * n - total for i in heavy))
    keep, other = np.ones(n), np.arange(n)
    for i, before in zip(light, [0, *lacking], strict=False):
        keep[i], other[i] = weights[i] * n / total, heavy[bisect_left(over, before)]
    # A word above the mean that has filled more than it had over is filled up by the next one.
    for j, i in enumerate(heavy[:-1]):
        at = bisect_right(lacking, over[j])
        if at < len(lacking):
            keep[i], other[i] = (total - lacking[at] + over[j]) / total, heavy[j + 1]
    return keep, other


def _digest(key: str, attempt: int) -> tuple[int, int]:
    digest = hashlib.md5(f"{key}|{attempt}".encode(), usedforsecurity=False).hexdigest()
    return int(digest[:DIGITS], 16), int(digest[DIGITS : 2 * DIGITS], 16)


def alias_samples(
    pairs: DataFrame,
    vocab: DataFrame,
    count: int,
    seed: int,
    keys: Sequence[str],
    exclude_context: bool = False,
    power: float = 0.75,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``count`` words per pair by the noise distribution of ``vocab``: adds ``draw`` (0-based) and ``negative``.

    Up to ``max_bytes`` the alias table is sent to the tasks and each draw is two hashes and one look into it, without a
    shuffle; with a larger vocabulary draws meet their interval by a join (`negative_samples`), which draws other words by
    the same law. With ``exclude_context`` a draw that hits the pair's context is made again until it does not; a
    vocabulary of that word alone has no other, and its draws are null. An empty vocabulary is an error.
    """
    weighted = noise_weights(vocab, power).select("idx", "weight")
    if table_bytes(weighted) > max_bytes:
        return negative_samples(pairs, negative_distribution(vocab, power), count, seed, keys, exclude_context)
    rows = weighted.toArrow().sort_by("idx")
    ids = rows.column("idx").to_numpy()
    if not len(ids):
        raise ValueError("no noise can be drawn from an empty vocabulary")
    # The weights have nine decimals; as whole numbers their sums are exact.
    table = (ids, *alias_table([int(w.scaleb(9)) for w in rows.column("weight").to_pylist()]))
    shared = pairs.sparkSession.sparkContext.broadcast(table)

    def look_up(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        held, keep, other = shared.value
        slot = first % len(held)
        return held[np.where(second < keep[slot] * SPAN, slot, other[slot])]

    def draw(first: pa.Array, second: pa.Array) -> pa.Array:
        return pa.array(look_up(first.to_numpy(), second.to_numpy()), pa.int64())

    def draw_others(first: pa.Array, second: pa.Array, key: pa.Array, context: pa.Array) -> pa.Array:
        found = look_up(first.to_numpy(), second.to_numpy())
        avoid = context.fill_null(-1).to_numpy()
        held = shared.value[0]
        again = np.flatnonzero(found == avoid)
        if len(held) == 1:
            return pa.array(found, pa.int64(), mask=found == avoid)
        attempt = 0
        while len(again):
            attempt += 1
            numbers = np.array([_digest(key[i].as_py(), attempt) for i in again], np.int64)
            found[again] = look_up(numbers[:, 0], numbers[:, 1])
            again = again[found[again] == avoid[again]]
        return pa.array(found, pa.int64())

    draws = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    # Without a null key's place, keys (null, 1) and (1, null) would draw alike.
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys], F.col("draw").cast("string"))
    draws = draws.withColumn("_key", key).withColumn("_digest", F.md5(F.concat("_key", F.lit("|0"))))

    def number(place: int) -> Column:
        return F.conv(F.substring("_digest", place * DIGITS + 1, DIGITS), 16, 10).cast("bigint")

    if exclude_context:
        made = F.arrow_udf(draw_others, "bigint")(number(0), number(1), F.col("_key"), F.col("context").cast("bigint"))
    else:
        made = F.arrow_udf(draw, "bigint")(number(0), number(1))
    return draws.withColumn("negative", made).drop("_key", "_digest")
