"""Skip-gram training data: subsampling, pairs, negative draws and the loss."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.functions.hashing import hash_int, hash_uniform
from textlens.functions.text import tokenize
from textlens.functions.vector import dot, interpolate, softplus
from textlens.operators.joins import BROADCAST_BYTES, lookup_join
from textlens.operators.ranking import global_index, running_total
from textlens.operators.vocab import UNKNOWN, coded_words
from textlens.session import materialise


def subsample(
    lines: DataFrame,
    vocab: DataFrame,
    seed: int,
    line: str = "line_id",
    max_bytes: int = BROADCAST_BYTES,
    prefix: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Index sequence per line without unknown words, each kept with its ``sample_prob``.

    The draw depends on the line and the position only. Lines that lose all words are left out. Up to ``max_bytes`` of
    the vocabulary are sent to the tasks; of a larger one, only words that are not among these leave their row. With ``prefix``, a column of
    text, words are looked up as its value, the character 31 and the word, so that groups of lines have vocabularies of
    their own. ``keep`` names columns of ``lines`` that stay.
    """
    words = tokenize(F.col("text"))
    if prefix is not None:
        words = F.transform(words, lambda word: F.concat_ws("\x1f", F.col(prefix), word))
    chances = vocab.withColumnRenamed("sample_prob", "chance")
    coded = coded_words(lines, words, chances, [line, *keep], max_bytes, idx=("bigint", UNKNOWN), chance=("double", -1.0))
    drawn = F.filter("_codes", lambda code, pos: hash_uniform(seed, F.col(line), pos) < code["chance"])
    # A generator of one row: the filter on its size stays above the draws, which are made once.
    kept = coded.select(line, *keep, F.explode(F.array(F.transform(drawn, lambda code: code["idx"]))).alias("seq"))
    return kept.filter(F.size("seq") > 0)


def _radius(window: int, seed: int | Column | None, line: str, pos: Column) -> Column:
    """The window, or with a seed a number in 1..window drawn by line and position."""
    if seed is None:
        return F.lit(window)
    return F.lit(window) - F.pmod(hash_int(seed, F.col(line), pos), F.lit(window)).cast("int")


def _neighbours(spots: DataFrame, window: int) -> DataFrame:
    """Meet every spot (``seq, pos, target, _radius``) with each word in reach at distance ``_step``.

    Two generators in a row compile into nested loops over the sequence, which is not copied.
    """
    steps = F.array(*[F.lit(step) for step in range(-window, window + 1) if step])
    other = F.col("pos") + F.col("_step")
    met = spots.withColumn("_step", F.explode(steps)).filter(
        (F.abs("_step") <= F.col("_radius")) & (other >= 0) & (other < F.size("seq"))
    )
    return met.withColumn("context_pos", other).withColumn("context", F.get("seq", other))


def skipgram_pairs(
    lines: DataFrame, window: int, line: str = "line_id", seed: int | Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Rows ``line, pos, context_pos, target, context`` in that order; made inside the row, without a shuffle.

    With a seed, which may be a column of ``keep``, the radius at each position is drawn from 1..window.
    """
    spots = lines.select(line, *keep, "seq", F.posexplode("seq").alias("pos", "target"))
    pairs = _neighbours(spots.withColumn("_radius", _radius(window, seed, line, F.col("pos"))), window)
    return pairs.select(line, *keep, "pos", "context_pos", "target", "context")


def line_progress(lines: DataFrame, line: str = "line_id") -> DataFrame:
    """Share of all lines before each line: ``line_no`` and ``progress`` in [0, 1)."""
    numbered = global_index(lines.select(line), [F.col(line).asc()], "line_no")
    total = numbered.agg(F.count(F.lit(1))).scalar()
    return numbered.withColumn("progress", F.col("line_no") / total)


def learning_rate(progress: Column, initial: float = 0.025, target: float = 1e-4) -> Column:
    return F.greatest(interpolate(initial, target, progress), F.lit(float(target)))


def training_pairs(
    lines: DataFrame, vocab: DataFrame, seed: int, window: int = 5, batch_size: int | None = None, line: str = "line_id"
) -> DataFrame:
    """Training pairs with ``progress`` and, for a batch size, their ``batch``; a last partial batch is dropped.

    Batches follow the order of lines. Pairs are numbered through the number of pairs per line, so the
    pairs themselves are never sorted.
    """
    kept = subsample(lines, vocab, seed, line).filter(F.size("seq") > 1)
    timed = kept.join(line_progress(lines, line), line)
    if batch_size is None:
        return skipgram_pairs(timed, window, line, seed, ["progress"])

    radii = F.transform("seq", lambda _, pos: _radius(window, seed, line, pos))
    ranged = materialise(timed.withColumn("_radii", radii).withColumn("_starts", _starts(F.col("_radii"))))
    sizes = ranged.select("line_no", F.element_at("_starts", -1).alias("_size"))
    whole = sizes.agg(F.floor(F.sum("_size") / batch_size) * batch_size).scalar()
    before = running_total(sizes, "line_no", "_size", "_before").drop("_size")
    spots = ranged.join(before, "line_no").select(
        line, "progress", "_before", "_starts", "_radii", "seq", F.posexplode("seq").alias("pos", "target")
    )
    spots = spots.withColumn("_radius", F.get("_radii", "pos"))
    spots = spots.withColumn("_first", F.col("_before") + F.get("_starts", "pos"))
    left = F.least("pos", "_radius")
    nth = F.when(F.col("_step") < 0, left + F.col("_step")).otherwise(left + F.col("_step") - 1)
    pairs = _neighbours(spots, window).withColumn("_no", F.col("_first") + nth).filter(F.col("_no") < whole)
    batch = F.floor(F.col("_no") / batch_size).cast("bigint")
    return pairs.select(line, "progress", batch.alias("batch"), "pos", "context_pos", "target", "context")


@F.arrow_udf(T.ArrayType(T.LongType()))
def _starts(radii: pa.Array) -> pa.Array:
    """Number of pairs before each position of a line, and at the end their total; all lines of a batch at once."""
    lengths = radii.value_lengths().to_numpy()
    ends = np.cumsum(lengths)
    first, last = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths) - 1
    radius, at = radii.flatten().to_numpy(), np.arange(lengths.sum())
    below = np.concatenate([[0], np.cumsum(np.minimum(at - first, radius) + np.minimum(last - at, radius))])
    cuts = np.concatenate([[0], np.cumsum(lengths + 1)])
    place = np.arange(cuts[-1]) - np.repeat(np.arange(len(lengths)), lengths + 1)
    counts = below[place] - np.repeat(below[ends - lengths], lengths + 1)
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(counts, pa.int64()))


def draw_by_interval(draws: DataFrame, intervals: DataFrame, u: str = "_u") -> DataFrame:
    """Join each draw in [0, 1) to the interval [``low``, ``high``) that holds it.

    The unit range is cut into about four cells per interval and the join runs on the cell, so a draw
    meets 1.25 intervals on average and draws spread evenly over the keys.
    """
    cells = 4 * max(1, intervals.count())
    first, last = F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))
    spans = intervals.withColumn("_cell", F.explode(F.sequence(F.least(first, F.lit(cells - 1)), last)))
    placed = draws.withColumn("_cell", F.floor(F.col(u) * cells))
    inside = (F.col(u) >= F.col("low")) & (F.col(u) < F.col("high"))
    return placed.join(spans, "_cell").filter(inside).drop("_cell")


def negative_samples(
    pairs: DataFrame,
    distribution: DataFrame,
    count: int,
    seed: int,
    keys: Sequence[str],
    exclude_context: bool = False,
) -> DataFrame:
    """``count`` words per pair by the noise distribution: adds ``draw`` (0-based) and ``negative``.

    With ``exclude_context`` the true context's interval is cut out of the range before drawing, which
    gives the conditional distribution exactly, without rejected draws.
    """
    intervals = materialise(distribution.select(F.col("idx").alias("negative"), "low", "high"))
    draws = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    u = hash_uniform(seed, *[F.col(key) for key in keys], F.col("draw"))
    if not exclude_context:
        return draw_by_interval(draws.withColumn("_u", u), intervals).drop("_u", "low", "high")
    own = intervals.select(
        F.col("negative").alias("context"), F.col("low").alias("_from"), (F.col("high") - F.col("low")).alias("_width")
    )
    located = lookup_join(draws, own, ["context"]).withColumn("_u", u * (F.lit(1.0) - F.col("_width")))
    skipped = F.when(F.col("_u") >= F.col("_from"), F.col("_u") + F.col("_width")).otherwise(F.col("_u"))
    return draw_by_interval(located.withColumn("_u", skipped), intervals).drop("_u", "_from", "_width", "low", "high")


def sgns_loss(pairs: DataFrame, negatives: DataFrame, weights: DataFrame, keys: Sequence[str], bias: bool = True) -> DataFrame:
    """Loss of every true pair and every negative draw.

    ``weights`` holds ``idx, proj, out, bias``. Rows: the keys, ``target``, ``word`` (context or negative),
    ``label`` and ``loss``.
    """
    true = pairs.select(*keys, "target", F.col("context").alias("word"), F.lit(1).alias("label"))
    false = negatives.select(*keys, "target", F.col("negative").alias("word"), F.lit(0).alias("label"))
    inputs = weights.select(F.col("idx").alias("target"), "proj")
    outputs = weights.select(F.col("idx").alias("word"), "out", "bias")
    joined = lookup_join(lookup_join(true.unionByName(false), inputs, ["target"]), outputs, ["word"])
    logit = dot(F.col("proj"), F.col("out")) + (F.col("bias") if bias else F.lit(0.0))
    loss = softplus(F.when(F.col("label") == 1, -logit).otherwise(logit))
    return joined.select(*keys, "target", "word", "label", loss.alias("loss"))


def loss_log(steps: DataFrame, every: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean ``loss`` and last ``learning_rate`` per window of ``every`` steps of ``step, loss, learning_rate``, within
    each group of ``by``."""
    return steps.groupBy(*by, F.floor(F.col("step") / every).cast("bigint").alias("log_window")).agg(
        F.avg("loss").alias("average_loss"), F.max_by("learning_rate", "step").alias("learning_rate")
    )
