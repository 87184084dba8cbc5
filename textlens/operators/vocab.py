"""Word counts, the ranked vocabulary and the translation between words and indices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.text import tokenize
from textlens.operators.joins import BROADCAST_BYTES, bytes_of, lookup_join
from textlens.operators.ranking import global_index, running_total
from textlens.session import materialise

UNKNOWN = -1
POSITIONS = 2147483648  # positions in a line stay below 2 ** 31


def token_rows(lines: DataFrame, keep: Sequence[str] = ("line_id",), text: str = "text") -> DataFrame:
    """One row per word: the kept columns, ``pos`` and ``word``."""
    return lines.select(*keep, F.posexplode(tokenize(F.col(text))).alias("pos", "word"))


def corpus_union(*corpora: DataFrame) -> DataFrame:
    """Bag union of corpora with the same columns."""
    united = corpora[0]
    for corpus in corpora[1:]:
        united = united.unionByName(corpus)
    return united


def word_counts(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each word, within each group of ``by``."""
    return tokens.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("freq"))


def ordered_word_counts(tokens: DataFrame, line: str = "line_id", by: Sequence[str] = ()) -> DataFrame:
    """Word counts, within each group of ``by``, with ``first_seen``, one number that orders words by first appearance.

    A decimal, unlike a struct, can be a hash aggregation buffer, so the counts need no sort.
    """
    place = F.col(line).cast("decimal(20,0)") * F.lit(POSITIONS).cast("decimal(10,0)") + F.col("pos")
    return tokens.groupBy(*by, "word").agg(
        F.count(F.lit(1)).alias("freq"), F.min(place.cast("decimal(38,0)")).alias("first_seen")
    )


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Add further counts to earlier ones."""
    return corpus_union(*counts).groupBy("word").agg(
        F.sum("freq").alias("freq"), F.min("first_seen").alias("first_seen")
    )


def keep_probability(freq: Column, corpus_size: Column, threshold: float = 1e-3) -> Column:
    share = freq / corpus_size
    return F.least((F.sqrt(share / F.lit(threshold)) + 1) * (F.lit(threshold) / share), F.lit(1.0))


def vocabulary(
    counts: DataFrame, max_tokens: int | None = None, min_frequency: int = 0, threshold: float = 1e-3
) -> DataFrame:
    """Words by falling frequency, ties by first appearance: ``word, idx, freq, sample_prob``.

    Rare words sort last, so dropping them first leaves the same words as cutting at ``max_tokens`` first.
    """
    frequent = counts.filter(F.col("freq") >= min_frequency)
    ranked = global_index(frequent, [F.col("freq").desc(), F.col("first_seen").asc()])
    if max_tokens is not None:
        ranked = ranked.filter(F.col("idx") < max_tokens)
    corpus_size = ranked.agg(F.sum("freq")).scalar()
    return ranked.select("word", "idx", "freq", keep_probability(F.col("freq"), corpus_size, threshold).alias("sample_prob"))


def bucket_vocabulary(counts: DataFrame, bucket: str = "bucket", min_frequency: int = 0, threshold: float = 1e-3) -> DataFrame:
    """A vocabulary for each bucket: ``bucket, word, idx, freq, sample_prob``, and ``place``, which counts on through all.

    Words of a bucket are ranked as `vocabulary` does. Rows without a bucket are left out. All buckets are ranked in one
    sort, so one that holds most words is no hot spot.
    """
    frequent = counts.filter((F.col("freq") >= min_frequency) & F.col(bucket).isNotNull())
    placed = global_index(frequent, [F.col(bucket).asc(), F.col("freq").desc(), F.col("first_seen").asc()], "place")
    sizes = placed.groupBy(bucket).agg(F.min("place").alias("_start"), F.sum("freq").alias("_total"))
    joined = lookup_join(placed, sizes, [bucket])
    chance = keep_probability(F.col("freq"), F.col("_total"), threshold)
    return joined.select(bucket, "word", (F.col("place") - F.col("_start")).alias("idx"), "freq", chance.alias("sample_prob"), "place")


def corpus_size(vocab: DataFrame) -> DataFrame:
    """Number of words in the corpus that are in the vocabulary."""
    return vocab.agg(F.sum("freq").alias("corpus_size"))


def word_frequency(counts: DataFrame, words: Sequence[str]) -> DataFrame:
    """Count of each given word, 0 if it never occurs; words cut from a vocabulary still have one."""
    wanted = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias("word"))
    found = counts.filter(F.col("word").isin(*words)).select("word", "freq")
    return wanted.join(found, "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq"))


def top_words(counts: DataFrame, n: int | None = None) -> DataFrame:
    """The ``n`` most frequent words, or all."""
    ordered = counts.orderBy(F.col("freq").desc(), F.col("first_seen").asc())
    return ordered if n is None else ordered.limit(n)


def noise_weights(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """``idx, word, weight``: ``freq^power`` of each word with nine decimals."""
    return vocab.select("idx", "word", F.pow("freq", F.lit(power)).cast("decimal(28,9)").alias("weight"))


def negative_distribution(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """Probability ``freq^power / sum`` per word, with the interval [``low``, ``high``) it owns in [0, 1).

    Weights are summed as decimals, so neighbouring intervals meet exactly whatever the summation order.
    """
    weighted = noise_weights(vocab, power).withColumnRenamed("weight", "_weight")
    total = weighted.agg(F.sum("_weight")).scalar().cast("double")
    return running_total(weighted, "idx", "_weight", "_below").select(
        "idx",
        "word",
        (F.col("_weight").cast("double") / total).alias("p"),
        (F.col("_below").cast("double") / total).alias("low"),
        ((F.col("_below") + F.col("_weight")).cast("double") / total).alias("high"),
    )


def word_lookup(vocab: DataFrame, **values: tuple[str, object]) -> Callable[[Column], Column]:
    """A function from an array of words to the array of their ``values`` in ``vocab``, which is sent to all tasks.

    Each value is named with its kind and what an unknown word has; a single one is returned plain, several as structs.
    For vocabularies of a checked size only. Words are looked up in one vectorised call per batch. The function counts as
    non-deterministic, so that filters on its result stay above it: pushed below, they would compute the words again.
    """
    table = vocab.select("word", *[F.col(name).cast(kind) for name, (kind, _) in values.items()]).toArrow()
    shared = vocab.sparkSession.sparkContext.broadcast([column.combine_chunks() for column in table.columns])
    absent, names = [value for _, value in values.values()], list(values)

    def look_up(words: pa.Array) -> pa.Array:
        known, *columns = shared.value
        at = pc.index_in(words.flatten().cast(known.type), value_set=known)
        found = [column.take(at) for column in columns]
        found = [column if none is None else pc.fill_null(column, pa.scalar(none, column.type)) for column, none in zip(found, absent, strict=True)]
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), found[0] if len(found) == 1 else pa.StructArray.from_arrays(found, names))

    kinds = [kind for kind, _ in values.values()]
    element = kinds[0] if len(kinds) == 1 else f"struct<{', '.join(f'{n}: {k}' for n, k in zip(names, kinds, strict=True))}>"
    return F.arrow_udf(look_up, f"array<{element}>").asNondeterministic()


def _head(vocab: DataFrame, max_bytes: int) -> int | None:
    """The ``idx`` below which words take up to ``max_bytes`` together, or None if all of them do."""
    band = F.ceil(F.log2(F.col("idx") + 1)).cast("int").alias("_band")
    bands = sorted(vocab.groupBy(band).agg(bytes_of(vocab).alias("_bytes")).collect())
    held, cut = 0, 0
    for number, size in bands:
        held += size
        if held > max_bytes:
            return cut
        cut = 1 << number
    return None


def coded_words(
    lines: DataFrame, words: Column, vocab: DataFrame, keep: Sequence[str], max_bytes: int, **values: tuple[str, object]
) -> DataFrame:
    """The kept columns of each line and ``_codes``, the ``values`` of its ``words`` as `word_lookup` returns them.

    Words of the lowest indices, up to ``max_bytes`` of them, are sent to the tasks and looked up inside their row. If
    there are more, the text is read once, and only the words not found so are joined with the rest of the vocabulary.
    """
    vocab, single = vocab.select("word", *values), len(values) == 1
    cut = _head(vocab, max_bytes)
    if cut is None:
        return lines.select(*keep, word_lookup(vocab, **values)(words).alias("_codes"))
    numbered = lines.select(*keep, F.monotonically_increasing_id().alias("_row"), words.alias("_words"))
    if cut:
        open_ended = {name: (kind, None) for name, (kind, _) in values.items()}
        numbered = numbered.withColumn("_found", word_lookup(vocab.filter(F.col("idx") < cut), **open_ended)("_words"))
    else:
        numbered = numbered.withColumn("_found", F.lit(None).cast(f"array<{'bigint' if single else 'struct<idx: bigint>'}>"))

    def named(code: Column) -> list[Column]:
        return [code.alias(name) if single else code[name].alias(name) for name in values]

    def unknown(pos: Column) -> Column:
        code = F.get("_found", pos)
        return (code if single else code["idx"]).isNull()

    missing = F.filter(F.transform("_words", lambda word, pos: F.struct(pos.alias("pos"), word.alias("word"))), lambda at: unknown(at["pos"]))
    none = F.array().cast(f"array<struct<pos: int, {', '.join(f'{name}: {kind}' for name, (kind, _) in values.items())}>>")
    known = none
    if cut:
        placed = F.transform("_found", lambda code, pos: F.struct(pos.alias("pos"), *named(code)))
        known = F.filter(placed, lambda code: code["idx"].isNotNull())
    stored = materialise(numbered.select(*keep, "_row", known.alias("_known"), missing.alias("_missing")), "coded")
    asked = stored.select("_row", F.explode("_missing").alias("_at")).select("_row", "_at.*")
    met = lookup_join(asked, vocab.filter(F.col("idx") >= cut), ["word"], "left", max_bytes)
    filled = F.struct("pos", *[F.coalesce(F.col(name), F.lit(none)).cast(kind).alias(name) for name, (kind, none) in values.items()])
    patches = met.groupBy("_row").agg(F.collect_list(filled).alias("_rest"))
    whole = stored.drop("_missing").join(patches.hint("merge"), "_row", "left")
    codes = F.array_sort(F.concat("_known", F.coalesce("_rest", none)))
    return whole.select(*keep, F.transform(codes, lambda code: code["idx"] if single else F.struct(*[code[n].alias(n) for n in values])).alias("_codes"))


def encode(
    lines: DataFrame, vocab: DataFrame, line: str = "line_id", unknown: int = UNKNOWN, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Index sequence ``seq`` per line; words outside the vocabulary become ``unknown``.

    Up to ``max_bytes`` of the vocabulary are sent to the tasks and words are coded inside their row, without a shuffle;
    words of a larger one that are not among these are joined.
    """
    coded = coded_words(lines, tokenize(F.col("text")), vocab, [line], max_bytes, idx=("bigint", unknown))
    return coded.withColumnRenamed("_codes", "seq")


def decode(codes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Word of each ``idx``; null outside the vocabulary."""
    return lookup_join(codes, vocab.select("idx", "word"), ["idx"], "left")
