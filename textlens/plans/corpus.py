"""Queries over text: the normalisation steps, tokens, word counts and the vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions import sql, text
from textlens.operators.clean import make_corpus
from textlens.operators.skipgram import line_progress
from textlens.operators.vocab import (
    corpus_size,
    corpus_union,
    decode,
    encode,
    merge_counts,
    negative_distribution,
    ordered_word_counts,
    token_rows,
    top_words,
    word_counts,
    word_frequency,
)
from textlens.plans import inputs
from textlens.plans.inputs import CAPPED_VOCAB, CORPUS, COUNTS, PHRASES, POSTS, SEED, TOKENS, VOCAB
from textlens.plans.registry import plan, rounded, rounded_sql, shown
from textlens.session import scratch_path
from textlens.sources.lines import read_lines, write_lines
from textlens.sources.spaces import load_vocabulary, save_vocabulary

_STEPS: dict[str, tuple[Callable[[Column], Column], Callable[[str], str]]] = {
    "tx_newlines": (text.replace_newlines, inputs.newlines_sql),
    "tx_ascii": (text.drop_non_ascii, inputs.ascii_sql),
    "tx_links": (text.drop_links, inputs.links_sql),
    "tx_phrases": (lambda t: text.join_phrases(t, PHRASES), inputs.phrases_sql),
    "tx_handles": (text.drop_handles, inputs.handles_sql),
    "tx_runs": (text.shorten_runs, inputs.runs_sql),
    "tx_contractions": (text.expand_contractions, inputs.contractions_sql),
    "tx_hyphen": (text.join_hyphens, inputs.hyphens_sql),
    "tx_strip": (text.strip, inputs.strip_sql),
    "tx_punctuation": (
        text.drop_punctuation,
        lambda t: f"translate({t}, {inputs.sql_text(text.PUNCTUATION)}, '')",
    ),
}


def _register_step(name: str, step: Callable[[Column], Column], step_sql: Callable[[str], str]) -> None:
    @plan(name, f"WITH {POSTS} SELECT id, {step_sql('text')} AS text FROM posts")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inputs.posts(spark, sf_dir).select("id", step(F.col("text")).alias("text"))


for _name, (_step, _step_sql) in _STEPS.items():
    _register_step(_name, _step, _step_sql)


@plan("corpus", f"WITH {CORPUS} SELECT line_id, bucket, text FROM corpus")
def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.corpus(spark, sf_dir).select("line_id", "bucket", "text")


@plan("corpus_scan", f"WITH {POSTS} SELECT id, bucket, text FROM posts WHERE text IS NOT NULL AND NOT truncated")
def _corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = dict.fromkeys(
        ["newlines", "non_ascii", "links", "handles", "runs", "contractions", "hyphens", "outer_spaces"], False
    )
    return make_corpus(inputs.posts(spark, sf_dir), ignore_truncated=True, **off).select("id", "bucket", "text")


@plan(
    "corpus_sample",
    f"""WITH {POSTS}, drawn AS (
    SELECT id, source_file, text, row_number() OVER (PARTITION BY source_file ORDER BY {inputs.hash_sql('id')}, id) AS nth,
           count(*) OVER (PARTITION BY source_file) AS n FROM posts),
    chosen AS (SELECT id, text FROM drawn WHERE nth <= floor(n * 0.5)),
    {inputs.normalise_sql('chosen', 'lines', 'id').replace(inputs.phrases_sql('text'), 'text')}
    SELECT id, text FROM lines""",
)
def _corpus_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_corpus(inputs.posts(spark, sf_dir), proportion=0.5, seed=SEED).select("id", "text")


@plan("read_lines", f"WITH {CORPUS} SELECT text, count(*) AS n FROM corpus GROUP BY text")
def _read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    write_lines(inputs.corpus(spark, sf_dir), path)
    return read_lines(spark, [path]).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@plan("tokenize", f"WITH {TOKENS} SELECT line_id, array_to_string(words, ' ') AS words, len(words) AS n FROM worded")
def _tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = inputs.corpus(spark, sf_dir).select("line_id", text.tokenize(F.col("text")).alias("words"))
    return words.select("line_id", F.array_join("words", " ").alias("words"), F.size("words").alias("n"))


@plan(
    "sql_functions",
    f"""WITH {POSTS}, plain AS (
    SELECT id, {inputs.strip_sql(inputs.hyphens_sql(inputs.handles_sql(inputs.links_sql(inputs.ascii_sql(inputs.newlines_sql('text'))))))} AS text
    FROM posts), runs AS (SELECT id, {inputs.runs_sql('text')} AS text FROM plain)
    SELECT id, array_to_string({inputs.tokens_sql('text')}, ' ') AS words FROM runs""",
)
def _sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    chain = "tl_runs(tl_strip(tl_hyphens(tl_handles(tl_links(tl_ascii(tl_newlines(text)))))))"
    return spark.sql(
        f"SELECT id, array_join(tl_tokens({chain}), ' ') AS words FROM {{posts}}", posts=inputs.posts(spark, sf_dir)
    )


@plan("word_count", f"WITH {COUNTS} SELECT word, freq FROM counts")
def _word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(inputs.tokens(spark, sf_dir))


@plan("first_seen", f"WITH {COUNTS} SELECT word, freq, first_seen // 1000000 AS line_id, first_seen % 1000000 AS pos FROM counts")
def _first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = inputs.counts(spark, sf_dir)
    line = F.floor(F.col("first_seen") / F.lit(2147483648)).cast("bigint")
    pos = (F.col("first_seen") % F.lit(2147483648)).cast("bigint")
    return seen.select("word", "freq", line.alias("line_id"), pos.alias("pos"))


@plan("vocabulary", f"WITH {CAPPED_VOCAB} SELECT word, idx, freq FROM vocab")
def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.capped_vocab(spark, sf_dir).select("word", "idx", "freq")


@plan("vocabulary_roundtrip", f"""WITH {VOCAB} SELECT c.word, c.freq, coalesce(CAST(v.idx AS VARCHAR), 'null') AS idx
FROM counts c LEFT JOIN vocab v ON v.word = c.word""")
def _vocabulary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vocabulary")
    save_vocabulary(inputs.vocab(spark, sf_dir), inputs.counts(spark, sf_dir), path)
    vocab, counts = load_vocabulary(spark, path)
    return counts.join(vocab.select("word", "idx"), "word", "left").select("word", "freq", shown("idx"))


@plan("sampling_table", f"WITH {VOCAB} SELECT idx, {rounded_sql('sample_prob', 9)} AS sample_prob FROM vocab")
def _sampling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.vocab(spark, sf_dir).select("idx", rounded(F.col("sample_prob"), 9).alias("sample_prob"))


@plan("corpus_size", f"WITH {VOCAB} SELECT CAST(sum(freq) AS BIGINT) AS corpus_size FROM vocab")
def _corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_size(inputs.vocab(spark, sf_dir))


NEGATIVES = (
    VOCAB
    + """,
weights AS MATERIALIZED (SELECT idx, word, CAST(pow(freq, 0.75) AS DECIMAL(28, 9)) AS w FROM vocab),
noise AS MATERIALIZED (
  SELECT idx, word, CAST(w AS DOUBLE) / total AS p,
         CAST(sum(w) OVER (ORDER BY idx) - w AS DOUBLE) / total AS low, CAST(sum(w) OVER (ORDER BY idx) AS DOUBLE) / total AS high
  FROM weights, (SELECT CAST(sum(w) AS DOUBLE) AS total FROM weights))"""
)


@plan(
    "negative_distribution",
    f"WITH {NEGATIVES} SELECT idx, word, {rounded_sql('p', 9)} AS p, {rounded_sql('low')} AS low, {rounded_sql('high')} AS high FROM noise",
)
def _negative_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = negative_distribution(inputs.vocab(spark, sf_dir))
    return noise.select(
        "idx", "word", rounded(F.col("p"), 9).alias("p"), rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high")
    )


_WORDS = ["the", "and", "climate_change", "change_denial", "#topic", "zzzz"]
_WORD_LIST = ", ".join(inputs.sql_text(word) for word in _WORDS)


@plan(
    "word_frequency",
    f"""WITH {COUNTS} SELECT w.word, coalesce(c.freq, 0) AS freq FROM (SELECT unnest([{_WORD_LIST}]) AS word) w
    LEFT JOIN counts c ON c.word = w.word""",
)
def _word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_frequency(inputs.counts(spark, sf_dir), _WORDS)


@plan("top_words", f"WITH {COUNTS} SELECT word, freq FROM counts ORDER BY freq DESC, first_seen LIMIT 50")
def _top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_words(inputs.counts(spark, sf_dir), 50).select("word", "freq")


def _benchmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.table(spark, sf_dir, "benchmark")
    return rows.select((F.col("item_id") + 1000000000).alias("line_id"), "text")


_UNITED = (
    TOKENS
    + f""",
more AS (SELECT item_id + 1000000000 AS line_id, {inputs.tokens_sql('text')} AS words FROM benchmark),
united AS (SELECT line_id, words FROM worded UNION ALL SELECT line_id, words FROM more)"""
)


@plan("corpus_union", f"WITH {_UNITED} SELECT line_id, len(words) AS n, array_to_string(words, ' ') AS words FROM united")
def _corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    united = corpus_union(inputs.corpus(spark, sf_dir).select("line_id", "text"), _benchmark_lines(spark, sf_dir))
    words = united.select("line_id", text.tokenize(F.col("text")).alias("words"))
    return words.select("line_id", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))


@plan("merge_counts", f"WITH {_UNITED} SELECT word, count(*) AS freq FROM (SELECT unnest(words) AS word FROM united) GROUP BY word")
def _merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = ordered_word_counts(token_rows(_benchmark_lines(spark, sf_dir)))
    return merge_counts(inputs.counts(spark, sf_dir), later).select("word", "freq")


ENCODED = VOCAB + """,
coded AS MATERIALIZED (SELECT t.line_id, t.pos, coalesce(v.idx, -1) AS idx FROM tokens t LEFT JOIN vocab v ON v.word = t.word)"""


_SEQUENCES = f"""WITH {ENCODED} SELECT w.line_id, coalesce(string_agg(CAST(c.idx AS VARCHAR), ' ' ORDER BY c.pos), '') AS seq
    FROM worded w LEFT JOIN coded c ON c.line_id = w.line_id GROUP BY w.line_id"""


@plan("encode_by_join", _SEQUENCES)
def _encode_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for a vocabulary too large to broadcast."""
    coded = encode(inputs.corpus(spark, sf_dir), inputs.vocab(spark, sf_dir), max_bytes=0)
    return coded.select("line_id", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))


@plan("encode", _SEQUENCES)
def _encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(inputs.corpus(spark, sf_dir), inputs.vocab(spark, sf_dir))
    return coded.select("line_id", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))


@plan(
    "decode",
    f"""WITH {VOCAB}, codes AS (SELECT doc_id, doc_id * 7 - 5 AS idx FROM documents)
    SELECT c.doc_id, c.idx, coalesce(v.word, 'null') AS word FROM codes c LEFT JOIN vocab v ON v.idx = c.idx""",
)
def _decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = inputs.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7 - 5).alias("idx"))
    return decode(codes, inputs.vocab(spark, sf_dir)).select("doc_id", "idx", shown("word"))


@plan(
    "progress",
    f"""WITH {CORPUS} SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS line_no,
    {rounded_sql('(row_number() OVER (ORDER BY line_id) - 1) / (SELECT count(*) FROM corpus)', 9)} AS progress FROM corpus""",
)
def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = line_progress(inputs.corpus(spark, sf_dir))
    return timed.select("line_id", "line_no", rounded(F.col("progress"), 9).alias("progress"))
