import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlens.operators import ranking
from textlens.operators.joins import lookup_join, salted_lookup_join, table_bytes
from textlens.operators.sampling import sample_per_group, split_dataset
from textlens.operators.noise import alias_samples, alias_table
from textlens.operators.skipgram import negative_samples, sgns_loss, skipgram_pairs, subsample, training_pairs
from textlens.operators.vocab import (
    decode,
    encode,
    merge_counts,
    negative_distribution,
    ordered_word_counts,
    token_rows,
    vocabulary,
    word_frequency,
)
from textlens.plans import PLANS
from textlens.sources.spaces import load_space_files, load_tokenizer_state


def lines_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id bigint, text string")


def counts_of(spark, texts):
    return ordered_word_counts(token_rows(lines_of(spark, texts)))


words = st.lists(st.lists(st.sampled_from("a b c d e f".split()), max_size=8).map(" ".join), min_size=1, max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words, st.integers(0, 3), st.one_of(st.none(), st.integers(1, 4)))
def test_vocabulary_is_most_common(spark, texts, least, most):
    counter = Counter()
    for text in texts:
        counter.update(text.split())
    expected = [(w, n) for w, n in counter.most_common(most) if n >= least]
    got = vocabulary(counts_of(spark, texts), most, least).orderBy("idx").collect()
    assert [(r.word, r.freq) for r in got] == expected
    assert [r.idx for r in got] == list(range(len(expected)))


def test_keep_probability(spark):
    texts = ["a a a a a a a a a b"]
    got = {r.word: r.sample_prob for r in vocabulary(counts_of(spark, texts)).collect()}
    assert got["a"] == pytest.approx((np.sqrt(900) + 1) * (0.001 / 0.9))
    assert got["b"] == pytest.approx(0.11)


def test_counts_add_up(spark):
    both = merge_counts(counts_of(spark, ["x y x"]), counts_of(spark, ["y z"]))
    assert {r.word: r.freq for r in both.collect()} == {"x": 2, "y": 2, "z": 1}
    assert {r.word: r.freq for r in word_frequency(both, ["x", "q"]).collect()} == {"x": 2, "q": 0}


def test_encode_decode(spark):
    vocab = vocabulary(counts_of(spark, ["b a b"]))
    coded = encode(lines_of(spark, ["a q b b", "", "q"]), vocab).orderBy("line_id").collect()
    assert [list(r.seq) for r in coded] == [[1, -1, 0, 0], [], [-1]]
    codes = spark.createDataFrame([(i,) for i in (-1, 0, 1, 2)], "idx bigint")
    assert {r.idx: r.word for r in decode(codes, vocab).collect()} == {-1: None, 0: "b", 1: "a", 2: None}


def test_negative_distribution(spark):
    noise = negative_distribution(vocabulary(counts_of(spark, ["a " * 16 + "b"]))).orderBy("idx").collect()
    assert [r.p for r in noise] == pytest.approx([8 / 9, 1 / 9])
    assert (noise[0].low, noise[0].high) == (0.0, noise[1].low) and noise[1].high == 1.0


def test_negative_draws_follow_the_law(spark):
    vocab = vocabulary(counts_of(spark, ["a " * 16 + "b b b b c"]))
    noise = negative_distribution(vocab).cache()
    pairs = spark.range(4000).select("id", F.lit(0).cast("bigint").alias("context"))
    drawn = negative_samples(pairs, noise, 5, 1, ["id"])
    shares = {r.negative: r.n / 20000 for r in drawn.groupBy("negative").agg(F.count("*").alias("n")).collect()}
    for row in noise.collect():
        assert shares[row.idx] == pytest.approx(row.p, abs=0.02)
    others = negative_samples(pairs, noise, 5, 1, ["id"], exclude_context=True)
    assert others.count() == 20000 and others.filter("negative = 0").count() == 0


def test_pairs_in_order(spark):
    sequences = {0: [8, 1, 6, 6, 9, 2, 1], 1: [7], 2: [], 3: [4, 4]}
    rows = spark.createDataFrame(list(sequences.items()), "line_id int, seq array<int>")
    got = skipgram_pairs(rows, 3).orderBy("line_id", "pos", "context_pos").collect()
    expected = [
        (line, i, j, seq[i], seq[j])
        for line, seq in sequences.items()
        for i in range(len(seq))
        for j in range(max(0, i - 3), min(len(seq), i + 4))
        if i != j
    ]
    assert [tuple(r) for r in got] == expected


@pytest.mark.parametrize("name", ["encode", "subsample", "skipgram_pairs", "skipgram_dynamic"])
def test_text_chain_runs_once(spark, name):
    """Filters on sequences stay above the lookup of words and the draws, so neither is computed twice."""
    plan = PLANS[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("(?i)(https?") <= 2
    if name == "subsample":
        assert plan.count("md5(") == 1


def test_batches_are_whole(spark):
    texts = ["a b c d e f g"] * 20
    vocab = vocabulary(counts_of(spark, texts), threshold=10.0)
    pairs = training_pairs(lines_of(spark, texts), vocab, 3, window=3, batch_size=16)
    sizes = pairs.groupBy("batch").count().orderBy("batch").collect()
    assert [r.batch for r in sizes] == list(range(len(sizes))) and {r["count"] for r in sizes} == {16}
    loose = training_pairs(lines_of(spark, texts), vocab, 3, window=3)
    assert loose.count() // 16 == len(sizes)


def test_loss(spark):
    weights = spark.createDataFrame(
        [(0, [1.0, 2.0], [0.5, -1.0], 0.1), (1, [0.0, 1.0], [2.0, 1.0], -0.2)],
        "idx bigint, proj array<double>, out array<double>, bias double",
    )
    true = spark.createDataFrame([(5, 0, 1)], "k int, target bigint, context bigint")
    false = spark.createDataFrame([(5, 0, 0)], "k int, target bigint, negative bigint")
    got = {r.label: r.loss for r in sgns_loss(true, false, weights, ["k"]).collect()}
    assert got == pytest.approx({1: np.log1p(np.exp(-3.8)), 0: np.log1p(np.exp(-1.4))})


def test_salted_join_equals_plain_join(spark):
    # Key 0 holds a third of the rows, and some rows have no key.
    left = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 500).alias("key"))
    right = spark.range(0, 400, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        expected = sorted(map(str, left.join(right, ["key"], how).collect()))
        assert sorted(map(str, salted_lookup_join(left, right, ["key"], how).collect())) == expected, how
        assert sorted(map(str, lookup_join(left, right, ["key"], how, max_bytes=0).collect())) == expected, how


def test_running_total_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK", 10)
    rows = spark.range(95).select("id", (F.col("id") % 7).alias("v"))
    got = ranking.running_total(rows, "id", "v", "t").orderBy("id").collect()
    assert [r.t for r in got] == [0, *np.cumsum([i % 7 for i in range(95)])[:-1].tolist()]


@pytest.mark.parametrize(("proportion", "size"), [(0.25, None), (None, 7), (1.0, None), (0.0, None), (None, 5000)])
def test_samples_are_exact_and_stable(spark, proportion, size):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 > 0, (F.col("id") % 11).cast("string")).alias("g"))
    per_group = {r.g: r["count"] for r in rows.groupBy("g").count().collect()}
    chosen = sample_per_group(rows, "g", ["id"], 5, proportion=proportion, size=size)
    got = {r.g: r["count"] for r in chosen.groupBy("g").count().collect()}
    wanted = {g: int(n * proportion) if size is None else min(n, size) for g, n in per_group.items()}
    assert got == {g: n for g, n in wanted.items() if n}
    again = sample_per_group(rows.repartition(13), "g", ["id"], 5, proportion=proportion, size=size)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in chosen.collect())


def test_split_is_stable(spark):
    rows = spark.range(2000)
    parts = {r.part: r["count"] for r in split_dataset(rows, ["id"], 1, 0.2, 0.1).groupBy("part").count().collect()}
    assert sum(parts.values()) == 2000 and abs(parts["test"] - 200) < 60 and abs(parts["validation"] - 360) < 80


def test_load_saved_state(spark, tmp_path):
    state = {"_words": ["b", "a"], "_sampling_table": [0.5, 1.0], "_counter": {"a": 2, "b": 3, "rare": 1}, "_corpus_size": 5}
    (tmp_path / "tokenizer.json").write_text(json.dumps(state))
    vocab, counts = load_tokenizer_state(spark, str(tmp_path / "tokenizer.json"))
    assert sorted(map(tuple, vocab.collect())) == [("a", 1, 2, 1.0), ("b", 0, 3, 0.5)]
    assert {r.word: (r.freq, int(r.first_seen)) for r in counts.collect()} == {"a": (2, 0), "b": (3, 1), "rare": (1, 2)}
    matrix = np.arange(12, dtype=np.float32).reshape(6, 2)
    np.save(tmp_path / "w.npy", matrix)
    (tmp_path / "vocab.txt").write_text("".join(f"word{i}\n" for i in range(6)))
    got = load_space_files(spark, str(tmp_path / "w.npy"), str(tmp_path / "vocab.txt"), 4).orderBy("idx").collect()
    assert [(r.word, list(r.vec)) for r in got] == [(f"word{i}", matrix[i].tolist()) for i in range(6)]


def test_alias_table_gives_every_word_its_weight():
    rng = np.random.default_rng(3)
    cases = [[5], [1, 1, 1], [0, 4], [1, 1, 10], [7, 1, 1, 7], [3, 2, 3, 0, 0, 9]]
    cases += [rng.integers(1, 1000, n).tolist() for n in (2, 17, 400)] + [[int(1e12 / (i + 1)) for i in range(500)]]
    for weights in cases:
        keep, other = alias_table(weights)
        given = keep.copy()
        np.add.at(given, other, 1 - keep)
        assert given / len(weights) == pytest.approx(np.array(weights) / sum(weights), abs=1e-12)
        assert (keep >= 0).all() and (keep <= 1).all()


def test_alias_draws(spark):
    vocab = vocabulary(counts_of(spark, ["a " * 16 + "b b b b c"])).cache()
    pairs = spark.range(4000).select("id", F.lit(0).cast("bigint").alias("context"))
    drawn = alias_samples(pairs, vocab, 5, 1, ["id"])
    shares = {r.negative: r.n / 20000 for r in drawn.groupBy("negative").agg(F.count("*").alias("n")).collect()}
    for row in negative_distribution(vocab).collect():
        assert shares[row.idx] == pytest.approx(row.p, abs=0.02)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    others = alias_samples(pairs, vocab, 5, 1, ["id"], exclude_context=True).groupBy("negative").count().collect()
    counts = {r.negative: r["count"] for r in others}
    assert sum(counts.values()) == 20000 and set(counts) == {1, 2}
    assert counts[1] / 20000 == pytest.approx(4**0.75 / (4**0.75 + 1), abs=0.02)
    # The join takes over for a vocabulary over the bound, by the same law.
    joined = alias_samples(pairs, vocab, 5, 1, ["id"], max_bytes=0)
    assert joined.columns == drawn.columns and joined.count() == 20000


def test_alias_draws_at_the_edges(spark):
    one = vocabulary(counts_of(spark, ["a a"]))
    pairs = spark.createDataFrame([(None, 0), (1, 0), (1, None)], "id bigint, context bigint")
    assert [r.negative for r in alias_samples(pairs, one, 2, 1, ["id"]).collect()] == [0] * 6
    alone = alias_samples(pairs, one, 2, 1, ["id"], exclude_context=True).collect()
    assert sorted((r.context is None, r.negative) for r in alone if r.context is None) == [(True, 0)] * 2
    assert [r.negative for r in alone if r.context is not None] == [None] * 4
    assert alias_samples(pairs.limit(0), one, 2, 1, ["id"]).count() == 0
    with pytest.raises(ValueError):
        alias_samples(pairs, one.limit(0), 2, 1, ["id"])


@pytest.mark.parametrize("max_bytes", [0, 300])
def test_words_beyond_the_sent_ones_are_joined(spark, max_bytes):
    """The text is read once, into a stored table, and each word is coded as by the whole vocabulary."""
    rows = [(i, " ".join(f"w{(i * k) % 40}" for k in range(1, 30))) for i in range(60)] + [(90, None), (91, ""), (92, "new w1 new")]
    lines = spark.createDataFrame(rows, "line_id bigint, text string").withColumn("text", F.regexp_replace("text", "x+", ""))
    vocab = vocabulary(ordered_word_counts(token_rows(lines.filter("line_id < 92")))).cache()
    assert table_bytes(vocab.select("word", "idx")) > 2 * max_bytes
    coded = encode(lines, vocab, max_bytes=max_bytes)
    assert "regexp_replace" not in coded._jdf.queryExecution().optimizedPlan().toString()
    assert {r[0]: r[1] for r in coded.collect()} == {r[0]: r[1] for r in encode(lines, vocab).collect()}
    kept = [{r[0]: r[1] for r in subsample(lines, vocab, 5, max_bytes=most).collect()} for most in (max_bytes, 1 << 20)]
    assert kept[0] == kept[1] and len(kept[0]) > 30
