import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from textlens.functions.vector import interpolate
from textlens.operators import stance
from textlens.operators.skipgram import learning_rate
from textlens.operators.temporal import entity_trend, event_overlay, similarity_over_time, term_frequency
from textlens.plans import PLANS, analysis
from textlens.plans.check import difference, tables
from textlens.streaming import jobs


def test_stance_of_logits(spark):
    rows = spark.createDataFrame([([0.1, 2.0, -1.0, 0.3],), ([3.0, 3.0, 0.0, 0.0],)], "logits array<double>")
    got = stance.stance_from_logits(rows).collect()
    assert [(r["class"], r.stance) for r in got] == [(1, 0), (0, -1)]
    assert got[0].confidence == pytest.approx(0.880797, abs=1e-6)


def test_evaluate(spark):
    rows = spark.createDataFrame([([1.0, 2.0], 1), ([0.0, 0.0], 1)], "logits array<double>, label int")
    row = stance.evaluate(rows).first()
    assert row.loss == pytest.approx((math.log(1 + math.exp(-1)) + math.log(2)) / 2) and row.accuracy == 0.5


def test_sampled_classes_follow_the_distribution(spark):
    rows = spark.range(4000).select("id", F.array(F.lit(0.0), F.lit(math.log(3.0))).alias("logits"))
    share = stance.sample_class(rows, ["id"], 9).agg(F.avg("sampled")).first()[0]
    assert share == pytest.approx(0.75, abs=0.03)


def test_classifier_is_kept(spark, tmp_path):
    """Fitted to its tolerance or to the ceiling, which is told; saved where the user says; measured on unseen texts."""
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} w{i % 17}", i % 2) for i in range(300)]
    texts = spark.createDataFrame(rows, "id bigint, text string, label int")
    path = str(tmp_path / "model")
    found, measured = stance.train_and_evaluate(texts, ["id"], 3, path, features=256)
    assert found.converged and found.path == path and 0 < found.iterations < 200
    parts = {r["part"]: r for r in measured.collect()}
    assert set(parts) == {"train", "validation", "test"} and parts["test"]["accuracy"] == 1.0 and sum(r["texts"] for r in parts.values()) == 300
    kept = stance.classify(texts, stance.load_classifier(path)).orderBy("id").collect()
    assert kept == stance.classify(texts, found.model).orderBy("id").collect()
    cut = stance.train_classifier(texts, features=256, iterations=1)
    assert not cut.converged and cut.iterations == 1


def test_classifier_and_hook(spark):
    texts = [(i, "good fine great" if i % 2 else "bad awful poor", i % 2) for i in range(60)]
    rows = spark.createDataFrame(texts, "id int, text string, label int")
    model = stance.fit_classifier(rows, features=64, iterations=10)
    assert stance.evaluate(stance.classify(rows, model)).first().accuracy == 1.0

    def load():
        return lambda batch: [[0.0, float("good" in t)] for t in batch]

    hooked = stance.stance_from_logits(stance.classify_with(rows, load), [0, 1])
    assert hooked.filter("stance != label").count() == 0 or hooked.filter("label = 1 AND stance != 1").count() == 0


def test_stance_over_time_and_own_statistic(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("bucket"), F.lit("x").alias("text"))

    def score(texts):
        return texts.withColumn("logits", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)))

    got = stance.stance_over_time(rows, score, size=10).collect()
    assert len(got) == 3 and all(r.value == pytest.approx(1 / (1 + math.exp(-2))) for r in got)
    counted = stance.stance_over_time(rows, score, size=10, statistic=lambda s, p: F.count(s)).collect()
    assert {r.value for r in counted} == {10}
    shared = stance.stance_over_time(rows, score, proportion=0.5, statistic=lambda s, p: F.count(s)).collect()
    assert {r.value for r in shared} == {50}


def test_terms_are_absent_not_zero(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "bucket int, word string")
    got = term_frequency(rows, ["a"]).collect()
    assert [(r.bucket, r.mentions, r.proportion) for r in got] == [(1, 2, pytest.approx(2 / 3))]
    kept = term_frequency(rows, min_frequency=2).collect()
    assert [(r.bucket, r.word, r.proportion) for r in kept] == [(1, "a", 1.0)]


def test_similarity_over_time(spark):
    rows = [(1, "a", [1.0, 0.0]), (1, "b", [1.0, 1.0]), (2, "a", [1.0, 0.0])]
    spaces = spark.createDataFrame(rows, "bucket int, word string, vec array<double>")
    got = similarity_over_time(spaces, "a", "b").collect()
    assert [(r.bucket, r.similarity) for r in got] == [(1, pytest.approx(1 / math.sqrt(2)))]


def test_entity_trend(spark):
    rows = [("x", 2006, 0.4), ("x", 2018, 0.6), ("y", 2006, 0.5), ("y", 2010, 0.9), ("y", 2018, 0.45)]
    survey = spark.createDataFrame(rows, "entity string, year int, prop double")
    assert [(r.entity, r.change) for r in entity_trend(survey, 0.1).collect()] == [("x", pytest.approx(0.2))]
    assert entity_trend(survey).count() == 2


def test_event_overlay(spark):
    rows = [("s", dt.date(2019, m, 1), float(m)) for m in range(1, 7)]
    series = spark.createDataFrame(rows, "series string, bucket date, value double")
    days = [(dt.date(2019, 3, 15), "one"), (dt.date(2019, 5, 1), "two"), (dt.date(2019, 5, 20), "three")]
    events = spark.createDataFrame(days, "day date, event string")
    got = event_overlay(series, events, window=2).orderBy("bucket").collect()
    assert [r.event for r in got] == [None, None, "one", "one", "three", "three"]
    assert (got[2].mean_before, got[2].mean_after) == (1.5, 3.5) and (got[5].mean_before, got[5].mean_after) == (3.5, 5.5)


def test_learning_rate(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (2.0,)], "t double")
    assert [r[0] for r in rows.select(learning_rate(F.col("t"))).collect()] == pytest.approx([0.025, 0.01255, 1e-4])
    assert rows.select(interpolate(1, 3, F.col("t"))).collect()[1][0] == 2.0


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    for n in range(3):
        rows = [(f"a b{n}", dt.datetime(2018, 2, 1 + n, 9)) for _ in range(4)]
        spark.createDataFrame(rows, "text string, created_ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path))
    arriving = (
        spark.readStream.schema("text string, created_ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    )
    counted = jobs.run_available(jobs.running_word_counts(arriving), final=True)
    got = {(str(r.day), r.word): r.freq for r in counted.collect()}
    assert got == {(f"2018-02-0{n + 1}", w): 4 for n in range(3) for w in ("a", f"b{n}")}
    months = jobs.months_of(counted).collect()
    assert {(str(r.bucket), r.word): r.freq for r in months}[("2018-02-01", "a")] == 12
    closed = jobs.run_available(jobs.running_word_counts(arriving))
    assert {str(r.day) for r in closed.collect()} <= {"2018-02-01", "2018-02-02"}


def test_restarted_stream_of_many_files(spark, monkeypatch):
    """No file of a micro-batch grows with the input; the result stays that of four micro-batches."""
    sf_dir, files = "/root/testdata/sf0.001", []
    monkeypatch.setattr(analysis, "FILE_BYTES", 40_000)
    monkeypatch.setattr(analysis, "_part", lambda n, own=analysis._part: (files.append(n), own(n))[1])
    got = PLANS["stream_restarted"].run(spark, sf_dir).toPandas()
    assert files[-1] > 1
    assert difference(got, tables(sf_dir).execute(PLANS["stream_restarted"].sql).df()) is None


def test_a_classifier_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [(f"good fine {i}" if i % 2 else f"bad poor {i}", float(i % 2)) for i in range(40)]
    labelled = spark.createDataFrame(rows, "text string, label double").withColumn("text", seen.asNondeterministic()("text"))
    found = stance.train_classifier(labelled, features=64)
    assert read.value == 40
    scored = stance.classify(spark.createDataFrame([("good fine", 1), ("bad poor", 0)], "text string, label int"), found.model)
    assert [r[0] for r in stance.stance_from_logits(scored, (0, 1)).select("class").collect()] == [1, 0]
