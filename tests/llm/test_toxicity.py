import numpy as np
from pyspark.sql import functions as F

from textlens.llm import toxicity
from tests.llm.data import documents, odd_documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = documents(spark, "labels", sf)
    got = toxicity.toxicity(documents(spark, "documents", sf), labels).filter("held_out").join(labels, "doc_id")
    table = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    right = [table.get((y, y), 0) / max(1, table.get((y, 0), 0) + table.get((y, 1), 0)) for y in (0, 1)]
    assert min(right) > 0.9, table


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = documents(spark), documents(spark, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b and len(a) == docs.count()


def test_odd_rows_and_no_labels(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == docs.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)
    one = spark.createDataFrame([(i, i % 2) for i in range(1, 18)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, one).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.toxicity(odd_documents(spark, empty=True), none).count() == 0


def test_features_in_blocks_equal_one_pass():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 900, n) | rng.integers(1, 900, n) << 20 for n in (0, 1, 2, 7, 500, 3)]
    model = toxicity.fit([t.astype(np.int64) for t in texts], np.array([0, 1, 0, 1, 0, 1]))
    whole = model.logits(texts)
    old, toxicity.BLOCK = toxicity.BLOCK, 16
    try:
        assert np.allclose(model.logits(texts), whole, atol=1e-5)
    finally:
        toxicity.BLOCK = old
    alone = np.concatenate([model.logits([t]) for t in texts])
    assert np.allclose(alone, whole, atol=1e-5)


def test_pieces_and_memory_change_no_code(monkeypatch):
    text = ("The %s end " % ("x" * 300) + " ".join(f"Wort{i % 700}é" for i in range(5000))).encode()
    toxicity.process_cache().pop("toxicity_words", None)
    whole = toxicity.encode(text)
    for piece, memo in ((1, 3), (50, 100), (7000, 10)):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        monkeypatch.setattr(toxicity, "MEMO", memo)
        toxicity.process_cache().pop("toxicity_words", None)
        assert (toxicity.encode(text) == whole).all()
        kept = toxicity.process_cache()["toxicity_words"]
        assert len(kept) <= memo and max(map(len, kept)) <= toxicity.MEMO_BYTES
    assert len(toxicity.encode(None)) == len(toxicity.encode(b" \n ")) == 0


def test_sample_is_bounded_in_words_and_one_row_an_id(spark):
    rows = [(i, "bad word " * (i % 9 + 1) if i % 2 else "good word " * 5) for i in range(1, 60)] + [(3, "good good"), (3, "bad"), (8, "w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    seen = []

    def fit(texts, labels, seed=7):
        seen.append(sum(map(len, texts)))
        return real(texts, labels, seed)

    real, toxicity.fit = toxicity.fit, fit
    try:
        for bound in (1 << 25, 6400, 200):
            assert len(toxicity.toxicity(docs, labels).collect()) == len(rows)
            toxicity.learn(docs, labels, words=bound)
            assert seen[-1] <= bound
    finally:
        toxicity.fit = real
    assert 0 < seen[-1] < seen[-3] <= seen[-5]
