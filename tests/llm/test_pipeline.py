from collections import Counter

import corpus_pipeline
from textlens.llm import toxicity
from tests.llm.data import SF, given_and_odd, odd_documents
from tests.llm.test_dedup import brute


def test_stages(spark):
    """Every stage on odd and given rows: same columns, whole rows, decisions that take effect."""
    docs = given_and_odd(spark)
    rows = Counter(tuple(r) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        kept = Counter(tuple(r) for r in after.collect())
        assert set(kept) <= set(rows), name
        if name != "mixing":
            assert not kept - rows
        empty = stage(spark, odd_documents(spark, empty=True), SF)
        assert empty.columns == docs.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_one_of_each_group_stays(spark):
    docs = given_and_odd(spark)
    after = corpus_pipeline.without_copies(spark, docs, SF).collect()
    labels = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if i is not None}
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(set(labels.values()))
    assert sum(r.doc_id is None for r in after) == 1


def test_rows_of_one_id_are_documents_of_their_own(spark):
    a, b, c, d = (" ".join(f"{name}{i}" for i in range(40)) for name in "abcd")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, d), (7, d), (8, None), (8, ""), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.without_copies(spark, docs, SF).collect()]
    assert Counter(t for i, t in kept if i is not None) == Counter([a, b, c, d, None, ""]) and (None, c) in kept
    assert set(kept) <= set(rows)
    # A third of all rows under one id.
    many = [(1 if i % 3 == 0 else i, " ".join(f"t{i // 2 * 7 + j}" for j in range(7))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in many], docs.schema)
    after = corpus_pipeline.without_copies(spark, docs, SF)
    assert after.count() == after.select("text").distinct().count() == len({t for _, t in many})


def test_toxic_documents_go(spark):
    docs = given_and_odd(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    after = Counter(r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, SF).collect())
    assert set(after) == {i for i, p in scored.items() if not p}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids_sha256" in out.columns
