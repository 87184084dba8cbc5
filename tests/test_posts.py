import bz2
import json
import os

import pytest
from pyspark.sql import functions as F

from textlens.operators.clean import clean_posts, clean_projection, language_filter, make_corpus, valid_posts
from textlens.sources import lines, posts


def raw(spark, *objects):
    rows = [(o if isinstance(o, str) else json.dumps(o), "f") for o in objects]
    return posts.parse_posts(spark.createDataFrame(rows, "value string, source_file string"))


def test_validity_is_about_keys(spark):
    found = raw(spark, {"id": 1}, {"id": 1, "text": None}, {"delete": None, "id": 1, "text": "a"}, "not json")
    assert [(r.id, r.text) for r in valid_posts(found, []).collect()] == [(1, None)]


def test_language(spark):
    found = raw(spark, {"id": 1, "text": "a", "lang": "en"}, {"id": 2, "text": "b"}, {"id": 3, "text": "c", "lang": "fr"})
    assert [r.id for r in valid_posts(found).collect()] == [1]
    assert language_filter(found, []).count() == 3


def test_null_and_zero_counts(spark):
    found = raw(spark, {"id": 1, "text": "a", "quote_count": 0, "reply_count": None, "retweet_count": 7, "place": {"x": 1}})
    row = clean_projection(valid_posts(found, [])).first()
    assert (row.quote_count, row.reply_count, row.retweet_count, row.truncated) == (None, None, 7, False)
    assert json.loads(str(row.place.toJson() if hasattr(row.place, "toJson") else row.place)) == {"x": 1}


def test_reposts(spark):
    original = {"id": 9, "text": "o", "lang": "fr"}
    found = raw(spark, {"id": 1, "text": "r", "lang": "en", "retweeted_status": original}, {"id": 2, "text": "p", "lang": "en"})
    assert [r.id for r in clean_posts(found).collect()] == [9, 2]
    kept = clean_posts(found, keep_reposts=True).collect()
    assert [(r.id, r.is_original) for r in kept] == [(9, True), (1, False), (2, False)]


def test_scan_both_layouts(spark, tmp_path):
    os.makedirs(tmp_path / "deep" / "er")
    objects = [{"id": i, "text": f"t{i}"} for i in range(4)]
    (tmp_path / "a.json.bz2").write_bytes(bz2.compress(json.dumps(objects[:2]).encode()))
    rows = "\n".join(json.dumps(o) for o in objects[2:]) + "\nbroken\n"
    (tmp_path / "deep" / "er" / "b.json.bz2").write_bytes(bz2.compress(rows.encode()))
    (tmp_path / "pretty.bz2").write_bytes(bz2.compress(json.dumps([{"id": 7, "text": "x"}], indent=2).encode()))
    assert sorted(r.id for r in posts.scan_posts(spark, str(tmp_path), "*.json.bz2").collect()) == [0, 1, 2, 3]
    whole = posts.scan_posts(spark, str(tmp_path), whole_files=True)
    assert sorted(r.id for r in whole.collect()) == [0, 1, 2, 3, 7]
    bad = posts.count_bad_rows(posts.read_text_files(spark, str(tmp_path), "*.json.bz2")).collect()
    assert sorted(r.bad_rows for r in bad) == [0, 1]


def test_dates_and_roundtrip(spark, tmp_path):
    found = raw(spark, {"id": 1, "text": "a", "lang": "en", "created_at": "Wed Jun 06 20:07:10 +0000 2018", "place": {"k": [1]}})
    dated = posts.with_bucket(clean_posts(found))
    row = dated.first()
    assert str(row.created_ts) == "2018-06-06 20:07:10" and str(row.bucket) == "2018-06-01"
    for form in ("parquet", "json"):
        path = str(tmp_path / form)
        posts.write_posts(dated, path, form=form)
        back = posts.scan_cleaned(spark, path, form).first()
        assert (back.id, back.text, str(back.bucket)) == (1, "a", "2018-06-01")


def test_bucket_from_path(spark):
    paths = ["/x/00001-2018_02_part", "/2011_01/00001-2019-12_p", "/data/none", "00002-2020_06_p3/"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [str(r[0]) for r in rows.select(lines.bucket_from_path(F.col("p"))).collect()]
    assert got == ["2018-02-01", "2019-12-01", "None", "2020-06-01"]


def test_labelled_folders_csv_and_survey(spark, tmp_path):
    for name, body in [("pro/1.txt", "yes\nindeed"), ("anti/1.txt", "no"), ("pro/2.txt", "aye")]:
        os.makedirs(tmp_path / "train" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "train" / name).write_text(body)
    got = lines.read_labelled_folders(spark, str(tmp_path / "train")).collect()
    assert sorted((r.text, r["class"], r.label) for r in got) == [("aye", "pro", 1), ("no", "anti", 0), ("yes\nindeed", "pro", 1)]
    (tmp_path / "t.csv").write_text('sentiment,message,tweetid\n-1,"a ""q"",\nb",5\n2,c,6\n')
    assert sorted(map(tuple, lines.read_labelled_csv(spark, str(tmp_path / "t.csv")).collect())) == [('a "q",\nb', -1), ("c", 2)]
    os.makedirs(tmp_path / "survey")
    (tmp_path / "survey" / "South Land.csv").write_text("year,prop\n2007,0.5\n2009,0.75\n")
    got = lines.read_survey(spark, str(tmp_path / "survey")).orderBy("year").collect()
    assert [tuple(r) for r in got] == [("South Land", 2007, 0.5), ("South Land", 2009, 0.75)]


def test_corpus_drops_truncated_and_null(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "a-b", True, "f"), (2, None, False, "f"), (3, " c ", None, "f")],
        "id int, text string, truncated boolean, source_file string",
    )
    assert [r.text for r in make_corpus(rows).collect()] == ["a_b", "c"]
    kept = make_corpus(rows, ignore_truncated=True)
    assert [r.text for r in kept.collect()] == ["c"]
    lines.write_lines(kept, str(tmp_path / "out"))
    assert [r.text for r in lines.read_lines(spark, [str(tmp_path / "out")]).collect()] == ["c"]


def test_labelled_folders_hold_one_whole_file_per_text(spark, tmp_path):
    texts = [("a", "c0"), ("a", "c0"), ("a", "c1"), ("", "c1"), ("ends\x00", "c0"), ("two\nlines ü", "x=y/z"), (None, "c0"), ("b", None)]
    written = tmp_path / "made"
    lines.write_labelled_folders(spark.createDataFrame(texts, "text string, class string").repartition(2), str(written))
    got = sorted((r.text, r["class"], r.label) for r in lines.read_labelled_folders(spark, str(written)).collect())
    assert [(t, label) for t, _, label in got] == [("", 1), ("a", 0), ("a", 0), ("a", 1), ("ends\x00", 0), ("two\nlines ü", 2)]
    # The files of tasks alone, without the drafts and checksums that a process each had to be started for.
    assert sorted(p.suffix for p in written.rglob("*") if p.is_file()) == [".txt"] * 6
    assert {p.name for p in written.iterdir()} == {"class=c0", "class=c1", "class=x%3Dy%2Fz"}
    with pytest.raises(FileExistsError):
        lines.write_labelled_folders(spark.createDataFrame(texts, "text string, class string"), str(written))


def test_labelled_folders_are_read_as_by_spark(spark, tmp_path):
    """Odd names, hidden files, empty files, bytes that are no text: tasks read what Spark's reader reads."""
    names = ["a b%/x.txt", "class=ä +%41;=@/1.txt", "deep/er/class=q/2.txt", "_hid/3.txt", "_kept=1/4.txt", ".dot/5.txt", "r.txt", "p/_6.txt", "p/.7.txt", "p/8.csv", "p/9.txt._COPYING_", "p/new\nline.txt", "n\u00a0b\u2028/1.txt"]
    bodies = [b"one", b"two\x00", b"\xef\xbb\xbfthree\x00\x00", b"4", b"five\r\n", b"6", b"\xff\xfe\x80", b"8", b"9", b"10", b"11", b"a\x00\n", b"\x00"]
    for name, body in zip(names, bodies, strict=True):
        os.makedirs(tmp_path / "top" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "top" / name).write_bytes(body)
    (tmp_path / "top" / "deep" / "empty.txt").write_bytes(b"")
    path = str(tmp_path / "top")

    def rows(frame):
        return sorted((bytes(r.b), r["class"], r.label) for r in frame.select(F.col("text").cast("binary").alias("b"), "class", "label").collect())

    expected = rows(lines.label_by_name(lines._class_of(lines._read_files(spark, path))))
    assert rows(lines.read_labelled_folders(spark, path)) == expected and len(expected) == 7
    assert rows(lines.read_labelled_folders(spark, f"{path}/*/er")) == rows(lines.label_by_name(lines._class_of(lines._read_files(spark, f"{path}/*/er"))))
    os.makedirs(tmp_path / "none")
    assert lines.read_labelled_folders(spark, str(tmp_path / "none")).count() == 0


def test_class_names_cost_no_second_reading(spark, tmp_path, monkeypatch):
    """Spark's reader starts anew for each file, and read all of them a second time for the names of classes."""
    lines.write_labelled_folders(spark.range(40).selectExpr("cast(id as string) text", "concat('c', id % 3) class"), str(tmp_path / "made"))
    monkeypatch.setattr(lines, "_read_files", lambda *args: pytest.fail("Spark's reader was used"))
    monkeypatch.setattr(lines, "_read_named", lambda batches: pytest.fail("texts were read for class names"))
    read = lines.read_labelled_folders(spark, str(tmp_path / "made"))
    assert read.select("label").schema.simpleString() == "struct<label:int>"
    monkeypatch.undo()
    read = lines.read_labelled_folders(spark, str(tmp_path / "made"))
    assert sorted((int(r.text), r["class"], r.label) for r in read.collect()) == [(i, f"c{i % 3}", i % 3) for i in range(40)]
