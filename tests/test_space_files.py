import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.sources import spaces
from textlens.sources.spaces import line_offsets, load_space_files, load_tokenizer_state, save_space_files


def test_offsets_for_any_cut(spark, tmp_path):
    for number, body in enumerate([b"a\nbb\n\nccc\n", b"a\nbb", b"\n", b"", "é\r\nlong line without end".encode()]):
        path = tmp_path / f"{number}.txt"
        path.write_bytes(body)
        starts = [0] + [i + 1 for i, c in enumerate(body) if c == 10]
        starts = [s for s in starts if s < len(body)]
        for parts in (1, 3, 30):
            *stretches, (_, _, lines) = line_offsets(spark, str(path), parts)
            assert lines == len(starts)
            assert [s[2] for s in stretches] == [sum(x < s[0] for x in starts) for s in stretches]


def test_space_files_by_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spaces, "STRETCH", 7)
    words = [random.Random(i).choice(["", "w", "naïve", "語" * 40]) + str(i) for i in range(100)] + [""]
    rng = np.random.default_rng(0)
    matrix = rng.random((len(words), 3), dtype=np.float32)
    rows = [(i, words[i], matrix[i].tolist()) for i in range(len(words))]
    random.Random(1).shuffle(rows)
    space = spark.createDataFrame(rows, "idx bigint, word string, vec array<float>")
    weights, names = str(tmp_path / "w.npy"), str(tmp_path / "w.txt")
    save_space_files(space, weights, names)
    assert np.array_equal(np.load(weights), matrix) and open(names, encoding="utf-8").read().split("\n") == [*words, ""]
    for parts in (1, 4, 64):
        got = load_space_files(spark, weights, names, parts).orderBy("idx").collect()
        assert [(r.idx, r.word, list(r.vec)) for r in got] == [(i, w, matrix[i].tolist()) for i, w in enumerate(words)]
    with open(names, "a", encoding="utf-8") as file:
        file.write("one too many")
    with pytest.raises(ValueError):
        load_space_files(spark, weights, names)
    for wrong in (space.filter("idx <> 3"), space.withColumn("word", F.lit("a\nb")), space.limit(0)):
        with pytest.raises(ValueError):
            save_space_files(wrong, str(tmp_path / "x.npy"), str(tmp_path / "x.txt"))


def test_state_in_pieces(spark, tmp_path):
    words = ['q"uote', "back\\slash", "語", "a,b]", *[f"w{i}" for i in range(20000)]]
    counter = {"rare": 1, **{w: i + 2 for i, w in enumerate(words)}}
    state = {"_note": {"x": [1, {"y": None}]}, "_counter": counter, "_words": words, "_sampling_table": [1 / (i + 1) for i in range(len(words))], "_size": 12}
    for number, style in enumerate([{}, {"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}]):
        path = tmp_path / f"{number}.json"
        path.write_text(json.dumps(state, **style), encoding="utf-8")
        vocab, counts = load_tokenizer_state(spark, str(path))
        assert {r.word: (r.idx, r.freq, r.sample_prob) for r in vocab.collect()} == {w: (i, i + 2, 1 / (i + 1)) for i, w in enumerate(words)}
        assert {r.word: (r.freq, int(r.first_seen)) for r in counts.collect()} == {w: (n, i) for i, (w, n) in enumerate(counter.items())}
    for broken in ('{"_words": ["a", ', '{"_words" ["a"]}', ""):
        reader = spaces._StateReader(io.StringIO(broken))
        with pytest.raises(ValueError):
            list(reader.fields())
