import bz2
import gzip
import json

import pytest
from pyspark.sql import Observation

from textlens.sources import archive, posts

POSTS = [{"id": i, "text": t} for i, t in enumerate(["a", "é😀" * 40, 'q"[]{},\\', "line\nend", "", "\u2028x\r\n", "z" * 300])]


def rows_of(text, size, monkeypatch):
    monkeypatch.setattr(archive, "BLOCK", size)

    class File:
        data = text.encode() if isinstance(text, str) else text

        def read(self, n):
            piece, self.data = self.data[:n], self.data[n:]
            return piece

    return list(archive.json_rows(archive.text_blocks(File())))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 16, 64, 1000])
def test_layouts_in_small_blocks(size, monkeypatch):
    for plain in (False, True):
        lines = [json.dumps(p, ensure_ascii=plain) for p in POSTS]
        for text in ("\n".join(lines), "\r\n".join(lines) + "\r\n", "\n\n" + "\n".join(lines)):
            assert [json.loads(r) for r in rows_of(text, size, monkeypatch) if r] == POSTS
        many = json.dumps(POSTS, ensure_ascii=plain, indent=2)
        for text in (f"[{','.join(lines)}]", many, f" \n{many}\n", "\ufeff" + many, "[\n" + ",\n".join(lines) + "\n]\n"):
            assert [json.loads(r) for r in rows_of(text, size, monkeypatch)] == POSTS
        assert [json.loads(r) for r in rows_of(f"{many}\n[]\n[{lines[0]}]", size, monkeypatch)] == [*POSTS, POSTS[0]]


@pytest.mark.parametrize("size", [1, 4, 9, 1000])
def test_broken_rows_stay_rows(size, monkeypatch):
    assert rows_of('[\n{"id": 1},\n{"id": oh},\n{"id": "cut},\n{"id": 3}\n]', size, monkeypatch) == ['{"id": 1}', '{"id": oh},', '{"id": "cut},', '{"id": 3}']
    assert rows_of('[{"id": 1}, 5, "x"\n{"id": 2}]', size, monkeypatch) == ['{"id": 1}', '5, "x"', '{"id": 2}']
    assert rows_of('[{"id": 1}, {"id": 2, "te', size, monkeypatch) == ['{"id": 1}', '{"id": 2, "te']
    assert rows_of('{"id": 1}\n[broken\n{"id": 2}', size, monkeypatch) == ['{"id": 1}', "[broken", '{"id": 2}']
    assert [r for r in rows_of(" \n ", size, monkeypatch) if r.strip()] == [] == rows_of("[]", size, monkeypatch) and rows_of("", size, monkeypatch) == [""]
    assert rows_of(b'{"id": "\xff"}\n', size, monkeypatch)[0] == '{"id": "\ufffd"}'


def test_files_are_unpacked_once(spark, tmp_path):
    deep = tmp_path / "a b%20é"
    deep.mkdir()
    halves = [json.dumps(p) + "\n" for p in POSTS]
    # Two streams in one file, as parallel packers write.
    (deep / "lines.bz2").write_bytes(bz2.compress("".join(halves[:3]).encode()) + bz2.compress("".join(halves[3:]).encode() + b"broken\n"))
    (tmp_path / "list.bz2").write_bytes(bz2.compress(json.dumps([{"id": 20}, {"id": 21}], indent=1).encode()))
    (tmp_path / "other.gz").write_bytes(gzip.compress(b'[{"id": 30}]'))
    (tmp_path / "empty.bz2").write_bytes(bz2.compress(b""))
    (tmp_path / "_left.bz2").write_bytes(bz2.compress(b'{"id": 99}'))
    seen = Observation()
    found = posts.scan_posts(spark, str(tmp_path), seen=seen)
    assert sum("Scan" in line for line in found._jdf.queryExecution().executedPlan().toString().split("\n")) == 1
    assert sorted(r.id for r in found.collect()) == [0, 1, 2, 3, 4, 5, 6, 20, 21]
    assert seen.get["bad_rows"] == 1
    names = {r.source_file for r in found.select("source_file").collect()}
    assert names == {r[1] for r in posts.read_text_files(spark, str(tmp_path)).filter("trim(value) <> ''").collect()}
    assert [r.id for r in posts.scan_posts(spark, f"file://{tmp_path}", "*.gz").collect()] == [30]
    assert [r.id for r in posts.scan_posts(spark, str(tmp_path / "list.bz2")).collect()] == [20, 21]
    assert posts.scan_posts(spark, str(tmp_path), "*.none").count() == 0


def test_files_dealt_by_size(tmp_path):
    for i in range(40):
        (tmp_path / f"{i:02}.json").write_text("{}")
    reader = archive.JsonFilesReader({"path": str(tmp_path), "tasks": "8"})
    parts = [p.names for p in reader.partitions()]
    assert sorted(n for p in parts for n in p) == sorted(str(p) for p in tmp_path.iterdir()) and 8 <= len(parts) <= 10
    with pytest.raises(FileNotFoundError):
        archive.JsonFilesReader({"path": str(tmp_path / "none")}).partitions()
