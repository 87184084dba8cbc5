import hashlib
import random
import re

from textlens.llm import winnow
from tests.llm.data import given_and_odd, odd_documents


def chosen(units, hashed):
    """Positions of winnowing: the rightmost smallest gram of every window."""
    grams = [tuple(units[i : i + winnow.GRAM]) for i in range(max(len(units) - winnow.GRAM + 1, min(len(units), 1)))]
    values = [hashed[g] for g in grams]
    out = []
    for i in range(max(len(grams) - winnow.WINDOW + 1, min(len(grams), 1))):
        window = values[i : i + winnow.WINDOW]
        best = max(j for j, v in enumerate(window) if v == min(window)) + i
        if best not in out:
            out.append(best)
    return out


def units_of(text):
    return re.findall(r"[^\x20\x09-\x0D]{1,%d}" % winnow.UNIT, text)


def test_edits_and_likeness(spark):
    docs = given_and_odd(spark)
    got = {}
    for r in winnow.fingerprint_edits(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "", r.doc_id) for r in docs.collect()), key=lambda r: (-r[0], r[1]))
    sets = lambda s: {int(x, 16) >> 32 for x in s.split()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = {}
    for (_, text, doc_id), (_, after, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        r = got[doc_id].pop(0) if len(got[doc_id]) == 1 else got[doc_id].pop(0)
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert r.n_chars == len(text)
        if doc_id != 13:  # its two rows are equal, so their order is open
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), doc_id
        assert r.near_edited == like(sets(r.fingerprint), sets(r.edited_fingerprint))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    for (_, text, doc_id), (_, after, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        near = {r.near_next for r in winnow.fingerprint_edits(docs.filter(f"doc_id <=> {doc_id if doc_id is not None else 'null'}")).collect()} if doc_id == 4 else None
        assert near in (None, {1.0})  # a single row is its own next
        assert like(sets(prints[text]), sets(prints[after])) >= 0


def test_next_fingerprints(spark):
    docs = given_and_odd(spark).filter("doc_id IS NOT NULL AND doc_id <> 13")
    rows = sorted(winnow.fingerprint_edits(docs).collect(), key=lambda r: -r.doc_id)
    sets = lambda s: {int(x, 16) >> 32 for x in s.split()}
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = sets(r.fingerprint), sets(after.fingerprint)
        assert r.near_next == (len(a & b) / len(a | b) if a | b else 1.0)


def test_positions_are_the_rightmost_minima(spark):
    docs = given_and_odd(spark).select("text").distinct()
    marked = winnow.with_fingerprint(docs, "text", "fp").select("text", "fp", winnow.positions(winnow.F.col("fp")).alias("at"))
    for r in marked.collect():
        units = units_of(r.text or "")
        low = {at: v >> 32 for at, v in zip(r.at, r.fp, strict=True)}
        grams = [tuple(units[i : i + winnow.GRAM]) for i in range(max(len(units) - winnow.GRAM + 1, min(len(units), 1)))]
        hashed = {grams[at]: v for at, v in low.items()}
        assert all(hashed[grams[at]] == v for at, v in low.items())
        # every window holds a chosen gram, and none to its right in that window has a hash as small
        for i in range(max(len(grams) - winnow.WINDOW + 1, min(len(grams), 1))):
            inside = [at for at in r.at if i <= at < i + winnow.WINDOW]
            assert inside
            best = min(low[at] for at in inside)
            last = max(at for at in inside if low[at] == best)
            assert all(hashed.get(g, best + 1) > best for g in grams[last + 1 : i + winnow.WINDOW])


def test_shared_passage_is_found(spark):
    passage = " ".join(f"pass{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "alpha beta " + passage + " gamma"), (2, "other words here " + passage)], "doc_id long, text string")
    assert all(r.near_next > 0 for r in winnow.fingerprint_edits(docs).collect())


def test_shared_unspaced_passage_is_found_at_every_offset(spark):
    digits = hashlib.sha512(b"passage").hexdigest() * 4
    texts = {"letters": digits, "chinese": "".join(chr(0x4E00 + int(digits[i : i + 4], 16) % 20000) for i in range(0, 500)), "pairs": "".join(chr(0x20000 + int(c, 16)) for c in digits)}
    sets = lambda s: {int(x, 16) >> 32 for x in s.split()}
    for name, passage in texts.items():
        rows = [(i, "z" * i + passage) for i in range(4)]
        got = {r.doc_id: sets(r.fingerprint) for r in winnow.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for i in range(1, 4):
            assert len(got[0] & got[i]) / len(got[0] | got[i]) > 0.8, (name, i)
        # one shared passage of GRAM + WINDOW - 1 characters is enough
        short = passage[: winnow.GRAM + winnow.WINDOW - 1]
        rows = [(i, "q" * (7 + i) + short + "xyz" * (5 + i)) for i in range(2)]
        assert all(r.near_next > 0 for r in winnow.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()), name


def test_empty_table(spark):
    assert winnow.fingerprint_edits(odd_documents(spark, empty=True)).count() == 0


def test_edited_fingerprint_is_that_of_the_whole(spark):
    """On given, odd and random texts, with ties, blanks at the seam and every short length."""
    rng = random.Random(7)
    made = ["".join(rng.choices("ab \n" if i % 2 else "a b", k=rng.choice([*range(200), 500, 2000]))) for i in range(240)]
    made += ["z" * n for n in (48, 49, 50, 79, 80, 81, 147, 300)] + ["chars " * 700, "", "x"]
    random_docs = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(made)], "doc_id long, text string")
    docs = given_and_odd(spark).select("doc_id", "text").union(random_docs)
    rows = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "") for r in docs.collect()), key=lambda r: (-r[0], r[1]))
    texts = {}
    for (_, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        texts[hashlib.sha256(edited.encode()).hexdigest()] = edited
    whole = spark.createDataFrame(list(texts.items()), "edited_sha256 string, text string")
    whole = winnow.with_fingerprint(whole, "text", "fp").select("edited_sha256", winnow.written(winnow.F.col("fp")).alias("fp"))
    expected = {r.edited_sha256: r.fp for r in whole.collect()}
    got = winnow.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    assert all(r.edited_fingerprint == expected[r.edited_sha256] for r in got)
