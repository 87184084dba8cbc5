import re

import pytest

from textlens.llm import licenses
from tests.llm.data import given_and_odd, odd_documents

NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return [w for w in NOT_WORD.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute(text):
    words, places = words_of(text), []
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(docs):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    got = licenses.license_scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), r
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    return {r.doc_id: r for r in got}


def test_phrases_agree_with_scan(spark):
    assert any(r.n_base for r in check(given_and_odd(spark)).values())
    assert licenses.license_scan(odd_documents(spark, empty=True)).count() == 0


def test_all_given_texts(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_texts_with_small_changes(spark, name):
    text = licenses.TEMPLATES[name]
    words = text.split()
    broken = words[: len(words) // 2] + (["(inserted)"] if len(words) > 20 else []) + words[len(words) // 2 :]
    half = words[: len(words) // 2]
    rows = [(1, "Intro. " + text.upper() + " more"), (2, "x " + " ".join(broken)), (3, " ".join(reversed(words))), (4, " ".join(half))]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert name in got[1].labels.split(",") and name in got[2].labels.split(",")
    assert name not in got[3].labels.split(",") and got[3].score < 0.5
    assert got[4].labels == got[4].base_labels  # half a license text gives no label of its own, a phrase in it does


def test_common_words_and_long_repeats(spark):
    rows = [(1, "under the mit license " * 3000), (2, "of the license " * 5000)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1].n_base == 3000 and got[2].labels == ""


def test_no_license_text_gives_another_label(spark):
    kin = {
        "": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        " ": licenses.TEMPLATES["gpl"].replace("GNU General", "GNU Lesser General"),
        "  ": licenses.TEMPLATES["mit"].replace("deal in", "deal with"),
        "   ": licenses.TEMPLATES["apache-2"].replace("Apache", "Educational Community"),
    }  # near to a license text, but another license
    named = [*licenses.TEMPLATES.items(), *kin.items()]
    named.append(("cc-by-nc", licenses.TEMPLATES["cc-by-nc"].replace("NonCommercial", "Non Commercial")))
    named.append(("cc-by,cc-by-nc", licenses.TEMPLATES["cc-by"] + ". " + licenses.TEMPLATES["cc-by-nc"]))
    rows = [(i, "Some words. " + text + ". More words.") for i, (_, text) in enumerate(named)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    for i, (name, _) in enumerate(named):
        assert set(got[i].labels.split(",")) - set(got[i].base_labels.split(",")) <= set(name.strip().split(",")), (name, got[i])
        assert set(got[i].labels.split(",")) - {""} >= set(name.strip().split(",")) - {""}, (name, got[i])


def test_template_places_count_once_and_wide_runs_are_kept(spark):
    often = "a " + "creative commons attribution " * 5 + "4 0 international"  # one k-gram on five neighbouring diagonals
    wide = "this source code " * 60 + licenses.TEMPLATES["mpl-2"]  # the license stands at the end of a long run
    got = check(spark.createDataFrame([(1, often), (2, wide)], "doc_id long, text string"))
    assert got[1].labels == "" and got[1].score == 5 / 11
    assert got[2].labels == "mpl-2" and got[2].score == 1.0
