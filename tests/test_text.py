import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlens.functions import sql, text

PHRASES = ["climate change", "change denial"]


def apply(spark, step, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(step(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("step", "given_text", "expected"),
    [
        (text.replace_newlines, "a\nb\r\nc", "a b c"),
        (text.drop_non_ascii, "café ’ok’", "caf ok"),
        (text.drop_links, "x https://wwwfoo.com https://www.foo.com/x", "x https://wwwfoo.com "),
        (text.drop_links, "WWW.Foo.com/a and HTTPS://t.co/ab", " and "),
        (lambda t: text.join_phrases(t, PHRASES), "x Climate Change denial y", "x Climate_Change denial y"),
        (lambda t: text.join_phrases(t, ["a+b c"]), "see A+B C now", "see A+B_C now"),
        (text.drop_handles, "e@x.y @bob", "e "),
        (text.shorten_runs, "Maaaaaaario!!!!! hiiii aaa", "Maaario!!! hiii aaa"),
        (
            text.expand_contractions,
            "I'm sure they don't know; It's rock 'n' roll",
            "I am sure they do not know; It is rock 'n' roll",
        ),
        (text.expand_contractions, "no apostrophe", "no apostrophe"),
        (text.join_hyphens, "state-of-the-art a-b-c", "state_of-the_art a_b-c"),
        (text.join_hyphens, "-a b- c--d e-f-g-h", "-a b- c--d e_f-g_h"),
        (text.strip, "\t  a b\x1c\n", "a b"),
        (text.drop_punctuation, "a.b#c_d'[e]\\f`~", "ab#c_def"),
    ],
)
def test_steps(spark, step, given_text, expected):
    assert apply(spark, step, [given_text]) == [expected]


def test_tokenize(spark):
    assert apply(spark, text.tokenize, ["Hello, World! #tag a_b it's", "  ", ""]) == [
        ["hello", "world", "#tag", "a_b", "its"],
        [],
        [],
    ]


messages = st.lists(st.text(alphabet="ab-_ @'.#é \n1", max_size=30), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(messages)
def test_steps_agree_with_plain_patterns(spark, values):
    assert apply(spark, text.join_hyphens, values) == [re.sub(r"(\w+)(-)(\w+)", r"\1_\3", v) for v in values]
    assert apply(spark, text.shorten_runs, values) == [re.sub(r"((.)\2{2})\2+", r"\1", v) for v in values]
    assert apply(spark, text.drop_handles, values) == [re.sub(r"@[^\s]+", "", v) for v in values]
    assert apply(spark, text.strip, values) == [v.strip() for v in values]
    marks = str.maketrans("", "", text.PUNCTUATION)
    assert apply(spark, text.tokenize, values) == [v.translate(marks).lower().split() for v in values]
    once = apply(spark, text.shorten_runs, values)
    assert apply(spark, text.shorten_runs, once) == once


def test_normalise_switches(spark):
    rows = spark.createDataFrame([("  a-b @x https://t.co/ab I'm\n",)], "text string")
    assert text.normalise(rows).first()[0] == "a_b   I am"
    off = dict.fromkeys(["newlines", "non_ascii", "links", "handles", "runs", "contractions", "hyphens", "outer_spaces"], False)
    assert text.normalise(rows, **off).first()[0] == rows.first()[0]


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    rows = spark.createDataFrame([("It's a-b-c, @x www.foo.com 'aaaaa' \"q\"",)], "t string")
    for name, step in [
        ("tl_hyphens", text.join_hyphens),
        ("tl_links", text.drop_links),
        ("tl_handles", text.drop_handles),
        ("tl_runs", text.shorten_runs),
        ("tl_tokens", text.tokenize),
    ]:
        got, expected = rows.select(F.expr(f"{name}(t)"), step(F.col("t"))).first()
        assert got == expected, name
