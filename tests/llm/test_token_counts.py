import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from textlens.llm import token_counts
from tests.llm.data import given_and_odd, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(word, heads, tails):
    n, at = 0, 0
    while at < len(word):
        stop = next((e for e in range(len(word), at, -1) if word[at:e] in (tails if at else heads)), None)
        if stop is None:
            return 1
        n, at = n + 1, stop
    return n


pieces = st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=14)


@settings(max_examples=400, deadline=None)
@given(pieces, pieces, st.text("abcd", max_size=14).map(str.encode))
def test_counts_agree_with_greedy_matching(heads, tails, word):
    assert token_counts.PieceCounter(heads, tails).count(word) == greedy(word, heads, tails)


def test_documents(spark):
    docs = given_and_odd(spark)
    heads, tails = token_counts.vocabulary(PATH)
    longest = max(map(len, heads | tails))

    def count(word):
        n, at = 0, 0
        while at < len(word):
            stop = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in (tails if at else heads)), None)
            if stop is None:
                return 1
            n, at = n + 1, stop
        return n

    want = sorted(((r.doc_id, len(w := (r.text or "").encode().split()), sum(map(count, w))) for r in docs.collect()), key=str)
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, PATH).collect()), key=str)
    assert got == want
    assert token_counts.token_counts(odd_documents(spark, empty=True), PATH).count() == 0


def test_long_words_are_counted_and_not_remembered(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 50)
    memo = token_counts.Memo(token_counts.load(PATH).counter)
    words = [b"%d" % i * (i % 90 + 1) for i in range(1000)] * 2
    assert [memo[w] for w in words] == [memo.counter.count(w) for w in words]
    assert len(memo) <= 50 and max(map(len, memo)) <= token_counts.MEMO_BYTES
