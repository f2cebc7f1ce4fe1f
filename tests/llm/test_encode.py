import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofloom.llm import encode
from proofloom.llm.bpe import Encoder, Vocabulary, tokenizer_path

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(tokenizer_path())


@pytest.fixture(scope="module")
def mine(vocabulary):
    return Encoder(vocabulary)


@pytest.fixture(scope="module")
def theirs(vocabulary):
    with open(tokenizer_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_merging(mine, theirs, vocabulary):
    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(), st.text("abAB er'\n", max_size=80), st.lists(st.sampled_from(["ing", "the", " ", "日本", "😀", "aaaa", "=", "\n\n", "'s", "​", "12"])).map("".join)))
    def check(text):
        text = text.encode("utf-8", "ignore").decode()
        ids = mine.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert vocabulary.decode(ids) == text

    check()


def test_long_pieces(mine, theirs):
    for text in ("a" * 5000, "ab" * 4000 + "c", "x" * 999 + "y", "\t" * 3000, "=" * 2500):
        assert mine.encode(text) == theirs.encode_ordinary(text)


def test_special_strings_are_text(mine, theirs):
    assert mine.encode("<|endoftext|>") == theirs.encode_ordinary("<|endoftext|>") != [50256]


def test_bounded_memory_of_pieces(vocabulary, theirs, monkeypatch):
    from proofloom.llm import bpe

    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    small = Encoder(vocabulary)
    text = "one two three four five six seven one two"
    assert small.encode(text) == theirs.encode_ordinary(text) and len(small) <= 3


def test_table_of_texts(spark, theirs):
    texts = [None, "", " ", "hello world", "é日本", "word " * 50_000, "hello world"]
    df = spark.createDataFrame([(i, t, "kept", [i]) for i, t in enumerate(texts)], "id bigint, text string, ids string, _text array<bigint>")
    got = {r.id: r for r in encode.encode(df).collect()}
    assert len(got) == len(texts)
    assert all(got[i].ids == (theirs.encode_ordinary(t) if t else []) and got[i]._text == [i] for i, t in enumerate(texts))
    counts = {r.id: r.tokens for r in encode.token_counts(df.select("id", "text")).collect()}
    assert counts == {i: len(got[i].ids) for i in got}
    back = {r.id: r.text for r in encode.decode(encode.encode(df.select("id", "text"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode.encode(df.limit(0)).count() == 0
    assert encode.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()[0].text is None


def test_ids_outside_the_vocabulary(vocabulary):
    with pytest.raises(IndexError):
        vocabulary.decode([-1])
