import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZERS), reason="needs the vocabulary files")


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def both(request):
    import tiktoken

    content = bpe._rank_file(request.param, bpe.TOKENIZERS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return bpe.BytePairEncoder.from_rank_file(content), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a", "Hello  world\n\n it's 2024<|endoftext|>", "naïve 日本語 👩‍🔬\r\n\tx", "\x1c\x85  　 a", "é́ ﬁ ½ ٣", "don't CAN'T", "x" * 5000, "ab" * 20_000, "=" * 3000 + " " * 3000]


def test_equals_library(both):
    own, library = both
    for text in TEXTS:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_equals_library_on_any_text(both, text):
    text = text.encode("utf-8", "ignore").decode()
    own, library = both
    assert own.encode(text) == library.encode_ordinary(text) and own.decode(own.encode(text)) == text


def test_equals_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    own = bpe.BytePairEncoder.from_rank_file(bpe._rank_file("byte_bpe_50k", bpe.TOKENIZERS))
    for text in TEXTS:
        assert own.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.BytePairEncoder.from_rank_file(bpe._rank_file("byte_bpe_50k", bpe.TOKENIZERS))
    text = "one two three four five one two three"
    assert own.decode(own.encode(text)) == text and len(own.known) <= 3


def test_column(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (1, "a b", "x"), (None, "c", "x")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in bpe.encode_column(df, "text", ["doc_id"]).collect()), key=str)
    assert got == sorted([(1, [64, 275]), (1, [64, 275]), (2, []), (3, []), (None, [66])], key=str)
    counts = bpe.encode_column(df, "text", ["doc_id"], counts_only=True)
    assert sorted(r["n_tokens"] for r in counts.collect()) == [0, 0, 1, 2, 2]
    assert bpe.encode_column(df.limit(0), "text", ["doc_id"]).count() == 0
    texts = spark.createDataFrame([(1, "a b\u00e9\n"), (2, None), (3, "")], "doc_id long, text string")
    back = bpe.decode_column(bpe.encode_column(texts, "text", ["doc_id"]), "ids", ["doc_id"])
    assert sorted(map(tuple, back.collect())) == [(1, "a b\u00e9\n"), (2, ""), (3, "")]
    assert bpe.decode_column(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), "ids", ["doc_id"]).first()["text"] == ""
