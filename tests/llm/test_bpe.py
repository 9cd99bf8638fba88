import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
if not os.path.exists(bpe.DEFAULT_VOCABULARY):
    pytest.skip("no vocabulary files", allow_module_level=True)

V = bpe.Vocabulary.load()
REF = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
REF.encode_special_tokens = True
ODD = ["", " ", "a", "aaaaaaa" * 200, "<|endoftext|> x", "naïve café   x\n\n\t y", "👩‍👩‍👧 12345 don't we'll", "x" * 20_000, "\x00\x1f\x85"]


def reference(texts):
    return [e.ids for e in REF.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_odd_texts():
    assert list(bpe.Encoder(V)(ODD)) == reference(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=60), max_size=5))
def test_same_as_reference_and_round_trip(texts):
    got = list(bpe.Encoder(V)(texts))
    assert got == reference(texts)
    assert [V.decode(x).decode() for x in got] == texts


def test_forgetting_changes_nothing():
    texts = [f"word{i} other{i * 7} thing" for i in range(200)]
    assert list(bpe.Encoder(V, remembered=10)(texts)) == reference(texts)


def test_column(spark):
    rows = [(i, t, "k") for i, t in enumerate([*ODD, None])]
    df = spark.createDataFrame(rows, "id long, text string, tokens string")
    got = {r.id: r.ids for r in bpe.encode_column(df, "text").collect()}
    assert got == dict(enumerate(reference([t for _, t, _ in rows])))
    n = {r.id: r.n for r in bpe.encode_column(df, "text", out="n", lengths_only=True).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert bpe.encode_column(df.limit(0), "text").collect() == []
    with pytest.raises(ValueError, match="already"):
        bpe.encode_column(df, "text", out="tokens")
