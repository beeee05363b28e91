"""Ids against the public tokenizer itself."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contextframe.llm.encoding import Encoder, Vocabulary, default_path, encode_corpus

PATH = default_path()


@pytest.fixture(scope="module")
def public():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary(PATH))


def ids(encoder, texts):
    flat, counts = encoder.encode(texts)
    found, at = [], 0
    for n in counts.tolist():
        found.append(flat[at : at + n].tolist())
        at += n
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("ab '\n\t1é中😀", max_size=40))))
def test_any_text(encoder, public, texts):
    assert ids(encoder, texts) == [public.encode(text, add_special_tokens=False).ids for text in texts]


def test_merges_only_use_earlier_symbols():
    vocabulary = Vocabulary(PATH)
    born = {made: rank for rank, made in enumerate(vocabulary.made)}
    assert len(born) == len(vocabulary)
    assert all(born.get(a, -1) < rank and born.get(b, -1) < rank for rank, (a, b) in enumerate(zip(vocabulary.left, vocabulary.right, strict=True)))


def test_table(spark, public):
    texts = ["", None, " ", "aaaaaaaaaaaaa", "<|endoftext|> x", "word " * 100_000, "x" * 20_000, "same", "same"]
    rows = [(k, text, "v") for k, text in enumerate(texts)]
    df = encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text")
    assert df.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    found = {r.doc_id: r.ids for r in df.collect()}
    assert found == {k: public.encode(text or "", add_special_tokens=False).ids for k, text, _ in rows}
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_documents(spark, data, public):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in df.collect()}
    for row in encode_corpus(df, "doc_id", "text").collect():
        assert row.ids == public.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
