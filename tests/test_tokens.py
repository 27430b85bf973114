"""Token counts against the tokenizer itself."""

import pytest

from tabsleuth.operators import tokens as TK
from tabsleuth.session import ship_package

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def _plain():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_counts_are_the_tokenizers(spark):
    ship_package(spark)
    tok = _plain()
    texts = ["Hello world", "", None, "it's  we'll  \n\n\tx ", "日本語 text 123 45.6!!", "a b c\u0085d", "Hello world", "x" * 5000, "  ", "<|endoftext|> a", "é́ ñ"]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string").withColumnRenamed("n", "n_rows")
    got = {r.n_rows: r.n_tokens for r in TK.with_tokens(df, "text", PATH).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(texts)}


def test_counts_of_conversations(spark):
    ship_package(spark)
    tok = _plain()
    rows = TK.with_tokens(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"), "text", PATH).collect()
    assert rows and all(r.n_tokens == len(tok.encode(r.text, add_special_tokens=False).ids) for r in rows if r.text)


def test_guard(spark):
    ship_package(spark)
    df = spark.createDataFrame([(1, "one two three"), (2, "one"), (3, None)], "id long, text string")
    got = {r.id: r.text for r in TK.guarded(df, "text", 2, "too long", PATH).collect()}
    assert got == {1: "too long", 2: "one", 3: None}
