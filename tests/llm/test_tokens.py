import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taskwatch.llm import tokens as K
from llm_fixtures import make  # noqa: F401

PATH = public_tokenizers.path(K.VOCABULARY)


@pytest.fixture(scope="module")
def table():
    return K.load(PATH)


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def texts():
    r = random.Random(4)
    out = ["a" * 5000, "ab" * 3000, " " * 3000, "\n\n  x \t y", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "", None,
           "it's we'll I'D he'd", "日本語" * 500, "é" * 999, "a\x00b\x1c\x85c d  e"]
    out += ["".join(r.choice("ab \n\'sé1<|>\U0001f600") for _ in range(r.randrange(400))) for _ in range(300)]
    out += [f"a{chr(c)} {chr(c)}{chr(c)}b 1{chr(c)}" for c in range(0, 0x3100) if not 0xD800 <= c < 0xE000]
    return out


def test_same_counts_as_the_library(table):
    assert K.Counter(table).counts(texts()) == library(texts())


def test_pieces_and_forgetting_change_nothing(table, monkeypatch):
    long = [" ".join(f"word{i} ünd so" for i in range(20000)), "x" * 60000]
    want = library(texts()[:320] + long)
    monkeypatch.setattr(K, "PIECE", 300)
    monkeypatch.setattr(K, "REMEMBERED", 40)
    assert K.Counter(table).counts(texts()[:320] + long) == want


def test_query_columns_nulls_repeats_and_clashes(make):
    rows = [(1, None), (2, ""), (None, "hello world"), (3, "é x"), (3, "é x"), (4, "w " * 1200)]
    df = make(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("mine"), "_counted": F.lit(1)})
    out = K.count_tokens(df, PATH, keep=["doc_id"])
    got = sorted(map(repr, map(tuple, out.collect())))
    want = library([t for _, t in rows])
    assert got == sorted(repr((d, len((t or "").encode()), n, n > 1024)) for (d, t), n in zip(rows, want))
    assert K.count_tokens(df.limit(0), PATH).count() == 0
