import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taskwatch.llm import bpe as B
from llm_fixtures import make  # noqa: F401

PATH = public_tokenizers.path(B.VOCABULARY)


@pytest.fixture(scope="module")
def table():
    return B.load(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def texts():
    r = random.Random(12)
    out = ["", None, "Hello World's 12 ΟΔΟΣ İstanbul café café I'LL", "a" * 4000, "ab" * 3000, "日本語" * 400, " \n\t ",
           "x<|endoftext|><|startoftext|> y <|endoftext|", "</w> a</w>b", "\x00a\x1cb\x85c d  e", "é" * 999, "e" + "́" * 50]
    out += ["".join(r.choice("ab \n\t'sé1<|>\U0001f600Σİ́\x00\x85") for _ in range(r.randrange(300))) for _ in range(300)]
    out += [f"a{chr(c)} {chr(c)}{chr(c)}b1{chr(c)}!" for c in [*range(0, 0x3100), *range(0xA000, 0xD800, 3), *range(0x10000, 0x20000, 5)]]
    return out


def test_same_ids_and_text_as_the_library(table, library):
    given = texts()
    got = [ids(g) for g in B.Codec(table).encode(given)]
    assert got == [e.ids for e in library.encode_batch([t or "" for t in given], add_special_tokens=False)]


def test_later_letters_and_numbers_are_neither(table, library):
    later = [c for a, b in B.LATER_LETTERS + B.LATER_NUMBERS + [c[:2] for c in B.LATER_CAPITALS] for c in {a, (a + b) // 2, b}]
    given = [f"x{chr(c)}y {chr(c)}{chr(c)} 1{chr(c)}!" for c in later]
    assert [ids(g) for g in B.Codec(table).encode(given)] == [library.encode(t, add_special_tokens=False).ids for t in given]


def test_cuts_are_the_pairs_inside_no_token(table):
    """Every token spelled out in initial symbols, by its merges."""
    spelled = {i: (s,) for s, i in enumerate(table["first"])}
    for (a, b), (_, made) in sorted(table["merges"].items(), key=lambda m: m[1][0]):
        spelled[made] = spelled[a] + spelled[b]
    inside = {p for s in spelled.values() for p in zip(s, s[1:])}
    assert {(a, b) for a, b in zip(*np.nonzero(~table["cut"]))} == inside
    assert table["cut"][256:].all()   # nothing follows the end of a word


def test_fragments_alone_give_the_whole(table):
    r = random.Random(3)
    first = np.array(table["first"])
    for _ in range(200):
        word = "".join(r.choice("etaoinqxzé漢1") for _ in range(r.randrange(1, 30))).encode()
        sym = np.frombuffer(word, dtype=np.uint8).astype(int)
        sym[-1] += 256
        stops = [*(np.flatnonzero(table["cut"][sym[:-1], sym[1:]]) + 1).tolist(), len(sym)]
        parts = [B.merge(first[sym[a:b]].tolist(), table["merges"]) for a, b in zip([0, *stops], stops)]
        assert sum(parts, []) == B.merge(first[sym].tolist(), table["merges"])


def test_pieces_and_forgetting_change_nothing(table, monkeypatch):
    given = texts()[:320] + [" ".join(f"word{i} ünd so" for i in range(5000)), "x" * 20000]
    want = B.Codec(table).encode(given)
    monkeypatch.setattr(B, "PIECE", 300)
    monkeypatch.setattr(B, "REMEMBERED", 200)
    assert B.Codec(table).encode(given) == want


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        B.load(public_tokenizers.path("byte_bpe_50k.json"))


def test_encode_decode_nulls_repeats_and_clashes(make, library):
    rows = [(1, None), (2, ""), (None, "Hello  world"), (3, "é x"), (3, "é x"), (4, "w " * 3000), (5, "<|endoftext|>a")]
    df = make(rows, "doc_id long, text string").withColumns({"ids": F.lit("mine"), "_encoded": F.lit(1), "other": F.lit("o")})
    enc = B.encode(df, PATH)
    assert enc.columns == ["doc_id", "text", "_encoded", "other", "ids"]
    out = B.decode(enc, PATH, keep=["doc_id", "ids"])
    got = sorted(((r["doc_id"] or 0), ids(r["ids"]), r["decoded"]) for r in out.collect())
    want = []
    for d, t in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((d or 0, e, library.decode(e, skip_special_tokens=False)))
    assert got == sorted(want)
    assert B.decode(B.encode(df.limit(0), PATH), PATH).count() == 0
    odd = make([(bytes(np.array([320, 10**6, 4_000_000_000], dtype="<u4").tobytes()),), (None,)], "ids binary")
    assert sorted(r["decoded"] for r in B.decode(odd, PATH).collect()) == ["", library.decode([320])]


def test_query_digests(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in B.query(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        e = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(e, skip_special_tokens=False)
        assert got[r["doc_id"]] == (len(e), hashlib.sha256(np.array(e, dtype="<u4").tobytes()).hexdigest(),
                                    hashlib.sha256(text.encode()).hexdigest())
