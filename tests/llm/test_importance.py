import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from taskwatch.llm import importance as I
from llm_fixtures import make  # noqa: F401


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(t, run):
    ws = words(t)
    return [" ".join(ws[i:i + k]) for k in range(1, run + 1) for i in range(len(ws) - k + 1)]


def brute(docs, target, run, buckets, seed, min_words, percent):
    def count(texts):
        c = [0] * buckets
        for t in texts:
            for g in grams(t, run):
                c[zlib.crc32(g.encode()) % buckets] += 1
        return c

    s, t = count([x for _, x in docs]), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for d, x in docs:
        fs = grams(x, run)
        w = sum(gain[zlib.crc32(g.encode()) % buckets] for g in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words(x)), len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((o for o in out if o[1] >= min_words), key=lambda o: (-o[4], o[0] is None, o[0] or 0, o[1], o[2]))
    rank = {id(o): i + 1 for i, o in enumerate(can[:percent * len(can) // 100])}
    return sorted(([*o, rank.get(id(o))] for o in out), key=repr)


def corpus(n=150):
    r = random.Random(13)
    vocab = [f"{a}{i}" for a in ("wort", "Ünd", "日本", "x") for i in range(40)]
    docs = [(i, r.choice([" ", "\n", "-", "\x00", "_"]).join(r.choice(vocab) for _ in range(r.randrange(60)))) for i in range(n)]
    docs += [(None, docs[3][1]), (None, None), (5, docs[5][1]), (5, docs[6][1]), (n, ""), (n + 1, "..."), (n + 2, "Wort1 " * 3000)]
    return docs, [" ".join(r.choice(vocab[:30]) for _ in range(40)) for _ in range(10)] + [None, ""]


def test_against_brute_force_with_runs_of_words(make):
    docs, target = corpus()
    for run in (1, 3):
        want = brute(docs, target, run, 500, 7, 10, 25)
        df = make(docs, "doc_id long, text string").withColumns({"weight": F.lit("mine"), "rank": F.lit(0), "_row": F.lit(1)})
        out = I.resampled(df, make([(t,) for t in target], "text string"), run=run, buckets=500, seed=7, min_words=10, percent=25)
        assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted((list(r) for r in out.collect()), key=repr) == want


def test_texts_longer_than_a_slice_lose_no_run(make, monkeypatch):
    docs, target = corpus(40)
    whole = {}
    for i, (_, t) in enumerate(docs):
        for g in grams(t, 3):
            key = (i, zlib.crc32(g.encode()), g.count(" ") + 1)
            whole[key] = whole.get(key, 0) + 1
    for size in (1, 7, 100):
        monkeypatch.setattr(I, "SLICE", size)
        got = {}
        for at, n, text, crc, order in I._slices(pa.array([t for _, t in docs]), 3):
            for key in zip((text + at).tolist(), crc.tolist(), order.tolist()):
                got[key] = got.get(key, 0) + 1
        assert got == whole


def test_words_do_not_reach_into_the_next_text():
    text, crc, order, found = I.features([b"a b", b"", b"c", b"--", b"d e f"], 3)
    assert found == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert sorted(zip(order.tolist(), text.tolist())) == [(1, 0), (1, 0), (1, 2), (1, 4), (1, 4), (1, 4), (2, 0), (2, 4), (2, 4), (3, 4)]
    assert zlib.crc32(b"d e f") in crc and zlib.crc32(b"b c") not in crc
    assert len(I.features([], 2)[0]) == 0


def test_empty_tables_and_an_empty_target(make):
    docs, _ = corpus(60)
    none = make([], "doc_id long, text string")
    assert I.resampled(none, none).count() == 0
    out = I.resampled(make(docs, "doc_id long, text string"), none, buckets=50, percent=100)
    assert sorted((list(r) for r in out.collect()), key=repr) == brute(docs, [], 1, 50, I.SEED, I.MIN_WORDS, 100)
    assert np.all(I.gains(I.bucket_counts(none), I.bucket_counts(none)) == 0)
