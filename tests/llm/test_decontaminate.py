import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from taskwatch.llm import decontaminate as D
from llm_fixtures import make  # noqa: F401

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
R = random.Random(3)
VOCAB = [f"t{i}" for i in range(400)]
W = lambda n: [R.choice(VOCAB) for _ in range(n)]


def tokens(text):
    import re
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    """Every diagonal of every pair, segment by segment."""
    out = {}
    for d, (_, text) in enumerate(docs):
        a = tokens(text)
        for item, t in items:
            b = tokens(t)
            if not b:
                continue
            for g in range(-len(b) + 1, len(a)):
                lo, hi = max(0, g), min(len(a), g + len(b))
                if len(b) <= 15:  # by share of the tokens, all of them below five
                    m = sum(a[i] == b[i - g] for i in range(lo, hi))
                    if m >= np.ceil(.8 * len(b)):
                        out[d, item] = max(out.get((d, item), 0), m)
                    continue
                best = cur = 0
                start = lo
                for i in range(lo, hi):
                    if cur <= 0:
                        cur, start = 0, i
                    cur += 1 if a[i] == b[i - g] else -D.PENALTY
                    if cur > best:
                        best = cur
                        m = sum(a[j] == b[j - g] for j in range(start, i + 1))
                        if m >= D.MIN_MATCH:
                            out[d, item] = max(out.get((d, item), 0), m)
    return out


def data():
    items = [(i, " ".join(W(n))) for i, n in enumerate([30, 45, 16, 60, 12, 8, 7, 5, 4, 25])] + [(50, None), (51, ""), (52, "T1, t2")]
    docs = []
    for k in range(120):
        w = W(R.choice([5, 60, 200]))
        if k % 2:
            passage = tokens(R.choice(items[:10])[1])
            rate = R.choice([0, 0, .05, .1])
            passage = [R.choice(VOCAB) if R.random() < rate else x for x in passage]
            cut = R.choice([0, 0, 5])
            at = R.randrange(len(w))
            w[at:at] = passage[cut:]
        docs.append((k, " ".join(x.upper() + R.choice(["", ",", "."]) for x in w)))
    return docs + [(900, None), (901, ""), (None, items[0][1]), (902, items[1][1] + " x" * 100000), (1, items[3][1])], items


def test_finds_what_brute_force_finds(make):
    docs, items = data()
    want = brute([d for d in docs if d[0] != 902], items)
    got = {}
    block = D.Block([i for i, t in items if t], [t.lower() for _, t in items if t])
    texts = [(t or "").lower() for d, t in docs if d != 902]
    for row, item, _, _, m in block.leaks(pa.array(texts)):
        got[row, item] = m
    assert got.keys() <= want.keys()
    missed = [k for k in want if k not in got]  # seeds may miss heavily substituted short overlaps
    assert len(missed) <= 0.02 * len(want), missed


def test_blocks_and_rows(make, monkeypatch):
    docs, items = data()
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    one = key(D.leaks(make(docs, DOCS), make(items, ITEMS)))
    monkeypatch.setattr(D, "BLOCK_TOKENS", 100)
    assert key(D.leaks(make(docs, DOCS), make(items, ITEMS))) == one
    assert any(x.startswith("(902, 1,") for x in one) and any(x.startswith("(None, 0,") for x in one)
    odd = make(docs, DOCS).withColumns({"item_id": F.lit("x"), "_lowered": F.lit(1)})
    left = D.clean(odd, make(items + items, ITEMS))
    assert left.columns == odd.columns
    block = D.Block([i for i, t in items if t], [t.lower() for _, t in items if t], D.MIN_TOKENS)
    leaking = {f[0] for f in block.leaks(pa.array([(t or "").lower() for _, t in docs]))}
    assert left.count() == len(docs) - len(leaking)
    assert left.where("doc_id = 900 or doc_id = 901").count() == 2
    assert D.leaks(make(docs, DOCS), make([], ITEMS)).count() == 0 and D.clean(odd, make([], ITEMS)).count() == len(docs)
    assert D.leaks(make([], DOCS), make(items, ITEMS)).count() == 0 and D.clean(odd.limit(0), make(items, ITEMS)).count() == 0


def test_scripts_without_spaces_and_unicode_punctuation():
    zh = "请问下列哪一个城市是中华人民共和国的首都，并说明理由。"
    th = "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"
    ja = "「コンピューター」の発明者は誰ですか？"
    dash = "one—two “three” four…five six·seven « eight » nine, ten eleven twelve thirteen"
    block = D.Block([1, 2, 3, 4], [zh, th, ja, dash])
    docs = [f"前言{zh}后记", f"x{th}y", "昨日、コンピューターの発明者は誰ですかと聞いた", dash.replace("—", " - ").replace("“", "'"), "没有关系的文字", None, ""]
    assert [(r, i) for r, i, *_ in block.leaks(pa.array(docs))] == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_short_items_with_one_token_substituted():
    """All that ``verify`` accepts is found, as with every diagonal tried."""
    for n in range(D.MIN_TOKENS, D.SPAN):
        item = [f"w{k}" for k in range(n)]
        block = D.Block([7], [" ".join(item)])
        found = 0
        for gap in range(n):
            for before, after in (("", ""), ("a b ", " c d")):
                changed = " ".join("other" if k == gap else w for k, w in enumerate(item))
                own, _ = D.tokens(pa.array([before + changed + after]))
                want = block.verify(own, 0, len(before.split())) is not None
                assert bool(block.leaks(pa.array([before + changed + after]))) == want
                found += want
        assert found >= 4 and block.leaks(pa.array([" ".join(item[1:])])) and block.leaks(pa.array([" ".join(item[:-1])]))
        assert not block.leaks(pa.array([" ".join(item[2:])]))


def test_every_accepted_placement_is_found():
    """Items of 1 to 15 tokens, each with every set of substitutions: found are
    those that leave four fifths of the tokens, counted here without ``verify``."""
    from itertools import combinations

    for n in range(1, 16):
        item = [f"w{k}" for k in range(n)]
        block = D.Block([7], [" ".join(item)])
        need = int(np.ceil(.8 * n))
        docs, want = [], []
        for lost in range(0, n - need + 2):
            for gone in combinations(range(n), lost):
                docs.append(" ".join(["pre", "x"] + ["other" if k in gone else w for k, w in enumerate(item)] + ["post"]))
                want.append(n - lost >= need)
        found = {f[0] for f in block.leaks(pa.array(docs))}
        assert found == {i for i, w in enumerate(want) if w}, n


def test_items_of_few_tokens(make):
    items = make([(1, "Forty two"), (2, "yes"), (3, "one two three four five six")], ITEMS)
    docs = make([(1, "it is forty-two, and forty two"), (2, "yes yes yes"), (3, "forty or two"), (4, "One, two three four five six!"),
                 (5, None)], DOCS)
    assert sorted(tuple(r)[:4] for r in D.leaks(docs, items).collect()) == [(1, 1, 2, 2), (2, 2, 0, 1), (4, 3, 0, 6)]
    assert sorted(r["doc_id"] for r in D.clean(docs, items).collect()) == [1, 2, 3, 5]
