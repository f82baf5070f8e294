import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskwatch.llm import ragged, simjoin as S
from taskwatch.llm.components import components
from llm_fixtures import make  # noqa: F401


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(len(w) - width, 0) + 1))


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            k = len(a & b)
            if k and 100 * k >= percent * (len(a) + len(b) - k):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(repr((d, len(s), least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], [[r.choice(vocab) for _ in range(n)] for n in (4, 9, 12, 15, 21, 25, 40, 80, 200, 600) for _ in range(4)]
    passage = [r.choice(vocab) for _ in range(60)]
    for k in range(420):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            at = r.randrange(len(w))
            what = r.random()
            w[at:at + 1] = [r.choice(vocab)] if what < .6 else [] if what < .8 and len(w) > 1 else [w[at], r.choice(vocab)]
        if r.random() < .2:
            w = w + passage
        rows.append((k, " ".join(x.upper() if r.random() < .05 else x for x in w)))
    rows += [(500 + k, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 6)))) for k in range(60)]
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one two"),
                   (906, "one two"), (907, "x " * 100000), (908, "x " * 100001)] + rows[:5]


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2), (2, 70, 3)])
def test_matches_brute_force(make, width, percent, seed):
    rows = corpus(seed)
    got = S.cluster(make(rows, "doc_id long, text string"), width, percent).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute(rows, width, percent)


def test_cluster_of_unlinked_near_copies(make, monkeypatch):
    """Many members around one centre, some linked to it, most only to each other or to nothing."""
    monkeypatch.setattr(S, "BLOCK", 16)
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(5000)]
    base = [r.choice(vocab) for _ in range(200)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(200)] = r.choice(vocab)
        rows.append((k, " ".join(w)))
        if k % 10 == 0:  # a near copy of the copy
            w[r.randrange(200)] = r.choice(vocab)
            rows.append((1000 + k, " ".join(w)))
    got = S.cluster(make(rows, "doc_id long, text string")).collect()
    assert sorted(repr((x["doc_id"], x["n_shingles"], x["component_id"])) for x in got) == brute(rows, 3, 90)


def shared_notice(count, seed, notice=13):
    """Unrelated texts of 27 words that share a notice; every 20th has a near copy."""
    r = random.Random(seed)
    common = [f"n{i}" for i in range(notice)]
    rows = []
    for k in range(count):
        w = [f"o{r.randrange(10 ** 9)}" for _ in range(27 - notice)]
        at = r.randrange(len(w) + 1)
        rows.append((k, " ".join(w[:at] + common + w[at:])))
        if k % 20 == 0:
            rows.append((10000 + k, " ".join((w[:at] + common + w[at:])[:-1])))
    return rows


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_notice_shared_by_unlinked_texts(make, monkeypatch, width, percent):
    """The blocks of one cluster do not grow with the texts that share a passage, and no link is lost."""
    monkeypatch.setattr(S, "BLOCK", 4)
    met, blocks = [], S._in_blocks

    def counted(edges, percent):
        met.append(edges.where("not linked").count())
        return blocks(edges, percent)

    monkeypatch.setattr(S, "_in_blocks", counted)
    within, lists = [], S._lists_within
    monkeypatch.setattr(S, "_lists_within", lambda *a: within.append(1) or lists(*a))
    rows = shared_notice(700, 3)
    got = S.cluster(make(rows, "doc_id long, text string"), width, percent).collect()
    assert sorted(repr((x["doc_id"], x["n_shingles"], x["component_id"])) for x in got) == brute(rows, width, percent)
    assert within and sum(met) < 100


def test_clusters_listed_anew_match_brute_force(make, monkeypatch):
    """Every cluster with an unlinked pair goes through all levels."""
    monkeypatch.setattr(S, "BLOCK", 1)
    monkeypatch.setattr(S, "_costly", lambda edges, members: edges.select("centre").distinct())
    rows = corpus(11)
    got = S.cluster(make(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted(repr((x["doc_id"], x["n_shingles"], x["component_id"])) for x in got) == brute(rows, 2, 80)


def test_required_overlap_and_boundary():
    for n in range(1, 60):
        for m in range(n, 70):
            c = S.overlap(n, m, 90)
            assert 100 * c >= 90 * (n + m - c) and (c == 0 or 100 * (c - 1) < 90 * (n + m - c + 1))
            if c <= n and 10 * n >= 9 * m:
                assert c in S.subset_sizes(n, 90) and c in S.subset_sizes(m, 90)
                assert n - c + 1 <= S.posted(n, 90)
    assert S.boundary({n: 10 for n in range(1, 49)}, 1.5, 90) >= 8
    assert S.boundary({n: 10 for n in range(1, 49)}, 50.0, 90) >= 18
    assert S.boundary({}, 1.0, 90) == 0


def test_stage_keeps_one_row_of_each_component(make):
    rows = corpus(7)
    df = make(rows, "doc_id long, text string").withColumns({"row": F.lit("mine"), "n": F.lit(3), "odd": F.lit(1)})
    out = S.distinct(df, 3, 90)
    assert out.columns == df.columns
    roots = {x.split(", ")[-1] for x in brute([x for x in rows if shingles(x[1], 3)], 3, 90)}
    assert out.where(F.col("text").rlike(r"[^ \n]")).count() == len(roots)
    assert out.where("text is null or trim(text) = '' or text = ' \n'").count() == 3
    assert S.distinct(df.limit(0)).count() == 0 and S.cluster(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5), (7, 6)]
    random.Random(1).shuffle(links)
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)}


def test_words_of_sliced_buffers(monkeypatch):
    texts = ["a bb  ccc", None, "", "x" * 500, " lead", "trail ", "é ü\x0bq", "\x00 z"] * 5
    whole, offsets = ragged.words(pa.array(texts))
    for size in (1, 7, 64, 300):
        monkeypatch.setattr(ragged, "SLICE", size)
        h, o = ragged.words(pa.array([*["pad"] * 2, *texts]).slice(2))
        assert np.array_equal(h, whole) and np.array_equal(o, offsets)
        assert [len(p) for _, p in ragged.row_slices(pa.array(texts))] and sum(len(p) for _, p in ragged.row_slices(pa.array(texts))) == len(texts)
