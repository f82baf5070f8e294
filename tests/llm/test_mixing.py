import random

from pyspark.sql import functions as F

from taskwatch.llm import mixing as M
from llm_fixtures import make  # noqa: F401

DOCS = "doc_id long, source string, text string"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    total, left = sum(sizes.values()), dict(sizes)
    target = {}
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] >= 3 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            del left[s]
    return target


def corpus(seed=1, n=3000):
    r = random.Random(seed)
    rows = [(i, r.choices(["b", "a", "ä", None, "z"], [60, 20, 10, 5, 1])[0], "w " * r.choice([0, 1, 3, 40, 200, r.randrange(900)]))
            for i in range(n)]
    return rows + [(n, "a", None), (None, "b", "x y z"), (n + 1, "b", "t " * 5000)] + [(n + 2, "b", "same text here")] * 400


def test_targets_totals_and_caps(make):
    rows = corpus()
    out = M.mix(make(rows, DOCS)).collect()
    assert len(out) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for r in out:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    want = brute_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5 * largest[s], (s, taken[s], want[s])


def test_rates_solve_the_dual(make):
    """Rates reproduce the targets and tilt one way along the size."""
    hist = make([("a", s, n) for s, n in [(1, 50), (10, 40), (100, 30), (1000, 3)]] + [("b", 7, 900)], "_source string, _size long, n long")
    goal = make([("a", 6450, 3000.0), ("b", 6300, 9000.0)], "_source string, source_size long, target double")
    lam = {r["_source"]: r for r in M.solve(hist, goal).collect()}
    per = M.classes(hist, M.solve(hist, goal)).collect()
    for s, t in (("a", 3000.0), ("b", 9000.0)):
        got = sum((r["_whole"] + r["_frac"] / 1e9) * r["_size"] * r["n"] for r in per if r["_source"] == s)
        assert abs(got - t) < 1e-4 * t
    assert lam["a"]["lam"] < 0 < lam["b"]["lam"]


def test_reruns_agree_and_do_not_depend_on_partitions(make):
    rows = corpus(2, 800)
    pick = lambda df: sorted(map(str, M.mix(df).select("doc_id", "source", "size", "taken").collect()))
    assert pick(make(rows, DOCS, 3)) == pick(make(rows[::-1], DOCS, 7))


def test_all_sources_at_cap_one_source_and_empty(make):
    out = M.mix(make([(1, "a", "x " * 10)], DOCS)).first()
    assert out["target"] == 10.0 and out["taken"] == 10
    assert M.mix(make([], DOCS)).count() == 0
    zero = M.mix(make([(1, "a", ""), (2, None, None)], DOCS)).collect()
    assert [r["taken"] for r in zero] == [0, 0]


def test_stage_keeps_clashing_columns(make):
    df = make(corpus(3, 200), DOCS).withColumns({"size": F.lit("s"), "_size": F.lit(9), "target": F.lit(1), "lang": F.lit("en")})
    out = M.mixed(df)
    assert out.columns == df.columns + ["mix_copies"]
    assert out.where("size = 's' and _size = 9").count() == out.count() > 0
