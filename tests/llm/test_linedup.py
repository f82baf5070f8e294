import re

from pyspark.sql import functions as F

from taskwatch.llm import linedup as L
from llm_fixtures import make  # noqa: F401

DOCS = "doc_id long, source string, text string, n_chars long"


def brute(rows, least):
    sites = {}
    for _, s, t, _ in rows:
        for x in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                sites.setdefault(x.strip(" \t\n\x0b\x0c\r"), set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for i, _, t, _ in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        ls = t.split("\n")
        hit = [x for x in ls if x.strip(" \t\n\x0b\x0c\r") in bad]
        n = lambda xs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in xs)
        goes = hit and n(hit) <= 0.5 * n(ls)
        out.append((i, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in ls), len(hit) if goes else 0,
                    "\n".join(x for x in ls if x not in hit) if goes else t))
    return sorted(map(repr, out))


def rows():
    own = lambda i: "\n".join(f"line {j} of document {i} with words" for j in range(4))
    out = []
    for i in range(60):
        menu = "Home | About | Contact us" if i // 10 % 2 else "  All rights reserved. \t"
        rare = f"seen on few sites {i % 30}"
        out.append((i, f"s{i % 10}" if i % 10 else None, f"{menu}\n{own(i)}\n\n{rare}\n{menu}", 5))
    out += [(100 + i, f"s{i}", own(0), 5) for i in range(10)]  # copies of one document
    out += [(200, "s1", None, None), (201, "s2", "", 0), (202, "s3", "Home | About | Contact us", 1), (None, "s4", out[1][2], 1),
            (1, "s5", "other row of the same key\nHome | About | Contact us\nand more words here to keep", 1),
            (203, "s6", "x " * 200000 + "\nHome | About | Contact us", 1)]
    return out + [out[3]] * 3


def test_matches_brute_force(make):
    data = rows()
    for least in (3, 5, 8):
        got = L.remove(make(data, DOCS), min_sites=least).select("doc_id", "n_lines", "n_removed", "clean_text").collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(data, least)


def test_near_threshold_lines_are_counted_exactly(make):
    """Site counts all around the threshold, on many sites."""
    data = [(s * 1000 + n, f"site{s}", f"line of {n} sites\n" + f"own {s} {n} words that stay here always", 1)
            for n in range(30, 50) for s in range(n)]
    got = {r["x"] for r in L.remove(make(data, DOCS), min_sites=40).where("n_removed > 0").selectExpr("doc_id % 1000 AS x").collect()}
    assert got == set(range(40, 50))


def test_stage_and_empty(make):
    df = make(rows(), DOCS).withColumns({"_hits": F.lit(1), "n_removed": F.lit("mine")})
    out = L.cleaned(df)
    assert out.columns == df.columns and out.count() == len(rows())
    assert out.where("n_removed <> 'mine' or _hits <> 1").count() == 0
    changed = out.where("text not like '%Home | About%'and text like 'line 0 of document 15 %'").collect()
    assert changed and all(r["n_chars"] == len(r["text"]) for r in changed)
    assert L.cleaned(df.limit(0)).count() == 0
