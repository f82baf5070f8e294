import re

from pyspark.sql import functions as F

from taskwatch.llm import licenses as L
from llm_fixtures import make  # noqa: F401

DOCS = "doc_id long, text string"


def grams(text):
    w = re.sub(r"[\W_]+", " ", text.lower()).split()
    return {(a, b) for a, b in zip(w, w[1:])}


def brute(rows, known, t=0.8):
    out = {}
    for key, text in set(rows):
        if text is None:
            continue
        lines = text.split("\n")
        for unit in lines + ([text] if len(lines) > 1 else []):
            a, best = grams(unit), None
            for lic, note in known:
                b = grams(note)
                if a and b and 2 * len(a & b) >= t * (len(a) + len(b)):
                    cand = (-len(a & b) / (len(a) + len(b)), lic, len(a) + len(b), len(a & b))
                    best = min(best or cand, cand)
            if best:
                n, hit = out.get((key, best[1]), (0, None))
                cand = (-best[0], best[2], best[3])
                out[key, best[1]] = (n + 1, max(hit or cand, cand))
    return {(k, lic, n, h[2], h[1]) for (k, lic), (n, h) in out.items()}


def rows():
    notes = [t for _, t in L.TEMPLATES]
    out = [(i, f"some text here\n{n}\nmore text there") for i, n in enumerate(notes)]
    out += [(100 + i, n.upper().replace(" ", "  \t")) for i, n in enumerate(notes)]
    out += [(200 + i, " ".join(n.split()[:-1])) for i, n in enumerate(notes)]  # a word short
    out += [(300 + i, " ".join(n.split()[::2])) for i, n in enumerate(notes)]  # every second word
    out += [(400 + i, "\n".join(n.split())) for i, n in enumerate(notes)]  # only as a whole
    return out + [(500, None), (501, ""), (502, "word"), (503, "MIT\n\n License"), (None, notes[0]), (0, notes[1]), (0, notes[1]),
                  (504, "lorem ipsum " * 50000 + "\n" + notes[2]), (505, notes[3] + "\n" + notes[3])]


def test_matches_brute_force(make, spark):
    got = L.scan(make(rows(), DOCS).withColumns({"license": F.lit("clash"), "size": F.lit(1)}), L.templates(spark)).collect()
    assert {tuple(r) for r in got} == brute(rows(), L.TEMPLATES) and len(got) == len({(r[0], r[1]) for r in got})


def test_no_notice_is_lost_to_spaces_or_repeats(make, spark):
    """Runs of spaces, and a notice whose bigrams are all said many times over."""
    notes = [t for _, t in L.TEMPLATES]
    given = [(i, n.replace(" ", " " * 8)) for i, n in enumerate(notes)]
    given += [(100 + i, "x\n" + (n + " ") * 40 + "\ny") for i, n in enumerate(notes)]
    got = L.scan(make(given, DOCS), L.templates(spark)).collect()
    assert {tuple(r) for r in got} == brute(given, L.TEMPLATES)
    assert {r["doc_id"] for r in got} >= set(range(len(notes)))


def test_every_match_holds_a_word_of_the_filter():
    """Whatever share of a template's bigrams a unit leaves out."""
    import random
    r, t = random.Random(2), 0.8
    words = [re.sub(r"[\W_]+", " ", n.lower()).split() for _, n in L.TEMPLATES]
    held = L.filter_words([(w, len(set(zip(w, w[1:])))) for w in words], t)
    assert 0 < len(held) < 120
    for w in words:
        pairs = sorted(set(zip(w, w[1:])))
        for _ in range(300):
            some = r.sample(pairs, L._least(len(pairs), t))
            assert any(h in x for p in some for x in p for h in held)
        bare = [p for p in pairs if not any(h in x for x in p for h in held)]
        assert len(bare) < L._least(len(pairs), t)


def test_many_templates_do_without_the_filter(make, spark, monkeypatch):
    monkeypatch.setattr(L, "FILTER_BIGRAMS", 10)
    got = L.scan(make(rows(), DOCS), L.templates(spark)).collect()
    assert {tuple(r) for r in got} == brute(rows(), L.TEMPLATES)


def test_empty_tables_and_odd_templates(make, spark):
    known = L.templates(spark)
    assert L.scan(make([], DOCS), known).count() == 0 and L.scan(make(rows(), DOCS), known.limit(0)).count() == 0
    odd = make([("x", None), ("y", ""), ("z", "word"), ("two", "all rights reserved")], "license string, text string")
    got = L.scan(make([(1, "All rights: reserved!"), (2, "rights reserved")], DOCS), odd).collect()
    assert [tuple(r) for r in got] == [(1, "two", 1, 2, 4)]
