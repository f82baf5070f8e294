import math
import re

from pyspark.sql import functions as F

from taskwatch.llm import quality as Q
from llm_fixtures import make  # noqa: F401

DOCS = "doc_id long, lang string, text string"


def brute(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i:i + 5]), []).append(i)
    marked = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked))


def test_signals_match_brute_force(make):
    many = " ".join(f"w{i % 90} x{i}" if i % 3 else "a b c d e" for i in range(400))
    texts = [None, "", "  \n\t ", "one", "a b c d e a b c d e", "a a a a a a a a", "x\x0by\x0cz\rq", "l1\nl1\n l1\n\n\nl2\nl1",
             "$#%& <a|b> **", "é è ü " * 9, "a b c d e f " * 3 + "g", many, many + " " + many,
             " ".join(str(i) for i in range(30000)), " ".join(str(i % 7000) for i in range(21000)), "word" * 50000]
    out = Q.signals(make([(i, "en", t) for i, t in enumerate(texts)], DOCS)).collect()
    for r in out:
        assert tuple(r[c] for c in Q.BASE_COLUMNS) == brute(texts[r["doc_id"]]), r["doc_id"]
        n, rep = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, .3), (2, 10, .3), (0, 3000, .004), (5, 3000, .004), (11, 3000, .004), (40, 20000, .004), (12, 3000, .004)]
    for k, n, r in cases:
        got = spark.range(1).select(Q.binomial_tail(F.lit(k), F.lit(n), r)).first()[0]
        want = 1.0 if k >= n * r else sum(math.comb(n, j) * r**j * (1 - r)**(n - j) for j in range(k + 1))
        assert abs(got - want) < 1e-9 * max(want, 1e-3)


def _corpus(make, good=3000, bad=300):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = [(i, "en", " ".join(words[(i + j) % 12] + str(j) for j in range(20))) for i in range(good)]
    rows += [(good + i, "en", " ".join(w + "$$$" for w in words) + f" {i}") for i in range(bad)]
    rows += [(10**6, None, "some text that nobody has given a label in this stratum at all"), (None, "en", "short")]
    return make(rows, DOCS), make([(i, int(i < good)) for i in range(good + bad)], "doc_id long, quality int")


def test_rules_reject_bad_and_keep_clean(make):
    docs, labels = _corpus(make)
    measured = Q.signals(docs)
    out = {r["doc_id"]: r["kept"] for r in Q.judge(measured, Q.fit(measured, labels)).collect()}
    assert all(out[i] for i in range(3000)) and not any(out[i] for i in range(3000, 3300))
    assert out[10**6] and out[None] is False


def test_too_few_labels_certify_nothing(make):
    docs, labels = _corpus(make, 100, 50)
    measured = Q.signals(docs)
    assert Q.fit(measured, labels).count() == 0
    assert Q.judge(measured, Q.fit(measured, labels)).where("not kept and not base_failed").count() == 0


def test_contradicting_and_null_labels_are_not_used(make):
    docs, labels = _corpus(make)
    noise = labels.where("quality = 0").select("doc_id", F.lit(1).alias("quality"))
    nulls = labels.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert Q.fit(Q.signals(docs), labels.unionByName(noise).unionByName(nulls)).count() == 0


def test_stage_passes_clashing_columns_and_empty_tables(make, spark):
    docs, labels = _corpus(make)
    odd = docs.withColumns({"n_words": F.lit("mine"), "kept": F.lit(7), "_stratum": F.lit("s")})
    out = Q.rejecting(odd, labels)
    assert out.columns == odd.columns and out.where("n_words = 'mine' and kept = 7").count() == 3001
    twice = Q.rejecting(odd.union(odd), labels)
    assert twice.count() == 6002
    assert Q.rejecting(odd.limit(0), labels).count() == 0 and Q.rejecting(odd, labels.limit(0)).count() == 3301
