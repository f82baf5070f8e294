import itertools
import random
import re

from pyspark.sql import functions as F

from taskwatch.llm import audit as A
from taskwatch.session import scratch_path
from llm_fixtures import make  # noqa: F401


def brute(rows, labels):
    """All metrics by running every order over every document."""
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    docs = []
    for d, t, lang in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        docs.append((lang or "", fails, d in good, d in toxic))
    out, names = {}, ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    for order in itertools.permutations("ABCDE"):
        for part in {d[0] for d in docs}:
            for i, f in enumerate(order):
                c = dict.fromkeys(names, 0)
                for p, fails, g, t in docs:
                    if p != part:
                        continue
                    early = any(fails[x] for x in order[:i])
                    here = fails[f] and not early
                    c["kept"] += not early and not here
                    c["removed"] += here
                    c["redundant"] += fails[f] and early
                    c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                    c["good_lost"] += here and g
                    c["toxic_lost"] += here and t
                out[part, "".join(order), i + 1] = c
    for (part, order, step), c in out.items():
        c["shapley"] = sum(o["removed"] for (p, x, s), o in out.items() if p == part and x[s - 1] == order[step - 1])
    return out


def written(spark, files, schema="doc_id long, text string, lang string"):
    """The row lists of ``files``, one Parquet file each, in this order of arrival."""
    import time
    path = scratch_path(spark, "audit-docs") + ".parquet"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return path


def audited(spark, files, labels, batches):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = A.audit(A.counters(spark, written(spark, files), lab, batches)).collect()
    return {(r["part"], r["filter_order"], r["step"]): r.asDict() for r in out}


def same(got, want):
    assert set(got) == set(want)
    for k, c in want.items():
        assert {n: got[k][n] for n in c} == c, k


def text_of(r, kind):
    words = [f"w{r.randrange(400)}" for _ in range(r.choice([5, 150, 260]))]
    if kind == 1:
        words = [w[:2] for w in words]
    if kind == 2:
        words = [w.upper() + "ABC" for w in words]
    return " ".join(words) + (" #" if kind == 3 else "")


def test_smaller_ids_that_arrive_later_retract(spark):
    """Ids fall from file to file, so every micro-batch retracts."""
    r = random.Random(4)
    texts = [text_of(r, k % 4) for k in range(10)] + [None, ""]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None])) for i in range(90)]
    rows += [rows[3], (7, rows[8][1], "fr"), (None, texts[0], "en"), (None, texts[0], "en"), (None, None, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    rows.sort(key=lambda x: -(x[0] or 0))
    files = [rows[i:i + 25] for i in range(0, len(rows), 25)]
    same(audited(spark, files, labels, batches=len(files)), brute(rows, labels))
    same(audited(spark, files[::-1], labels, batches=2), brute(rows, labels))


def test_a_text_of_a_third_of_all_rows(spark):
    r = random.Random(5)
    hot = text_of(r, 0)
    rows = [(i, hot if i % 3 else text_of(r, i % 4), "en") for i in range(240)]
    r.shuffle(rows)
    same(audited(spark, [rows[:120], rows[120:]], [], 2), brute(rows, []))


def test_one_file_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = written(spark, [[]])
    assert A.audit(A.counters(spark, path, empty)).count() == 0
    rows = [(1, "a", "en", "x", 5), (2, "a", "en", "y", 6)]
    path = written(spark, [rows], "doc_id long, text string, lang string, part string, bits int")
    import os
    one = [os.path.join(path, f) for f in os.listdir(path.replace("file:", "")) if f.endswith(".parquet")][0]
    got = {(r["part"], r["bits"]): r["n"] for r in A.counters(spark, one, empty).collect()}
    assert got == {("en", 1): 1, ("en", 1 | A.DUPLICATE): 1}


def test_a_smaller_id_retracts_and_counts_again(spark):
    """One text over several batches, each against the state of those before."""
    cell = "digest binary, id long, part string, bits int, n long"
    state = spark.createDataFrame([], A._STATE)
    e, t, got = A.DUPLICATE, bytearray(b"t"), []
    batches = [[(t, 9, "en", 0, 1)], [(t, 12, "de", 1, 2)], [(t, 9, "en", 0, 1), (t, 9, "fr", 0, 1)],
               [(t, 3, "fr", 2, 1), (t, 5, "fr", 2, 1), (t, None, "fr", 2, 1)]]
    for i, rows in enumerate(batches):
        done = A.merged(spark.createDataFrame(rows, cell), state).cache()
        sums = done.select(F.inline("deltas")).groupBy("part", "bits").agg(F.sum("n").alias("n")).where("n <> 0")
        got.append({(r["part"], r["bits"]): r["n"] for r in sums.collect()})
        state = state.unionByName(done.where("fresh").select("digest", "low", F.lit(i).cast("long").alias("batch"), "rows")).cache()
    assert got == [{("en", 0): 1}, {("de", 1 | e): 2}, {("en", 0): 1, ("fr", 0): 1},
                   {("en", 0): -2, ("en", e): 2, ("fr", 0): -1, ("fr", e): 1, ("fr", 2): 1, ("fr", 2 | e): 1}]
    assert state.orderBy(F.desc("batch")).first()["low"] == 3


def test_a_retried_batch_replaces_its_writes(spark):
    labels = A.label_bits(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    work = scratch_path(spark, "audit-retry")
    r, frame = A.Retractor(labels, work), "doc_id long, text string, lang string"
    first = A.digests(spark.createDataFrame([(5, "x", "en"), (6, "x", "en")], frame))
    second = A.digests(spark.createDataFrame([(4, "x", "de")], frame))
    r(first, 0)
    for _ in range(3):
        r(second, 1)
    got = spark.read.parquet(r.deltas).groupBy("part", "bits").agg(F.sum("n").alias("n")).where("n <> 0").collect()
    assert {(x["part"], x["bits"]): x["n"] for x in got} == {("de", 1): 1, ("en", 1 | A.DUPLICATE): 2}


def test_a_stream_goes_on_where_it_stopped(spark):
    """New files, with a smaller id, after the first run: the state is taken up again."""
    path = written(spark, [[(2, "x", "en"), (3, "x", "en")]])
    labels = A.label_bits(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    work = scratch_path(spark, "audit-twice")

    def run():
        stream = spark.readStream.schema("doc_id long, text string, lang string").parquet(path)
        out = spark.read.parquet(A.count_stream(stream, labels, work))
        return {r["bits"]: r["n"] for r in out.groupBy("bits").agg(F.sum("n").alias("n")).collect()}

    assert run() == {1: 1, 1 | A.DUPLICATE: 1}
    spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string").write.mode("append").parquet(path)
    assert run() == {1: 1, 1 | A.DUPLICATE: 2}
    assert run() == {1: 1, 1 | A.DUPLICATE: 2}
