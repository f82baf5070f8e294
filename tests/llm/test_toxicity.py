import random

from pyspark.sql import functions as F

from conftest import SF001
from taskwatch.llm import toxicity as X
from llm_fixtures import make  # noqa: F401


def test_folding():
    assert X.fold("ІDІОТ!! 1d10t ídíot id!ot $cum 2024 a1") == " idiot idiot idiot idiot scum ai "
    assert X.fold(None) == X.fold("") == " "


def test_entries_exceptions_and_length():
    m = X.build({" vile ": 4.0, " vil": 1.0, " rott": 2.0}, [" rotten egg "])
    assert [w for _, _, w in X.hits(m, X.fold("vile villain rotting"))] == [4.0, 1.0, 2.0]
    assert X.hits(m, X.fold("a rotten egg")) == [] and len(X.hits(m, X.fold("a rotten man"))) == 1
    assert X.measure(m, X.fold("vile " + "x " * 99)) == 4.0 / 10
    assert X.measure(m, X.fold("")) == 0.0 == X.measure(X.build({}), X.fold("vile"))


def corpus(n=1500):
    r = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo") for c in ("na", "pe", "qui", "zo")]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([20, 60, 300]))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(1 + len(w) // 40):
                w[r.randrange(len(w))] = r.choice(["beast", "SW1NE!!", "grobi" + r.choice(vocab), "grobi" + r.choice(vocab)])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_scores_separate_held_out_rows(make):
    rows, labels = corpus()
    docs, known = make(rows, "doc_id long, text string"), make(labels, "doc_id long, toxic int")
    model = X.learn(X.training_rows(docs, known))
    out = X.score(docs, model, ["doc_id"]).withColumn("held_out", X.held_out()).collect()
    held = [r for r in out if r["held_out"]]
    right = sum(r["predicted"] == int(r["doc_id"] % 8 == 0) for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= .5) for r in out)


def test_held_out_labels_are_never_used(make):
    rows, labels = corpus(300)
    docs = make(rows, "doc_id long, text string")
    known = make(labels, "doc_id long, toxic int")
    flipped = known.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.learn(X.training_rows(docs, known)) == X.learn(X.training_rows(docs, flipped))


def test_bounded_training_rows(make):
    rows, labels = corpus(1500)
    docs, known = make(rows, "doc_id long, text string"), make(labels, "doc_id long, toxic int")
    all_rows = X.training_rows(docs, known).count()
    some = X.training_rows(docs, known, 500).count()
    assert all_rows > 1100 and 350 < some < 500


def test_nulls_empty_and_missing_labels(make):
    docs = make([(1, None), (2, ""), (None, "text"), (3, "y " * 100000), (3, "y"), (3, "y")], "doc_id long, text string")
    none = make([], "doc_id long, toxic int")
    out = X.score(docs, X.learn(X.training_rows(docs, none)), ["doc_id"]).collect()
    assert len(out) == 6 and all(r["score"] < 1e-6 and r["predicted"] == 0 for r in out)
    odd = make([(3, 1), (3, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert X.training_rows(docs, odd).count() == 0
    assert X.score(docs.limit(0), ({}, [], (0.0, 0.0)), ["doc_id"]).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    """Against the labels of the rows not learned from."""
    out = X.query(spark, SF001.replace("sf0.01", "sf0.1")).join(
        spark.read.parquet(SF001.replace("sf0.01", "sf0.1") + "/labels.parquet").select("doc_id", "toxic"), "doc_id")
    r = out.where("held_out").agg(F.sum(F.expr("int(predicted = 1 and toxic = 1)")).alias("tp"), F.sum("toxic").alias("t"),
                                  F.sum(F.expr("int(predicted = 1 and toxic = 0)")).alias("fp"), F.sum(1 - F.col("toxic")).alias("c")).first()
    assert r["tp"] >= 0.88 * r["t"] and r["fp"] <= 0.01 * r["c"]


def test_no_entry_is_lost_for_its_rank(make):
    """More ordinary words than any list of the commonest features would hold."""
    letters = "abcdefghijklm"
    common = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters)
    rows = [(i, f"{common if i < 16 else 'plain words here'} {'vileness' if i < 5 else ''}") for i in range(70)]
    rows = make([(t, i < 6) for i, t in rows], "text string, toxic boolean")
    assert list(X.learn(rows)[0]) == [" vile"]
    assert len(X._prune({f" {a}{b}{c}{d} ": 1.0 for a in letters for b in letters for c in letters for d in letters})) == 13 ** 4
