"""Quality rules with risk-controlled thresholds (operator 1, native).

Every document gets integer signals. A rule rejects where one signal's ratio
exceeds a cutoff, and the cutoffs are chosen per stratum (language) from
labelled holdout documents: going from the most lenient cutoff to stricter
ones, a cutoff is certified while the exact binomial test rejects "the rule
drops at least ``risk / signals`` of the good documents", that is while
P(Bin(n, r) <= k) <= alpha / (strata * signals) with k of the stratum's n good
holdout documents rejected. The walk stops at the first failure (fixed
sequence testing, so the cutoffs of one rule need no further correction); the
Bonferroni factor covers strata and signals. With confidence 1 - alpha all
strata lose at most ``risk`` of their good documents to the rules together.
Of the certified cutoffs the most lenient that rejects the most labelled bad
documents is used; a rule that rejects none is not used, and a stratum with
too few labels keeps everything the base rules keep.

Defined results: a null text is an empty one (base_failed); a null stratum is
a stratum of its own; labels that are null or contradict each other for one
document are not used; repeated rows are counted and returned as often as
they come; extra columns are passed through, and an input column named like
an output column is replaced by the output. Only DataFrame functions are
used: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from taskwatch.llm.common import NOT_WS, REC, carried, count_of, fresh, let, words
from taskwatch.operators.joins import attach
from taskwatch.session import pin

SYMBOLS = "[#*$%&|<>]+"
UPPER = "[A-Z]+"
#: up to so many different repeated windows are looked up one by one, more by sorting
FEW = 64

#: signal -> (numerator, denominator), both integer columns of ``signals``
RATIOS = {
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "bangs": ("n_bangs", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: cutoffs in thousandths, lenient to strict
CUTOFFS = [900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 40, 20]
RISK = 0.02
ALPHA = 0.05
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA_COLUMNS = ["n_lines", "n_upper", "n_bangs"]


def _repeated(ws: Column, span: int) -> Column:
    """Words inside windows of ``span`` words that occur at least twice."""
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.slice(
        F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, span)])),
        1, F.size(h) - (span - 1)))

    def positions(win):  # of repeated windows, ascending
        pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.transform(F.filter(
            F.transform(s, lambda p, j: F.when(
                (p["h"] == F.get(s, j - 1)["h"]) | (p["h"] == F.get(s, j + 1)["h"]), p["i"])),
            lambda i: i.isNotNull()), lambda i: i)))

    def covered(pos):  # length of the union of [i, i + span)
        return let(pos, lambda p: F.aggregate(
            F.transform(p, lambda i, j: F.least(F.coalesce(F.get(p, j + 1) - i, F.lit(span)), F.lit(span))),
            F.lit(0), lambda a, x: a + x))

    def repeated(win):  # the hashes that occur twice
        return let(F.sort_array(win), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))

    def looked_up(win, few):
        return F.filter(F.transform(win, lambda x, i: F.when(F.array_contains(few, x), i)), lambda i: i.isNotNull())

    found = let(windows, lambda win: F.when(
        F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(repeated(win), lambda twice: F.when(
            F.size(twice) <= FEW, covered(looked_up(win, twice))).otherwise(covered(positions(win))))))
    return F.when(F.size(ws) <= span, F.lit(0)).otherwise(found).cast("long")


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the signal columns (all long). Window equality is by
    64-bit hash inside one document."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_WS))
    w, ls = fresh(docs, "_words"), fresh(docs, "_lines")
    out = docs.withColumns({w: words(F.col(text)), ls: lines})
    return out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(F.col(w), "")).cast("long"),
        "n_symbols": count_of(t, SYMBOLS),
        "n_upper": count_of(t, UPPER),
        "n_bangs": count_of(t, "!+"),
        "n_lines": F.size(ls).cast("long"),
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(F.col(ls)))).cast("long"),
        "n_repeat_words": _repeated(F.col(w), 5),
    }).drop(w, ls).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _ln_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 8, good to about 1e-12."""
    y = x + F.lit(8.0)
    series = (y * F.log(y) - y + 0.5 * F.log(2 * F.pi() * y)
              + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))))
    shift = sum((F.log(x + F.lit(float(k))) for k in range(1, 9)), F.lit(0.0))
    return series - shift


def binomial_tail(k: Column, n: Column, r: float) -> Column:
    """P(Bin(n, r) <= k), and 1 from the mean on, where no test can pass.
    Terms are summed downwards from k as far as a double can tell them."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
                + k * F.log(F.lit(r)) + (n - k) * F.log(F.lit(1 - r)))
    terms = F.least(k, F.ceil(40 * F.sqrt(n * (r * (1 - r)))) + 60).cast("int")
    total = let(F.struct(k.alias("k"), n.alias("n"), top.alias("top"), terms.alias("terms")), lambda s: F.aggregate(
        F.sequence(F.lit(0), s["terms"]),
        F.struct(s["top"].alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct(
            (a["term"] * (s["k"] - j) * (1 - r) / ((s["n"] - s["k"] + j + 1) * r)).alias("term"),
            (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"]))
    return F.when(k >= n * r, F.lit(1.0)).otherwise(total)


def _stratum(col: str | None) -> Column:
    return F.lit("all") if col is None else F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str | None = "lang",
        label: str = "quality", risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """Certified cutoffs: one row per stratum (``_stratum``) and one nullable
    column ``cut_<signal>`` per rule. ``measured`` is the output of ``signals``."""
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key)
             .agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
             .where(F.col("_low") == F.col("_high")).select(key, (F.col("_low") == 1).alias("_good")))
    def passed(a, b):  # how many cutoffs, from the lenient end, let the document pass
        return F.size(F.filter(F.array(*[F.lit(c) for c in CUTOFFS]), lambda c: 1000 * F.col(a) <= c * F.col(b)))

    first = {s: passed(a, b) for s, (a, b) in RATIOS.items()}
    rows = (measured.where(~F.col("base_failed"))
            .select(key, _stratum(stratum).alias("_stratum"),
                    F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), i.alias("first"))
                                        for s, i in first.items()])).alias("x"))
            .join(known, key)
            .groupBy("_stratum", "x.signal", "x.first")
            .agg(F.sum(F.col("_good").cast("long")).alias("good"), F.sum((~F.col("_good")).cast("long")).alias("bad")))
    # one row per stratum, signal and cutoff: documents it rejects
    steps = rows.groupBy("_stratum", "signal").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("first", "good", "bad")).alias("h"))
    steps = steps.select("_stratum", "signal", "n", F.posexplode(F.transform(
        F.array(*[F.lit(i) for i in range(len(CUTOFFS))]),
        lambda i: F.aggregate(F.col("h"), F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("bad")),
                              lambda a, x: F.when(x["first"] <= i, F.struct(
                                  (a["k"] + x["good"]).alias("k"), (a["bad"] + x["bad"]).alias("bad"))).otherwise(a))
    )).alias("step", "c"))
    steps = pin(steps, "quality-steps")  # strata * signals * cutoffs rows
    level = alpha / (max(1, steps.select("_stratum").distinct().count()) * len(RATIOS))
    tested = steps.withColumn(
        "ok", binomial_tail(F.col("c.k"), F.col("n"), risk / len(RATIOS)) <= level)
    walk = Window.partitionBy("_stratum", "signal").orderBy("step")
    sure = tested.withColumn("ok", F.min(F.col("ok").cast("int")).over(walk)).where(
        (F.col("ok") == 1) & (F.col("c.bad") > 0))
    cut = F.element_at(F.array(*[F.lit(c) for c in CUTOFFS]), F.col("best.i").cast("int"))
    best = sure.groupBy("_stratum", "signal").agg(
        F.max(F.struct(F.col("c.bad").alias("bad"), (-F.col("step")).alias("lenient"),
                       (F.col("step") + 1).alias("i"))).alias("best"))
    return best.groupBy("_stratum").agg(*[F.max(F.when(F.col("signal") == s, cut)).alias(f"cut_{s}") for s in RATIOS])


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """``measured`` with ``kept``: false for base failures and for documents
    that a certified rule of their stratum rejects. The cutoff table has one
    row per stratum; it is broadcast only if its measured size allows."""
    out = attach(measured.withColumn("_stratum", _stratum(stratum)), cutoffs, ["_stratum"])
    hit = F.lit(False)
    for s, (a, b) in RATIOS.items():
        hit = hit | F.coalesce(1000 * F.col(a) > F.col(f"cut_{s}") * F.col(b), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~hit).drop("_stratum", *[f"cut_{s}" for s in RATIOS])


def query(spark, sf_dir: str) -> DataFrame:
    from taskwatch.llm.common import read
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = pin(signals(docs).drop("text"), "quality")
    out = judge(measured, fit(measured, read(spark, sf_dir, "labels")))
    return out.select("doc_id", *BASE_COLUMNS, "base_failed", "kept")


def rejecting(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents the rules keep, with the columns they came with."""
    measured = pin(signals(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    cutoffs = fit(measured, labels)
    return judge(signals(carried(docs), f"{REC}.text"), cutoffs, f"{REC}.lang").where("kept").select(f"{REC}.*")
