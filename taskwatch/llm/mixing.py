"""Mixing sources to target weights by entropy balancing (operator 5, native).

Documents get rates as close as possible, in relative entropy, to "once each"
such that every source yields its target of words and no document is taken
more than ``CAP`` times. With rate / CAP as a probability the relative
entropy to a base rate of one gives exponentially tilted rates,

    rate(s) = CAP * e^(lam x) / (CAP - 1 + e^(lam x)),   x = size / mean size,

one dual variable per source, and the dual is convex. Newton's method solves
it on the histogram (source, size, documents), which is what a document's
rate depends on: each iteration is one aggregation by source, safeguarded by
a bracket. Targets at 0 or at the cap need no iteration.

Rates become whole copies by systematic rounding: along a source's documents
in order of size, document i gets round(F(i)) - round(F(i - 1)) extra copies,
F being the running sum of the fractional parts. Every run of documents is
rounded to within one copy, so a source misses its target by at most about
one of its largest documents. Running sums are taken in blocks of bounded
size and carried from block to block, never over a whole source in one task.

Targets: sources in order of code points, null last, weigh 5, 2, 1, repeating;
they share all words by weight; a target stops at CAP times its source's size
and the excess is shared again by weight until none is above.

Defined results: a null text has size 0; documents of size 0 are returned and
take nothing; a null source is a source of its own; repeated rows are rows of
their own; an empty table gives an empty result; extra columns are passed
through, and an input column named like an output column is replaced. Only
DataFrame functions are used. Reruns agree: the order within one size follows
a hash of the key and the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from taskwatch.llm.common import REC, carried, fresh, read, words
from taskwatch.operators.joins import attach
from taskwatch.session import pin

WEIGHTS = [5, 2, 1]
CAP = 3
ROUNDS = 60
TOLERANCE = 1e-10
#: documents in one rounding block, and sizes in one block of the running sum
BLOCK = 1000
LIMIT = 60.0


def size_of(text: str) -> Column:
    return F.size(words(F.col(text))).cast("long")


def histogram(sized: DataFrame) -> DataFrame:
    """``(_source, _size, n)`` of ``sized(_source, _size)``."""
    return sized.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("n"))


def targets(hist: DataFrame, weights: list[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(_source, source_size, target)``, one row per source.

    Sources are ranked by one window over one row per source. The reshared
    excess has a closed form: in order of cap per weight, the share per weight
    left to the others rises as long as the sources taken out are capped ones
    and falls after them, so its maximum is the level all others get.
    """
    sizes = hist.groupBy("_source").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").isNull(), F.encode("_source", "UTF-8")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank - 1) % len(weights) + 1)
    t = sizes.withColumn("_w", w).withColumn("_limit", (F.col("source_size") * cap).cast("double"))
    every = Window.partitionBy()
    by_limit = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("_source").isNull(), F.encode("_source", "UTF-8"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "_total": F.sum("source_size").over(every).cast("double"), "_all": F.sum("_w").over(every),
        "_spent": F.coalesce(F.sum("_limit").over(before), F.lit(0.0)),
        "_gone": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    t = t.withColumn("_level", (F.col("_total") - F.col("_spent")) / (F.col("_all") - F.col("_gone")))
    # the level rises while capped sources are taken out and falls after them
    level = F.max("_level").over(every)
    return t.select("_source", "source_size", F.least(
        F.col("_limit"), level * F.col("_w")).alias("target"))


def rate(lam: Column, x: Column, cap: int = CAP) -> Column:
    tilt = F.exp(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), lam * x)))
    return cap * tilt / (cap - 1 + tilt)


def solve(hist: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """``goal`` with ``lam`` and ``mean``: Newton's iterations over ``hist``,
    one aggregation each, all sources at once. ``lam`` is null for targets at
    the cap or at 0."""
    spark = hist.sparkSession
    mean = hist.groupBy("_source").agg((F.sum(F.col("_size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = pin(goal.join(mean, goal["_source"].eqNullSafe(mean["_source"])).drop(mean["_source"]).select(
        "*", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"),
        ((F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))).alias("open"),
        F.lit(False).alias("done")), "mix-state")
    for _ in range(ROUNDS):
        live = state.where("open and not done")
        if not live.limit(1).count():
            break
        h, s = hist.alias("h"), live.alias("s")
        x = F.col("h._size") / F.col("s.mean")
        r = rate(F.col("s.lam"), x, cap)
        words_ = F.col("h.n") * F.col("h._size")
        sums = (h.join(s, F.col("h._source").eqNullSafe(F.col("s._source")))
                .groupBy(F.col("s._source").alias("_source"))
                .agg(F.sum(words_ * r).alias("_f"), F.sum(words_ * x * r * (1 - r / cap)).alias("_g")))
        t = state.join(sums, state["_source"].eqNullSafe(sums["_source"]), "left").drop(sums["_source"])
        over = F.col("_f") > F.col("target")
        t = t.withColumns({"high": F.when(over, F.least("high", "lam")).otherwise(F.col("high")),
                           "low": F.when(over, F.col("low")).otherwise(F.greatest("low", "lam"))})
        step = F.col("lam") - (F.col("_f") - F.col("target")) / F.col("_g")
        bounded = F.greatest(F.col("lam") - 8, F.least(F.col("lam") + 8, step))
        inside = (bounded > F.col("low")) & (bounded < F.col("high"))
        t = t.withColumn("done", F.col("done") | F.col("_f").isNull()
                         | (F.abs(F.col("_f") - F.col("target")) <= TOLERANCE * F.col("target"))
                         | (F.col("high") - F.col("low") < 1e-12))
        t = t.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, bounded)
                         .otherwise((F.col("low") + F.col("high")) / 2))
        state = pin(t.drop("_f", "_g"), "mix-state")
    return state


def classes(hist: DataFrame, solved: DataFrame, cap: int = CAP) -> DataFrame:
    """Per (source, size): the rate's whole part, its fraction, and the sum of
    fractions of all smaller sizes of the source (``_start``)."""
    h, s = hist.alias("h"), solved.alias("s")
    r = F.when(F.col("s.target") <= 0, F.lit(0.0)).when(~F.col("s.open"), F.lit(float(cap))).otherwise(
        rate(F.col("s.lam"), F.col("h._size") / F.col("s.mean"), cap))
    t = h.join(s, F.col("h._source").eqNullSafe(F.col("s._source"))).select(
        "h._source", "h._size", "h.n", "s.source_size", "s.target", F.when(F.col("h._size") == 0, F.lit(0.0)).otherwise(r).alias("_rate"))
    t = t.withColumns({"_whole": F.floor("_rate"), "_frac": F.col("_rate") - F.floor("_rate"),
                       "_block": F.floor(F.col("_size") / 64)})
    # fractions as whole billionths: sums do not depend on the order of rows
    t = pin(t.withColumn("_frac", F.floor(F.col("_frac") * 1e9)), "mix-classes")
    blocks = t.groupBy("_source", "_block").agg(F.sum(F.col("_frac") * F.col("n")).alias("_sum"))
    ahead = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_source").alias("_bs"), F.col("_block").alias("_bb"),
                           F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    t = t.join(blocks, t["_source"].eqNullSafe(blocks["_bs"]) & (t["_block"] == blocks["_bb"])).drop("_bs", "_bb")
    inside = Window.partitionBy("_source", "_block").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("_start", F.col("_base") + F.coalesce(
        F.sum(F.col("_frac") * F.col("n")).over(inside), F.lit(0))).drop("_base", "_block", "_rate")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        sized: DataFrame | None = None, weights: list[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``sized`` may be given when sizes are already there, pinned: ``docs`` with
    ``_source``, ``_size`` and ``_order``."""
    spark = docs.sparkSession
    if sized is None:
        sized = with_size(docs, key, text, source)
    hist = pin(histogram(sized.select("_source", "_size")), "mix-hist")
    per = pin(classes(hist, solve(hist, targets(hist, weights, cap), cap), cap), "mix-per")
    # number of hash blocks of one (source, size), and where each one starts
    block = F.pmod(F.col("_order"), F.floor(F.col("n") / BLOCK) + 1).cast("int")
    per = per.withColumn("_s", _key("_source"))
    sized = sized.withColumn("_s", _key("_source"))
    rows = attach(sized, per.drop("_source"), ["_s", "_size"]).withColumn("_part", block)
    counts = (attach(sized.select("_s", "_size", "_order"), per.where(F.col("n") >= BLOCK).select("_s", "_size", "n"),
                     ["_s", "_size"], how="inner")
              .withColumn("_part", block).groupBy("_s", "_size", "_part").agg(F.count(F.lit(1)).alias("_m")))
    ahead = Window.partitionBy("_s", "_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_s", "_size", "_part", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_ahead"))
    rows = attach(rows, counts, ["_s", "_size", "_part"])
    place = F.row_number().over(Window.partitionBy("_s", "_size", "_part").orderBy("_order")) + F.coalesce("_ahead", F.lit(0))
    rows = rows.withColumn("_end", F.col("_start") + F.col("_frac") * place)
    unit = 1_000_000_000
    extra = (F.floor((F.col("_end") + unit // 2) / unit)
             - F.floor((F.col("_end") - F.col("_frac") + unit // 2) / unit))
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    return rows.select(*keep, F.col("_size").alias("size"), "source_size", "target",
                       (F.col("_whole") + extra).cast("int").alias("copies"),
                       ((F.col("_whole") + extra) * F.col("_size")).cast("long").alias("taken"))


def _key(source: str) -> Column:
    """A join key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def with_size(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return docs.withColumns({"_source": F.col(source).cast("string"), "_size": size_of(text),
                             "_order": F.xxhash64(F.lit(11), F.col(key), F.col(text))})


def query(spark, sf_dir: str) -> DataFrame:
    docs = with_size(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "text", "source")
    sized = pin(docs.drop("text"), "mix-sizes")
    return mix(sized.select("doc_id"), sized=sized).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, those taken at least once, with the columns
    they came with and the copies taken (``mix_copies``)."""
    out = mix(carried(docs), f"{REC}.doc_id", f"{REC}.text", f"{REC}.source")
    return out.where(F.col("copies") > 0).select(f"{REC}.*", F.col("copies").alias(fresh(docs, "mix_copies")))
