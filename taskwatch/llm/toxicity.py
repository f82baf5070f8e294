"""Toxicity by a weighted lexicon and Aho-Corasick matching (operator 8).

Texts are folded first: compatibility forms and accents are removed, look-alike
letters of other alphabets and digits inside words become the Latin letters
they stand for, everything else that is no letter separates words. Lexicon
entries are whole words and word beginnings, so inflected and compounded
languages need no list of all forms. One automaton finds all entries in one
pass over a text; an exception phrase cancels the entries it covers.

The lexicon is learned from labelled rows that are not held out, all of them up
to ``TRAIN_ROWS`` and a hash sample of about that many beyond; this bounds the
table of their keys, which is broadcast, so no text is shuffled. Spark counts,
over all of them, in how many toxic and clean documents each candidate occurs
and how often; an entry stays if its log odds over documents are positive by
``SURE`` standard errors, and its weight is the smoothed log ratio of its rates
per word. A longer entry gives way to a shorter one that weighs about as much. Exceptions are learned the same way: an entry with its neighbouring word
that occurs in clean documents almost only. All candidates are counted in one
aggregation and tested there; only what passes is collected, so that no entry
or exception is lost for its rank. The automaton is broadcast; the tests over
at most ``TRAIN_ROWS`` rows bound it.

A document's score is a logistic function of its weights per square root of
its words, fitted on the same rows from a histogram of that value.

Defined results: a null or empty text has no hits and scores lowest;
contradicting or null labels are not used; without any usable label no entry
is learned and every score is 0; repeated rows are scored as often as they
come. Label, language, source and key are never inputs of a score.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from taskwatch.session import pin, ship_package

FOLDS = 5
#: labelled rows the lexicon is learned from, at most
TRAIN_ROWS = 200_000
#: features a task holds before it passes their counts on
HELD = 200_000
#: an entry's toxic documents at least, and the standard errors by which its log odds exceed ``LIFT``
MIN_DOCS = 4
SURE = 2.75
LIFT = 0.5
#: weight by which a longer entry must exceed a shorter one to stay
MARGIN = 0.7
#: power of the number of words that a sum of weights is divided by
LENGTH_POWER = 0.5
#: lengths of word beginnings that are candidates
STEMS = range(4, 9)
BINS = 200

#: look-alike characters (fixed values)
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "γ": "y", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe",
}
#: digits and signs that stand for letters inside words (fixed values)
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}


class _Fold(dict):
    """Translation of one character, made on demand."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HOMOGLYPHS:
            out = HOMOGLYPHS[c]
        elif c.isdigit() or c in "@$!":
            out = c
        elif unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Cf"):
            out = ""
        else:
            out = c if c.isalpha() else " "
        self[code] = out
        return out


_FOLD = _Fold()
_SIGNS = str.maketrans({k: " " for k in SUBSTITUTES})
_LETTERS = str.maketrans(SUBSTITUTES)
_MARKS = set(SUBSTITUTES)


def fold(text: str | None) -> str:
    """Folded words of ``text``, each followed by a space, after a space."""
    if not text:
        return " "
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    words = text.translate(_FOLD).split()
    if not _MARKS.isdisjoint(text):
        words = [x for w in words for x in ((w,) if w.isalpha() else _spell(w))]
    return " " + " ".join(words) + " "


def _spell(word: str) -> list[str]:
    """A word with digits or signs: those between or before letters are read
    as letters, trailing and lone ones separate words."""
    word = word.rstrip("!$@")
    if not any(c.isalpha() for c in word):
        return []
    return word.lstrip("!").translate(_LETTERS).split()


def candidates(folded: str) -> Counter:
    """Whole words (" word ") and word beginnings (" wor"), with their counts."""
    out = Counter()
    for w, n in Counter(folded.split()).items():
        if len(w) > 2:
            out[f" {w} "] += n
        for k in STEMS:
            if len(w) <= k:
                break
            out[" " + w[:k]] += n
    return out


def build(entries: dict[str, float], exceptions: list[str] = ()) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for e, weight in entries.items():
        machine.add_word(e, (len(e), weight))
    for e in exceptions:
        if e not in entries:
            machine.add_word(e, (len(e), 0.0))
    if len(machine):
        machine.make_automaton()
    return machine


def hits(machine, folded: str) -> list[tuple[int, int, float]]:
    """``(start, end, weight)``: at each start the heaviest entry, without
    those that an exception (weight 0) covers."""
    best, free = {}, []
    for end, (size, weight) in machine.iter(folded):
        start = end - size + 1
        if weight == 0.0:
            free.append((start, end))
        elif start not in best or weight > best[start][1]:
            best[start] = (end, weight)
    free.sort()
    starts, reach = [a for a, _ in free], list(accumulate((b for _, b in free), max, initial=-1))
    return [(s, e, w) for s, (e, w) in best.items() if reach[bisect_right(starts, s)] < e - 1]


def measure(machine, folded: str) -> float:
    """Weight of the hits, normalised by the number of words."""
    if not len(machine):
        return 0.0
    found = hits(machine, folded)
    if not found:
        return 0.0
    return sum(w for _, _, w in found) / max(folded.count(" ") - 1, 1) ** LENGTH_POWER


def _count(rows: DataFrame, of) -> DataFrame:
    """``(feature, toxic, clean, toxic_n, clean_n)``: documents of each class
    with a feature, and its occurrences in them. ``of(folded)`` counts a
    document's features; sums are taken per ``HELD`` features before the shuffle."""
    names = ["toxic", "clean", "toxic_n", "clean_n"]

    def sums(n):
        features = list(n["toxic"].keys() | n["clean"].keys())
        return pa.RecordBatch.from_pydict({"feature": pa.array(features, pa.string())} | {
            k: pa.array([n[k][f] for f in features], pa.int64()) for k in names})

    def run(batches):
        n = {k: Counter() for k in names}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, side = of(fold(text)), "toxic" if toxic else "clean"
                n[side].update(found.keys())
                n[side + "_n"].update(found)
                if len(n["toxic"]) + len(n["clean"]) > HELD:
                    yield sums(n)
                    n = {k: Counter() for k in names}
        yield sums(n)

    schema = "feature string, " + ", ".join(f"{k} long" for k in names)
    return (rows.select("text", "toxic").mapInArrow(run, schema)
            .groupBy("feature").agg(*[F.sum(k).alias(k) for k in names]))


def learn(rows: DataFrame) -> tuple[dict[str, float], list[str], tuple[float, float]]:
    """Entries with weights, exception phrases, and slope and intercept of the
    score; ``rows`` has ``text`` and boolean ``toxic``."""
    spark = rows.sparkSession
    ship_package(spark)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    if not n_toxic or not n_clean:
        return {}, [], (0.0, -40.0)

    def listed(folded):  # and the words in all, as the feature ""
        out = candidates(folded)
        out[""] = folded.count(" ")
        return out

    counted = pin(_count(rows, listed).where((F.col("toxic") >= MIN_DOCS) | (F.col("feature") == "")), "toxic-counts")
    words = counted.where("feature = ''").first()
    odds = F.log((F.col("toxic") + 1) / (n_toxic + 2)) - F.log((F.col("clean") + 1) / (n_clean + 2))
    error = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))
    weight = (F.log((F.col("toxic_n") + 0.5) / float(words["toxic_n"]))
              - F.log((F.col("clean_n") + 0.5) / float(max(words["clean_n"], 1))))
    sure = counted.where((F.col("feature") != "") & (F.col("toxic") >= MIN_DOCS) & (odds - SURE * error > LIFT))
    best = sure.select("feature", weight.alias("weight")).where("weight > 0").collect()
    entries = _prune({r["feature"]: r["weight"] for r in best})
    machine = spark.sparkContext.broadcast(entries)
    exceptions = []
    if entries:
        def phrases(folded, cache=[]):  # noqa: B006  one automaton per worker
            if not cache:
                cache.append(build(machine.value))
            out = Counter()
            for s, e, _ in hits(cache[0], folded):
                e = folded.index(" ", e)
                before, after = folded.rfind(" ", 0, s), folded.find(" ", e + 1)
                if before >= 0:
                    out[folded[before:e + 1]] += 1
                if after >= 0:
                    out[folded[s:after + 1]] += 1
            return out

        fine = _count(rows, phrases).where((F.col("clean") >= MIN_DOCS) & (F.col("toxic") <= 0.1 * F.col("clean")))
        exceptions = [r["feature"] for r in fine.orderBy(F.desc("clean"), "feature").collect()]
    return entries, exceptions, _scale(rows, entries, exceptions)


def _prune(found: dict[str, float]) -> dict[str, float]:
    """All entries, the heaviest first, without those that a kept shorter beginning covers
    at a weight less than ``MARGIN`` lower."""
    kept: dict[str, float] = {}
    for f in sorted(found, key=lambda f: (len(f.rstrip()), f)):
        stem = f.rstrip()
        if not any(kept.get(stem[:k], -MARGIN) > found[f] - MARGIN for k in range(4, len(stem) + 1)):
            kept[f] = found[f]
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0])))


def _scale(rows: DataFrame, entries, exceptions) -> tuple[float, float]:
    """Logistic slope and intercept over the measure, by Newton's method on a
    histogram of ``BINS`` values."""
    values = _measured(rows.select("text", "toxic"), entries, exceptions, ["toxic"])
    binned = (values.select("toxic", F.least(F.floor(F.col("value") * 20), F.lit(BINS - 1)).alias("bin"))
              .groupBy("toxic", "bin").count().collect())
    x = np.array([(r["bin"] + 0.5) / 20 if r["bin"] else 0.0 for r in binned])
    y = np.array([float(r["toxic"]) for r in binned])
    n = np.array([float(r["count"]) for r in binned])
    total = n.sum()
    a, b = 1.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(n * (p - y) * x).sum() / total + 1e-4 * a, (n * (p - y)).sum() / total + 1e-6 * b])
        v = n * p * (1 - p) / total
        h = np.array([[(v * x * x).sum() + 1e-4, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _measured(docs: DataFrame, entries, exceptions, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``value``, the measure of ``text``."""
    spark = docs.sparkSession
    ship_package(spark)
    lexicon = spark.sparkContext.broadcast((entries, exceptions))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("value", T.DoubleType())])

    def run(batches):
        machine = build(*lexicon.value)
        for b in batches:
            v = [measure(machine, fold(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(v, pa.float64())], names=[*keep, "value"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that are only scored: crc32 of the key as text, modulo the folds."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``text`` and boolean ``toxic`` of the labelled documents not held out, of
    about 0.95 ``limit`` of them (chosen by a hash of the key) if there are more."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
             .agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).where("low = high")
             .select("doc_id", (F.col("low") == 1).alias("toxic")))
    known = pin(known, "toxic-known")
    rows = known.count()
    if rows > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(0.95 * limit / rows * (1 << 20)))
    # at most ``limit`` rows of a key and a flag
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``."""
    entries, exceptions, (a, b) = model
    out = _measured(docs, entries, exceptions, keep)
    return out.withColumn("score", 1 / (1 + F.exp(-(a * F.col("value") + b)))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")).drop("value")


def query(spark, sf_dir: str) -> DataFrame:
    from taskwatch.llm.common import read
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(pin(training_rows(docs, read(spark, sf_dir, "labels")), "toxic-train"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
