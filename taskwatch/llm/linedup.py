"""Line dedup by distinct-site spread (operator 6, native).

A line (text between ``\\n``, outer white space trimmed) that stands on many
different sites is boilerplate. Sites are counted per line hash with
HyperLogLog sketches: partial sketches merge by aggregation, so a line that a
third of all documents hold costs each task one sketch. Lines whose estimate
is near the threshold (within ``BAND``, over ten standard errors) get an exact
distinct count; below the band they stay, above it they are boilerplate.

A document then loses its boilerplate lines, unless they hold more than half
of its words: such a document is a copy of others rather than a page with a
menu, and copies are for the near-duplicate stage to judge as a whole.

Lines are known by two hashes (96 bits); a document's hits travel as hashes
and meet its text in one join on the document key. Keys that repeat are safe:
being boilerplate is a property of the line, so hits of one row hold for all
rows of that key.

Defined results: a null text has no lines and stays null; a null site counts
as one site of its own; lines without a word are never boilerplate and never
removed; a null key is a key like any other; extra columns are passed
through. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskwatch.llm.common import NOT_WS, REC, carried, fresh, read, words
from taskwatch.session import pin

#: lines on at least so many different sites are boilerplate
MIN_SITES = 8
#: a document whose boilerplate holds more than this share of its words stays whole
MAX_SHARE = 0.5
#: relative distance from the threshold within which sites are counted exactly
BAND = 0.2
LG_K = 12


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def line_hashes(text: Column) -> Column:
    """Distinct hashes of the worded lines of ``text``."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_WS))
    return F.array_distinct(F.transform(lines, lambda x: _line_key(_trim(x))))


def _trim(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def boilerplate(hashes: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(a, b)`` of the lines on at least ``min_sites`` sites; ``hashes`` has
    one row ``(line, site)`` per document and distinct line."""
    site = F.coalesce(F.concat(F.lit("="), F.col("site")), F.lit("null"))
    spread = (hashes.groupBy("line.a", "line.b")
              .agg(F.hll_sketch_agg(site, F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_sites)
              .select("a", "b", F.hll_sketch_estimate("sketch").alias("sites")))
    spread = pin(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "line-spread")
    near = spread.where(F.col("sites") < min_sites * (1 + BAND)).select("a", "b")
    exact = (hashes.select("line.a", "line.b", site.alias("site")).join(near, ["a", "b"], "left_semi")
             .distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("sites"))
             .where(F.col("sites") >= min_sites).select("a", "b"))
    return spread.where(F.col("sites") >= min_sites * (1 + BAND)).select("a", "b").unionByName(exact)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source",
           min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` (worded lines before) and
    ``n_removed`` (lines taken out)."""
    hashes = pin(docs.select(F.col(key).alias("key"), F.col(site).cast("string").alias("site"),
                             F.explode(line_hashes(F.col(text))).alias("line")), "line-hashes")
    found = pin(boilerplate(hashes, min_sites), "line-found")
    k, h, b, g = (fresh(docs, x) for x in ("_key", "_hits", "_bad", "_goes"))
    hits = (hashes.select("key", F.col("line.a").alias("a"), F.col("line.b").alias("b"))
            .join(found, ["a", "b"]).groupBy(F.col("key").alias(k)).agg(F.collect_set(F.struct("a", "b")).alias(h)))
    out = docs.join(hits, docs[key].eqNullSafe(hits[k]), "left").drop(k)
    lines = F.split(F.col(text), "\n")
    bad = F.filter(lines, lambda x: x.rlike(NOT_WS) & F.array_contains(h, _line_key(_trim(x))))
    out = out.withColumn(b, F.when(F.col(h).isNull() | F.col(text).isNull(), F.array().cast("array<string>")).otherwise(bad))
    lost = F.size(words(F.array_join(b, "\n")))
    out = out.withColumn(g, (F.size(b) > 0) & (lost <= MAX_SHARE * F.size(words(F.col(text)))))
    left = F.array_join(F.filter(lines, lambda x: ~F.array_contains(b, x)), "\n")
    return out.withColumns({
        "n_lines": F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(NOT_WS))), F.lit(0)).cast("long"),
        "n_removed": F.when(F.col(g), F.size(b)).otherwise(0).cast("long"),
        "clean_text": F.when(F.col(g), left).otherwise(F.col(text))}).drop(h, b, g)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("clean_text").cast("long").alias("n_chars"),
                      F.sha2(F.encode("clean_text", "UTF-8"), 256).alias("text_sha256"))


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents with boilerplate lines taken out, with the columns they came
    with; ``n_chars`` follows the text."""
    out = remove(carried(docs), f"{REC}.doc_id", f"{REC}.text", f"{REC}.source")
    changed = {"text": F.col("clean_text"), "n_chars": F.when(
        F.col("n_removed") > 0, F.length("clean_text").cast("long")).otherwise(F.col(f"{REC}.n_chars"))}
    return out.select(*[changed.get(c, F.col(f"{REC}.`{c}`")).alias(c) for c in docs.columns])
