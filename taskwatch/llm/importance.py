"""Target-distribution importance resampling by batch concatenation (operator 13).

Documents are drawn by how much likelier their words are in a target corpus
than in the raw one. Features are hashed into buckets; a bucket's gain is the
log ratio of its smoothed shares in the two corpora, a document's weight the
sum of its features' gains, and adding Gumbel noise to the weights and taking
the highest scores draws without replacement in proportion to the weights.

Features of many texts are found together: a slice of texts is joined with
separator bytes that no word holds, one pass of a regular expression finds all
words, ``searchsorted`` of the texts' offsets over the words' places says which
text a word belongs to, runs of words that reach into the next text are masked,
and ``bincount`` counts the rest, over buckets for a corpus and over texts for
the documents. A run's checksum goes on from that of the run one word shorter,
so no run is put together as a string. A text longer than a slice is cut
between words, and the last words of one piece go before the next, so that no
run is lost and none is counted twice.

The texts are read twice, once to count and once to weigh. Every task passes on
at most one row per bucket. The gains, one number per bucket, reach the driver
and are broadcast. Ranks come from one range partitioning of the weighed rows
(``prefix.global_row_number``), whatever the number drawn.

Defined results: a null or empty text has no feature and weight 0; a null key
draws its noise as an empty string and loses ties; repeated rows are drawn
independently but share their noise; with an empty target, gains follow from
the smoothing alone; extra columns of the input play no part.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taskwatch.llm.ragged import row_slices
from taskwatch.operators.prefix import global_row_number
from taskwatch.session import ship_package

BUCKETS = 10_000
#: longest run of words that is a feature
RUN = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: bytes of text that are joined at once
SLICE = 4 << 20

#: runs of bytes that are ASCII digits, small letters or no ASCII (fixed value)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: stands between texts and is part of no word
SENTINEL = b"\n"


def features(texts: list[bytes], run: int = RUN, before: list[bytes] | None = None):
    """``(text, checksum, order, words)``: the text each feature lies in, its
    CRC-32, its number of words, all runs of 1 to ``run`` words; and the words
    found. Texts have lower case already. ``before`` holds words that precede
    the first text: runs may begin among them, but must end after them."""
    lead = list(before or [])
    head = SENTINEL.join(lead) + SENTINEL if lead else b""
    joined = head + SENTINEL.join(texts)
    words, starts = [], []
    for m in WORD.finditer(joined):
        words.append(m.group())
        starts.append(m.start())
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = len(head) + np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
    text = np.maximum(np.searchsorted(offsets, np.array(starts, dtype=np.int64), side="right") - 1, 0)
    sums = list(map(zlib.crc32, words))
    out = [(text, np.array(sums, dtype=np.int64))]
    for k in range(1, run):
        # the run that starts one word earlier, continued by this word
        sums = [zlib.crc32(b" " + w, s) for w, s in zip(words[k:], sums)]
        out.append((text[k:], np.array(sums, dtype=np.int64)))
    found = []
    for k, (end, crc) in enumerate(out):
        ok = np.arange(k, len(words)) >= len(lead)
        ok &= text[:len(end)] == end
        found.append((end[ok], crc[ok], np.full(ok.sum(), k + 1)))
    return (*(np.concatenate(c) for c in zip(*found)), words)


def _slices(column: pa.Array, run: int):
    """``(first row, rows, text, checksum, order)`` of consecutive slices; a
    text longer than ``SLICE`` gives several slices of its row alone."""
    for at, part in row_slices(column, SLICE):
        texts = [(t or "").encode().lower() for t in part.to_pylist()]
        if len(texts) > 1 or len(texts[0]) <= SLICE:
            yield at, len(part), *features(texts, run)[:3]
            continue
        long, lo, before = texts[0], 0, []
        while lo < len(long):
            gap = GAP.search(long, lo + SLICE) if lo + SLICE < len(long) else None
            hi = gap.end() if gap else len(long)
            text, crc, order, words = features([long[lo:hi]], run, before)
            yield at, 1, text, crc, order
            before, lo = (words[-(run - 1):] if run > 1 else []), hi


def bucket_counts(docs: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the features of ``docs`` fall into each bucket."""
    ship_package(docs.sparkSession)

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, _, _, crc, _ in _slices(b.column(0), run):
                total += np.bincount(crc % buckets, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["bucket", "n"])

    return docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, in thousandths, from two tables of ``bucket_counts``."""
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    rows = raw.select("bucket", "n", F.lit(0).alias("side")).unionByName(target.select("bucket", "n", F.lit(1).alias("side")))
    for r in rows.collect():   # two rows a bucket at most
        (t if r["side"] else s)[r["bucket"]] = r["n"]
    s_all, t_all = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s_all + buckets) / ((a + 1) * (t_all + buckets))))
                     for a, b in zip(s.tolist(), t.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(key, n_words, n_features, weight) of every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    table, buckets = spark.sparkContext.broadcast(gain), len(gain)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long"

    def weigh(batches):
        for b in batches:
            out = np.zeros((3, b.num_rows), dtype=np.int64)
            for at, n, doc, crc, order in _slices(b.column(1), run):
                rows = out[:, at:at + n]
                rows[0] += np.bincount(doc[order == 1], minlength=n)
                rows[1] += np.bincount(doc, minlength=n)
                # sums of whole numbers far below 2 ** 53 are exact in doubles
                rows[2] += np.bincount(doc, weights=table.value[crc % buckets], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=[key, "n_words", "n_features", "weight"])

    return docs.select(key, text).mapInArrow(weigh, schema)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of seed and key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN,
              buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of
    ``docs``; ``rank`` is null where a row is not drawn."""
    gain = gains(bucket_counts(docs, text, run, buckets), bucket_counts(target, text, run, buckets), buckets)
    rows = weighed(docs, gain, key, text, run).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    # rows that can be drawn first, best first; a null key loses ties
    rows = rows.withColumns({"_closed": F.col("n_words") < min_words, "_down": -F.col("score"), "_last": F.col(key).isNull()})
    numbered = global_row_number(rows, ["_closed", "_down", "_last", key, "n_words", "n_features"], "_row")
    k = numbered.agg(F.count_if(~F.col("_closed")).alias("n")).first()["n"] * percent // 100
    return numbered.select(key, "n_words", "n_features", "weight", "score",
                           F.when(~F.col("_closed") & (F.col("_row") <= k), F.col("_row")).cast("long").alias("rank"))


def query(spark, sf_dir: str) -> DataFrame:
    from taskwatch.llm.common import read
    out = resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
