"""Filter interaction audit by incremental retraction streaming (operator 11).

Which filter removes what depends on the order of the filters. A document's
failures, one bit per filter, decide its fate in every order, so the number of
documents per part, failure mask and labels says all. Four filters look at a
text alone; the fifth, "an equal text has a smaller id", at the whole table.

All files of the table are processed as available-now micro-batches. Each row
becomes a digest of its text, its id, part and bits; rows that agree in all but
the id are combined while their smallest id and its number of rows are kept, so
a text that a third of all rows share reaches its key as a few rows per task.
The state is a table keyed by digest in the shared folder: the smallest id of
each text so far with the parts, bits and number of that id's rows. A micro-
batch joins its digests with the state. When a smaller id arrives, the rows
counted as originals are retracted from the part counters and counted again as
duplicates, and the new smallest id is appended to the state; nothing else of
it is written again. State and counter deltas are written per batch id, and a
batch reads the state of earlier ids alone, so a retried batch replaces its own
writes and repeats none. The counters are the sums of all deltas.

The audit follows from the counters, at most 128 rows a part: for each order
and step a mask is kept, removed here, or was removed earlier. Over all orders
a mask with c failures is removed by each of them in an equal share, 120 / c.

Defined results: a null text is an empty one; a null part is the empty string;
rows with equal ids and texts are no duplicates of each other; a row without an
id is no duplicate and makes none; labels are 1 if any row for the id says so;
an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import itertools
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taskwatch.llm.common import count_of, let, words
from taskwatch.session import drop_paths, pin, pinned_scope, scratch_path

#: micro-batches that all files are dealt to, about
BATCHES = 4
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
DUPLICATE, GOOD, TOXIC = BIT["E"], 1 << 5, 1 << 6
_CELL = "part string, bits int, n long"
_CELLS = "array<struct<part: string, bits: int, n: bigint>>"
_STATE = f"digest binary, low long, batch long, rows {_CELLS}"


def failures(text: Column) -> Column:
    """Bits of the filters A to D for a text."""
    t = F.coalesce(text, F.lit(""))

    def bit(f, ok):
        return F.when(ok, BIT[f]).otherwise(0)

    by_words = let(words(text), lambda ws: bit("A", F.size(ws) < 200)
                   + bit("B", 100 * F.size(F.array_distinct(ws)) < 50 * F.size(ws)))
    return by_words + bit("C", 100 * count_of(t, "[A-Z]+") > 3 * F.length(t)) + bit("D", t.rlike("[#$%&*|]"))


def label_bits(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, labels): one row per labelled id."""
    bit = {c: F.max((F.col(c) == 1).cast("int")) for c in ("quality", "toxic")}
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_label_id")).agg(
        (F.coalesce(bit["quality"], F.lit(0)) * GOOD + F.coalesce(bit["toxic"], F.lit(0)) * TOXIC).alias("_labels"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(digest, id, part, fails) of every row of ``docs``, a stream or not."""
    return docs.select(
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), F.col(key).cast("long").alias("id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"), failures(F.col(text)).alias("fails"))


def _cells(cells: Column, n, dup: bool = False) -> Column:
    """``cells`` with the number ``n(cell)`` each, as duplicates or as they are."""
    return F.transform(cells, lambda c: F.struct(
        c["part"].alias("part"), (c["bits"].bitwiseOR(F.lit(DUPLICATE)) if dup else c["bits"]).alias("bits"), n(c).alias("n")))


def merged(counted: DataFrame, state: DataFrame) -> DataFrame:
    """What a micro-batch does to each of its texts: (digest, low, rows, fresh,
    deltas). ``counted`` holds (digest, id, part, bits, n), one row per
    combination; ``state`` the rows that earlier batches wrote."""
    cells = counted.where(F.col("id").isNotNull()).groupBy("digest", "part", "bits").agg(
        F.sum("n").alias("n"), F.min(F.struct("id", F.col("n").alias("ns"))).alias("first"))
    texts = cells.groupBy("digest").agg(   # as many cells as parts and labels at most
        F.collect_list(F.struct("part", "bits", "n", "first")).alias("cells"), F.min("first.id").alias("here"))
    known = state.groupBy("digest").agg(F.min(F.struct("low", (-F.col("batch")).alias("age"), "rows")).alias("was"))
    t = texts.join(known, "digest", "left").withColumn("low", F.least("here", "was.low"))
    was = F.coalesce(F.col("was.rows"), F.expr(f"CAST(array() AS {_CELLS})"))
    fell = F.coalesce(F.col("here") < F.col("was.low"), F.lit(False))

    def open_rows(c):   # of a cell, those of the smallest id
        return F.when(c["first"]["id"] == F.col("low"), c["first"]["ns"]).otherwise(0).cast("long")

    opened = F.filter(_cells(F.col("cells"), open_rows), lambda c: c["n"] > 0)
    closed = _cells(F.col("cells"), lambda c: c["n"] - open_rows(c), dup=True)
    retracted = F.when(fell, F.concat(_cells(was, lambda c: -c["n"]), _cells(was, lambda c: c["n"], dup=True)))
    return t.select("digest", "low", F.when(fell, opened).otherwise(F.concat(was, opened)).alias("rows"),
                    (F.size(opened) > 0).alias("fresh"),
                    F.concat(opened, closed, F.coalesce(retracted, F.slice(was, 1, 0))).alias("deltas"))


class Retractor:
    """The ``foreachBatch`` function: updates the state and writes the deltas."""

    def __init__(self, labels: DataFrame, work: str):
        self.labels, self.state, self.deltas = labels, os.path.join(work, "state"), os.path.join(work, "deltas")
        spark = labels.sparkSession
        for path, schema in ((self.state, _STATE), (self.deltas, _CELL)):   # a first, empty batch
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(os.path.join(path, "of=-1"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with pinned_scope() as pinned:
            self._process(batch, batch_id)
        drop_paths(batch.sparkSession, pinned)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.join(self.labels, F.col("id") == F.col("_label_id"), "left").withColumn(
            "bits", (F.col("fails") + F.coalesce(F.col("_labels"), F.lit(0))).cast("int"))
        counted = pin(rows.groupBy("digest", "id", "part", "bits").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
        earlier = spark.read.schema(f"{_STATE}, of long").parquet(self.state).where(F.col("of") < batch_id)
        done = pin(merged(counted, earlier.drop("of")), "audit-texts")
        done.where("fresh").select("digest", "low", F.lit(batch_id).cast("long").alias("batch"), "rows") \
            .write.mode("overwrite").parquet(os.path.join(self.state, f"of={batch_id}"))
        deltas = done.select(F.inline("deltas")).unionByName(counted.where(F.col("id").isNull()).select("part", "bits", "n"))
        deltas.groupBy("part", "bits").agg(F.sum("n").alias("n")).where("n <> 0") \
            .write.mode("overwrite").parquet(os.path.join(self.deltas, f"of={batch_id}"))


def count_stream(docs: DataFrame, labels: DataFrame, work: str, **columns) -> str:
    """Run the stream ``docs`` over all that is available; the folder of the
    counter deltas (part, bits, n)."""
    retractor = Retractor(labels, work)
    query = (digests(docs, **columns).writeStream.foreachBatch(retractor)
             .option("checkpointLocation", os.path.join(work, "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    return retractor.deltas


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, **columns) -> DataFrame:
    """(part, bits, n) of the Parquet table at ``path``, whose files are
    processed as about ``batches`` micro-batches."""
    table = spark.read.parquet(path)
    files = -(-max(1, len(table.inputFiles())) // batches)
    folder, name = os.path.split(path.rstrip("/"))
    # a pattern that only the table itself matches: a stream's plain path must be a folder, a table may be one file
    stream = (spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
              .option("maxFileAge", "36500d").parquet(os.path.join(folder, f"{{{name}}}")))
    out = count_stream(stream, pin(label_bits(labels), "audit-labels"), scratch_path(spark, "audit"), **columns)
    deltas = spark.read.schema(_CELL).parquet(out)
    return deltas.groupBy("part", "bits").agg(F.sum("n").alias("n")).where("n <> 0")


def audit(counted: DataFrame) -> DataFrame:
    """One row per part, order and step from the counters of ``counters``."""
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(BIT[f]).alias("bit"),
                               F.lit(sum(BIT[g] for g in o[:i])).alias("before")) for o in ORDERS for i, f in enumerate(o)])
    x = counted.select("part", "bits", "n", F.inline(steps))
    fails, early = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    mask = F.col("bits").bitwiseAND(F.lit(sum(BIT.values())))
    here = fails & ~early
    share = F.lit(len(ORDERS)) / F.bit_count(mask)

    def total(which: Column, n: Column = F.col("n")) -> Column:
        return F.sum(F.when(which, n).otherwise(0)).cast("long")

    return x.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~early).alias("kept"), total(here).alias("removed"), total(fails & early).alias("redundant"),
        total(mask == F.col("bit")).alias("unique_fails"),
        total(here & (F.col("bits").bitwiseAND(F.lit(GOOD)) != 0)).alias("good_lost"),
        total(here & (F.col("bits").bitwiseAND(F.lit(TOXIC)) != 0)).alias("toxic_lost"),
        total(fails, (F.col("n") * share).cast("long")).alias("shapley"))


def query(spark, sf_dir: str) -> DataFrame:
    from taskwatch.llm.common import read
    # the counters are few rows; written, so that the audit does not sum them again when it is read twice
    return audit(pin(counters(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels")), "audit-counters"))
