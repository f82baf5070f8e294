"""N-gram Jaccard join, size-aware (operator 10).

A document's set holds its distinct word n-grams; two documents are linked
when 100 * intersection >= percent * union. The result is exact: every row's
connected component, no link between different texts lost.

Documents with equal sets form one class; only classes are joined. Light and
heavy sets are found differently, as the size-aware join does:

* *Small sets* enumerate subsets of fixed sizes. Two sets of sizes n and m are
  linked only if they share c(n, m) elements, hence a subset of exactly that
  size; each small set emits all its subsets of the sizes it can need.
* *Large sets* go into inverted lists. Elements are ordered by their document
  frequency, rarest first, and a set of size n posts the first
  n - ceil(percent n / 100) + 1 of them: linked sets share one of these. The
  frequency is counted exactly, over all classes, for the elements whose hash
  lies in the lowest ``REGION`` of the hash range; the order is "inside the
  region by frequency, then the others by hash", and any order all sets agree
  on is lossless. Elements of one class alone are dropped at once.
* The *boundary* is the size at which the subsets emitted plus the list
  entries scanned cost least, from the histogram of sizes.

Scanning must not pair all members of a long list. Every class takes a centre,
the smallest member of its longest list, and is verified against it on the
full sets, which also gives its difference from the centre. Two classes with
one centre differ by the symmetric difference of their differences, so a
cluster is finished in blocks of ``BLOCK`` members on these short arrays:
only members not linked to the centre need it, and a block gives back at most
a spanning forest. Classes with different centres in one list are verified in
pairs, centres first, and only across components.

A passage that many otherwise different texts share makes one list, hence one
cluster, of classes that are not linked, and blocks of them would grow with the
square of their number. A cluster whose blocks would cost more than reading its
members' sets is therefore listed anew, by (centre, element): the frequencies
are now exact within the cluster for all elements, not only those of the region,
so the shared passage comes last and only sets that consist of common elements
almost throughout post any of it. What remains together goes through the same
steps (``LEVELS``), the last of which are the blocks.

Defined results: a null or empty text has an empty set, n_shingles 0, no link,
and itself as component; texts with fewer words than n are one shingle, their
whole sequence; a null key is returned as null and is never the smallest of a
component that has another; repeated rows are rows of one class; an empty
table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from taskwatch.llm import ragged
from taskwatch.llm.common import REC, carried
from taskwatch.llm.components import components
from taskwatch.operators.joins import attach
from taskwatch.session import pin, ship_package

BITS = 50
#: largest boundary that is considered
SMALL = 24
#: members of a cluster in one block
BLOCK = 128
#: times that a cluster is listed anew by the frequencies within it
LEVELS = 2


def region(percent: int) -> float:
    """Share of the hash range whose elements are counted: twice the share of
    a set that must be posted."""
    return min(1.0, 2 * (100 - percent) / 100)


def posted(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def overlap(n: int, m: int, percent: int) -> int:
    """Elements that linked sets of sizes n and m share at least."""
    return -(-percent * (n + m) // (100 + percent))


def subset_sizes(n: int, percent: int) -> list[int]:
    low, high = -(-percent * n // 100), 100 * n // percent
    return sorted({c for m in range(max(1, low), high + 1) if (c := overlap(n, m, percent)) <= min(n, m)})


def boundary(sizes: dict[int, int], reach: float, percent: int) -> int:
    """Largest size that enumerates subsets. ``sizes``: classes per size up to
    ``SMALL``; ``reach``: list entries met per posted element."""
    def subsets(n):
        return sum(math.comb(n, c) for c in subset_sizes(n, percent))

    def cost(x):
        first = -(-percent * (x + 1) // 100)  # sizes that large sets must meet in lists
        return (sum(k * subsets(n) for n, k in sizes.items() if n <= x)
                + sum(k * posted(n, percent) * reach for n, k in sizes.items() if n >= first))

    return min(range(SMALL + 1), key=lambda x: (cost(x), x))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (``BITS`` bits) of all rows, and offsets."""
    hashes, offsets = ragged.words(texts)
    h, row, _ = ragged.windows(hashes, offsets, (1,) * width)
    n = np.diff(offsets)
    for k in range(1, width):  # short texts: the whole sequence
        short = np.flatnonzero(n == k)
        whole = np.full(len(short), k, dtype=np.uint64)
        for j in range(k):
            whole = ragged.mix(whole ^ hashes[offsets[short] + j]) + np.uint64(k)
        h, row = np.concatenate((h, ragged.mix(whole))), np.concatenate((row, short))
    key = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
    count = np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=len(n))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate(([0], np.cumsum(count)))


def class_ids(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit id of each row's set; with its size it names the class."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(ragged.mix(values.astype(np.uint64) + np.uint64(7)), out=total[1:])
    return ragged.mix(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _take(values, offsets, counts) -> pa.Array:
    """List array of the first ``counts[i]`` values of each row."""
    start = np.repeat(offsets[:-1], counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + start
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()),
                                    pa.array(values[at], pa.int64()))


def _row():
    return F.xxhash64("doc_id", "text")


MAX_ROWS = 1 << (63 - BITS)


def _parts(texts: pa.Array):
    for first, part in ragged.row_slices(texts):
        for k in range(0, len(part), MAX_ROWS):
            yield first + k, part.slice(k, MAX_ROWS)


def sketch(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: ``doc_id, row, n, c`` and what it may post: ``stored`` (region
    first, ``inside`` of them in it) and ``small``, the whole set of small ones."""
    limit = int(region(percent) * (1 << BITS))

    def run(batches):
        for b in batches:
            for first, part in _parts(b.column(2)):
                values, offsets = shingle_sets(part, width)
                n = np.diff(offsets)
                total = np.concatenate(([0], np.cumsum(values < limit)))
                inside = total[offsets[1:]] - total[offsets[:-1]]
                need = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(part)), b.column(1).slice(first, len(part)),
                     pa.array(n.astype(np.int32)), pa.array(class_ids(values, offsets)),
                     pa.array(inside.astype(np.int32)), _take(values, offsets, np.maximum(inside, need)),
                     _take(values, offsets, np.where(n <= SMALL, n, 0))],
                    names=["doc_id", "row", "n", "c", "inside", "stored", "small"])

    return docs.select("doc_id", _row().alias("row"), "text").mapInArrow(
        run, "doc_id long, row long, n int, c long, inside int, stored array<long>, small array<long>")


def _subset_keys(classes: DataFrame, percent: int) -> DataFrame:
    """``(key, c, n)``: hashes of the fixed-size subsets of small sets."""
    from itertools import combinations

    def run(batches):
        for b in batches:
            keys, cs, ns = [], [], []
            for c, n, small in zip(*[x.to_pylist() for x in b.columns]):
                h = ragged.mix(np.array(small, dtype=np.uint64) + np.uint64(13))
                total = h.sum(dtype=np.uint64)
                for size in subset_sizes(n, percent):
                    gone = np.array(list(combinations(range(n), n - size)), dtype=np.int64).reshape(math.comb(n, size), n - size)
                    k = ragged.mix(total - h[gone].sum(axis=1, dtype=np.uint64) + np.uint64(size << 8)).view(np.int64)
                    keys.append(k)
                    cs.append(np.full(len(k), c, dtype=np.int64))
                    ns.append(np.full(len(k), n, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, cs, ns)],
                                                 names=["key", "c", "n"])

    return classes.select("c", "n", "small").mapInArrow(run, "key long, c long, n int")


def _lists(sketches: DataFrame, percent: int) -> DataFrame:
    """``(key, id)``: the inverted lists with two classes at least."""
    some = sketches.where("n > 0")
    sizes = {r["n"]: r["k"] for r in some.where(F.col("n") <= 2 * SMALL).groupBy("n").agg(
        F.count_distinct("c").alias("k")).collect()}
    entries, distinct = some.select(F.explode("stored").alias("e")).agg(
        F.count("e"), F.approx_count_distinct("e")).first()
    x = boundary(sizes, entries / max(distinct, 1), percent)
    classes = some.groupBy("c", "n").agg(F.first("inside").alias("inside"), F.first("stored").alias("stored"))
    limit = int(region(percent) * (1 << BITS))
    large = classes.where(F.col("n") >= -(-percent * (x + 1) // 100)).select("c", "n", "inside", F.explode("stored").alias("key"))
    # counted where the entries are, as a second shuffle of all keys, most of them of one class, costs
    # half as much disk again; a frequent key's rows pass one task, which spills them
    met = (large.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("key")))
           .where("df > 1").withColumn("out", F.col("key") >= limit))
    own = Window.partitionBy("c", "n", "out")
    need = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    large = (met.withColumns({"_multi": F.count(F.lit(1)).over(own),
                              "_rank": F.row_number().over(own.orderBy("df", "key"))})
             .where(F.col("out") | (F.col("inside") - F.col("_multi") + F.col("_rank") <= need)))
    small = _subset_keys(some.where(F.col("n") <= x).groupBy("c", "n").agg(F.first("small").alias("small")), percent)
    both = large.select("key", "c", "n").unionByName(small).distinct()
    return _counted(both, "size").select("key", F.struct("c", "n").alias("id"), "size")


def _counted(entries: DataFrame, name: str) -> DataFrame:
    """``entries`` of the keys that come more than once, with their number. Counted
    before they meet, so a frequent key is one row a task until it is joined."""
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)
    return entries.join(counts, "key")


def _lists_within(clusters: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``(key, id, size)``: inverted lists of the classes of ``clusters(id, centre)``, one
    per centre and element, each set's elements in the order of their number in the cluster."""
    sets = clusters.join(members, "id")
    entries = sets.select("id", F.explode("set").alias("e"), F.xxhash64("centre").alias("_at")).select(
        "id", F.xxhash64("_at", "e").alias("key"))
    met = _counted(entries, "df")
    n = F.col("id.n")
    # elements of one class alone come first in the order and are in no list
    own = Window.partitionBy("id")
    alone = n - F.count(F.lit(1)).over(own)
    need = n - F.floor((percent * n + 99) / 100) + 1
    met = met.withColumns({"_alone": alone, "_rank": F.row_number().over(own.orderBy("df", "key"))}).where(
        F.col("_alone") + F.col("_rank") <= need)
    return _counted(met.select("key", "id"), "size")


def _members(docs: DataFrame, sketches: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(id, set)`` of the wanted classes, from one row of each."""
    rows = (sketches.select("row", F.struct("c", "n").alias("id")).groupBy("id").agg(F.min("row").alias("row"))
            .join(wanted, "id").select("row"))

    def run(batches):
        for b in batches:
            for _, part in _parts(b.column(0)):
                values, offsets = shingle_sets(part, width)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(class_ids(values, offsets)), pa.array(n.astype(np.int32)), _take(values, offsets, n)],
                    names=["c", "n", "set"])

    chosen = attach(docs.select(_row().alias("row"), "text"), rows.withColumn("_hit", F.lit(True)), ["row"], how="inner")
    sets = chosen.select("text").mapInArrow(run, "c long, n int, set array<long>")
    return sets.dropDuplicates(["c", "n"]).select(F.struct("c", "n").alias("id"), "set")


def _linked(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


def _verify(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs(a, b)``, on the full sets."""
    left = members.select(F.col("id").alias("a"), F.col("set").alias("_x"))
    right = members.select(F.col("id").alias("b"), F.col("set").alias("_y"))
    t = pairs.join(left, "a").join(right, "b")
    return t.where(_linked(F.size(F.array_intersect("_x", "_y")), F.size("_x"), F.size("_y"), percent)).select("a", "b")


def _fits(a: str, b: str, percent: int):
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _in_blocks(edges: DataFrame, percent: int) -> DataFrame:
    """Links among classes of one centre with an unlinked member among them."""
    sums = edges.groupBy("centre").agg(
        F.sum((~F.col("linked")).cast("long")).alias("u"), F.sum(F.col("linked").cast("long")).alias("k")).where(
        (F.col("u") > 0) & (F.col("u") + F.col("k") > 1))
    # unlinked members fill blocks 0..ub-1, linked ones ub..ub+kb-1; an unlinked block meets every block
    t = attach(edges, sums.select("centre", F.ceil(F.col("u") / BLOCK).cast("int").alias("ub"),
                                  F.ceil(F.col("k") / BLOCK).cast("int").alias("kb")), ["centre"], how="inner")
    h = F.xxhash64("id")
    t = t.withColumn("at", F.when(F.col("linked"), F.col("ub") + F.pmod(h, F.greatest("kb", F.lit(1))))
                     .otherwise(F.pmod(h, F.col("ub"))).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.when(F.col("linked"), F.col("ub") - 1).otherwise(F.col("ub") + F.col("kb") - 1)))
    t = t.withColumn("with", partner).select(
        "centre", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "id", "at", "linked", "delta")

    def run(key, table):
        ids = table.column("id").combine_chunks()
        rows = table.num_rows
        out_schema = pa.schema([("ac", pa.int64()), ("an", pa.int32()), ("bc", pa.int64()), ("bn", pa.int32())])
        c, n = np.array(ids.field("c")), np.array(ids.field("n")).astype(np.int64)
        open_ = ~np.array(table.column("linked").to_pylist(), dtype=bool)
        delta = table.column("delta").combine_chunks()
        size = np.diff(np.array(delta.offsets))
        flat = np.array(delta.flatten())
        _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(count > 1)
        place = np.full(len(count), -1)
        place[shared] = np.arange(len(shared))
        row, col = np.repeat(np.arange(rows), size), place[element]
        row, col = row[col >= 0], col[col >= 0]
        common = np.zeros((rows, rows), dtype=np.float64)
        for lo in range(0, len(shared), 8192):  # bounded width of the incidence matrix
            here = (col >= lo) & (col < lo + 8192)
            m = np.zeros((rows, min(8192, len(shared) - lo)), dtype=np.float32)
            m[row[here], col[here] - lo] = 1
            common += m @ m.T
        apart = size[:, None] + size[None, :] - 2 * common
        both = (n[:, None] + n[None, :] - apart) / 2
        hit = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (open_[:, None] | open_[None, :])
        a, b = np.nonzero(np.triu(hit, 1))
        up = list(range(rows))

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        keep = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = root(x), root(y)
            if p != q:
                up[p] = q
                keep.append((x, y))
        x, y = np.array([k[0] for k in keep], dtype=np.int64), np.array([k[1] for k in keep], dtype=np.int64)
        return pa.Table.from_arrays([pa.array(c[x]), pa.array(n[x].astype(np.int32)), pa.array(c[y]),
                                     pa.array(n[y].astype(np.int32))], schema=out_schema)

    found = t.groupBy("centre", "i", "j").applyInArrow(run, "ac long, an int, bc long, bn int")
    return found.select(F.struct(F.col("ac").alias("c"), F.col("an").alias("n")).alias("a"),
                        F.struct(F.col("bc").alias("c"), F.col("bn").alias("n")).alias("b"))


def _centres(lists: DataFrame) -> DataFrame:
    """``(id, centre)``: the smallest member of a class's longest list,
    followed a few steps towards common centres."""
    least = lists.groupBy("key").agg(F.min("id").alias("centre"))
    t = lists.join(least, "key").groupBy("id").agg(
        F.min(F.struct((-F.col("size")).alias("s"), F.col("centre").alias("centre"))).alias("best"))
    t = pin(t.select("id", F.col("best.centre").alias("centre")), "ngram-centres")
    for _ in range(2):
        up = t.select(F.col("id").alias("_at"), F.col("centre").alias("_up"))
        t = pin(t.join(up, t["centre"] == up["_at"], "left").select(
            "id", F.coalesce("_up", "centre").alias("centre")), "ngram-centres")
    return t


def _costly(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(centre)`` of the clusters whose blocks hold more rows than their members' sets have elements."""
    sums = edges.groupBy("centre").agg(
        F.sum((~F.col("linked")).cast("long")).alias("u"), F.sum(F.col("linked").cast("long")).alias("k"),
        F.sum(F.col("id.n").cast("long")).alias("elements")).where(F.col("u") > BLOCK)
    ub, kb = F.ceil(F.col("u") / BLOCK), F.ceil(F.col("k") / BLOCK)
    return sums.where(F.col("u") * (ub + kb) + F.col("k") * ub > F.col("elements")).select("centre")


def class_links(docs: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """``(node, root)`` of the classes that are linked to another class."""
    lists = pin(_lists(sketches, percent), "ngram-lists")
    centres = _centres(lists)
    members = pin(_members(docs, sketches, centres.select("id"), width), "ngram-members")
    return _connect(lists, centres, members, percent, LEVELS)[1]


def _connect(lists: DataFrame, centres: DataFrame, members: DataFrame, percent: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """``(a, b)``, links that connect all classes which are linked and share a
    list, and their components ``(node, root)``."""
    spokes = centres.where(F.col("id") != F.col("centre"))
    x = members.select("id", F.col("set").alias("_x"))
    y = members.select(F.col("id").alias("centre"), F.col("set").alias("_y"))
    delta = F.concat(F.array_except("_x", "_y"), F.array_except("_y", "_x"))
    n, m = F.col("id.n"), F.col("centre.n")
    edges = pin(spokes.join(x, "id").join(y, "centre").withColumn("delta", delta).withColumn(
        "linked", _linked((n + m - F.size("delta")) / 2, n, m, percent)).drop("_x", "_y"), "ngram-edges")
    links = edges.where("linked").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    blocks = edges
    if levels:
        costly = pin(_costly(edges, members), "ngram-costly")
        if costly.limit(1).count():
            blocks = edges.join(costly, "centre", "left_anti")
            again = pin(_lists_within(edges.join(costly, "centre").select("id", "centre"), members, percent), "ngram-within")
            links = links.unionByName(_connect(again, _centres(again), members, percent, levels - 1)[0])
    # different centres that meet in a list: centres first, then members across components
    at = lists.select("key", "id").join(centres, "id")
    groups = pin(at.select("key", "centre").distinct(), "ngram-groups")
    g, h = groups.alias("g"), groups.alias("h")
    meet = pin(g.join(h, (F.col("g.key") == F.col("h.key")) & (F.col("g.centre") < F.col("h.centre"))).select(
        F.col("g.key").alias("key"), F.col("g.centre").alias("ca"), F.col("h.centre").alias("cb")), "ngram-meet")
    first = meet.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where(_fits("a", "b", percent)).distinct()
    links = pin(links.unionByName(_verify(first, members, percent)).unionByName(_in_blocks(blocks, percent)), "ngram-links")
    found = components(links)
    root = found.select(F.col("node").alias("id"), "root")
    at = at.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    left = at.select("key", F.col("centre").alias("ca"), F.col("id").alias("a"), F.col("root").alias("ra"))
    right = at.select("key", F.col("centre").alias("cb"), F.col("id").alias("b"), F.col("root").alias("rb"))
    rest = (meet.join(left, ["key", "ca"]).join(right, ["key", "cb"])
            .where((F.col("ra") != F.col("rb")) & _fits("a", "b", percent)).select("a", "b").distinct())
    more = pin(_verify(rest, members, percent), "ngram-more")
    if more.limit(1).count():
        links = links.unionByName(more)
        found = components(links)
    return links, found


def cluster(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, row, n_shingles, component_id`` of every row, and ``first``:
    whether its class and key are the ones a component keeps."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = pin(sketch(docs, width, percent), "ngram-sketches")
    found = class_links(docs, sketches, width, percent)
    ident = F.struct("c", "n")
    rows = sketches.select("doc_id", "row", "n", ident.alias("id"))
    classes = rows.where("n > 0").groupBy("id").agg(
        F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("least"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    roots = found.select(F.col("node").alias("id"), "root")
    grouped = classes.join(roots, "id", "left").where("root is not null or k > 1").withColumn(
        "root", F.coalesce("root", "id"))
    grouped = pin(grouped, "ngram-grouped")
    tops = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.min("best").alias("best"))
    named = grouped.select("id", "root").join(tops, "root").select(
        F.col("id.c").alias("c"), F.col("id.n").alias("n"), "component_id", F.col("best.row").alias("_best"), F.lit(True).alias("_in"))
    out = attach(rows.select("doc_id", "row", "n", F.col("id.c").alias("c")), named, ["c", "n"])
    return out.select(
        "doc_id", "row", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("_best"), F.lit(True)).alias("first"))


def query(spark, sf_dir: str) -> DataFrame:
    from taskwatch.llm.common import read
    return cluster(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id")


def distinct(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of every component, the one with the smallest key, with
    the columns it came with. Rows that repeat key and text count as one."""
    rows = pin(cluster(docs.select("doc_id", "text"), width, percent), "ngram-rows")
    seen = rows.groupBy("row").agg(F.count(F.lit(1)).alias("k"), F.min("first").alias("first"),
                                   F.max("n_shingles").alias("n"))
    # rows that go, and rows that come more than once, of which one stays
    odd = seen.where("(not first) or (k > 1 and n > 0)").select("row", F.col("first").alias("one"), F.lit(True).alias("odd"))
    row = F.xxhash64(F.col(f"{REC}.doc_id").cast("long"), f"{REC}.text")
    marked = attach(carried(docs).withColumn("row", row), odd, ["row"]).where("odd is null or one")
    rest = marked.where("odd is null").select(f"{REC}.*")
    once = marked.where("one").dropDuplicates(["row"]).select(f"{REC}.*")
    return rest.unionByName(once)
