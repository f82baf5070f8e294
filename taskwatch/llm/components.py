"""Connected components of a link table, by hooking and pointer jumping.

Every round each node that is the larger end of a link hooks to its smallest
smaller neighbour, pointers are jumped until they end at roots, and the links
are contracted to the roots; links inside a component vanish. All tables are
pinned in the shared folder between rounds, nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskwatch.session import pin


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _roots(links: DataFrame) -> DataFrame:
    """``(node, root)`` of one hooking round over ``(lo, hi)``."""
    parents = pin(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "cc-hooks")
    while True:
        up = parents.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
        jumped = pin(parents.join(up, parents["root"] == up["_at"], "left").select(
            "node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "cc-jump")
        parents = jumped.select("node", "root")
        if not _some(jumped.where("moved")):
            return parents


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the smallest node of
    its component. Nodes may be of any type that can be ordered."""
    links = pin(_ordered(links), "cc-links")
    nodes = links.select(F.col("lo").alias("node")).union(links.select("hi")).distinct()
    found = pin(nodes.select("node", F.col("node").alias("root")), "cc-nodes")
    while _some(links):
        roots = _roots(links)
        r = roots.select(F.col("node").alias("_at"), F.col("root").alias("_root"))
        found = pin(found.join(r, found["root"] == r["_at"], "left").select(
            "node", F.coalesce("_root", "root").alias("root")), "cc-found")
        l = links.join(r, links["lo"] == r["_at"], "left").select(F.coalesce("_root", "lo").alias("a"), "hi")
        l = l.join(r, l["hi"] == r["_at"], "left").select("a", F.coalesce("_root", "hi").alias("b"))
        links = pin(_ordered(l), "cc-links")
    return found


def _ordered(links: DataFrame) -> DataFrame:
    """Links as distinct ``(lo, hi)`` without loops."""
    swap = F.col("a") > F.col("b")
    return links.where("a != b").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("lo"),
                                        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("hi")).distinct()
