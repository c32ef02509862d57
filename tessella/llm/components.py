"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, root) for every node of ``edges(u long, v long)``; root is the least node
    of its component. Loops and repeated edges do no harm; no edges give no rows.

    Each round's table is written to the shared folder, until one equals the last; the
    number of rounds grows with the logarithm of the nodes. A node's neighbours are only
    reduced to their minimum, never gathered, so that a hub costs no more than its
    edges; adaptive execution splits its join.
    """
    nodes = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = scratch.table(edges.where("u <> v").select(*nodes).distinct(), "cc")
    last = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join deals its own rows and a hub's can be split.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = scratch.table(least, "cc")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = scratch.table(small.where("u <> v").distinct(), "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    # Written, so that those who join it read even parts.
    return scratch.table(now.select("u", F.col("v").alias("root")).unionAll(roots), "cc-roots")
