"""Connected components of a list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import cut, drop_cut


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): the smallest node of its component.

    Links may repeat and point either way; a node linked with itself alone is its own root. Each round joins and
    aggregates by node; every step is written to the shared folder. A hub is only ever grouped by a minimum.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        # large star: larger neighbours hang on the smallest of node and neighbours
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node hang on the smallest of them
        down = large.filter("a > b")
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(root, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(small.unionByName(root.select("a", F.col("m").alias("b"))).distinct(), "edges")
        mark = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop_cut(edges)
        edges, same, last = new, mark == last, mark
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
