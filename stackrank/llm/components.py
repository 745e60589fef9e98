"""Connected components of an edge table by large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackrank.llm.common import written


def _digest(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node ``a`` of the edges (a, b) that is not its component's
    smallest node. Every round links each node to the smallest neighbour known; a
    component of m nodes needs about log2(m) rounds. Each round is written to the
    shared folder, and only the smallest neighbour of a node travels, so a node with
    very many edges makes no large group."""
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                               F.least("a", "b").alias("b")).distinct(), "cc")
    state = _digest(cur)
    while state[0]:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select(
            "a", F.least("a", "_m").alias("_m"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct())
        # small star: smaller neighbours and the node itself go to the smallest one
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = (large.join(low, "a").where("b <> _m")
                 .select(F.col("b").alias("a"), F.col("_m").alias("b")))
        cur = written(small.union(low.select("a", F.col("_m").alias("b"))).distinct(), "cc")
        new = _digest(cur)
        if new == state:
            break
        state = new
    return cur.select("a", F.col("b").alias("root"))
