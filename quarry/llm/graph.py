"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import adopt, materialise, recording, release


def components(edges: DataFrame) -> DataFrame:
    """node and its root, the least node it is connected to, for all nodes of edges (a, b).

    Each round links every node's larger neighbours to its least neighbour, then its smaller ones; rounds end when the
    edges no longer change, after about the logarithm of a component's diameter. A round is a table in the shared
    folder. Minima are aggregated before the shuffle, so a node with very many edges is no hot group. Null ends and
    loops are left out; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    with recording() as old:
        now = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small_least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(small_least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e"))
        with recording() as new:
            now = materialise(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        release(spark, old)
        old = new
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    adopt(old)
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
