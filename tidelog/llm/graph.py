"""Connected components of an edge table, without gathering any node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import new_path, remove

#: Each round at least halves the depth of every tree, so this is never reached by real input.
MOST_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges (a > b): hang neighbours on the smallest node nearby.

    Large star: each node's larger neighbours go to the smallest of its neighbours and itself.
    Small star: each node and its smaller neighbours go to the smallest of them.
    Minima are found by partial aggregation, and handed back by a join whose large keys can be split.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionAll(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b longs): root is the smallest node that it can reach.

    Self loops and repeated edges do no harm; edges with a null end are ignored; no edges, no rows.
    Alternating star steps, each written to the shared folder, until the edges form stars.
    """
    spark = edges.sparkSession
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before, old = None, None
    for _ in range(MOST_ROUNDS):
        path = new_path(spark, "stars")
        _star(_star(now, True), False).write.parquet(path)
        now = spark.read.schema("a long, b long").parquet(path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if old:
            remove(spark, old)
        if tuple(state) == before:
            break
        before, old = tuple(state), path
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
