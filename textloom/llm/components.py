"""Connected components by alternating stars, on edges that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import durable, sized


#: Edges for each partition between rounds, and partitions at least: a small graph needs few.
EDGES_EACH, LEAST_PARTITIONS = 100_000, 6


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges (a, b) with a > b.

    Large: each node points its larger neighbours to the least of its neighbours and itself.
    Small: each node points its smaller neighbours and itself to the least of those.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    pointed = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pointed.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of ``edges`` (a, b) with the least node it is connected to.

    Rounds go on until one changes nothing; their number grows with the logarithm of the size, and
    a round moves each edge a fixed number of times. Roots are nodes, so they have a row too. Edges
    with a null end or from a node to itself are left out.
    """
    now, n = sized(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), EDGES_EACH, LEAST_PARTITIONS)
    parts = max(LEAST_PARTITIONS, n // EDGES_EACH)
    state = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    before, mark = None, now.agg(state).first()[0]
    while mark["n"] and mark != before:
        now = durable(_stars(_stars(now, large=True).coalesce(parts), large=False).coalesce(parts))
        before, mark = mark, now.agg(state).first()[0]
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
