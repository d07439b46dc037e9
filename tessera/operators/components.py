"""Connected components of an edge table by alternating stars, each round one shuffle of the edges or two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import Table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or other) neighbours are tied to the least of its neighbourhood instead."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = F.col("b") > F.col("a")
    else:
        both, moved = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), F.lit(True)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = both.join(least, "a").where(moved)
    out = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("least").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (a, b).

    Ends when a round changes nothing, after some log(nodes) squared rounds at most; each round's edges are written to the shared folder. Nodes with very many
    edges are summed up before the shuffle (least) and joined by a plain equi-join, which Spark can split.
    """
    table = Table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        before, table = table, Table(_star(_star(table.df, large=True), large=False))
        before.drop()
        now = table.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == now:
            break
        seen = now
    edges = table.df
    tied = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tied.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
