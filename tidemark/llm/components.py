"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u")
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) of every node that some link names; root is the least node it reaches.

    ``links`` has columns u and v of one orderable type. The minimum of a
    neighbourhood is a partial aggregate and the join that spreads it has one
    row per node on one side, so a node with a third of all links is split.
    Every round is written, so the lineage is one round long. Links of a node
    to itself and repeated links do nothing; no links give no rows.
    """
    edges = ws.write(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    while True:
        # a star forest: no node has two roots, or is a root and has one
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("v", F.lit(0), F.lit(1))
        )
        odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if odd.where("up + down > 1").isEmpty():
            break
        after = ws.write(_small_star(_large_star(edges)), "star")
        ws.drop(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
