"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written, written_at


def _settled(edges: DataFrame) -> bool:
    """Whether edges, each from a greater node u to a lesser v, are stars: each u has one edge, and no v has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()


def _with_least(edges: DataFrame) -> tuple[DataFrame, str]:
    """edges with m, the least neighbour of each u, and where these are written.

    min() is combined before the shuffle; the join reads its result from storage, so that Spark can
    split the edges of a hub among tasks.
    """
    least, path = written_at(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u"), path


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Nodes are of any orderable type. Each round hooks every node to a smaller one and is written to
    shared storage; what a round no longer needs is deleted. Nulls and self-loops are ignored; repeated
    edges count once; no edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    now, path = written_at(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _settled(now):
        both, least = _with_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large, larger = written_at(large.where("u != v").distinct(), "edges")
        # few nodes have many smaller neighbours after that
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        after, new = written_at(small, "edges")
        for old in (path, least, larger):
            discard(now.sparkSession, old)
        now, path = after, new
    roots = written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    discard(now.sparkSession, path)
    return roots


def joined_components(roots: DataFrame, more: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of roots(node, root) after further edges between nodes that are roots; the graph of roots is all that is walked again."""
    above = connected_components(more, left, right).toDF("root", "_above")
    return roots.join(above, "root", "left").select("node", F.coalesce("_above", "root").alias("root"))
