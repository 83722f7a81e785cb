"""Connected components by alternating star contraction, as DataFrame joins and aggregates.

Every round halves the depth of the remaining trees.  The minimum of a node's neighbours is
found with map-side partial aggregation and sent back over a join that adaptive execution
splits at hot nodes, so a hub with a third of all edges never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.runtime import materialize, release


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def is_star_forest(edges: DataFrame) -> bool:
    """Whether every node points at one root and no root points on."""
    doubled = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    onward = edges.select(F.col("b").alias("a")).distinct().join(edges, "a", "left_semi")
    return doubled.isEmpty() and onward.isEmpty()


def star_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``a`` to the smallest node ``b`` of its component, for every node but that one.

    ``edges`` has two columns ``a``, ``b`` of one type; loops and repeated edges do not
    matter, edges with a NULL end are left out, an empty table gives no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if is_star_forest(e):
            return e
        nxt = materialize(_small_star(_large_star(e)), "edges")
        release(e)
        e = nxt
    raise RuntimeError("components did not settle")


def token_components(df: DataFrame, *, node: str, tokens: list) -> DataFrame:
    """Component of each node when nodes sharing any token belong together.

    ``tokens`` are columns (NULL relates nothing); values of different token columns never
    match each other.  Returns ``node`` and ``component`` (its smallest node), one row per
    distinct non-NULL node.
    """
    pairs = df.select(
        F.col(f"`{node}`").alias("node"),
        F.explode(
            F.array(*[F.when(t.isNotNull(), F.concat(F.lit(f"{i}:"), t.cast("string"))) for i, t in enumerate(tokens)])
        ).alias("token"),
    ).where("node is not null and token is not null")
    head = pairs.groupBy("token").agg(F.min("node").alias("b"), F.max("node").alias("z")).where("b < z")
    edges = pairs.join(head, "token").select(F.col("node").alias("a"), "b")
    forest = star_forest(edges)
    nodes = df.select(F.col(f"`{node}`").alias("node")).where("node is not null").distinct()
    return nodes.join(forest, nodes["node"] == forest["a"], "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )
