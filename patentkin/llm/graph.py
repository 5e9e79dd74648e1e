"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.llm.sized import cut_sized

MAX_ROUNDS = 60


def _resolved(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none that has one is the lower end of another."""
    one, other = (F.struct(F.col(end).alias("u"), F.lit(down).alias("down")) for end, down in (("hi", 1), ("lo", 0)))
    ends = edges.select(F.inline(F.array(one, other)))
    roles = ends.groupBy("u").agg(F.sum("down").alias("downs"), F.min("down").alias("least"))
    return roles.agg(F.count_if((F.col("downs") > 1) | (F.col("downs") > 0) & (F.col("least") == 0)).alias("n")).first()["n"] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    one, other = (F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (("hi", "lo"), ("lo", "hi")))
    both = edges.select(F.inline(F.array(one, other)))
    # written out, so that the join can be split at a node with very many neighbours
    least = cut_sized(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    # a neighbour above the least is tied to it; the least itself keeps the node
    tied = F.struct(F.when(F.col("lo") > F.col("m"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("m").alias("lo"))
    return edges.join(least.hint("merge"), "hi").select(tied.alias("e")).select("e.*").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that occurs in `links` (a, b); the component is its least node.

    Links with a null end and loops are left out; repeated links and either direction are fine.
    Only one number a round comes to the driver, and no side of a join is broadcast. The rounds grow with the logarithm of the
    longest chain; every round is written to the shared checkpoint folder.
    """
    edges = cut_sized(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    for _ in range(MAX_ROUNDS):
        if _resolved(edges):
            break
        edges = cut_sized(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"links not resolved after {MAX_ROUNDS} rounds")
    tied = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return tied.unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
