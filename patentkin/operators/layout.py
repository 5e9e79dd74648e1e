"""Neighbour-graph layout: a map that keeps near points together.

After the published UMAP method (McInnes, Healy, Melville 2018): a weighted graph of nearest
neighbours, then points pulled along its edges and pushed apart where they crowd. All steps are
joins and grouped sums. Crowding is measured against the centres of grid cells, so no step
compares all pairs of a group. Nothing is random and forces are added as whole numbers, so two
runs give one map.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patentkin.operators.neighbours import knn_within
from patentkin.operators.skew import cut_lineage

RATE_STEPS = 48
MAX_STEP = 4.0
NEGATIVES = 5.0
INITIAL_SPREAD = 10.0
UNIT = 1e9


def _rate(beyond: Column, target: float) -> Column:
    """Rate at which the sum of exp(-beyond / rate) reaches the target, by bisection."""

    def narrow(state: Column, _: Column) -> Column:
        rate = state["rate"]
        total = F.aggregate(beyond, F.lit(0.0), lambda t, d: t + F.exp(-d / rate))
        low = F.when(total > target, state["low"]).otherwise(rate)
        high = F.when(total > target, rate).otherwise(state["high"])
        middle = F.when(high == math.inf, rate * 2).otherwise((low + high) / 2)
        return F.struct(low.alias("low"), high.alias("high"), middle.alias("rate"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(math.inf).alias("high"), F.lit(1.0).alias("rate"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(RATE_STEPS)), start, narrow, lambda s: s["rate"])


def neighbour_graph(df: DataFrame, n_neighbors: int = 3) -> DataFrame:
    """(group, src, dst, weight): symmetric neighbour graph of rows (group, id, embedding).

    `n_neighbors` counts the point itself, so each point names n_neighbors - 1 others. The weight of
    a named neighbour falls off with its distance beyond the nearest one, at a rate chosen per
    point so that the weights add up to log2(n_neighbors). Weights a and b of the two directions
    join as a + b - a*b.
    """
    near = knn_within(df, n_neighbors - 1).select(
        "group", F.col("query_id").alias("src"), F.sqrt(-F.col("score")).alias("distance"), F.col("id").alias("dst")
    )
    # A source has at most n_neighbors - 1 rows, so these arrays stay that short.
    points = near.groupBy("group", "src").agg(F.collect_list(F.struct("distance", "dst")).alias("near"))
    nearest = F.array_min(F.filter(F.transform("near", lambda n: n["distance"]), lambda d: d > 0))
    beyond = F.transform("near", lambda n: F.greatest(n["distance"] - F.coalesce("nearest", F.lit(0.0)), F.lit(0.0)))
    rated = (
        points.withColumn("nearest", nearest)
        .withColumn("beyond", beyond)
        .withColumn("rate", _rate(F.col("beyond"), math.log2(n_neighbors)))
    )
    directed = rated.select("group", "src", "rate", F.explode(F.arrays_zip("near", "beyond")).alias("edge")).select(
        "group",
        "src",
        F.col("edge.near.dst").alias("dst"),
        F.when(F.col("edge.beyond") > 0, F.exp(-F.col("edge.beyond") / F.col("rate"))).otherwise(1.0).alias("weight"),
    )
    turned = directed.select("group", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    shared = F.when(F.count("*") > 1, F.min("weight") * F.max("weight")).otherwise(0.0)
    return directed.unionByName(turned).groupBy("group", "src", "dst").agg((F.sum("weight") - shared).alias("weight"))


def curve(min_dist: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^2b) that best follows a flat top up to min_dist and exp(min_dist - d) beyond."""
    d = np.linspace(0.01, 3.0, 300)
    wanted = np.where(d < min_dist, 1.0, np.exp(min_dist - d))
    a_low, a_high, b_low, b_high = 0.1, 10.0, 0.3, 2.0
    best = (1.0, 1.0)
    for _ in range(6):
        a, b = np.meshgrid(np.linspace(a_low, a_high, 41), np.linspace(b_low, b_high, 41), indexing="ij")
        error = ((1.0 / (1.0 + a[..., None] * d ** (2 * b[..., None])) - wanted) ** 2).sum(-1)
        i, j = np.unravel_index(error.argmin(), error.shape)
        best = (float(a[i, j]), float(b[i, j]))
        a_step, b_step = (a_high - a_low) / 20, (b_high - b_low) / 20
        a_low, a_high = max(best[0] - a_step, 1e-3), best[0] + a_step
        b_low, b_high = max(best[1] - b_step, 1e-3), best[1] + b_step
    return best


def _exact_sum(force: Column) -> Column:
    """Sum that does not depend on the order of its rows."""
    return F.sum(F.round(force * UNIT).cast("bigint")) / UNIT


def _bounded(force: Column) -> Column:
    return F.greatest(F.least(force, F.lit(MAX_STEP)), F.lit(-MAX_STEP))


def _pull(graph: DataFrame, at: DataFrame, a: float, b: float) -> DataFrame:
    """(group, id, pull_x, pull_y, degree) along the edges of every point."""
    here = at.select("group", F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    there = at.select("group", F.col("id").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    square = dx * dx + dy * dy
    strength = F.when(
        square > 0, F.col("weight") * 2 * a * b * F.pow(square, F.lit(b - 1)) / (1 + a * F.pow(square, F.lit(b)))
    ).otherwise(0.0)
    return (
        graph.join(here, ["group", "src"])
        .join(there, ["group", "dst"])
        .groupBy("group", F.col("src").alias("id"))
        .agg(
            _exact_sum(_bounded(strength * dx)).alias("pull_x"),
            _exact_sum(_bounded(strength * dy)).alias("pull_y"),
            F.count("*").alias("degree"),
        )
    )


def _with_crowd(at: DataFrame) -> DataFrame:
    """Points with `crowd`, the centres and counts of the nine cells around them, and the group size."""
    placed = at.withColumns({"cx": F.floor("x"), "cy": F.floor("y")})
    cells = placed.groupBy("group", "cx", "cy").agg(
        F.count("*").alias("n"), _exact_sum(F.col("x")).alias("sum_x"), _exact_sum(F.col("y")).alias("sum_y")
    )
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = (
        cells.withColumn("ox", F.explode(step))
        .withColumn("oy", F.explode(step))
        .groupBy("group", (F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy"))
        # At most nine cells send here.
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(((F.col("ox") == 0) & (F.col("oy") == 0)).alias("own"), "n", "sum_x", "sum_y")
                )
            ).alias("crowd")
        )
    )
    sizes = cells.groupBy("group").agg(F.sum("n").alias("size"))
    return placed.join(around, ["group", "cx", "cy"]).join(sizes, "group")


def _push(axis: str, a: float, b: float) -> Column:
    """Push away from the crowd, each cell standing for its points (without the point itself)."""

    def one(cell: Column) -> Column:
        own = cell["own"].cast("int")
        n = cell["n"] - own
        dx = F.col("x") - (cell["sum_x"] - own * F.col("x")) / n
        dy = F.col("y") - (cell["sum_y"] - own * F.col("y")) / n
        square = dx * dx + dy * dy
        strength = 2 * b / ((0.001 + square) * (1 + a * F.pow(square, F.lit(b))))
        return F.when(n > 0, _bounded(strength * (dx if axis == "x" else dy)) * n).otherwise(0.0)

    total = F.aggregate("crowd", F.lit(0.0), lambda t, cell: t + one(cell))
    samples = NEGATIVES * F.coalesce("degree", F.lit(0))
    return _bounded(total * samples / F.col("size"))


def layout(graph: DataFrame, init: DataFrame, rounds: int = 10, min_dist: float = 0.1) -> DataFrame:
    """(group, id, x, y): the points of `init` moved by `graph` for a fixed number of rounds.

    Each round is checkpointed, so the plan does not grow and a lost executor costs one round.
    """
    a, b = curve(min_dist)
    graph = cut_lineage(graph.repartition("group", "src"))
    extent = init.groupBy("group").agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("extent"))
    scale = INITIAL_SPREAD / F.nullif(F.col("extent"), F.lit(0.0))
    at = init.join(extent, "group").select(
        "group", "id",
        F.coalesce(F.col("x") * scale, F.lit(0.0)).alias("x"),
        F.coalesce(F.col("y") * scale, F.lit(0.0)).alias("y"),
    )
    at = cut_lineage(at)
    for turn in range(rounds):
        pace = 1.0 - turn / rounds
        moved = _with_crowd(at).join(_pull(graph, at, a, b), ["group", "id"], "left")
        at = moved.select(
            "group", "id",
            *[
                (F.col(c) + pace * (_bounded(F.coalesce(f"pull_{c}", F.lit(0.0))) + _push(c, a, b))).alias(c)
                for c in ("x", "y")
            ],
        )
        at = cut_lineage(at)
    return at
