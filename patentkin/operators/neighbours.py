"""Exact nearest neighbours between a set of query vectors and a corpus.

Two ways to bring queries and corpus together, chosen by the measured size of the queries: few are
broadcast and the corpus is scanned in place; many travel through a metric index, each to the cells
that can hold one of its neighbours.

Over a large corpus that is scanned, a first search in a fixed part of it finds, for every query, a
score that its k-th neighbour reaches at least. Nothing below that score can be in the result, so the
tasks of the full search leave it out, and the shuffle no longer grows with the number of tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.operators.block_search import (
    CELL_BYTES, CELL_ROWS, TIE_DIGITS, Vectors, as_vectors, ranked_by_score, search_broadcast, search_cells, usable_vectors,
)
from patentkin.operators.metric_index import build_index, search_index
from patentkin.operators.skew import salt

BOUND_ROWS = 2_000_000  # corpus size from which a first search pays
BOUND_PART = 64  # one in so many corpus rows takes part in it
DIGITS = 4
QUERY_BYTES = 16 * 2**20  # of queries in double precision, which every Python worker of a scan holds


def odd_vectors(emb: DataFrame) -> DataFrame:
    """(id, dimension) of the vectors that a search leaves out, since most have another length."""
    usual = as_vectors(emb).dimension
    return usable_vectors(emb).where(F.size("embedding") != usual).select("id", F.size("embedding").alias("dimension"))


def vectors_for(ids: DataFrame, emb: DataFrame | Vectors) -> DataFrame:
    """(id, embedding) of the wanted ids that have a vector."""
    rows = emb.rows if isinstance(emb, Vectors) else usable_vectors(emb)
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def search(
    queries: DataFrame, emb: DataFrame | Vectors, k_max: int, n_queries: int,
    digits: int = TIE_DIGITS, skip_self: bool = False, broadcast_bytes: int = QUERY_BYTES, cell_rows: int | None = None,
) -> DataFrame:
    """(query_id, id, score, rank) by cosine for queries (query_id, k, embedding)."""
    corpus, dimension, count = emb = as_vectors(emb)
    queries = queries.where(F.size("embedding") == dimension)
    if n_queries * dimension * 8 > broadcast_bytes:
        return search_index(build_index(emb, cell_rows), queries, k_max, digits, skip_self)

    def find(asked: DataFrame, part: DataFrame) -> DataFrame:
        return ranked_by_score(search_broadcast(asked, part, "cosine", digits, skip_self), ["query_id"], k_max)

    asked = queries.withColumn("floor", F.lit(-math.inf))
    if count >= BOUND_ROWS:
        last = find(asked, corpus.where(salt(F.col("id"), BOUND_PART) == 0)).where(F.col("rank") == F.col("k"))
        bound = last.select("query_id", F.col("score").alias("bound"))
        asked = queries.join(bound, "query_id", "left").withColumn("floor", F.coalesce("bound", F.lit(-math.inf)))
    return find(asked, corpus).select("query_id", "id", "score", "rank")


def knn_by_id(
    seeds: DataFrame, emb: DataFrame | Vectors, k: int = 10, broadcast_bytes: int = QUERY_BYTES,
    cell_rows: int | None = None,
) -> DataFrame:
    """(seed_id, family_id, similarity, rank): the k nearest other families of every seed.

    A column `k` on the seeds asks for a number of its own per seed. Similarities are rounded
    to four digits before they are ranked. Seeds without a vector have no rows. `cell_rows` is the
    size of the cells that queries beyond `broadcast_bytes` are searched in.
    """
    emb = as_vectors(emb)
    depth = F.col("k").cast("int") if "k" in seeds.columns else F.lit(k)
    wanted = seeds.select(F.col("seed_id").cast("bigint").alias("id"), depth.alias("k"))
    wanted = wanted.groupBy("id").agg(F.max("k").alias("k"))
    size = wanted.agg(F.count("*").alias("n"), F.max("k").alias("k")).first()
    queries = emb.rows.join(wanted, "id").select(F.col("id").alias("query_id"), "k", "embedding")
    found = search(
        queries, emb, size["k"] or 0, size["n"], DIGITS, skip_self=True, broadcast_bytes=broadcast_bytes, cell_rows=cell_rows
    )
    return found.select(
        F.col("query_id").alias("seed_id"), F.col("id").alias("family_id"), F.col("score").alias("similarity"), "rank"
    )


def knn_by_vector(
    queries: DataFrame, emb: DataFrame | Vectors, n: int = 10, broadcast_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(query_id, id, distance, rank): the n nearest vectors of every query vector.

    A column `k` on the queries asks for a number of its own per query.
    """
    depth = F.col("k").cast("int") if "k" in queries.columns else F.lit(n)
    asked = queries.select("query_id", depth.alias("k"), "embedding").where(F.size("embedding") > 0)
    size = asked.agg(F.count("*").alias("n"), F.max("k").alias("k")).first()
    found = search(asked, emb, size["k"] or 0, size["n"], broadcast_bytes=broadcast_bytes)
    return found.select("query_id", "id", (F.lit(1.0) - F.col("score")).alias("distance"), "rank")


def knn_within(df: DataFrame, k: int, metric: str = "euclidean", cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(group, query_id, id, score, rank): nearest others inside the same group.

    A group whose vectors fit `cell_bytes` is one cell; a larger one is cut into blocks that meet pairwise.
    """
    points = df.select("group", "id", "embedding").where(F.size("embedding") > 0)
    blocks = F.greatest(
        F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum(F.size("embedding")) * 8 / cell_bytes)
    ).cast("int")
    sizes = points.groupBy("group").agg(blocks.alias("blocks"))
    blocked = points.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = blocked.select(
        "group", F.col("own").alias("g"), every.alias("h"), F.col("id").alias("query_id"), F.lit(k).alias("k"),
        F.lit(-math.inf).alias("floor"), "embedding",
    )
    right = blocked.select("group", every.alias("g"), F.col("own").alias("h"), "id", "embedding")
    found = search_cells(left, right, ["group", "g", "h"], metric, TIE_DIGITS, skip_self=True)
    return ranked_by_score(found, ["group", "query_id"], k).select("group", "query_id", "id", "score", "rank")
