"""What a client knows about a family: watches and lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.operators.skew import broadcast_if_small, cut_lineage

KEYS = ["client_uid", "patent_family_id"]
PART_ROWS = 250_000


def active_sonars(sonars: DataFrame) -> DataFrame:
    """(client_uid, patent_family_id) watched at present, each once."""
    return sonars.where(F.col("deactivated_at").isNull()).select(*KEYS).distinct()


def list_memberships(lists: DataFrame, list_items: DataFrame) -> DataFrame:
    """(client_uid, patent_family_id, lists): the lists of a client that hold the family.

    An item on another client's list keeps its place with an empty name and uid. An entry carries
    how often it occurs, so a group has one entry per list of the client, however many items.

    Both shuffles have as many partitions as the items fill at PART_ROWS rows, so a task groups no more, whatever the
    number of items; left to adaptive execution a partition would be filled by its compressed bytes.
    """
    list_items = list_items.select(*KEYS, "list_uid")
    parts = max(1, math.ceil(list_items.count() / PART_ROWS))
    own = lists.select(F.col("uid").alias("list_uid"), "client_uid", "name", F.col("uid").alias("own_uid"))
    items = list_items.repartition(parts, *KEYS, "list_uid").groupBy(*KEYS, "list_uid").agg(F.count("*").alias("n"))
    entries = (
        items.join(broadcast_if_small(own), ["list_uid", "client_uid"], "left").repartition(parts, *KEYS)
        .groupBy(*KEYS, "name", "own_uid")
        .agg(F.sum("n").alias("times"))
    )
    entry = F.struct("name", F.col("own_uid").alias("list_uid"), "times")
    return entries.groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).alias("lists"))


def enrich(
    neighbours: DataFrame, fam: DataFrame, sonars: DataFrame, lists: DataFrame, list_items: DataFrame
) -> DataFrame:
    """Neighbours (client_uid, family_id, …) with family metadata, watch flag and lists of the client.

    Every join is a left join on a unique key, so no neighbour is lost or repeated. Only what the
    neighbours ask for is shuffled: families, watches and list items are cut down to their keys
    first, so the texts of all other families stay where they are if the keys fit a broadcast.
    """
    asked = cut_lineage(neighbours.withColumn("patent_family_id", F.col("family_id").cast("string")))
    keys = asked.select(*KEYS).distinct()
    wanted = broadcast_if_small(asked.select("patent_family_id").distinct())
    meta = fam.where(F.col("family_id").isNotNull()).select(
        F.col("family_id").alias("patent_family_id"),
        "title", "abstract", "family_authorities", "first_application_pub_date",
    ).join(wanted, "patent_family_id", "left_semi")
    watched = active_sonars(sonars.join(keys, KEYS, "left_semi")).withColumn("watched", F.lit(True))
    return (
        asked.join(meta, "patent_family_id", "left")
        .join(watched, KEYS, "left")
        .join(list_memberships(lists, list_items.join(keys, KEYS, "left_semi")), KEYS, "left")
        .withColumn("sonar_is_active", F.col("watched").isNotNull())
        .drop("watched", "patent_family_id")
    )
