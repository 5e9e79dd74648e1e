"""Narrow tables cut from their lineage in as many partitions as their rows fill."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from patentkin.operators.skew import cut_lineage

ROWS_PER_PART = 200_000


def cut_sized(df: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """`df` checkpointed, in partitions of about `rows_per_part` rows, never in more than it has.

    Rounds of an iteration shuffle tables that get smaller and smaller; in the partitions of the
    first round they would be mostly empty files. For rows of a few numbers only.
    """
    out = cut_lineage(df)
    return out.coalesce(max(1, math.ceil(out.count() / rows_per_part)))
