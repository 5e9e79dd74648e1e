"""Priorities that decide which publication speaks for its family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patentkin.functions.text import present

# Authorities from most to least preferred.
AUTHORITIES = (
    "EP", "WO", "US", "CN", "JP", "KR", "GB", "CA", "TW",
    "DE", "ES", "RU", "AU", "FR", "MX", "UA", "NZ",
)

# Rank of a kind code at the authorities with an order of their own.
EP_KINDS = {"B2": 1, "B3": 2, "B1": 3, "A1": 4, "A3": 5, "A2": 6, "B9": 9, "B8": 9, "A9": 9, "A8": 9}
WO_KINDS = {"A1": 1, "A3": 2, "A2": 3, "A4": 4}

UNLISTED = 99
UNLISTED_STRICT = 999


def authority_priority(authority: Column, strict: bool = False) -> Column:
    """Rank of an authority. The strict form compares case and keeps NULL."""
    known = F.expr("array({})".format(", ".join(f"'{a}'" for a in AUTHORITIES)))
    if strict:
        place = F.array_position(known, authority)
        return F.when(place == 0, F.lit(UNLISTED_STRICT)).otherwise(place).cast("int")
    place = F.array_position(known, F.upper(F.coalesce(authority, F.lit(""))))
    return F.when(place == 0, F.lit(UNLISTED)).otherwise(place).cast("int")


def kind_priority(authority: Column, kind: Column) -> Column:
    """Rank of a kind code: the authority's own order first, then grants before applications."""
    ranks = {f"EP {k}": r for k, r in EP_KINDS.items()} | {f"WO {k}": r for k, r in WO_KINDS.items()}
    table = F.expr("map({})".format(", ".join(f"'{k}', {r}" for k, r in ranks.items())))
    own = F.try_element_at(table, F.concat(F.upper(authority), F.lit(" "), kind))
    letter = F.upper(F.substring(kind, 1, 1))
    general = (
        F.when(letter == "B", 1)
        .when(kind == "A1", 2)
        .when(letter == "A", 3)
        .otherwise(UNLISTED)
    )
    return F.coalesce(own, general).cast("int")


def content_priority(title: Column, abstract: Column) -> Column:
    """How many of the two texts are missing: 0, 1 or 2."""
    return present(title).isNull().cast("int") + present(abstract).isNull().cast("int")
