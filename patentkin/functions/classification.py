"""Expansion of one classification code into its ancestors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION, CLASS, SUBCLASS, MAIN_GROUP, SUBGROUP = 1, 2, 3, 4, 5


def normal_code(code: Column) -> Column:
    return F.upper(F.replace(code, F.lit(" "), F.lit("")))


def parent_code(code: Column) -> Column:
    """The code one level up in normal spelling: subgroup, main group, subclass, class, section; NULL above that."""
    stem = F.substring_index(code, "/", 1)
    is_group, main = F.contains(code, F.lit("/")), F.endswith(code, F.lit("/00"))
    return (
        F.when(is_group & ~main, F.concat(stem, F.lit("/00")))
        .when(is_group, F.substr(stem, F.lit(1), F.lit(4)))
        .when(F.length(code) == 4, F.substr(code, F.lit(1), F.lit(3)))
        .when(F.length(code) == 3, F.substr(code, F.lit(1), F.lit(1)))
    )


def cpc_pieces(code: Column, group_digits: int = 3) -> Column:
    """Section, class, subclass, main group and subgroup of a raw code, as array<struct<code, hier_rank>>.

    Main groups keep `group_digits` digits; 3 cuts four-digit groups, 4 keeps them.
    """
    norm = normal_code(code)

    def prefix(pattern: str) -> Column:
        return F.regexp_substr(norm, F.lit(pattern))

    pieces = (
        (prefix(r"^[A-HY]"), SECTION),
        (prefix(r"^[A-HY]\d{2}"), CLASS),
        (prefix(r"^[A-HY]\d{2}[A-Z]"), SUBCLASS),
        (F.concat(prefix(r"^[A-HY]\d{2}[A-Z]\d{1,%d}" % group_digits), F.lit("/00")), MAIN_GROUP),
        (F.when(F.contains(norm, F.lit("/")), norm), SUBGROUP),
    )
    structs = F.array(*[F.struct(c.alias("code"), F.lit(r).alias("hier_rank")) for c, r in pieces])
    return F.filter(structs, lambda p: p["code"].isNotNull())
