"""Vectors held in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patentkin.functions.text import strip

_NUMBER = r"(?i)^[+-]?(\d+(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\z"


def parse_vector(text: Column) -> Column:
    """Vector from text such as `[1,2]`, `(1,2)` or `{1,2}`.

    Blank pieces are skipped; one piece that is no number makes the vector NULL.
    """
    bare = strip(text)
    wrapped = bare.rlike(r"(?s)^(\[.*\]|\(.*\)|\{.*\})\z")
    inner = F.when(wrapped, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    parts = F.filter(F.transform(F.split(inner, ","), strip), lambda p: p != "")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(_NUMBER), p.try_cast("double")))
    return F.when(~F.exists(numbers, lambda n: n.isNull()), numbers)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; NULL where one has no length.

    For single pairs. Search over a corpus goes through the block kernel in operators.neighbours.
    """
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)
