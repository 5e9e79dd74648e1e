"""Text predicates and expressions on titles, abstracts and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW_OVERHEAD_BYTES = 32


def present(text: Column) -> Column:
    """The text without outer spaces, NULL where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def strip(text: Column) -> Column:
    """Text without outer white space of any kind (tabs, newlines, Unicode spaces)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def is_ready(family_id: Column, title: Column, abstract: Column) -> Column:
    """True where a family has a numeric id and both texts: it can be embedded.

    The plain NOT NULL tests are implied by the others; they are there to reach the file scan.
    """
    there = family_id.isNotNull() & title.isNotNull() & abstract.isNotNull()
    filled = present(title).isNotNull() & present(abstract).isNotNull()
    return there & family_id.rlike(r"^[0-9]+\z") & filled


def combined_text(title: Column, abstract: Column) -> Column:
    """Title and abstract as the one text that is embedded."""
    return F.concat(strip(title), F.lit("\n\n"), strip(abstract))


def row_size(title: Column, abstract: Column) -> Column:
    """Estimated stored bytes of one pending family."""
    return (F.octet_length(title) + F.octet_length(abstract) + F.lit(ROW_OVERHEAD_BYTES)).cast("long")


def safe_id(text: Column) -> Column:
    """A whole number, or NULL where the text is none."""
    return text.try_cast("bigint")
