"""Publications rolled up into patent families.

Every column of a family is one aggregate over its publications, so a family costs one shuffle of
its rows. Families with very many rows are aggregated in salted parts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patentkin.functions.priority import authority_priority, content_priority, kind_priority
from patentkin.operators.skew import HOT_ROWS, cut_lineage, hot_keys, salt

CPC_WIDTH = 200
SALTS = 256


def score(pubs: DataFrame) -> DataFrame:
    """Publications with their three priorities."""
    return pubs.withColumns(
        {
            "authority_priority": authority_priority(F.col("authority")),
            "kind_priority": kind_priority(F.col("authority"), F.col("kind")),
            "content_priority": content_priority(F.col("title"), F.col("abstract")),
        }
    )


def _order(*priorities: str) -> str:
    """Sort key of a publication: priorities, newest first, then number and id; NULLs last."""
    parts = [*priorities]
    for value in ("-unix_date(publication_date)", "doc_number", "id"):
        parts += [f"{value} IS NULL", value]
    return "struct({})".format(", ".join(f"{p} AS k{i}" for i, p in enumerate(parts)))


def _in_family(value: str) -> str:
    # Rows without a family have no member list, authorities, dates or unions.
    return f"CASE WHEN family_id IS NOT NULL THEN {value} END"


def representative() -> Column:
    """The publication that speaks for the family, with its sort key."""
    key = _order("authority_priority", "kind_priority", "content_priority")
    return F.expr(f"min(struct({key} AS key, id, authority, kind, publication_date, title, abstract))")


def members() -> Column:
    """Publication ids with what they are sorted by."""
    member = "struct(publication_date IS NULL AS undated, publication_date AS date, id)"
    return F.expr(f"collect_list({_in_family(member)})")


def authorities() -> Column:
    """Distinct authorities with their rank."""
    known = "CASE WHEN authority IS NOT NULL THEN struct(authority_priority AS rank, authority) END"
    return F.expr(f"collect_set({_in_family(known)})")


def first_date(prefix: str) -> Column:
    """Earliest publication whose kind starts with the letter."""
    return F.expr(f"min(publication_date) FILTER (WHERE family_id IS NOT NULL AND startswith(kind, '{prefix}'))")


def union_of(values: str) -> Column:
    """Distinct elements of an array column; NULL elements stay."""
    return F.expr(f"array_distinct(flatten(collect_set({_in_family(values)})))")


def best_text(column: str) -> Column:
    """Text of the best publication that has one, with its sort key."""
    key = _order("authority_priority", "kind_priority")
    return F.expr(
        f"min(struct({key} AS key, {column} AS text)) FILTER (WHERE family_id IS NOT NULL AND trim({column}) <> '')"
    )


def _parts() -> list[Column]:
    parts = {
        "rep": representative(),
        "members": members(),
        "authorities": authorities(),
        "first_application_pub_date": first_date("A"),
        "first_grant_pub_date": first_date("B"),
        "cpc": union_of(f"transform(cpc_classes, c -> left(c, {CPC_WIDTH}))"),
        "applicants": union_of("applicants"),
        "inventors": union_of("inventors"),
        "best_title": best_text("title"),
        "best_abstract": best_text("abstract"),
    }
    return [column.alias(name) for name, column in parts.items()]


def _merged_parts() -> list[Column]:
    """Aggregates that put salted parts of one family together."""
    least = ("rep", "first_application_pub_date", "first_grant_pub_date", "best_title", "best_abstract")
    union = ("authorities", "cpc", "applicants", "inventors")
    return [
        *[F.expr(f"min({name}) AS {name}") for name in least],
        *[F.expr(f"array_distinct(flatten(collect_list({name}))) AS {name}") for name in union],
        F.expr("flatten(collect_list(members)) AS members"),
    ]


def _finish(parts: DataFrame) -> DataFrame:
    return parts.selectExpr(
        "family_id",
        _in_family("transform(array_sort(members), m -> m.id)") + " AS family_members",
        "nullif(transform(array_sort(authorities), a -> a.authority), array()) AS family_authorities",
        "coalesce(nullif(trim(rep.title), ''), best_title.text) AS title",
        "coalesce(nullif(trim(rep.abstract), ''), best_abstract.text) AS abstract",
        "array_sort(cpc) AS cpc",
        "array_sort(applicants) AS applicants",
        "array_sort(inventors) AS inventors",
        "first_application_pub_date",
        "first_grant_pub_date",
        "rep.id AS rep_id",
        "rep.authority AS rep_authority",
        "rep.kind AS rep_kind",
        "rep.publication_date AS rep_pub_date",
    )


def rollup(scored: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per family, from one scan of the publications besides a count of their family ids.

    Rows are shuffled once and aggregated where they arrive, so each text travels once. A family
    above `hot_rows` rows, of which there are few, is dealt to SALTS groups on the same shuffle; only the
    reduced rows of these groups travel again.
    """
    parts = _parts()
    hot = cut_lineage(hot_keys(scored, "family_id", hot_rows).withColumn("hot", F.lit(True)))
    if hot.isEmpty():
        return _finish(scored.repartition("family_id").groupBy("family_id").agg(*parts))
    # at most rows / hot_rows keys
    marked = scored.join(F.broadcast(hot), F.col("family_id").eqNullSafe(F.col("hot_key")), "left")
    dealt = marked.withColumn("salt", F.when(F.col("hot"), salt(F.col("id"), SALTS)))
    reduced = cut_lineage(dealt.repartition("family_id", "salt").groupBy("family_id", "salt").agg(*parts))
    merged = reduced.where("salt is not null").groupBy("family_id").agg(*_merged_parts())
    return _finish(reduced.where("salt is null")).unionByName(_finish(merged))
