"""Request filters as predicates and joins on families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patentkin.functions.classification import normal_code
from patentkin.functions.names import normalize_applicant
from patentkin.operators.applicants import similar_names
from patentkin.operators.encoding import embed
from patentkin.operators.neighbours import knn_by_vector
from patentkin.operators.requests import documents
from patentkin.operators.skew import broadcast_if_small, store_columns as cut_lineage

FUZZY_THRESHOLD = 0.3
DATE_COLUMNS = {"publication": "first_application_pub_date", "grant": "first_grant_pub_date"}
NO_COLUMN = ("status", "language", "citationCount")


class UnsupportedFilter(ValueError):
    """A filter on something no table holds."""


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def in_date_range(field: str, start: str | None, end: str | None) -> Column:
    if field not in DATE_COLUMNS:
        raise UnsupportedFilter(f"no column holds the {field} date")
    date = F.col(DATE_COLUMNS[field])
    inside = date.isNotNull()
    if start:
        inside = inside & (date >= F.lit(start).cast("date"))
    if end:
        inside = inside & (date <= F.lit(end).cast("date"))
    return inside


def has_authority(values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap("family_authorities", _texts(values)), F.lit(False))


def has_kind(values: list[str]) -> Column:
    return F.coalesce(F.col("rep_kind").isin(*values), F.lit(False))


def names_any(column: str, values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(column, _texts(values)), F.lit(False))


def size_between(least: int | None, most: int | None) -> Column:
    size = F.coalesce(F.size("family_members"), F.lit(0))
    inside = F.lit(True)
    if least is not None:
        inside = inside & (size >= least)
    if most is not None:
        inside = inside & (size <= most)
    return inside


def mentions(word: str) -> Column:
    """The word occurs in title or abstract, ignoring case."""
    return F.contains(F.lower(F.concat_ws(" ", "title", "abstract")), F.lower(F.lit(word)))


def by_assignee(applicant_family: DataFrame, names: list[str], fuzzy: bool = False) -> DataFrame:
    """Families of the named applicants, by equal normal name or by shared trigrams.

    The trigrams are built once for every distinct applicant, not for each of its families.
    """
    spark = applicant_family.sparkSession
    given = spark.createDataFrame([(name,) for name in names], "name string")
    wanted = given.select(normalize_applicant(F.col("name")).alias("name"))
    if fuzzy:
        known = applicant_family.select(F.col("applicant").alias("name")).distinct()
        wanted = similar_names(wanted, known, FUZZY_THRESHOLD).select(F.col("b").alias("name"))
    wanted = wanted.where("name is not null").distinct()
    return applicant_family.join(wanted, F.col("applicant") == F.col("name"), "left_semi").select("family_id").distinct()


def by_code(index: DataFrame, code: str, depth: str = "exact") -> DataFrame:
    """Families under a classification code.

    exact: the code as written. subtree: the code and everything below, in normal spelling.
    children: families with a code one level below it.
    """
    if depth == "exact":
        return index.where(F.col("code") == code).select("family_id").distinct()
    norm = normal_code(F.lit(code))
    if depth == "subtree":
        return index.where(F.col("code") == norm).select("family_id").distinct()
    stem = F.regexp_replace(norm, "/00$", "/")
    level = (
        F.when(F.contains(norm, F.lit("/")), 4)
        .when(F.length(norm) == 1, 1)
        .when(F.length(norm) == 3, 2)
        .otherwise(3)
    )
    own = F.when(F.contains(F.col("code"), F.lit("/00")), 4).when(F.contains(F.col("code"), F.lit("/")), 5)
    own = own.when(F.length("code") == 1, 1).when(F.length("code") == 3, 2).otherwise(3)
    below = F.startswith(F.col("code"), stem) & (own == level + 1)
    return index.where(below).select("family_id").distinct()


def by_collection(list_items: DataFrame, uids: list[str]) -> DataFrame:
    """Families on any of the lists."""
    on_list = list_items.where(F.col("list_uid").cast("string").isin(*[str(u) for u in uids]))
    return on_list.select(F.col("patent_family_id").alias("family_id")).distinct()


def _keep(df: DataFrame, spec: dict, families: Callable[[list[str]], DataFrame]) -> DataFrame:
    if spec.get("include"):
        df = df.join(families(spec["include"]), "family_id", "left_semi")
    if spec.get("exclude"):
        df = df.join(families(spec["exclude"]), "family_id", "left_anti")
    return df


def _any_code(index: DataFrame, codes: list[str]) -> DataFrame:
    return index.where(F.col("code").isin(*codes)).select("family_id").distinct()


def apply_filters(
    fam: DataFrame, filters: dict, index: DataFrame, applicant_family: DataFrame, list_items: DataFrame
) -> DataFrame:
    """Families that pass the `filters` object of a request node."""
    for name in NO_COLUMN:
        if filters.get(name):
            raise UnsupportedFilter(f"no column holds {name}")
    out = fam
    if date := filters.get("date"):
        start = date.get("from") or date.get("from_")
        out = out.where(in_date_range(date.get("field") or "publication", start, date.get("to")))
    if authority := filters.get("authority"):
        out = out.where(has_authority(authority))
    if kinds := filters.get("kindCodes"):
        out = out.where(has_kind(kinds))
    if size := filters.get("familySize"):
        out = out.where(size_between(size.get("min"), size.get("max")))
    for word in filters.get("textMustContain") or []:
        out = out.where(mentions(word))
    for word in filters.get("textMustNotContain") or []:
        out = out.where(~mentions(word))
    for field, column in (("inventor", "inventors"), ("applicant", "applicants")):
        spec = filters.get(field) or {}
        if spec.get("include"):
            out = out.where(names_any(column, spec["include"]))
        if spec.get("exclude"):
            out = out.where(~names_any(column, spec["exclude"]))
    assignee = filters.get("assignee") or {}
    out = _keep(out, assignee, lambda names: by_assignee(applicant_family, names, bool(assignee.get("fuzzy"))))
    codes = {"include": filters.get("cpcInclude"), "exclude": filters.get("cpcExclude")}
    out = _keep(out, codes, lambda wanted: _any_code(index, wanted))
    return _keep(out, {"include": filters.get("collections")}, lambda uids: by_collection(list_items, uids))


def seed_documents(requests: DataFrame, make_predict_fn: Callable | None = None) -> DataFrame:
    """(job_uid, query_id, embedding, weight, k) of the documents given as seeds."""
    docs = documents(requests)
    vectors = embed(docs.withColumnRenamed("query_id", "family_id"), make_predict_fn)
    return docs.select("job_uid", "query_id", "weight", "k").join(
        vectors.withColumnRenamed("id", "query_id"), "query_id"
    )


def document_neighbours(docs: DataFrame, emb: DataFrame) -> DataFrame:
    """(job_uid, query_id, family_id, similarity): families near the given documents, similarity times weight.

    Equal vectors are searched once, at the greatest depth that one of their documents asks for.
    """
    docs = cut_lineage(docs.select("job_uid", "query_id", "weight", "k", "embedding"))
    again = broadcast_if_small(cut_lineage(docs.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id")))
    single, repeated = docs.join(again, "query_id", "left_anti"), docs.join(again, "query_id", "left_semi")
    texts = cut_lineage(single.groupBy("embedding").agg(F.min("query_id").alias("asked_id"), F.max("k").alias("k")))
    queries = texts.select(F.col("asked_id").alias("query_id"), "k", "embedding")
    # documents that share a query_id share its neighbours too, so these are searched as they are
    queries = queries.unionByName(repeated.select("query_id", "k", "embedding"))
    found = broadcast_if_small(cut_lineage(knn_by_vector(queries, emb).select(F.col("query_id").alias("asked_id"), "id", "distance", "rank")))
    asking = single.join(broadcast_if_small(texts.select("asked_id", "embedding")), "embedding").drop("embedding")
    asking = asking.unionByName(repeated.select("job_uid", "query_id", "weight", "k", F.col("query_id").alias("asked_id")))
    return asking.join(found, "asked_id").where(F.col("rank") <= F.col("k")).select(
        "job_uid", "query_id", F.col("id").alias("family_id"),
        ((F.lit(1.0) - F.col("distance")) * F.col("weight")).alias("similarity"),
    )
