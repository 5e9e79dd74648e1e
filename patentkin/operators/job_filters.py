"""Filters of many jobs at once, as a relational division.

The filters of a job become rows, one for each condition. What families hold becomes rows too, and
the two meet in joins; a family passes where the conditions it met are as many as its job asked
for and none that the job ruled out is among them. No plan is built per job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patentkin.functions.names import normalize_applicant
from patentkin.operators.applicants import applicant_family, similar_names
from patentkin.operators.filters import FUZZY_THRESHOLD
from patentkin.operators.requests import whole_number
from patentkin.operators.skew import broadcast_if_small, store_columns as cut_lineage

CONDITION = "struct<kind:string,negative:boolean,fuzzy:boolean,wanted:array<string>,low:string,high:string>"
ROW_KINDS = ("publication", "grant", "size", "text")
TRUE_TEXTS = ("true", "1", "1.0", "yes", "on", "t", "y")


def _given(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def _struct(kind: str | Column, negative: bool = False, **parts: Column) -> Column:
    plain = {
        "kind": F.lit(kind) if isinstance(kind, str) else kind, "negative": F.lit(negative), "fuzzy": F.lit(False),
        "wanted": F.array().cast("array<string>"), "low": F.lit(None).cast("string"), "high": F.lit(None).cast("string"),
    }
    return F.struct(*[value.alias(name) for name, value in (plain | parts).items()]).cast(CONDITION)


def _if(given: Column, condition: Column) -> Column:
    return F.when(given, F.array(condition)).otherwise(F.array().cast(f"array<{CONDITION}>"))


def _any_of(kind: str, values: Column, negative: bool = False, fuzzy: Column | None = None) -> Column:
    extra = {} if fuzzy is None else {"fuzzy": F.coalesce(fuzzy, F.lit(False))}
    return _if(_given(values), _struct(kind, negative, wanted=values, **extra))


def _each(values: Column, negative: bool) -> Column:
    words = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda w: w.isNotNull())
    return F.transform(words, lambda w: _struct("text", negative, low=w))


def _node_conditions(f: Column) -> Column:
    """The conditions in the filters of one node."""
    date, size = f["date"], f["familySize"]
    start = F.coalesce(date["from"], date["from_"])
    dated = F.coalesce(date["field"], start, date["to"]).isNotNull()
    fuzzy = F.lower(f["assignee"]["fuzzy"]).isin(*TRUE_TEXTS)
    return F.concat(
        _if(dated, _struct(F.coalesce(date["field"], F.lit("publication")), low=start, high=date["to"])),
        _if(F.coalesce(size["min"], size["max"]).isNotNull(), _struct("size", low=size["min"], high=size["max"])),
        _any_of("authority", f["authority"]),
        _any_of("kind", f["kindCodes"]),
        _any_of("assignee", f["assignee"]["include"], fuzzy=fuzzy),
        _any_of("assignee", f["assignee"]["exclude"], True, fuzzy),
        _any_of("inventor", f["inventor"]["include"]),
        _any_of("inventor", f["inventor"]["exclude"], True),
        _any_of("applicant", f["applicant"]["include"]),
        _any_of("applicant", f["applicant"]["exclude"], True),
        _any_of("cpc", f["cpcInclude"]),
        _any_of("cpc", f["cpcExclude"], True),
        _any_of("collection", f["collections"]),
        _each(f["textMustContain"], False),
        _each(f["textMustNotContain"], True),
    )


def _node_problem(f: Column) -> Column:
    """Why the filters of one node cannot be answered, NULL where they can."""
    field = F.coalesce(f["date"]["field"], F.lit("publication"))
    counted = F.coalesce(f["citationCount"]["min"], f["citationCount"]["max"]).isNotNull()
    unheld = [(_given(f["status"]), "status"), (_given(f["language"]), "language"), (counted, "citationCount")]
    out = F.when(field.isin("priority", "filing"), F.concat(F.lit("no column holds the "), field, F.lit(" date")))
    for is_given, name in unheld:
        out = out.when(is_given, F.lit(f"no column holds {name}"))
    for bound in ("from", "from_", "to"):
        text = f["date"][bound]
        out = out.when(text.isNotNull() & text.try_cast("date").isNull(), F.lit(f"filters.date.{bound}: no date"))
    return out


def check_filters(requests: DataFrame) -> DataFrame:
    """Requests with an error where a filter asks for something no table holds, or for a date that is none."""
    filters = F.filter(F.col("request.children.node.filters"), lambda f: f.isNotNull())
    problem = F.get(F.filter(F.transform(filters, _node_problem), lambda p: p.isNotNull()), F.lit(0))
    error = F.coalesce("error", F.concat(F.lit("Unsupported filter: "), problem))
    return requests.withColumn("error", error).withColumn("request", F.when(F.col("error").isNull(), F.col("request")))


def conditions(requests: DataFrame) -> DataFrame:
    """(job_uid, client_uid, condition, kind, negative, fuzzy, wanted, low, high): the conditions of all nodes of a job."""
    filters = F.filter(F.col("request.children.node.filters"), lambda f: f.isNotNull())
    listed = F.flatten(F.transform(filters, _node_conditions))
    valid = requests.where(F.col("error").isNull())
    return valid.select("job_uid", "client_uid", F.posexplode(listed).alias("condition", "c")).select(
        "job_uid", "client_uid", "condition", "c.*"
    )


def _similar(asked: DataFrame, by_family: DataFrame) -> DataFrame:
    """Wanted assignees, with every similar applicant in the place of a fuzzy one."""
    asked = cut_lineage(asked)
    if asked.where("fuzzy").isEmpty():
        return asked
    names = asked.where("fuzzy").select(F.col("value").alias("name")).distinct()
    found = similar_names(names, by_family.select(F.col("applicant").alias("name")).distinct(), FUZZY_THRESHOLD)
    near = found.select(F.col("a").alias("value"), F.col("b").alias("near"))
    fuzzy = asked.where("fuzzy").join(near, "value").withColumn("value", F.col("near")).drop("near")
    return asked.where("not fuzzy").unionByName(fuzzy.select(*asked.columns))


def _wanted_values(asked: DataFrame, by_family: DataFrame) -> DataFrame:
    """(job_uid, condition, negative, kind, value) of the conditions that ask for one of several values."""
    value = (
        F.when(F.col("kind") == "assignee", normalize_applicant(F.col("value")))
        .when(F.col("kind") == "collection", F.concat_ws("\t", "client_uid", "value"))
        .otherwise(F.col("value"))
    )
    listed = asked.where(~F.col("kind").isin(*ROW_KINDS)).withColumn("value", F.explode("wanted"))
    listed = listed.withColumn("value", value).where("value is not null").drop("wanted", "low", "high", "client_uid")
    assignees = listed.where("kind = 'assignee'")
    return listed.where("kind <> 'assignee'").unionByName(_similar(assignees, by_family)).drop("fuzzy").distinct()


def family_values(fam: DataFrame, index: DataFrame, by_family: DataFrame, list_items: DataFrame) -> DataFrame:
    """(family_id text, kind, value): what conditions on values are compared with."""

    def every(kind: str, column: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    own = F.concat(
        every("authority", "family_authorities"), every("inventor", "inventors"), every("applicant", "applicants"),
        F.array(F.struct(F.lit("kind").alias("kind"), F.col("rep_kind").alias("value"))),
    )
    held = fam.select("family_id", F.inline(own))
    codes = index.select("family_id", F.lit("cpc").alias("kind"), F.col("code").alias("value"))
    names = by_family.select("family_id", F.lit("assignee").alias("kind"), F.col("applicant").alias("value"))
    listed = list_items.select(
        F.col("patent_family_id").alias("family_id"), F.lit("collection").alias("kind"),
        F.concat_ws("\t", "client_uid", F.col("list_uid").cast("string")).alias("value"),
    )
    return held.unionByName(codes).unionByName(names).unionByName(listed).where("family_id is not null and value is not null")


def _row_holds() -> Column:
    """Whether a family row meets a condition on its dates, size or text."""

    def between(date: str) -> Column:
        since, until = F.col("low").cast("date"), F.col("high").cast("date")
        return F.col(date).isNotNull() & (since.isNull() | (F.col(date) >= since)) & (until.isNull() | (F.col(date) <= until))

    least, most = whole_number(F.col("low")), whole_number(F.col("high"))
    size = F.col("size")
    return (
        F.when(F.col("kind") == "publication", between("first_application_pub_date"))
        .when(F.col("kind") == "grant", between("first_grant_pub_date"))
        .when(F.col("kind") == "size", (least.isNull() | (size >= least)) & (most.isNull() | (size <= most)))
        .otherwise(F.contains(F.col("words"), F.lower("low")))
    )


def condition_classes(asked: DataFrame) -> DataFrame:
    """(job_uid, alike): a text that jobs with equal conditions have in common. The client counts where a collection is asked for."""
    client = F.when(F.col("kind") == "collection", F.col("client_uid")).alias("client_uid")
    own = F.struct("condition", "kind", "negative", "fuzzy", "wanted", "low", "high", client)
    listed = F.array_sort(F.collect_list(own))
    return asked.groupBy("job_uid").agg(F.sha2(F.to_json(listed), 256).alias("alike"))


def passing(
    candidates: DataFrame, asked: DataFrame, fam: DataFrame, index: DataFrame, list_items: DataFrame | None = None
) -> DataFrame:
    """The candidates (job_uid, family_id) that meet every condition of their job; a job without conditions keeps all.

    Each positive condition has to be met by one of its values, and a negative one by none. A
    collection counts on the lists of the job's own client. A family that is not in `fam` meets
    no positive condition. Null ids and repeated candidates come back once. A family is judged
    once for all jobs with equal conditions.
    """
    passed = rows_passing(candidates.select("job_uid", "family_id").distinct(), asked, fam, index, list_items)
    return passed.select("job_uid", F.col("family_id").cast("bigint").alias("family_id"))


def rows_passing(
    rows: DataFrame, asked: DataFrame, fam: DataFrame, index: DataFrame, list_items: DataFrame | None = None
) -> DataFrame:
    """`passing` for rows (job_uid, family_id, …) that are kept as they are; only pairs of conditions and families are made distinct."""
    asked = cut_lineage(asked)
    jobs = cut_lineage(condition_classes(asked))
    bound = cut_lineage(rows.join(jobs, "job_uid", "left").withColumn("text_id", F.col("family_id").cast("string")))
    one = jobs.groupBy("alike").agg(F.min("job_uid").alias("job_uid"))
    rules = asked.join(one, "job_uid").drop("job_uid").withColumnRenamed("alike", "job_uid")
    judged = bound.where(F.col("alike").isNotNull())
    pairs = judged.select(F.col("alike").alias("job_uid"), F.col("text_id").alias("family_id")).distinct()
    kept = _passing(pairs, rules, fam, index, list_items).select(F.col("job_uid").alias("class"), F.col("family_id").alias("passed"))
    same = (F.col("alike") == F.col("class")) & F.col("text_id").eqNullSafe(F.col("passed"))
    free = bound.where(F.col("alike").isNull())
    return free.unionByName(judged.join(kept, same, "left_semi")).select(*rows.columns)


def _passing(candidates: DataFrame, asked: DataFrame, fam: DataFrame, index: DataFrame, list_items: DataFrame | None) -> DataFrame:
    """`passing` for candidates that are distinct, all of jobs with conditions."""
    asked, bound = cut_lineage(asked), cut_lineage(candidates)
    jobs = asked.groupBy("job_uid").agg(F.count_if(~F.col("negative")).alias("wanted"))
    ids = broadcast_if_small(bound.select("family_id").distinct())
    own = fam.where("family_id is not null").join(ids, "family_id", "left_semi")
    by_family = cut_lineage(applicant_family(own).select("applicant", "family_id"))
    if list_items is None:
        list_items = fam.sparkSession.createDataFrame([], "client_uid string, patent_family_id string, list_uid string")

    values = cut_lineage(_wanted_values(asked, by_family))
    keys = broadcast_if_small(values.select("kind", "value").distinct())
    held = family_values(own, index, by_family, list_items).join(keys, ["kind", "value"], "left_semi").distinct()
    by_value = bound.join(held, "family_id").join(values, ["job_uid", "kind", "value"])

    rows = asked.where(F.col("kind").isin(*ROW_KINDS)).select("job_uid", "condition", "negative", "kind", "low", "high")
    seen = own.select(
        "family_id", "first_application_pub_date", "first_grant_pub_date",
        F.coalesce(F.size("family_members"), F.lit(0)).alias("size"),
        F.lower(F.concat_ws(" ", "title", "abstract")).alias("words"),
    )
    of_rows = bound.join(rows.select("job_uid").distinct(), "job_uid", "left_semi").join(seen, "family_id")
    by_row = of_rows.join(rows, "job_uid").where(_row_holds())

    columns = ["job_uid", "family_id", "condition", "negative"]
    met = by_value.select(*columns).unionByName(by_row.select(*columns)).distinct()
    met = met.groupBy("job_uid", "family_id").agg(
        F.count_if(~F.col("negative")).alias("met"), F.count_if("negative").alias("ruled_out")
    )
    return (
        bound.join(jobs, "job_uid").join(met, ["job_uid", "family_id"], "left")
        .where("coalesce(met, 0) = wanted and coalesce(ruled_out, 0) = 0").select("job_uid", "family_id")
    )
