"""Landscape requests: checked, then read for seeds and search depth."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from patentkin.functions.text import safe_id
from patentkin.operators.classification import cpc_seeds

# The default search depth and what a failed job is told.
DEFAULT_K = 200
NO_SEEDS = "No seed family IDs found from search vectors"
NO_VECTORS = "Missing 'search_vectors' in record"
NO_CLIENT = "Missing 'client_uid' in record"

STRING, INTEGER, NUMBER, BOOLEAN = "string", "integer", "number", "boolean"


@dataclass(frozen=True)
class Choice:
    """One of the given texts."""

    values: tuple[str, ...]


@dataclass(frozen=True)
class Items:
    """A list of one kind of value."""

    of: object


@dataclass(frozen=True)
class Fields:
    """An object with these fields only. Optional fields may be null; required ones only where `null_ok` says so."""

    of: dict[str, object]
    required: tuple[str, ...] = ()
    null_ok: tuple[str, ...] = ()


_PARTY = Fields({"include": Items(STRING), "exclude": Items(STRING)})
_RANGE = Fields({"min": INTEGER, "max": INTEGER})

# The request format.
FILTERS = Fields(
    {
        "date": Fields(
            {
                "field": Choice(("priority", "filing", "publication", "grant")),
                "from": STRING, "from_": STRING, "to": STRING,
            }
        ),
        "authority": Items(STRING),
        "kindCodes": Items(STRING),
        "status": Items(Choice(("pending", "granted", "expired", "withdrawn"))),
        "language": Items(STRING),
        "assignee": Fields({"include": Items(STRING), "exclude": Items(STRING), "fuzzy": BOOLEAN}),
        "inventor": _PARTY,
        "applicant": _PARTY,
        "cpcInclude": Items(STRING),
        "cpcExclude": Items(STRING),
        "familySize": _RANGE,
        "citationCount": _RANGE,
        "collections": Items(STRING),
        "textMustContain": Items(STRING),
        "textMustNotContain": Items(STRING),
    }
)
_COMMON = {"type": STRING, "name": STRING, "description": STRING, "filters": FILTERS}
NODES = {
    "seed_patents": Fields(
        {
            **_COMMON,
            "k": INTEGER,
            "seeds": Fields({"patentFamilyIds": Items(STRING), "negativePatentFamilyIds": Items(STRING)}),
        },
        required=("seeds",),
    ),
    "cpc": Fields(
        {
            **_COMMON,
            "classes": Items(
                Fields({"code": STRING, "depth": Choice(("exact", "children", "subtree"))}, required=("code",))
            ),
        },
        required=("classes",),
    ),
    "seed_docs": Fields(
        {
            **_COMMON,
            "k": INTEGER,
            "docs": Items(
                Fields(
                    {
                        "id": STRING, "title": STRING, "abstract": STRING, "weight": NUMBER,
                        "textRef": Fields({"uri": STRING, "sha256": STRING}, required=("uri",)),
                    }
                )
            ),
        },
        required=("docs",),
        null_ok=("docs",),
    ),
}

_PARTY_TYPE = "struct<include: array<string>, exclude: array<string>>"
_RANGE_TYPE = "struct<min: string, max: string>"
REQUEST = f"""
children array<struct<
  node: struct<
    type: string, k: string,
    filters: struct<
      date: struct<field: string, from: string, from_: string, to: string>,
      authority: array<string>, kindCodes: array<string>, status: array<string>, language: array<string>,
      assignee: struct<include: array<string>, exclude: array<string>, fuzzy: string>,
      inventor: {_PARTY_TYPE}, applicant: {_PARTY_TYPE}, cpcInclude: array<string>, cpcExclude: array<string>,
      familySize: {_RANGE_TYPE}, citationCount: {_RANGE_TYPE}, collections: array<string>,
      textMustContain: array<string>, textMustNotContain: array<string>>,
    seeds: struct<patentFamilyIds: array<string>, negativePatentFamilyIds: array<string>>,
    classes: array<struct<code: string, depth: string>>,
    docs: array<struct<id: string, title: string, abstract: string, weight: string>>>>>
"""


MAX_NUMBER = 1e300
_TRUTHS = ("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")


def _is_number(value: object) -> bool:
    if isinstance(value, str):
        try:
            return math.isfinite(float(value))
        except ValueError:
            return False
    return isinstance(value, (int, float)) and abs(value) < MAX_NUMBER


def _fits(value: object, spec: object) -> bool:
    """Whether a plain value is of the wanted kind. Numbers may come as texts, texts never as numbers."""
    if isinstance(spec, Choice):
        return isinstance(value, str) and value in spec.values
    if spec == STRING:
        return isinstance(value, str)
    if spec == BOOLEAN:
        return str(value).lower() in _TRUTHS
    return _is_number(value) and (spec == NUMBER or float(value).is_integer())


def find_problem(value: object, name: str, spec: object) -> str | None:
    """First problem of a JSON value against its description, None where it fits."""
    label = name or "request"
    if isinstance(spec, Items):
        if not isinstance(value, list):
            return f"{label}: wrong value"
        found = (find_problem(v, name, spec.of) for v in value)
        return next((p for p in found if p), None)
    if not isinstance(spec, Fields):
        return None if _fits(value, spec) else f"{label}: wrong value"
    if not isinstance(value, dict):
        return f"{label}: wrong value"
    prefix = f"{name}." if name else ""
    for field in spec.required:
        if field not in value or (value[field] is None and field not in spec.null_ok):
            return f"{prefix}{field}: missing"
    for field, inner in value.items():
        if field not in spec.of:
            return f"{prefix}{field}: unknown field"
        if inner is not None:
            problem = find_problem(inner, prefix + field, spec.of[field])
            if problem:
                return problem
    return None


def _child_problem(child: object) -> str | None:
    if not isinstance(child, dict) or not isinstance(child.get("node"), dict):
        return "node: missing"
    node = child["node"]
    kind = node.get("type")
    if not isinstance(kind, str) or kind not in NODES:
        return "node.type: wrong value"
    rest = {field: value for field, value in child.items() if field != "node"}
    return find_problem(node, "node", NODES[kind]) or find_problem(rest, "", Fields({"order": INTEGER}))


def check_request(text: str | None) -> str | None:
    """What is wrong with a request text, None where nothing is."""
    if text is None:
        return None
    try:
        request = json.loads(text)
    except (ValueError, RecursionError):
        return "no JSON"
    if not isinstance(request, dict):
        return "request: wrong value"
    if request.get("v") != 1 or isinstance(request["v"], bool):
        return "v: wrong value"
    if request.get("type") != "hybrid":
        return "type: wrong value"
    unknown = [field for field in request if field not in ("v", "type", "children")]
    if unknown:
        return f"{unknown[0]}: unknown field"
    children = request.get("children", [])
    if not isinstance(children, list):
        return "children: wrong value"
    try:
        return next((p for p in map(_child_problem, children) if p), None)
    except RecursionError:
        return "request: too deep"


@F.pandas_udf(StringType())
def request_problem(texts: pd.Series) -> pd.Series:
    """`check_request` over Arrow batches.

    Requests are few and small beside the corpus. The same check as one column expression over
    variants took about seven times as long.
    """
    return texts.map(check_request)


def parse_requests(jobs: DataFrame) -> DataFrame:
    """Jobs (job_uid, client_uid, search_vectors) with `request`, or with `error` where they cannot run.

    A bad job is a row with an error, never a failed batch.
    """
    error = (
        F.when(F.col("search_vectors").isNull(), F.lit(NO_VECTORS))
        .when(F.col("problem").isNotNull(), F.concat(F.lit("Invalid search vectors: "), F.col("problem")))
        .when(F.coalesce(F.col("client_uid"), F.lit("")) == "", F.lit(NO_CLIENT))
    )
    request = F.from_json("search_vectors", REQUEST)
    return (
        jobs.withColumn("problem", request_problem(F.col("search_vectors")))
        .withColumn("error", error)
        .withColumn("request", F.when(F.col("error").isNull(), request))
        .drop("problem")
    )


def nodes(requests: DataFrame) -> DataFrame:
    """(job_uid, place, node): the nodes of the requests that can run."""
    valid = requests.where(F.col("error").isNull())
    return valid.select("job_uid", F.posexplode("request.children.node").alias("place", "node"))


def whole_number(text: Column) -> Column:
    """A whole number given as 7, 7.0 or "7.0", as the check accepts it; one beyond an int is the largest int."""
    value = F.trim(text).try_cast("double")
    # least and greatest pass over nulls
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(2.0**31 - 1)), F.lit(-(2.0**31))).cast("int"))


def k_of(requests: DataFrame) -> DataFrame:
    """(job_uid, k): the largest positive depth a job asks for, or the default."""
    asked = F.filter(
        F.transform(
            F.filter("request.children.node", lambda n: n["type"] == "seed_patents"),
            lambda n: whole_number(n["k"]),
        ),
        lambda k: k > 0,
    )
    valid = requests.where(F.col("error").isNull())
    return valid.select("job_uid", F.coalesce(F.array_max(asked), F.lit(DEFAULT_K)).alias("k"))


def requested_codes(requests: DataFrame) -> DataFrame:
    """(job_uid, code, depth) of the classification nodes; a code without a depth is meant exactly."""
    classes = nodes(requests).where(F.col("node.type") == "cpc").select("job_uid", F.explode("node.classes").alias("c"))
    depth = F.coalesce("c.depth", F.lit("exact")).alias("depth")
    return classes.where(F.col("c.code") != "").select("job_uid", F.col("c.code").alias("code"), depth)


def without_seeds(requests: DataFrame, seeds: DataFrame) -> DataFrame:
    """(job_uid, error) of the jobs that could run but have no seed left."""
    valid = requests.where(F.col("error").isNull()).select("job_uid")
    started = seeds.select("job_uid").distinct()  # counted where the seeds are, which can be very many
    return valid.join(started, "job_uid", "left_anti").select("job_uid", F.lit(NO_SEEDS).alias("error"))


def given_families(requests: DataFrame) -> DataFrame:
    """(job_uid, family_id, negative) of the families a job names by id, as seeds or as ones that are none. Ids that are no numbers are skipped."""
    listed = nodes(requests).where(F.col("node.type") == "seed_patents").select("job_uid", "node.seeds.*")

    def ids(column: str, negative: bool) -> Column:
        given = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(given, lambda i: F.struct(safe_id(i).alias("family_id"), F.lit(negative).alias("negative")))

    both = F.concat(ids("patentFamilyIds", False), ids("negativePatentFamilyIds", True))
    from_ids = listed.select("job_uid", F.explode(both).alias("i")).select("job_uid", "i.*")
    return (
        from_ids.where(F.col("family_id").isNotNull())
        .groupBy("job_uid", "family_id")
        .agg(F.max("negative").alias("negative"))
    )


def seed_index(index: DataFrame) -> DataFrame:
    """(family_id, code) of the index for families whose id is a number."""
    return index.select(safe_id(F.col("family_id")).alias("family_id"), "code").where(F.col("family_id").isNotNull())


def collect_seeds(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(job_uid, family_id) of the seeds of every job.

    Negatives remove a family wherever it came from. Ids that are no numbers are skipped.
    """
    given = given_families(requests)
    from_codes = cpc_seeds(requested_codes(requests), seed_index(index), given.select("job_uid", "family_id"))
    return given.where(~F.col("negative")).select("job_uid", "family_id").unionByName(from_codes)


def documents(requests: DataFrame) -> DataFrame:
    """(job_uid, query_id, title, abstract, weight, k) of the documents given as seeds."""
    docs = nodes(requests).where(F.col("node.type") == "seed_docs").select(
        "job_uid", "place", F.coalesce(whole_number(F.col("node.k")), F.lit(DEFAULT_K)).alias("k"),
        F.posexplode("node.docs").alias("number", "doc"),
    )
    return docs.select(
        "job_uid", F.xxhash64("job_uid", "place", "number").alias("query_id"),
        F.coalesce("doc.title", F.lit("")).alias("title"), F.coalesce("doc.abstract", F.lit("")).alias("abstract"),
        F.coalesce(F.trim("doc.weight").try_cast("double"), F.lit(1.0)).alias("weight"), "k",
    )
