"""Filters that have no column, and documents as seeds."""

import json

import pytest

from patentkin.operators.neighbours import knn_by_vector
from patentkin.operators import filters, job_filters
from patentkin.operators.applicants import similar_names
from patentkin.operators.classification import cpc_seeds
from patentkin.operators.requests import parse_requests


@pytest.fixture
def fam(spark):
    return spark.createDataFrame(
        [("1", "A gear", "with teeth", ["1"], ["EP"], "B1"), ("2", None, "Gearbox", ["2", "3"], None, None), (None, "x", "y", None, None, "A1")],
        "family_id string, title string, abstract string, family_members array<string>, family_authorities array<string>, rep_kind string",
    )


@pytest.mark.parametrize("name, value", [("status", ["granted"]), ("language", ["en"]), ("citationCount", {"min": 1})])
def test_filters_without_a_column_are_refused(fam, name, value):
    with pytest.raises(filters.UnsupportedFilter, match=name):
        filters.apply_filters(fam, {name: value}, None, None, None)


@pytest.mark.parametrize("field", ["priority", "filing"])
def test_dates_without_a_column_are_refused(fam, field):
    with pytest.raises(filters.UnsupportedFilter, match=field):
        filters.apply_filters(fam, {"date": {"field": field}}, None, None, None)


@pytest.mark.parametrize(
    "spec, kept",
    [
        ({}, {"1", "2", None}), ({"authority": ["EP"]}, {"1"}), ({"kindCodes": ["B1", "A1"]}, {"1", None}),
        ({"familySize": {"min": 2}}, {"2"}), ({"familySize": {"max": 0}}, {None}), ({"familySize": {"min": 0, "max": 1}}, {"1", None}),
        ({"textMustContain": ["GEAR", "teeth"]}, {"1"}), ({"textMustNotContain": ["gear"]}, {None}),
    ],
)
def test_simple_filters(fam, spec, kept):
    assert {r["family_id"] for r in filters.apply_filters(fam, spec, None, None, None).collect()} == kept


def test_codes_by_depth(spark):
    index = spark.createDataFrame(
        [("1", "F"), ("1", "F16"), ("1", "F16H"), ("1", "F16H4/00"), ("1", "F16H4/12"), ("2", "F16"), ("2", "F"), ("3", "F16H"), ("3", "F16H40/00")],
        "family_id string, code string",
    )

    def found(code, depth):
        return {r["family_id"] for r in filters.by_code(index, code, depth).collect()}

    assert found("F16H", "exact") == {"1", "3"} and found("f16h", "exact") == set()
    assert found("f 16h", "subtree") == {"1", "3"}
    assert found("F", "children") == {"1", "2"} and found("F16", "children") == {"1", "3"}
    assert found("F16H", "children") == {"1", "3"} and found("F16H4/00", "children") == {"1"}
    assert found("F16H40/00", "children") == set()


def test_weights_scale_similarity(spark):
    docs = spark.createDataFrame([("j", 1, [1.0, 0.0], 0.5, 1), ("j", 2, [0.0, 1.0], 1.0, 2)], "job_uid string, query_id bigint, embedding array<float>, weight double, k int")
    emb = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 2.0])], "id bigint, embedding array<float>")
    rows = {(r["query_id"], r["family_id"]): round(r["similarity"], 6) for r in filters.document_neighbours(docs, emb).collect()}
    assert rows == {(1, 7): 0.5, (2, 8): 1.0, (2, 7): 0.0}


def request(uid, *nodes, client="c"):
    children = [{"node": {"type": "seed_patents", "seeds": {"patentFamilyIds": []}, "filters": f}} for f in nodes]
    return (uid, client, json.dumps({"v": 1, "type": "hybrid", "children": children}))


@pytest.fixture
def held(spark):
    rows = [
        ("1", "A gear", "with teeth", ["1"], ["EP"], "B1", ["Acme Inc"], ["Ann"], "2001-05-05"),
        ("2", None, "Gearbox", ["2", "3"], None, None, ["Foo Ltd", "ACME Corp"], None, None),
        ("3", "Pump", "a pump", ["4"], ["EP", "US"], "A1", None, ["Bob", "Ann"], "1999-01-01"),
        (None, "x", "y", None, ["EP"], "A1", None, None, None),
    ]
    schema = "family_id string, title string, abstract string, family_members array<string>, family_authorities array<string>, rep_kind string, applicants array<string>, inventors array<string>, d string"
    fam = spark.createDataFrame(rows, schema)
    day = fam["d"].cast("date")
    fam = fam.withColumns({"first_application_pub_date": day, "first_grant_pub_date": day}).drop("d")
    index = spark.createDataFrame([("1", "F16H"), ("1", "F16"), ("3", "A01B")], "family_id string, code string")
    lists = spark.createDataFrame([("c", "2", 7), ("d", "3", 7), ("c", "9", 7)], "client_uid string, patent_family_id string, list_uid long")
    return fam, index, lists


JOBS_AND_FAMILIES = [
    ([], "1 2 3 9"), ([{}], "1 2 3 9"), ([{"authority": []}], "1 2 3 9"),
    ([{"authority": ["EP"]}], "1 3"), ([{"authority": ["US", "XX"]}], "3"), ([{"kindCodes": ["A1", "B1"]}], "1 3"),
    ([{"assignee": {"include": ["The ACME Holdings"]}}], "1 2"), ([{"assignee": {"exclude": ["Acme", "nobody"]}}], "3 9"),
    ([{"assignee": {"include": ["Acmee"], "fuzzy": True}}], "1 2"), ([{"assignee": {"include": ["Acmee"]}}], ""),
    ([{"inventor": {"include": ["Ann"], "exclude": ["Bob"]}}], "1"), ([{"applicant": {"exclude": ["Foo Ltd"]}}], "1 3 9"),
    ([{"cpcInclude": ["F16", "A01B"], "cpcExclude": ["F16H"]}], "3"), ([{"collections": ["7"]}], "2 9"),
    ([{"familySize": {"min": "2.0"}}], "2"), ([{"familySize": {"max": 1}}], "1 3"),
    ([{"textMustContain": ["GEAR", "e"]}], "1 2"), ([{"textMustNotContain": ["gear"]}], "3 9"),
    ([{"date": {"from": "2000-01-01", "to": None}}], "1"), ([{"date": {"field": "grant", "to": "1999-01-01"}}], "3"),
    ([{"date": {"field": "grant"}}], "1 3"), ([{"authority": ["EP"]}, {"inventor": {"include": ["Bob"]}}], "3"),
    ([{"authority": ["EP"]}, {"authority": ["US"]}, {"textMustNotContain": ["pump"]}], ""),
]


def test_filters_of_many_jobs(spark, held):
    fam, index, lists = held
    wanted = {f"j{n}": kept for n, (_, kept) in enumerate(JOBS_AND_FAMILIES)}
    given = [request(f"j{n}", *nodes) for n, (nodes, _) in enumerate(JOBS_AND_FAMILIES)] + [request("none", {"kindCodes": ["Q"]})]
    jobs = spark.createDataFrame(given, "job_uid string, client_uid string, search_vectors string")
    requests = job_filters.check_filters(parse_requests(jobs))
    rows = [(j, i) for j in [*wanted, "none"] for i in (1, 2, 3, 9)] + [("j3", 1)]
    candidates = spark.createDataFrame(rows, "job_uid string, family_id bigint")
    found = {j: [] for j in wanted}
    for r in job_filters.passing(candidates, job_filters.conditions(requests), fam, index, lists).collect():
        found[r["job_uid"]].append(r["family_id"])
    assert {j: " ".join(map(str, sorted(ids))) for j, ids in found.items()} == wanted


def test_filters_that_no_table_answers_are_errors_of_their_job(spark):
    given = {
        "a": {"status": ["granted"]}, "b": {"citationCount": {"max": 3}}, "c": {"date": {"field": "priority"}},
        "d": {"date": {"from": "soon"}}, "e": {"language": ["en"]}, "f": {"language": [], "citationCount": {}},
    }
    jobs = spark.createDataFrame([request(uid, {}, f) for uid, f in given.items()], "job_uid string, client_uid string, search_vectors string")
    found = {r["job_uid"]: r["error"] for r in job_filters.check_filters(parse_requests(jobs)).collect()}
    assert found == {
        "a": "Unsupported filter: no column holds status", "b": "Unsupported filter: no column holds citationCount",
        "c": "Unsupported filter: no column holds the priority date", "d": "Unsupported filter: filters.date.from: no date",
        "e": "Unsupported filter: no column holds language", "f": None,
    }


def test_depths_of_many_codes_in_one_join(spark):
    index = spark.createDataFrame(
        [("1", "F"), ("1", "F16"), ("1", "F16H"), ("1", "F16H4/00"), ("1", "F16H4/12"), ("2", "F16"), ("2", "F"), ("3", "F16H"), ("3", "F16H40/00")],
        "family_id string, code string",
    )
    codes = ["F16H", "f16h", "f 16h", "F", "F16", "F16H4/00", "F16H40/00", "G", ""]
    asked = spark.createDataFrame([(f"{c}|{d}", c, d) for c in codes for d in ("exact", "subtree", "children")], "job_uid string, code string, depth string")
    found = {}
    for r in cpc_seeds(asked, index).collect():
        found.setdefault(r["job_uid"], set()).add(r["family_id"])
    for c in codes:
        for d in ("exact", "subtree", "children"):
            if c:
                assert found.get(f"{c}|{d}", set()) == {r["family_id"] for r in filters.by_code(index, c, d).collect()}


def test_similar_names(spark):
    names = ["acme", "acme corp", "acme gears", "zzz", "kyoto robotics", "kyoto robotic", "robotics kyoto", "abcdef", "abcdefghi", "", "--", None, "a"]
    table = spark.createDataFrame([(n,) for n in names + names], "name string")

    def grams(name):
        return {f"  {w} "[k : k + 3] for w in name.replace("-", " ").split() for k in range(len(w) + 1)}

    for threshold in (0.3, 0.7, 1.0):
        wanted = {}
        for a in names:
            for b in names:
                if a and b and grams(a) and grams(b):
                    share = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
                    if share >= threshold:
                        wanted[a, b] = round(share, 9)
        assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in similar_names(table, table, threshold).collect()} == wanted


def test_equal_documents_are_searched_once(spark, monkeypatch):
    asked = []

    def spy(queries, emb, *rest):
        asked.append(queries.count())
        return knn_by_vector(queries, emb, *rest)

    monkeypatch.setattr(filters, "knn_by_vector", spy)
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id bigint, embedding array<float>")
    rows = [("a", 1, 1.0, 1, [1.0, 0.0]), ("b", 2, 0.5, 3, [1.0, 0.0]), ("c", 3, 1.0, 1, [0.0, 1.0]), ("d", 4, 1.0, 1, None)]
    docs = spark.createDataFrame(rows, "job_uid string, query_id bigint, weight double, k int, embedding array<float>")
    found = filters.document_neighbours(docs, emb).collect()
    assert sorted((r["job_uid"], r["query_id"], r["family_id"], round(r["similarity"], 6)) for r in found) == [
        ("a", 1, 1, 1.0), ("b", 2, 1, 0.5), ("b", 2, 2, 0.0), ("b", 2, 3, -0.5), ("c", 3, 2, 1.0),
    ]
    assert asked == [3]


def test_jobs_with_equal_conditions_are_judged_once(spark, fam, monkeypatch):
    judged = []
    own = job_filters._passing
    monkeypatch.setattr(job_filters, "_passing", lambda pairs, *rest: judged.append(pairs.count()) or own(pairs, *rest))
    whole = fam.selectExpr(
        "*", "cast(null as date) first_application_pub_date", "cast(null as date) first_grant_pub_date",
        "cast(array() as array<string>) inventors", "cast(array() as array<string>) applicants",
    )
    index = spark.createDataFrame([], "family_id string, code string")
    conditions = job_filters.conditions(parse_requests(spark.createDataFrame(
        [(f"j{n}", f"c{n}", json.dumps({"v": 1, "type": "hybrid", "children": [{"node": {
            "type": "seed_patents", "seeds": {}, "filters": {"authority": ["EP"]}}}]})) for n in range(20)],
        "job_uid string, client_uid string, search_vectors string",
    )))
    candidates = spark.createDataFrame([(f"j{n}", f) for n in range(21) for f in (1, 2)], "job_uid string, family_id long")
    got = {tuple(r) for r in job_filters.passing(candidates, conditions, whole, index).collect()}
    assert got == {(f"j{n}", 1) for n in range(20)} | {("j20", 1), ("j20", 2)}  # the last has no condition
    assert judged == [2]
