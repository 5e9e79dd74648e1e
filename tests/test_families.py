"""Rollup, classification and applicants on hand-written families."""

import datetime

from patentkin.operators.applicants import applicant_candidates, applicant_family
from patentkin.operators.classification import cpc_index, cpc_seeds, with_cpc_titles
from patentkin.operators.families import rollup, score
from patentkin.sources.samples import sample
from patentkin.sources.tables import PATENTS, require_columns
from conftest import TABLES

DAY = datetime.date(2020, 1, 1)


def pub(id, family="1", authority="EP", number="1", kind="B1", day=DAY, title="t", abstract="a", cpc=None, apps=None, invs=None):
    return (id, family, authority, number, kind, day, title, abstract, cpc, apps, invs)


def rolled(spark, *pubs, **options):
    rows = rollup(score(spark.createDataFrame(pubs, PATENTS)), **options).collect()
    return {r["family_id"]: r for r in rows}


def test_missing_numbers_and_dates_come_last(spark):
    fam = rolled(
        spark, pub("a", number=None), pub("b", number="1"),
        pub("c", "2", day=None, number="0"), pub("d", "2", day=DAY, number="9"),
    )
    assert fam["1"]["rep_id"] == "b"
    assert fam["2"]["rep_id"] == "d" and fam["2"]["family_members"] == ["d", "c"]


def test_content_decides_after_kind(spark):
    fam = rolled(spark, pub("a", title=" ", day=datetime.date(2021, 1, 1)), pub("b"), pub("c", kind="A1"))
    assert fam["1"]["rep_id"] == "b"


def test_texts_fall_back_to_the_best_member(spark):
    fam = rolled(spark, pub("a", title=" ", abstract=" own "), pub("b", kind="A2", title=" other ", abstract="x"))
    assert fam["1"]["rep_id"] == "a"
    assert fam["1"]["abstract"] == "own"  # the representative's text is trimmed
    assert fam["1"]["title"] == " other "  # the fallback is not


def test_family_without_id(spark):
    fam = rolled(spark, pub("a", None, title=None, apps=["x"], cpc=["A"]), pub("b", None, authority="US", title="u"))
    assert list(fam) == [None]
    row = fam[None]
    assert row["rep_id"] == "a" and row["title"] is None and row["abstract"] == "a"
    assert row["family_members"] is None and row["family_authorities"] is None
    assert row["first_grant_pub_date"] is None
    assert row["cpc"] == [] and row["applicants"] == [] and row["inventors"] == []


def test_lists(spark):
    fam = rolled(
        spark, pub("a", apps=[None, "A"], cpc=["z" * 250], authority="ep"), pub("b", apps=["A", "B"], authority="EP"),
        pub("c", authority=None), pub("d", "2", authority=None),
    )
    assert fam["1"]["applicants"] == ["A", "B", None]
    assert fam["1"]["family_authorities"] == ["EP", "ep"]
    assert fam["1"]["cpc"] == ["z" * 200] and fam["1"]["inventors"] == []
    assert fam["2"]["family_authorities"] is None


def test_dates_look_at_the_case_of_the_kind(spark):
    early = datetime.date(2000, 1, 1)
    fam = rolled(spark, pub("a", kind="b1", day=early), pub("b", kind="B1"), pub("c", kind="A1", day=None))
    assert fam["1"]["first_grant_pub_date"] == DAY and fam["1"]["first_application_pub_date"] is None


def test_hot_families_roll_up_alike(spark):
    scored = score(sample(spark, TABLES, "patents"))
    plain = {str(r) for r in rollup(scored).collect()}
    for hot_rows in (0, 1, 2):
        assert {str(r) for r in rollup(scored, hot_rows=hot_rows).collect()} == plain


def test_publications_are_scanned_once_at_full_width(spark, tmp_path):
    pubs = spark.createDataFrame([pub(f"P{k}", str(k % 7)) for k in range(50)], PATENTS)
    pubs.write.parquet(str(tmp_path / "patents"))
    plan = rollup(score(spark.read.parquet(str(tmp_path / "patents"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_one_family_holds_a_third_of_all_rows(spark):
    pubs = [pub(f"p{i:05}", "hot" if i % 3 == 0 else f"f{i}", number=str(i), apps=[f"n{i % 7}"]) for i in range(3_000)]
    fam = rolled(spark, *pubs, hot_rows=100)
    assert len(fam) == 2_001
    assert fam["hot"]["family_members"] == sorted(f"p{i:05}" for i in range(0, 3_000, 3))
    assert fam["hot"]["applicants"] == [f"n{i}" for i in range(7)]


def test_code_index(spark):
    fam = spark.createDataFrame([("1", ["F16H4/00", "f16h 5/02"]), ("2", ["H04L1/00"]), (None, [])], "family_id string, cpc array<string>")
    titles = spark.createDataFrame(
        [("F", "Mechanics", 1), ("F16H", "Gearing", 3), ("F16H", "A gear", 3), ("F16H5/02", "Wheels", 5)],
        "cpc_code string, title string, level int",
    )
    index = cpc_index(fam, titles)
    assert {tuple(r) for r in index.collect()} == {
        ("1", "F", "Mechanics", 1), ("1", "F16H", "A gear", 3), ("1", "F16H5/02", "Wheels", 5)
    }
    lists = {r["family_id"]: [c["code"] for c in r["cpc_titles"]] for r in with_cpc_titles(fam, index).collect()}
    assert lists == {"1": ["F", "F16H", "F16H5/02"], "2": [], None: []}
    asked = spark.createDataFrame([("j", "F16H"), ("j", "f16h"), ("k", "H04L")], "job_uid string, code string")
    assert [tuple(r) for r in cpc_seeds(asked, index).collect()] == [("j", "1")]


def test_applicants(spark):
    fam = spark.createDataFrame(
        [("1", ["Foo Inc", "FOO GmbH", "Group"]), ("2", ["Foo Inc", "Bar"]), ("3", [])], "family_id string, applicants array<string>"
    )
    by_family = applicant_family(fam)
    assert {(r[0], r[1], tuple(r[2])) for r in by_family.collect()} == {
        ("foo", "1", ("FOO GmbH", "Foo Inc")), ("foo", "2", ("Foo Inc",)), ("bar", "2", ("Bar",))
    }
    assert [tuple(r) for r in applicant_candidates(by_family).collect()] == [
        ("foo", 2, ["FOO GmbH", "Foo Inc"]), ("bar", 1, ["Bar"])
    ]


def test_required_columns(spark):
    df = spark.createDataFrame([(1, "t", "a", 0)], "family_id bigint, title string, abstract string, more int")
    assert require_columns(df, "title string, family_id bigint").columns == ["title", "family_id"]
    try:
        require_columns(df, "family_id string, shard bigint")
    except ValueError as error:
        assert "family_id: bigint, wanted string" in str(error) and "shard: missing" in str(error)
    else:
        raise AssertionError("a wrong schema passed")
