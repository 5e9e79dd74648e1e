"""Hand-written rows for every trap of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from patentkin.functions.classification import cpc_pieces
from patentkin.functions.names import name_similarity, normalize_applicant, trigrams
from patentkin.functions.priority import authority_priority, content_priority, kind_priority
from patentkin.functions.text import combined_text, is_ready, row_size, safe_id
from patentkin.functions.vectors import cosine_distance, cosine_similarity, parse_vector


def values(spark, rows, schema, *columns):
    """The columns over the rows, as plain tuples in row order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    out = df.select("_i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("_i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]


def test_authority_priority(spark):
    rows = [("EP",), ("ep",), ("NZ",), ("XX",), (None,), ("",)]
    a = F.col("a")
    loose, strict = zip(*values(spark, rows, "a string", authority_priority(a), authority_priority(a, strict=True)))
    assert loose == (1, 1, 17, 99, 99, 99)
    assert strict == (1, 999, 17, 999, None, 999)


def test_kind_priority(spark):
    cases = {
        ("EP", "B2"): 1, ("EP", "B3"): 2, ("ep", "B1"): 3, ("EP", "A1"): 4, ("EP", "A3"): 5, ("EP", "A2"): 6,
        ("EP", "B9"): 9, ("EP", "A8"): 9, ("EP", "b2"): 1, ("EP", "U"): 99, ("EP", "A4"): 3,
        ("WO", "A1"): 1, ("WO", "A3"): 2, ("WO", "A2"): 3, ("wo", "A4"): 4, ("WO", "A9"): 3,
        ("US", "B2"): 1, ("US", "b1"): 1, ("US", "A1"): 2, ("US", "a1"): 3, ("US", "A"): 3,
        (None, "B1"): 1, (None, "A1"): 2, ("US", None): 99, ("EP", None): 99,
    }
    got = values(spark, list(cases), "a string, k string", kind_priority(F.col("a"), F.col("k")))
    assert dict(zip(cases, got)) == cases


def test_content_priority(spark):
    rows = [("t", "a"), ("t", " "), (None, "a"), ("", None), ("\t", "a")]
    assert values(spark, rows, "t string, a string", content_priority(F.col("t"), F.col("a"))) == [0, 1, 1, 2, 0]


def test_is_ready(spark):
    rows = [
        ("12", "t", "a"), ("12\n", "t", "a"), ("X12", "t", "a"), (None, "t", "a"), ("12", " ", "a"),
        ("12", "t", None), ("", "t", "a"), ("12", "\t", "a"),
    ]
    got = values(spark, rows, "f string, t string, a string", is_ready(F.col("f"), F.col("t"), F.col("a")))
    assert got == [True, False, False, False, False, False, False, True]


def test_texts(spark):
    rows = [("\t title \n", " abs tract "), ("é", "a")]
    got = values(
        spark, rows, "t string, a string", combined_text(F.col("t"), F.col("a")), row_size(F.col("t"), F.col("a"))
    )
    assert got[0][0] == "title\n\nabs tract"
    assert got[1] == ("é\n\na", 2 + 1 + 32)


def test_safe_id(spark):
    rows = [("12",), (" 7 ",), ("-3",), ("+4",), ("1.5",), ("x",), ("",), (None,), ("99999999999999999999",)]
    assert values(spark, rows, "i string", safe_id(F.col("i"))) == [12, 7, -3, 4, None, None, None, None, None]


def test_cpc_pieces(spark):
    rows = [("A61K2039/505",), ("f16h 4 / 00",), ("Y10T",), ("I01B1/00",), ("A",), (None,), ("A61K",)]
    got = values(spark, rows, "c string", cpc_pieces(F.col("c")), cpc_pieces(F.col("c"), group_digits=4))
    codes = [[tuple(p) for p in g[0]] for g in got]
    assert codes[0] == [("A", 1), ("A61", 2), ("A61K", 3), ("A61K203/00", 4), ("A61K2039/505", 5)]
    assert codes[1] == [("F", 1), ("F16", 2), ("F16H", 3), ("F16H4/00", 4), ("F16H4/00", 5)]
    assert codes[2] == [("Y", 1), ("Y10", 2), ("Y10T", 3)]
    assert codes[3] == [("I01B1/00", 5)]
    assert codes[4] == [("A", 1)] and codes[5] == []
    assert [p["code"] for p in got[0][1]][3] == "A61K2039/00"


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("foo sa de cv", "foo"), ("s.l.foo", "s l foo"), ("The & Co", "and"), ("Société Générale S.A.", "societe generale s a"),
        ("Groß AG", "gross"), ("The Müller & Söhne GmbH", "muller and sohne"), ("Acme Holdings, Inc.", "acme"),
        ("Kabushiki  Kaisha Foo", "foo"), ("Foo Co., Ltd.", "foo"), ("FOO PTE LTD", "foo"), ("Łódź Æther Sp. z o.o.", "lodz aether"),
        ("company", None), ("  ", None), (None, None), ("Incubator", "incubator"), ("theatre", "theatre"), ("a_b", "a b"),
        ("Co-op", "op"), ("Holding Group", None), ("Foo 3M", "foo 3m"),
    ],
)
def test_normalize_applicant(spark, raw, wanted):
    assert values(spark, [(raw,)], "n string", normalize_applicant(F.col("n"))) == [wanted]


def test_trigrams(spark):
    got = values(
        spark, [("cat", "cats"), ("cat", "dog"), ("cat", "cat")], "a string, b string",
        trigrams(F.col("a")), name_similarity(F.col("a"), F.col("b")),
    )
    assert sorted(got[0][0]) == ["  c", " ca", "at ", "cat"]
    assert got[0][1] == pytest.approx(3 / 6) and got[1][1] == 0 and got[2][1] == 1


def test_parse_vector(spark):
    rows = [
        ("[1,,2]",), ("(1,2)",), ("{1,x}",), ("[]",), ("  [1.5, -2e3]  ",), ("3,4",), ("[1,2",), (None,), ("1d",), ("nan",), (".5",),
    ]
    got = values(spark, rows, "v string", parse_vector(F.col("v")))
    assert got[:9] == [[1.0, 2.0], [1.0, 2.0], None, [], [1.5, -2000.0], [3.0, 4.0], None, None, None]
    assert math.isnan(got[9][0]) and got[10] == [0.5]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    got = values(
        spark, rows, "a array<float>, b array<float>",
        cosine_similarity(F.col("a"), F.col("b")), cosine_distance(F.col("a"), F.col("b")),
    )
    assert got[0] == pytest.approx((math.sqrt(0.5), 1 - math.sqrt(0.5)))
    assert got[1] == (-1.0, 2.0) and got[2] == (None, None)
