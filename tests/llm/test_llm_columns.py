"""The stages of the pipeline pass on columns of any name and type, and the scan finds tokens of any length."""

import pytest

pytest.importorskip("patentkin.llm")

from patentkin.llm import decontaminate, language, line_dedup, near_dedup, secrets  # noqa: E402

NAMES = (
    "deleted text_key gone gone_id gone_key new_text _whole_text own_score lang_pred score langs _none rest c0 none hit_id "
    "kept component_id a.b node key"
).split()
PASSAGE = "\n".join(f"line {k} " + " ".join(f"w{k}x{j}" for j in range(12)) for k in range(6))


def odd_table(spark):
    texts = ["one two three four five six seven eight", PASSAGE + "\nend one", "head two\n" + PASSAGE, None, "",
             "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "12 34",
             "other words that nobody else has written down here before"]
    rows = [
        (k, t, "en" if k % 2 else "de", None if t is None else len(t), {"m": k}, [{"x.y": k}], *[f"{c}{k}" for c in NAMES])
        for k, t in enumerate(texts)
    ]
    rows.append(rows[5])  # a row twice
    columns = ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame(
        rows, f"doc_id long, text string, lang string, n_chars long, tags map<string, int>, `list` array<struct<`x.y`: int>>, {columns}"
    )


def as_rows(df):
    return {repr(r) for r in df.collect()}


def test_stages_pass_on_any_column(spark):
    docs = odd_table(spark)
    before = as_rows(docs)
    benchmark = spark.createDataFrame([("i", "other words that nobody else has written down here before")], "item_id string, text string")
    for stage, left in (
        (language.keep_identified, {0, 1, 2, 5, 7}),
        (near_dedup.keep_one, {0, 1, 3, 4, 5, 6, 7}),
        (lambda d: decontaminate.decontaminate(d, benchmark), {0, 1, 2, 3, 4, 5, 6}),
    ):
        out = stage(docs)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert as_rows(out) <= before
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert ids >= left - {2} and ids <= left | {2}
    assert near_dedup.keep_one(docs).where("doc_id = 5").count() == 1
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    found = {r["doc_id"]: r for r in out.collect()}
    assert found[2]["text"] == "head two" and found[2]["n_chars"] == 8
    assert all(r["deleted"] == f"deleted{k}" and r["a.b"] == f"a.b{k}" and r["tags"] == {"m": k} for k, r in found.items())


def test_stages_on_an_empty_table_with_odd_columns(spark):
    docs = odd_table(spark).limit(0)
    for stage in (language.keep_identified, line_dedup.dedup_lines, near_dedup.keep_one):
        assert stage(docs).columns == docs.columns and stage(docs).count() == 0


@pytest.mark.parametrize("letters", [30, 66, 5_000])
def test_tokens_of_any_length_are_found_beside_an_identifier(spark, letters):
    token = "Q" * (letters // 2) + "q" * (letters // 2) + "7xyz"
    rows = [(1, f"login=alice {token}"), (2, f"login=alice {'q' * letters}"), (3, token)]
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert spans == {1: f"id:0:11,token:12:{12 + len(token)}", 2: "", 3: ""}
