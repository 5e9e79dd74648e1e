"""The pipeline stage by stage and against a plain version, and every registered corpus query over a whole table."""

import random

import pytest

pytest.importorskip("patentkin.llm")

import corpus_pipeline  # noqa: E402
from patentkin.llm import decontaminate, line_dedup, near_dedup, packing  # noqa: E402
from patentkin.llm.queries import QUERIES  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    table = {"op7": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    rows = QUERIES[name](spark, TABLES)
    n = spark.read.parquet(f"{TABLES}/{table}.parquet").count()
    if name.startswith("op12_"):  # a row per word
        assert rows.count() == rows.select("word").distinct().count() > n
    elif name.startswith("op13_"):  # and eight components
        assert rows.count() == 8 * n
    else:
        assert rows.count() >= n if name.startswith("op10_") else rows.count() == n


def test_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, TABLES)
        assert after.columns == docs.columns, name
        before = spark.createDataFrame(after.collect(), docs.schema)
    assert 0 < before.count() < docs.count()
    assert line_dedup.mark_lines(before).where("size(deleted) > 0").count() == 0
    assert near_dedup.near_duplicates(before).where("not kept").count() == 0
    benchmark = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    assert decontaminate.contamination(before, benchmark).where("contaminated").count() == 0
    packed = corpus_pipeline.run(spark, TABLES)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def plain_run(rows, items):
    """Tokens left of every document: the stages by plain rules, one after the other."""
    from test_llm_operators import deleted_lines, shingles, words_of

    rows = [(i, t) for i, t in rows if any(map(str.isalpha, t or ""))]
    gone = deleted_lines(rows, line_dedup.MIN_WORDS)
    cut = [(i, t, gone.get((i, t), [])) for i, t in rows]
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lines) if lines else t) for i, t, lines in cut]
    rows = [(i, t) for (i, t), (_, _, lines) in zip(rows, cut, strict=True) if not lines or t.strip()]
    sets, tied = [(i, shingles(t, 5)) for i, t in rows], {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and tied[i] != tied[j] and 100 * len(a & b) >= 80 * len(a | b):
                    tied[i] = tied[j] = min(tied[i], tied[j])
                    changed = True
    rows = [(i, t) for i, t in rows if tied[i] == i]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for t in items:
        own = words_of(t, pattern)
        windows |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9))} if own else set()
    sizes = {len(w) for w in windows}

    def hit(t):
        own = words_of(t, pattern)
        return any(tuple(own[k : k + n]) in windows for n in sizes for k in range(len(own) - n + 1))

    model = packing.encoder("byte_bpe_50k")
    model.ids("  ")
    return {i: len(model.whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows if not hit(t)}


def test_run_equals_a_plain_version(spark, tmp_path):
    from test_llm_operators import prose

    chance = random.Random(11)
    passage = "\n".join(prose(700 + k, 14) for k in range(5))
    rows = [(1, passage), (2, "own words here\n" + passage + "\n" + prose(2, 30)), (3, passage), (4, None), (5, ""), (6, "12 ?!"), (7, "short text")]
    for g in range(4):
        own = prose(100 + g, 90).split()
        for k in range(8):
            changed = list(own)
            for _ in range(chance.randrange(5)):
                changed[chance.randrange(90)] = f"x{g}y{k}z{chance.randrange(9)}"
            rows.append((100 * (g + 1) + k, " ".join(changed)))
    items = [prose(900, 30), "only three words", prose(901, 12)]
    rows += [(800, prose(3, 20) + " " + " ".join(items[0].split()[5:17])), (801, "with Only, three WORDS inside"), (802, " ".join(items[0].split()[3:12]))]
    rows += [(803, prose(4, 3_000)), (804, prose(5, 40) + "\n\n" + prose(6, 40))]
    chance.shuffle(rows)
    table = [(i, t, ("en", "de")[i % 2], "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    benchmark = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(items)], "item_id string, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    found, places = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert found == plain_run(rows, items)
    assert 800 not in found and 801 not in found and {802, 803, 2, 1} <= set(found) and 3 not in found
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2_048
    assert len(places) <= 1.5 * -(-sum(found.values()) // 2_048)
