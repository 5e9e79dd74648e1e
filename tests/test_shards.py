"""Shards and pending families."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patentkin.functions.text import row_size
from patentkin.operators.pending import backlog, pending_families
from patentkin.operators.shards import assign_shards, composed, range_steps, write_shards
from patentkin.sources.tables import read_shards


def families(spark, n):
    return spark.range(n).select(
        (F.col("id") * 7 % 1009).alias("family_id"),
        F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"),
        F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("abstract"),
    )


def sized(df, target, rows_per_range):
    """(family_id, shard, bytes) in the order of the ids."""
    planned = assign_shards(df, target, rows_per_range=rows_per_range)
    rows = planned.withColumn("bytes", row_size(F.col("title"), F.col("abstract"))).orderBy("family_id").collect()
    return [(r["family_id"], r["shard"], r["bytes"]) for r in rows]


def greedy(sizes, target):
    shards, filled = [], 0
    for size in sizes:
        if shards and (not filled or filled + size < target):
            shards.append(shards[-1])
        else:
            shards.append(shards[-1] + 1 if shards else 0)
            filled = 0
        filled += size
    return shards


@pytest.mark.parametrize("target", [200, 1_000, 50_000])
def test_one_range_is_filled_greedily(spark, target):
    rows = sized(families(spark, 500), target, 200_000)
    assert [s for _, s, _ in rows] == greedy([b for *_, b in rows], target)


@pytest.mark.parametrize("rows_per_range", [1, 7, 40])
@pytest.mark.parametrize("target", [40, 2_000, 100_000])
def test_ranges_side_by_side_equal_one_pass(spark, rows_per_range, target):
    df = families(spark, 300)
    plans = [
        {r["family_id"]: r["shard"] for r in assign_shards(df, target, rows_per_range=n).collect()} for n in (200_000, rows_per_range)
    ]
    assert plans[0] == plans[1] and len(plans[0]) == 300


def test_composed_steps_equal_one_pass():
    chance = random.Random(1)

    def one_pass(sizes, target, filled):
        closed = 0
        for size in sizes:
            if filled and filled + size >= target:
                closed, filled = closed + 1, 0
            filled += size
        return closed, filled

    for _ in range(400):
        target = chance.choice([5, 20, 100])
        parts = [[chance.choice([1, 2, 3, 7, 30, 100]) for _ in range(chance.randrange(1, 20))] for _ in range(chance.randrange(1, 5))]
        steps = range_steps(np.array(parts[0]), target)
        for part in parts[1:]:
            steps = composed(steps, range_steps(np.array(part), target))
        for filled in (0, 1, 2, target - 1, target, chance.randrange(2 * target)):
            closed, left = steps(np.array([filled]))
            assert (closed[0], left[0]) == one_pass(sum(parts, []), target, filled)


@pytest.mark.parametrize("rows_per_range", [200_000, 40])
@pytest.mark.parametrize("target", [200, 1_000, 50_000])
def test_every_shard_is_below_the_target_and_in_order(spark, rows_per_range, target):
    rows = sized(families(spark, 500), target, rows_per_range)
    assert len(rows) == 500
    shards = [s for _, s, _ in rows]
    assert shards == sorted(shards) and set(shards) == set(range(shards[-1] + 1))
    total = {}
    for _, s, b in rows:
        total[s] = total.get(s, 0) + b
    assert max(total.values()) < target
    early = sum(total[a[1]] + b[2] < target for a, b in zip(rows, rows[1:]) if a[1] != b[1])
    assert early < 500 / rows_per_range + 1  # only the end of a range closes a shard early


def test_rows_above_the_target(spark):
    rows = sized(families(spark, 30), 40, 7)
    assert len(rows) == 30 and len({s for _, s, _ in rows}) == 30


def test_one_large_row_changes_no_other_shard(spark):
    df = families(spark, 500)
    heavy = F.when(F.col("family_id") == 497, F.repeat(F.lit("x"), 950)).when(F.col("family_id") == 700, F.repeat(F.lit("x"), 5_000))
    plain, odd = (sized(x, 1_000, 200_000) for x in (df, df.withColumn("abstract", F.coalesce(heavy, "abstract"))))
    assert [s for _, s, _ in odd] == greedy([b for *_, b in odd], 1_000)
    total = {}
    for _, s, b in odd:
        total.setdefault(s, []).append(b)
    assert [x for x in total.values() if sum(x) >= 1_000] == [[x for *_, x in odd if x > 5_000]]
    assert len(total) <= plain[-1][1] + 1 + 4


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (None, "c", None), (2, None, "d")], "family_id long, title string, abstract string")
    rows = assign_shards(df, 100).collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["family_id"] == 1}) == 1


def test_nothing_to_shard(spark):
    assert assign_shards(families(spark, 10).where("family_id < 0"), 100).count() == 0


def test_stored_shards(spark, tmp_path):
    planned = assign_shards(families(spark, 300), 2_000, rows_per_range=50)
    write_shards(planned, str(tmp_path / "shards"))
    wanted = planned.select("shard").distinct().count()
    files = list((tmp_path / "shards").glob("shard=*/*.parquet"))
    assert len(files) == wanted and all(f.name.endswith(".snappy.parquet") for f in files)
    back = read_shards(spark, str(tmp_path / "shards"))
    assert back.schema.simpleString() == "struct<family_id:bigint,title:string,abstract:string>"
    assert {r["family_id"] for r in back.collect()} == {r["family_id"] for r in families(spark, 300).collect()}


def test_pending(spark):
    fam = spark.createDataFrame(
        [("3", "t", "a"), ("1", "t", "a"), ("2", "t", "a"), ("X4", "t", "a"), ("5", " ", "a"), ("6", "t", None),
         (None, "t", "a"), ("99999999999999999999", "t", "a")],
        "family_id string, title string, abstract string",
    )
    emb = spark.createDataFrame([(2, [1.0]), (2, [1.0])], "id bigint, embedding array<float>")
    pending = pending_families(fam, emb)
    assert sorted(r["family_id"] for r in pending.collect()) == [1, 3]
    assert [r["family_id"] for r in pending_families(fam, emb, 1).collect()] == [1]
    assert backlog(fam, emb).first()["families_pending"] == 2
    plan = pending_families(fam, emb, 1)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "TakeOrderedAndProject" in plan
