"""Neighbour search against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patentkin.operators import tenants
from patentkin.operators import block_search, metric_index
from patentkin.operators import neighbours as near
from patentkin.operators.metric_index import build_index, visits
from patentkin.operators.landscapes import job_neighbours, merge_neighbours
from patentkin.operators.tenants import enrich

SCHEMA = "id bigint, embedding array<float>"


def table(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], SCHEMA)


def brute(ids, vectors, k, digits):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = np.round(unit @ unit.T, digits)
    out = {}
    for i, seed in enumerate(ids):
        order = np.lexsort((ids, -scores[i]))
        out[seed] = [(ids[j], scores[i, j]) for j in order if j != i][:k]
    return out


@pytest.fixture(scope="module")
def cloud():
    random = np.random.default_rng(5)
    vectors = random.normal(size=(240, 8)).astype(np.float32)
    vectors[80:160] = vectors[0]  # a third of all vectors are copies of one
    ids = random.permutation(1_000)[:240]
    return ids, vectors


@pytest.mark.parametrize("bytes_allowed", [2**26, 0])
@pytest.mark.parametrize("bound_rows", [2**30, 0])
@pytest.mark.parametrize("k", [1, 7, 300])
def test_equals_brute_force(spark, cloud, monkeypatch, bytes_allowed, bound_rows, k):
    ids, vectors = cloud
    monkeypatch.setattr(near, "BOUND_ROWS", bound_rows)
    monkeypatch.setattr(near, "BOUND_PART", 4)
    monkeypatch.setattr(metric_index, "CELL_ROWS", 70)
    monkeypatch.setattr(block_search, "CHUNK_ROWS", 64)
    emb = table(spark, vectors, ids).repartition(3)
    seeds = emb.select(F.col("id").alias("seed_id"))
    rows = near.knn_by_id(seeds, emb, k, broadcast_bytes=bytes_allowed).orderBy("seed_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r["seed_id"], []).append((r["family_id"], r["similarity"]))
    wanted = brute(ids, vectors.astype(float), k, 4)
    assert {s: [i for i, _ in found] for s, found in got.items()} == {s: [i for i, _ in w] for s, w in wanted.items()}
    assert all(np.allclose([x for _, x in got[s]], [x for _, x in wanted[s]]) for s in wanted)


def test_by_vector_keeps_the_query_itself_and_ties_by_id(spark, cloud):
    ids, vectors = cloud
    emb = table(spark, vectors, ids)
    queries = spark.createDataFrame([(1, [float(x) for x in vectors[0]])], "query_id bigint, embedding array<float>")
    rows = near.knn_by_vector(queries, emb, 4).orderBy("rank").collect()
    copies = sorted([int(ids[0]), *[int(i) for i in ids[80:160]]])
    assert [r["id"] for r in rows] == copies[:4]
    assert all(abs(r["distance"]) < 1e-9 for r in rows)


def test_depth_of_each_seed(spark, cloud):
    ids, vectors = cloud
    emb = table(spark, vectors, ids)
    seeds = spark.createDataFrame([(int(ids[0]), 2), (int(ids[1]), 5), (int(ids[1]), 3)], "seed_id bigint, k int")
    counts = near.knn_by_id(seeds, emb).groupBy("seed_id").count().collect()
    assert {r[0]: r[1] for r in counts} == {int(ids[0]): 2, int(ids[1]): 5}


def test_vectors_without_length(spark):
    emb = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [float("nan"), 1.0])], SCHEMA
    )
    seeds = spark.createDataFrame([(1,), (2,), (9,)], "seed_id bigint")
    assert [tuple(r) for r in near.knn_by_id(seeds, emb, 5).collect()] == [(1, 3, 0.7071, 1)]


def test_vectors_as_text(spark):
    emb = spark.createDataFrame([(1, "[1,0]"), (2, "(1,1)"), (3, "{1,x}"), (4, "[]")], "id bigint, embedding string")
    seeds = spark.createDataFrame([(1,)], "seed_id bigint")
    assert [tuple(r) for r in near.knn_by_id(seeds, emb, 5).collect()] == [(1, 2, 0.7071, 1)]
    assert sorted(r["id"] for r in near.vectors_for(emb.select("id"), emb).collect()) == [1, 2]


def test_no_seeds(spark, cloud):
    ids, vectors = cloud
    emb = table(spark, vectors, ids)
    assert near.knn_by_id(spark.createDataFrame([], "seed_id bigint"), emb, 5).collect() == []


def test_vectors_of_another_length_are_left_out_and_reported(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 1.0])], SCHEMA).coalesce(1)
    seeds = spark.createDataFrame([(1,), (2,)], "seed_id long")
    assert {(r["seed_id"], r["family_id"]) for r in near.knn_by_id(seeds, emb, 5).collect()} == {(1, 3)}
    assert [tuple(r) for r in near.odd_vectors(emb).collect()] == [(2, 1)]


def test_an_id_stored_twice_takes_one_place(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [0.9, 0.1]), (3, [1.0, 0.3]), (4, [1.0, 0.5]), (5, [1.0, 0.9])]
    emb = spark.createDataFrame(rows, SCHEMA)
    found = near.knn_by_id(spark.createDataFrame([(1,)], "seed_id long"), emb, 4).orderBy("rank").collect()
    assert [r["family_id"] for r in found] == [2, 3, 4, 5]


def test_within_groups(spark, cloud):
    ids, vectors = cloud
    points = table(spark, vectors, ids).withColumn("group", (F.col("id") % 3).cast("string"))
    wanted = {}
    for g in range(3):
        mine = [i for i in range(len(ids)) if ids[i] % 3 == g]
        for i in mine:
            d = [(round(float(((vectors[i].astype(float) - vectors[j]) ** 2).sum()), 9), ids[j]) for j in mine if j != i]
            wanted[ids[i]] = [j for _, j in sorted(d)[:2]]
    for cell_bytes in (near.CELL_BYTES, 20 * 8 * 8):
        rows = near.knn_within(points, 2, cell_bytes=cell_bytes).orderBy("query_id", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == wanted


@pytest.mark.parametrize("cell_rows", [1, 20, 1_000])
def test_cells_that_cannot_hold_a_neighbour_are_skipped(spark, cell_rows):
    random = np.random.default_rng(8)
    centres = random.normal(size=(12, 8)) * 5
    vectors = (centres[np.arange(240) % 12] + random.normal(size=(240, 8)) * 0.05).astype(np.float32)
    vectors[7] = vectors[31]  # a tie
    ids = list(range(1_000, 1_240))
    emb = table(spark, np.vstack([vectors, np.zeros((1, 8), dtype=np.float32)]), [*ids, 5])
    seeds = emb.select(F.col("id").alias("seed_id"), (F.col("id") % 4).cast("int").alias("k"))
    columns = ["seed_id", "rank", "family_id", "similarity"]

    def rows(**options):
        return [tuple(r) for r in near.knn_by_id(seeds, emb, **options).select(*columns).orderBy(*columns[:2]).collect()]

    assert rows(broadcast_bytes=0, cell_rows=cell_rows) == rows()
    index = build_index(emb, cell_rows)
    assert int(index.rows.sum()) == 240
    open_ = emb.select(F.col("id").alias("query_id"), F.lit(3).alias("k"), F.lit(0.99).alias("floor"), "embedding")
    first, rest = (visits(index, open_, 4, turn) for turn in (True, False))
    both = first.select("query_id", "cell").union(rest.select("query_id", "cell"))
    assert both.distinct().count() == both.count()
    if cell_rows == 20:
        assert both.count() < 240 * len(index.rows) / 2


def test_plan_has_no_pairwise_join(spark, cloud):
    ids, vectors = cloud
    emb = table(spark, vectors, ids)
    for allowed in (2**26, 0):
        found = near.knn_by_id(emb.select(F.col("id").alias("seed_id")), emb, 3, broadcast_bytes=allowed)
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert "WindowGroupLimit" in plan


def test_merge(spark):
    seeds = spark.createDataFrame([("j", 1, 2), ("j", 2, 2), ("k", 1, 1)], "job_uid string, seed_id bigint, k int")
    found = spark.createDataFrame(
        [(1, 5, 0.5, 1), (1, 2, 0.4, 2), (2, 5, 0.9, 1), (2, 6, 0.1, 2)],
        "seed_id bigint, family_id bigint, similarity double, rank int",
    )
    merged = merge_neighbours(job_neighbours(seeds, found), seeds.withColumnRenamed("seed_id", "family_id"))
    assert {(r[0], r[1], r[2], tuple(r[3])) for r in merged.collect()} == {
        ("j", 5, 0.9, (1, 2)), ("j", 6, 0.1, (2,)), ("k", 5, 0.5, (1,))
    }


def test_enrich(spark):
    neighbours = spark.createDataFrame([("c", 1, 7), ("d", 1, 7), ("c", 1, 8)], "client_uid string, seed_id bigint, family_id bigint")
    fam = spark.createDataFrame(
        [("7", "t", "a", ["EP"], None)],
        "family_id string, title string, abstract string, family_authorities array<string>, first_application_pub_date date",
    )
    sonars = spark.createDataFrame(
        [("c", "7", None), ("c", "7", None), ("d", "7", "2020")], "client_uid string, patent_family_id string, deactivated_at string"
    )
    lists = spark.createDataFrame([(1, "c", "mine"), (2, "d", "other")], "uid int, client_uid string, name string")
    items = spark.createDataFrame(
        [(1, "7", "c"), (1, "7", "c"), (2, "7", "c")], "list_uid int, patent_family_id string, client_uid string"
    )
    rows = {(r["client_uid"], r["family_id"]): r for r in enrich(neighbours, fam, sonars, lists, items).collect()}
    assert len(rows) == 3
    mine = rows["c", 7]
    assert mine["sonar_is_active"] and mine["title"] == "t"
    assert [tuple(e) for e in mine["lists"]] == [(None, None, 1), ("mine", 1, 2)]
    assert not rows["d", 7]["sonar_is_active"] and rows["d", 7]["lists"] is None
    assert rows["c", 8]["title"] is None and not rows["c", 8]["sonar_is_active"]


def test_a_search_holds_few_scores_whatever_the_number_of_cells_and_queries(monkeypatch):
    from patentkin.operators import block_search

    random = np.random.default_rng(5)
    vectors, held = random.normal(size=(700, 4)), []
    ids, whole = np.arange(700), block_search._scores
    monkeypatch.setattr(block_search, "CHUNK_SCORES", 2**12)
    monkeypatch.setattr(block_search, "_scores", lambda *a: held.append(whole(*a)) or held[-1])
    open_ = np.full(700, -np.inf)
    found = list(block_search._search(ids, vectors, np.full(700, 3), open_, [(ids, vectors)], "cosine", 12, True))
    got = pa.Table.from_batches(found).to_pandas().sort_values(["query_id", "score"], ascending=[True, False])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = unit @ unit.T
    np.fill_diagonal(scores, -np.inf)
    assert got["id"].to_numpy().reshape(700, 3).tolist() == np.argsort(-scores, axis=1)[:, :3].tolist()
    assert max(s.size for s in held) <= 2**12


def test_memberships_are_grouped_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tenants, "PART_ROWS", 10)
    lists = spark.createDataFrame([(1, "c", "one"), (2, "d", "two")], "uid bigint, client_uid string, name string")
    items = spark.createDataFrame([(1 + i % 2, str(i // 4), "c") for i in range(95)], "list_uid bigint, patent_family_id string, client_uid string")
    held = tenants.list_memberships(lists, items)
    assert held.rdd.getNumPartitions() == 10
    rows = {r["patent_family_id"]: [tuple(e) for e in r["lists"]] for r in held.collect()}
    assert len(rows) == 24 and rows["0"] == [(None, None, 2), ("one", 1, 2)] and rows["23"] == [(None, None, 1), ("one", 1, 2)]
