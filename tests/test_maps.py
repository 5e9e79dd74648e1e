"""Projection and layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patentkin.operators.layout import curve, layout, neighbour_graph
from patentkin.operators.projection import add_sums, axes_of_jobs, project_pca, vector_sums


def points(spark, vectors, groups):
    rows = [(g, i, [float(x) for x in v]) for i, (g, v) in enumerate(zip(groups, vectors))]
    return spark.createDataFrame(rows, "group string, id bigint, embedding array<float>")


def svd(vectors):
    centred = vectors - vectors.mean(axis=0)
    return centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T


@pytest.mark.parametrize("chunk_rows", [4_096, 16])
def test_projection_equals_svd_up_to_sign(spark, chunk_rows):
    random = np.random.default_rng(3)
    sizes = {"large": 120, "small": 9, "pair": 2, "single": 1}
    groups = [g for g, n in sizes.items() for _ in range(n)]
    vectors = random.normal(size=(len(groups), 70)).astype(np.float32)
    got = project_pca(points(spark, vectors, groups), chunk_rows).toPandas().sort_values("id")
    assert len(got) == len(groups)
    for group in ("large", "small"):
        mine = [i for i, g in enumerate(groups) if g == group]
        xy = got[got["group"] == group][["x", "y"]].to_numpy()
        assert np.allclose(np.abs(xy), np.abs(svd(vectors[mine].astype(float))), atol=1e-9)
    pair = got[got["group"] == "pair"][["x", "y"]].to_numpy()
    distance = np.linalg.norm(vectors[-3].astype(float) - vectors[-2])
    assert np.isclose(abs(pair[0, 0] - pair[1, 0]), distance) and np.allclose(pair[:, 1], 0)
    assert got[got["group"] == "single"][["x", "y"]].to_numpy().tolist() == [[0.0, 0.0]]


@pytest.mark.parametrize("block_rows", [4_096, 3])
def test_axes_of_jobs_with_changes(spark, block_rows):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(60, 70))
    less, more = {"a": [1, 2], "b": [], "c": [0, 5, 7]}, {"a": [51], "b": [], "c": [50, 52, 53]}
    base = [("k", i, 1, 50, vectors[i].tolist()) for i in range(50)]
    whole = add_sums(vector_sums(spark.createDataFrame(base, "group string, id long, sign int, n long, embedding array<double>")))
    changes = [(j, i, sign, vectors[i].tolist()) for of, sign in ((less, -1), (more, 1)) for j, ids in of.items() for i in ids]
    jobs = spark.createDataFrame([(j, "k") for j in less], "job_uid string, class string")
    changes = spark.createDataFrame(changes, "job_uid string, id long, sign int, embedding array<double>")
    got = {r["group"]: r for r in axes_of_jobs(whole, jobs, changes, block_rows).collect()}
    assert got.keys() == less.keys()
    for job, model in got.items():
        own = vectors[[i for i in range(50) if i not in less[job]] + more[job]]
        assert np.allclose(model["centre"], own.mean(axis=0), atol=1e-9)
        xy = (own - own.mean(axis=0)) @ np.array([model["axis_x"], model["axis_y"]]).T
        assert np.allclose(np.abs(xy), np.abs(svd(own)), atol=1e-7)


def test_groups_cut_by_batches(spark):
    random = np.random.default_rng(4)
    groups = [str(i % 11) for i in range(200)]
    df = points(spark, random.normal(size=(200, 5)), groups).coalesce(1)
    whole = project_pca(df).toPandas().sort_values("id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = project_pca(df).toPandas().sort_values("id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(whole[["x", "y"]], cut[["x", "y"]])


def test_curve():
    assert curve(0.1) == pytest.approx((1.577, 0.895), abs=2e-3)


def test_graph_weights(spark):
    line = [[0.0, 0.0], [1.0, 0.0], [3.0, 0.0], [3.0, 0.0]]
    rows = neighbour_graph(points(spark, line, ["g"] * 4)).collect()
    weight = {(r["src"], r["dst"]): r["weight"] for r in rows}
    far = np.log2(3) - 1
    assert weight[0, 1] == pytest.approx(1.0)  # 0 names 1 first, 1 names 0 first
    assert weight[2, 3] == pytest.approx(1.0)  # copies
    assert weight[1, 2] == pytest.approx(far + 1 - far)  # 1 names 2 second; for 2 it is the first at a distance
    assert all(weight[a, b] == pytest.approx(weight[b, a]) for a, b in weight)


def test_more_neighbours_sum_to_the_log(spark):
    random = np.random.default_rng(8)
    vectors = random.normal(size=(40, 6))
    from patentkin.operators.layout import _rate

    near = spark.createDataFrame([([0.0, 0.3, 0.9, 1.7],), ([0.0, 0.01, 2.0, 5.0],)], "beyond array<double>")
    for row in near.withColumn("rate", _rate(F.col("beyond"), np.log2(5))).collect():
        assert np.exp(-np.array(row["beyond"]) / row["rate"]).sum() == pytest.approx(np.log2(5), abs=1e-6)
    graph = neighbour_graph(points(spark, vectors, ["g"] * 40), n_neighbors=5)
    assert graph.where("weight <= 0 OR weight > 1.0000001").count() == 0


def test_layout_keeps_near_points_near_and_repeats(spark):
    random = np.random.default_rng(6)
    centres = random.normal(size=(4, 12)) * 6
    label = np.repeat(np.arange(4), 15)
    df = points(spark, centres[label] + random.normal(size=(60, 12)) * 0.3, ["g"] * 60)
    graph, start = neighbour_graph(df), project_pca(df)
    first = layout(graph, start, rounds=3).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    again = layout(graph, start, rounds=3).toPandas().sort_values("id")[["x", "y"]].to_numpy()
    assert np.allclose(first, again, atol=1e-6)

    def share_of_own_cluster(xy):
        d = ((xy[:, None] - xy[None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        return (label[np.argsort(d, axis=1)[:, :3]] == label[:, None]).mean()

    assert share_of_own_cluster(first) > 0.9 > share_of_own_cluster(random.normal(size=(60, 2)))
