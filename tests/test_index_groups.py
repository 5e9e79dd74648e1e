"""Queries that have to look into many small cells of the metric index."""

import numpy as np
from pyspark.sql import functions as F

from patentkin.operators import metric_index
from patentkin.operators.neighbours import knn_by_id
from patentkin.operators.skew import store_columns


def test_a_query_travels_once_for_the_cells_of_a_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 24))
    emb = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    stored = []
    monkeypatch.setattr(metric_index, "cut_lineage", lambda df: [out := store_columns(df), stored.append((out.columns, out.count()))][0])
    found = knn_by_id(emb.select(F.col("id").alias("seed_id")), emb, 5, broadcast_bytes=0, cell_rows=4).collect()
    assert max(n for columns, n in stored if "embedding" in columns) <= 300
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    score = np.round(unit @ unit.T, 4)
    np.fill_diagonal(score, -9)
    wanted = {(i, int(f), r + 1) for i in range(300) for r, f in enumerate(np.lexsort((np.arange(300), -score[i]))[:5])}
    assert {(r["seed_id"], r["family_id"], r["rank"]) for r in found} == wanted
