"""Streams run until the source is read, twice where repetition must not change anything."""

import json

import numpy as np
import pytest

from patentkin.operators.encoding import embed, masked_mean, mean_pool, new_embeddings, text_windows
from patentkin.operators.projection import project_pca
from patentkin.plans.landscape import Tables
from patentkin.streaming import embedding
from patentkin.streaming.embedding import start_embedding, stored_embeddings
from patentkin.sources.tables import JOBS
from patentkin.streaming.embedding import compact_embeddings
from patentkin.streaming.jobs import (
    compact_jobs, current_items, current_results, current_status, latest_record, latest_status, newest_changes, newest_rows, read_jobs,
    start_jobs,
)
from patentkin.streaming.sink import batch_folder, commit, committed, run_of


@pytest.fixture
def tables(spark):
    fam = spark.createDataFrame([(str(i), f"title {i}") for i in range(1, 5)], "family_id string, title string")
    codes = spark.createDataFrame([("1", "F16H")], "family_id string, code string")
    emb = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(1, 5)], "id bigint, embedding array<float>")
    return Tables(fam, codes, emb)


def record(uid, ids, status="to_calculate", client="c", created="2024-01-01T00:00:00"):
    vectors = {"v": 1, "type": "hybrid", "children": [{"node": {"type": "seed_patents", "k": 2, "seeds": {"patentFamilyIds": ids}}}]}
    return {"uid": uid, "client_uid": client, "created_at": created, "_status": status, "search_vectors": vectors}


def put(folder, name, *records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def test_job_stream(spark, tmp_path, tables):
    source, sink = tmp_path / "records", str(tmp_path / "sink")
    put(source, "1.json", record("a", ["1"]), record("b", ["x"]), record("c", ["2"], status="draft"), record(None, ["1"]),
        record("d", ["2"], client=None), record("e", ["1"]), record("e", ["3"], created="2024-01-02T00:00:00"))

    def run(checkpoint="checkpoint"):
        query = start_jobs(read_jobs(spark, str(source)), sink, str(tmp_path / checkpoint), lambda: tables)
        query.awaitTermination()
        status = latest_status(spark.read.parquet(f"{sink}/status")).collect()
        return {r["uid"]: (r["status"], r["progress"], r["message"]) for r in status}

    first = run()
    assert first == {
        "a": ("done", 100, None), "b": ("error", 100, "No seed family IDs found from search vectors"),
        "d": ("error", 100, "Missing 'client_uid' in record"), "e": ("done", 100, None),
    }
    items = spark.read.parquet(f"{sink}/items")
    assert {r["family_id"] for r in items.where("job_uid = 'e' AND is_seed").collect()} == {"3"}
    count = items.count()
    assert run() == first and spark.read.parquet(f"{sink}/items").count() == count  # nothing new
    assert run("lost") == first  # batch 0 again, under a run of its own
    assert newest_rows(spark.read.parquet(f"{sink}/items")).count() == count
    put(source, "2.json", record("b", ["2"]))
    assert run("lost") == {**first, "b": ("done", 100, None)}


def test_late_changes_and_failed_runs(spark, tmp_path, tables):
    source, sink = tmp_path / "records", str(tmp_path / "sink")

    def change(uid, ids, seq):
        return {**record(uid, ids), "commit_seq": seq}

    def run():
        start_jobs(read_jobs(spark, str(source)), sink, str(tmp_path / "checkpoint"), lambda: tables).awaitTermination()
        seeds = current_items(spark, sink).where("is_seed").collect()
        return {(r["job_uid"], r["family_id"]) for r in seeds}

    put(source, "1.json", change("a", ["1"], 5), change("b", ["2"], 5), change("c", ["3"], 5))
    assert run() == {("a", "1"), ("b", "2"), ("c", "3")}
    put(source, "2.json", change("a", ["4"], 4), change("b", ["1"], 5), change("c", ["2"], 6))
    assert run() == {("a", "1"), ("b", "2"), ("c", "2")}
    folder = compact_jobs(spark, sink)
    assert committed(spark, f"{sink}/manifest").base == folder and not committed(spark, f"{sink}/manifest").batches
    before = current_items(spark, sink).count()
    put(source, "3.json", change("a", ["x"], 7), change("b", ["3"], 3))
    assert run() == {("b", "2"), ("c", "2")}  # the newest run of a has failed, so its older items are gone
    assert current_items(spark, sink).count() < before
    status = {r["uid"]: r["status"] for r in current_status(spark, sink).collect()}
    assert status == {"a": "error", "b": "done", "c": "done"}
    compact_jobs(spark, sink)
    assert {r["uid"]: r["status"] for r in current_results(spark, sink).collect()} == status
    assert {r["uid"]: r["status"] for r in current_status(spark, sink).collect()} == status


def test_a_batch_costs_no_python_per_job_and_runs_with_adaptive_execution(spark, tmp_path, tables):
    source, adaptive = tmp_path / "records", []
    put(source, "1.json", record("a", ["1"]), record("b", ["2"]))
    records = read_jobs(spark, str(source))
    assert "Pandas" not in newest_changes(records)._jdf.queryExecution().logical().toString()

    def project(vectors):
        adaptive.append(vectors.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return project_pca(vectors)

    start_jobs(records, str(tmp_path / "sink"), str(tmp_path / "checkpoint"), lambda: tables, project).awaitTermination()
    assert adaptive == ["true"]


def test_changes_without_a_number(spark, tmp_path):
    source, seen = tmp_path / "records", []

    def run(*records):
        put(source, f"{len(seen)}.json", *records)
        rows = []
        query = newest_changes(read_jobs(spark, str(source))).writeStream.outputMode("update")
        query = query.foreachBatch(lambda batch, _: rows.extend(batch.collect()))
        query.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        seen.append(rows)
        return {r["uid"]: json.loads(r["search_vectors"])["children"][0]["node"]["seeds"]["patentFamilyIds"] for r in rows}

    day = "2024-01-0{}T00:00:00".format
    assert run(record("a", ["1"], created=day(2)), record("a", ["2"], created=day(1)), record("n", ["1"], created=None)) == {"a": ["1"], "n": ["1"]}
    assert run(record("a", ["0"], created=day(2)), record("n", ["0"], created=None)) == {"a": ["0"], "n": ["0"]}
    assert run(record("a", ["3"], created=day(1)), record("b", ["3"], created=day(1))) == {"b": ["3"]}


def test_batches_without_an_entry_are_not_read(spark, tmp_path):
    sink, schema = str(tmp_path / "vectors"), "id bigint, embedding array<float>"
    for run, batch in (("1", 0), ("1", 1), ("2", 0)):
        rows = spark.createDataFrame([(batch, [1.0]), (7, [float(run)])], schema)
        rows.write.parquet(batch_folder(sink, run, batch))
        if (run, batch) != ("1", 1):
            commit(spark, f"{sink}-manifest", run, batch)
    assert sorted((r["id"], r["run_id"]) for r in stored_embeddings(spark, sink).collect()) == [(0, "1"), (0, "2"), (7, "1"), (7, "2")]
    compact_embeddings(spark, sink)
    assert sorted((r["id"], r["run_id"]) for r in stored_embeddings(spark, sink).collect()) == [(0, "1"), (7, "1")]
    commit(spark, f"{sink}-manifest", "1", 1)
    assert stored_embeddings(spark, sink).count() == 4
    assert stored_embeddings(spark, str(tmp_path / "nothing")).count() == 0


def test_a_run_keeps_its_name(spark, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")
    spark.createDataFrame([], "run string").write.parquet(f"{checkpoint}/run")  # a process died before it wrote the name
    name = run_of(spark, checkpoint)
    assert name and run_of(spark, checkpoint) == name


def test_two_changes_of_a_job_in_one_batch(spark):
    old, new = json.dumps(record("a", ["1"])["search_vectors"]), json.dumps(record("a", ["0"])["search_vectors"])
    rows = [("a", "c", None, 7, "to_calculate", new), ("a", "c", None, 6, "to_calculate", old)]
    newest = latest_record(spark.createDataFrame(rows, JOBS)).collect()
    assert [r["search_vectors"] for r in newest] == [new]


def test_embedding_stream(spark, tmp_path):
    pending = spark.createDataFrame(
        [(i, f"title {i}", "text") for i in range(20)] + [(3, "title 3", "text")], "family_id bigint, title string, abstract string"
    )
    source, sink = str(tmp_path / "shards"), str(tmp_path / "vectors")
    pending.repartition(4).write.parquet(source)

    def run(checkpoint, **options):
        start_embedding(spark, source, sink, str(tmp_path / checkpoint), shards_per_batch=2, **options).awaitTermination()
        return stored_embeddings(spark, sink).groupBy("id").count().collect()

    first = run("one")
    assert len(first) == 20 and {r["count"] for r in first} == {1}
    vectors = {r["id"]: r["embedding"] for r in stored_embeddings(spark, sink).collect()}
    wanted = {r["id"]: r["embedding"] for r in embed(pending).collect()}
    assert vectors == wanted
    assert len(run("one")) == 20  # no new shards
    before = stored_embeddings(spark, sink).count()
    spark.createDataFrame([(3, "title 3", "text"), (50, "new", "text")], pending.schema).write.mode("append").parquet(source)
    again = run("one")
    assert len(again) == 21 and {r["count"] for r in again} == {1}
    assert stored_embeddings(spark, sink).count() == before + 1


def test_two_sources_with_two_checkpoints_share_a_sink(spark, tmp_path):
    schema, sink = "family_id bigint, title string, abstract string", str(tmp_path / "vectors")
    for day, ids in (("one", [1, 2]), ("two", [2, 3])):
        spark.createDataFrame([(i, "t", "a") for i in ids], schema).write.parquet(str(tmp_path / day))
        start_embedding(spark, str(tmp_path / day), sink, str(tmp_path / f"checkpoint-{day}")).awaitTermination()
    assert sorted(r["id"] for r in stored_embeddings(spark, sink).collect()) == [1, 2, 3]


def test_a_long_run_does_not_open_all_its_folders_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding, "FOLD_BATCHES", 2)
    sink, schema = str(tmp_path / "vectors"), "id bigint, embedding array<float>"
    stored_ids = embedding._stored_ids(spark, sink)
    assert stored_ids().count() == 0
    for batch in range(5):
        spark.createDataFrame([(batch, [1.0]), (None, [1.0])], schema).coalesce(1).write.parquet(batch_folder(sink, "1", batch))
        commit(spark, f"{sink}-manifest", "1", batch)
        ids = stored_ids()
        rows = [(r["id"], r["run_id"], r["batch_id"]) for r in ids.where("id is not null").collect()]
        assert sorted(rows) == [(b, "1", b) for b in range(batch + 1)] and ids.count() == 2 * (batch + 1)
        assert len(ids.inputFiles()) < 2
    compact_embeddings(spark, sink)
    assert sorted(r["id"] for r in stored_ids().where("id is not null").collect()) == [0, 1, 2, 3, 4]


def test_finished_shards_are_deleted(spark, tmp_path):
    source, sink = tmp_path / "shards", str(tmp_path / "vectors")
    schema = "family_id bigint, title string, abstract string"
    for i in range(3):
        spark.createDataFrame([(i, "t", "a")], schema).coalesce(1).write.mode("append").parquet(str(source))
    start_embedding(
        spark, str(source), sink, str(tmp_path / "checkpoint"), shards_per_batch=1, done_shards="delete"
    ).awaitTermination()
    assert stored_embeddings(spark, sink).count() == 3
    # The last shards go with the next batch.
    assert len(list(source.glob("*.parquet"))) < 3


def test_new_embeddings(spark):
    encoded = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (2, [2.0])], "id bigint, embedding array<float>")
    existing = spark.createDataFrame([(1, [0.0])], "id bigint, embedding array<float>")
    assert [tuple(r) for r in new_embeddings(encoded, existing).collect()] == [(2, [2.0])]


def test_long_texts_are_read_whole_in_windows(spark):
    long = " ".join(f"w{i}" for i in range(600))
    pending = spark.createDataFrame([(1, "a", long), (2, "a", long + " more"), (3, "a", "b"), (4, "¿", "¡")], "family_id bigint, title string, abstract string")
    vectors = {r["id"]: r["embedding"] for r in embed(pending).collect()}
    assert vectors[1] != vectors[2]
    whole = {r["id"]: r["embedding"] for r in embed(pending, max_length=1_000).collect()}
    assert all(np.allclose(whole[i], vectors[i], atol=1e-6) for i in whole)
    assert [n for _, n in text_windows("a b-c  d e", 2)] == [1, 2, 2]
    assert set(vectors[4]) == {0.0}  # no token at all


def test_mean_pool_table_equals_batch_form(spark):
    random = np.random.default_rng(2)
    vectors, mask = random.normal(size=(3, 5, 4)).astype(np.float32), np.array([[1, 1, 0, 1, 0], [1, 0, 0, 0, 0], [0] * 5])
    rows = [(d, p, int(mask[d, p]), [float(x) for x in vectors[d, p]]) for d in range(3) for p in range(5)]
    got = mean_pool(spark.createDataFrame(rows, "doc int, pos int, mask int, vec array<float>")).orderBy("doc").collect()
    assert np.allclose([r["embedding"] for r in got], masked_mean(vectors, mask), atol=1e-6)
    assert got[2]["embedding"] == [0.0] * 4
