"""Requests: what passes, what is refused, and what is read from them."""

import json

import numpy as np
import pytest
from pyspark.sql import Row

from patentkin.operators import classification
from patentkin.operators import landscapes as land
from patentkin.operators import requests as req
from patentkin.operators.landscapes import to_output
from patentkin.operators.skew import cut_lineage
from patentkin.plans import landscape
from patentkin.plans.landscape import Tables, project_graph, run_jobs


def request(*nodes, **top):
    return {"v": 1, "type": "hybrid", "children": [{"node": n, "order": i} for i, n in enumerate(nodes)], **top}


def patents(*ids, k=None, negative=(), **more):
    node = {"type": "seed_patents", "seeds": {"patentFamilyIds": list(ids), "negativePatentFamilyIds": list(negative)}, **more}
    return node if k is None else {**node, "k": k}


def cpc(*codes):
    return {"type": "cpc", "classes": [{"code": c, "depth": "exact"} for c in codes]}


GOOD = [
    request(patents("4711", "4712", k=5), cpc("A01B1/02")),
    request(),
    {"v": 1, "type": "hybrid"},
    request({"type": "seed_patents", "seeds": {}, "k": None, "name": None}),
    request({"type": "seed_patents", "seeds": {"patentFamilyIds": None}, "k": "7"}),
    request({"type": "seed_docs", "docs": None}),
    request({"type": "seed_docs", "docs": [{"id": "d", "textRef": {"uri": "u"}, "weight": "0.5"}], "k": 3}),
    request(patents("1", filters={
        "date": {"field": "grant", "from": "2020-01-01"}, "authority": ["EP"], "familySize": {"min": 1},
        "assignee": {"include": ["x"], "fuzzy": True}, "status": ["granted"], "cpcInclude": [], "textMustContain": ["y"],
    })),
]

BAD = [
    ("{", "no JSON"), ("[]", "request: wrong value"), ("null", "request: wrong value"),
    (request(v=2), "v: wrong value"), (request(v="1"), "v: wrong value"), (request(v=True), "v: wrong value"),
    (request(type="other"), "type: wrong value"), (request(more=1), "more: unknown field"),
    (request(children=None), "children: wrong value"), (request(children=[{}]), "node: missing"),
    (request(children=[{"node": cpc("A"), "extra": 1}]), "extra: unknown field"),
    (request(children=[{"node": cpc("A"), "order": "x"}]), "order: wrong value"),
    (request({"type": "seed_text"}), "node.type: wrong value"), (request({"seeds": {}}), "node.type: wrong value"),
    (request({"type": "seed_patents"}), "node.seeds: missing"), (request({"type": "seed_patents", "seeds": None}), "node.seeds: missing"),
    (request({"type": "cpc"}), "node.classes: missing"), (request({"type": "seed_docs"}), "node.docs: missing"),
    (request(patents(1)), "node.seeds.patentFamilyIds: wrong value"),
    (request(patents("1", None)), "node.seeds.patentFamilyIds: wrong value"),
    (request(patents("1", depth=1)), "node.depth: unknown field"),
    (request({"type": "seed_patents", "seeds": {"ids": []}}), "node.seeds.ids: unknown field"),
    (request(patents("1", k=1.5)), "node.k: wrong value"), (request(patents("1", k="x")), "node.k: wrong value"),
    (request({"type": "cpc", "classes": [{"code": "A", "depth": "all"}]}), "node.classes.depth: wrong value"),
    (request({"type": "cpc", "classes": [{"depth": "exact"}]}), "node.classes.code: missing"),
    (request(patents("1", filters={"date": {"field": "today"}})), "node.filters.date.field: wrong value"),
    (request(patents("1", filters={"familySize": {"least": 1}})), "node.filters.familySize.least: unknown field"),
    (request(patents("1", filters={"assignee": {"fuzzy": "maybe"}})), "node.filters.assignee.fuzzy: wrong value"),
    (request({"type": "seed_docs", "docs": [{"textRef": {}}]}), "node.docs.textRef.uri: missing"),
]


@pytest.mark.parametrize("given", GOOD)
def test_accepted(given):
    assert req.check_request(json.dumps(given)) is None


@pytest.mark.parametrize("given, problem", BAD)
def test_refused(given, problem):
    assert req.check_request(given if isinstance(given, str) else json.dumps(given)) == problem


def jobs(spark, **requests):
    rows = [(uid, "c", r if r is None or isinstance(r, str) else json.dumps(r)) for uid, r in requests.items()]
    return spark.createDataFrame(rows, "job_uid string, client_uid string, search_vectors string")


@pytest.fixture
def tables(spark):
    fam = spark.createDataFrame([(str(i), f"title {i}" if i % 2 else "") for i in range(1, 8)] + [("X9", "x")], "family_id string, title string")
    codes = spark.createDataFrame([("6", "F16H"), ("7", "F16H"), ("X9", "F16H")], "family_id string, code string")
    vectors = [(i, [1.0, i / 10, 0.5 * (i % 2)]) for i in range(1, 7)]
    return Tables(fam, codes, spark.createDataFrame(vectors, "id bigint, embedding array<float>"))


def test_depth(spark):
    parsed = req.parse_requests(
        jobs(spark, a=request(patents("1", k=5), patents("2", k=9)), b=request(patents("1", k=0)), c=request(patents("1", k=-4)),
             d=request(cpc("A")), e=request({"type": "seed_docs", "docs": None, "k": 3}), f=request(patents("1", k="8")))
    )
    assert {r["job_uid"]: r["k"] for r in req.k_of(parsed).collect()} == {"a": 9, "b": 200, "c": 200, "d": 200, "e": 200, "f": 8}


def test_odd_numbers_neither_stop_the_batch_nor_change(spark):
    doc = {"type": "seed_docs", "docs": [{"title": "t", "weight": "0.5"}], "k": "7.0"}
    huge = json.dumps(request(patents("1", k=5))).replace('"k": 5', '"k": ' + "9" * 400)
    deep = '{"v": 1, "type": "hybrid", "children": ' + "[" * 100_000 + "]" * 100_000 + "}"
    parsed = req.parse_requests(
        jobs(spark, a=request(patents("1", k=7.0)), b=request(patents("1", k="7.0")), c=huge, d=deep, e=request(doc))
    )
    refused = {r["job_uid"] for r in parsed.where("error is not null").collect()}
    assert refused == {"c", "d"}
    assert {r["job_uid"]: r["k"] for r in req.k_of(parsed).collect()} == {"a": 7, "b": 7, "e": 200}
    assert [(r["weight"], r["k"]) for r in req.documents(parsed).collect()] == [(0.5, 7)]


def test_seeds(spark, tables):
    parsed = req.parse_requests(
        jobs(spark, a=request(patents("1", " 2 ", "x", "3.5", negative=["2"])), b=request(patents("1", negative=["6"]), cpc("F16H", "f16h")),
             c=request(patents("1"), patents(negative=["1"])), d=request(cpc("")), e="{")
    )
    seeds = req.collect_seeds(parsed, tables.codes)
    assert {(r[0], r[1]) for r in seeds.collect()} == {("a", 1), ("b", 1), ("b", 7)}
    assert {r["job_uid"] for r in req.without_seeds(parsed, seeds).collect()} == {"c", "d"}


@pytest.mark.parametrize("project", [None, lambda v: project_graph(v, rounds=1)])
def test_run(spark, tables, project):
    given = jobs(spark, a=request(patents("1", "7", k=2)), b=request(cpc("F16H")), c=request(), d="{", e=None)
    out = run_jobs(given, tables, project) if project else run_jobs(given, tables)
    items = {}
    for r in out.items.collect():
        items.setdefault(r["job_uid"], {})[r["family_id"]] = r
    assert set(items) == {"a", "b"}
    assert items["a"]["1"]["is_seed"] and items["a"]["7"]["is_seed"] and len(items["a"]) == 4
    assert (items["a"]["7"]["x"], items["a"]["7"]["y"]) == (0.0, 0.0)  # a seed without a vector
    assert items["a"]["1"]["title"] == "title 1" and items["b"]["6"]["title"] == ""
    results = {r["uid"]: r for r in out.results.collect()}
    document = json.loads(results["a"]["output"])
    assert document["v"] == 1 and document["items"] == document["neighbors"] and document["neighbor_count"] == 4
    assert [int(i["family_id"]) for i in document["items"]] == sorted(int(f) for f in items["a"])
    assert set(document["items"][0]) == {"family_id", "title", "x", "y", "is_seed"}
    assert results["c"]["message"] == req.NO_SEEDS and results["e"]["message"] == req.NO_VECTORS
    assert results["d"]["status"] == "error" and results["d"]["message"] == "Invalid search vectors: no JSON"
    steps = {}
    for r in out.status.orderBy("progress").collect():
        steps.setdefault(r["uid"], []).append((r["progress"], r["status"], r["message"]))
    assert [s[0] for s in steps["a"]] == [5, 15, 30, 55, 90, 100] and steps["a"][-1][1] == "done"
    assert steps["a"][1][2] == "Found 2 seed families" and steps["a"][2][2].endswith("(k=2) by seed id")
    assert steps["a"][3][2] == "Aggregated 2 unique neighbors, 1 seeds without vector"
    assert [s[:2] for s in steps["c"]] == [(5, "calculating"), (100, "error")]
    assert [s[:2] for s in steps["d"]] == [(100, "error")]


def test_large_documents_come_in_parts(spark):
    items = spark.range(1_000).selectExpr(
        "'j' AS job_uid", "cast(id AS string) AS family_id", "'t' AS title", "0.0D AS x", "0.0D AS y", "false AS is_seed"
    )
    rows = to_output(items, max_items=300).orderBy("part").collect()
    assert len(rows) == 4 and {r["parts"] for r in rows} == {4} and {r["neighbor_count"] for r in rows} == {1_000}
    found = [int(i["family_id"]) for r in rows for i in json.loads(r["output"])["items"]]
    assert found == list(range(1_000))
    assert max(len(json.loads(r["output"])["items"]) for r in rows) <= 300


def test_parts_of_jobs_that_lie_over_several_ranges(spark):
    sizes = {"a": 1, "b": 130, "c": 50, "d": 49, "e": 900, "f": 51}
    rows = [(job, str(i * 7 % 1_000), "t", 0.5, 0.25, False) for job, n in sizes.items() for i in range(n)]
    items = spark.createDataFrame(rows, "job_uid string, family_id string, title string, x double, y double, is_seed boolean")
    found = {}
    for r in to_output(items.repartition(5), max_items=50).orderBy("job_uid", "part").collect():
        listed = json.loads(r["output"])["items"]
        assert r["neighbor_count"] == sizes[r["job_uid"]] and r["parts"] == -(-sizes[r["job_uid"]] // 50)
        assert len(listed) == min(50, sizes[r["job_uid"]] - 50 * r["part"]) and listed[0]["x"] == 0.5
        found.setdefault(r["job_uid"], []).extend(int(i["family_id"]) for i in listed)
    assert found == {job: sorted(i * 7 % 1_000 for i in range(n)) for job, n in sizes.items()}
    assert to_output(items.limit(0)).collect() == []


def test_jobs_without_a_depth_have_the_default(spark):
    def request(*nodes):
        return json.dumps({"v": 1, "type": "hybrid", "children": [{"node": n} for n in nodes]})

    seeds, docs = {"type": "seed_patents", "seeds": {}}, {"type": "seed_docs", "docs": [{"title": "t"}]}
    rows = [("a", request(seeds)), ("b", request({**seeds, "k": None}, {**seeds, "k": 7.0})), ("c", request({**seeds, "k": -3})), ("d", request(docs))]
    jobs = spark.createDataFrame([(uid, "c", text) for uid, text in rows], "job_uid string, client_uid string, search_vectors string")
    parsed = req.parse_requests(jobs)
    assert {r["job_uid"]: r["k"] for r in req.k_of(parsed).collect()} == {"a": 200, "b": 7, "c": 200, "d": 200}
    assert [r["k"] for r in req.documents(parsed).collect()] == [200]


def test_code_seeds_in_blocks_and_unshuffled_pairs(spark, monkeypatch):
    monkeypatch.setattr(classification, "BLOCK_ROWS", 2)
    index = spark.createDataFrame([(i, "F16H" if i % 2 else "G06F") for i in range(9)] * 2, "family_id bigint, code string")
    wanted = [(str(j), "F16H") for j in range(5)] + [("x", "F16H"), ("x", "G06F"), ("x", "G06F"), (None, "G06F"), ("none", "A01B")]
    requested = spark.createDataFrame(wanted, "job_uid string, code string")
    without = spark.createDataFrame([("0", 1), ("0", 7), ("x", 8), (None, 0), ("1", 2), ("9", 1)], "job_uid string, family_id bigint")
    expected = {(str(j), i) for j in range(5) for i in (1, 3, 5, 7)} | {("x", i) for i in range(9)} | {(None, i) for i in (0, 2, 4, 6, 8)}
    found = classification.cpc_seeds(requested, index)
    assert sorted(map(str, found.collect())) == sorted(map(str, (Row(job_uid=j, family_id=i) for j, i in expected)))
    left = classification.cpc_seeds(requested, index, without)
    expected -= {("0", 1), ("0", 7), ("x", 8), (None, 0)}
    assert sorted(map(str, left.collect())) == sorted(map(str, (Row(job_uid=j, family_id=i) for j, i in expected)))
    for df in (found, left):
        above = df._jdf.queryExecution().sparkPlan().toString().split("Join")[0]
        assert "Aggregate" not in above  # the pairs are not made distinct again


def _plain_jobs(wanted, vectors, codes):
    """{(job, family): is_seed} of jobs {job: (k, ids, negatives, code)} by plain loops."""
    def nearest(seed, k):
        if seed not in vectors:
            return []
        unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
        order = sorted((i for i in vectors if i != seed), key=lambda i: (-round(float(unit[seed] @ unit[i]), 4), i))
        return order[:k]

    items = {}
    for job, (k, ids, negatives, code) in wanted.items():
        seeds = (set(ids) | {f for f, c in codes if c == code}) - set(negatives)
        found = {f for s in seeds for f in nearest(s, k)} - seeds
        items |= {(job, str(f)): True for f in seeds} | {(job, str(f)): False for f in found}
    return items


@pytest.fixture(scope="module")
def alike_jobs(spark):
    """Sixty jobs of two code classes, some with ids and negatives inside and outside their class, and jobs without codes."""
    rng = np.random.default_rng(5)
    vectors = {i: [round(float(x), 3) for x in rng.normal(size=4)] for i in range(60) if i % 7}
    codes = [(i, "A") for i in range(0, 60, 3)] + [(i, "B") for i in range(0, 60, 5)]
    wanted = {}
    for j in range(66):
        code = ("A", "B", None)[min(j // 30, 2)]
        ids = [int(x) for x in rng.integers(0, 60, 2)] if j % 2 or code is None else []
        negatives = [int(x) for x in rng.choice(60, 1 + j % 9, replace=False)] if j % 3 == 0 else []
        wanted[f"j{j}"] = (2 + (j % 2 if code == "B" else 0), ids, negatives, code)
    jobs = [
        (job, "c", json.dumps(request(patents(*map(str, ids), k=k, negative=list(map(str, negatives))), *([cpc(code)] if code else []))))
        for job, (k, ids, negatives, code) in wanted.items()
    ]
    tables = Tables(
        spark.createDataFrame([(str(i), f"t{i}") for i in range(60)], "family_id string, title string"),
        spark.createDataFrame([(str(f), c) for f, c in codes], "family_id string, code string"),
        spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>"),
    )
    return spark.createDataFrame(jobs, "job_uid string, client_uid string, search_vectors string"), tables, _plain_jobs(wanted, vectors, codes)


@pytest.mark.parametrize("shared_rows", [4096, 5])
def test_jobs_of_one_class_with_families_of_their_own(alike_jobs, shared_rows):
    jobs, tables, wanted = alike_jobs
    out = run_jobs(jobs, tables, shared_rows=shared_rows)
    rows = out.items.collect()
    assert len(rows) == len(wanted) and {(r["job_uid"], r["family_id"]): r["is_seed"] for r in rows} == wanted
    assert all(r["title"] == f"t{r['family_id']}" and r["client_uid"] == "c" for r in rows)
    told = {r["uid"]: r["message"] for r in out.status.where("progress = 55").collect()}
    for job in {j for j, _ in wanted}:
        near = sum(1 for (j, _), seed in wanted.items() if j == job and not seed)
        bare = sum(1 for (j, f), seed in wanted.items() if j == job and seed and int(f) % 7 == 0)
        assert told[job] == f"Aggregated {near} unique neighbors, {bare} seeds without vector"


def test_maps_of_classes_equal_maps_of_jobs(alike_jobs):
    jobs, tables, _ = alike_jobs
    by_class, by_job = ({(r["job_uid"], r["family_id"]): (r["x"], r["y"]) for r in run_jobs(jobs, tables, shared_rows=n).items.collect()} for n in (5, 4096))
    assert by_class.keys() == by_job.keys()
    assert max(abs(a - b) for key in by_job for a, b in zip(by_class[key], by_job[key])) < 1e-8


def test_neighbours_are_merged_once_per_class(alike_jobs, monkeypatch):
    jobs, tables, _ = alike_jobs
    merged = []
    monkeypatch.setattr(landscape, "best_neighbours", lambda near, seeds: merged.append(near.count()) or land.best_neighbours(near, seeds))
    only = jobs.where("job_uid in ('j2', 'j4', 'j8', 'j10', 'j14', 'j16', 'j20', 'j22', 'j26', 'j28')")
    landscape.run_jobs(only, tables)
    assert sum(merged) <= 2 * 20  # k neighbours of the families of one code, however many jobs ask for it


def test_only_jobs_of_several_parts_are_numbered(spark, monkeypatch):
    numbered = []
    monkeypatch.setattr(land, "numbered_items", lambda items, own=land.numbered_items: numbered.append(items.count()) or own(items))
    rows = [("a", str(i), f"t{i}", 0.0, 0.0, True) for i in (10, 9, 100)] + [("b", str(i), "t", 0.0, 0.0, False) for i in range(12, 0, -1)]
    items = spark.createDataFrame(rows, "job_uid string, family_id string, title string, x double, y double, is_seed boolean")
    got = {(r["job_uid"], r["part"]): ([i["family_id"] for i in json.loads(r["output"])["items"]], r["parts"], r["neighbor_count"])
           for r in to_output(items, max_items=5).collect()}
    assert got[("a", 0)] == (["9", "10", "100"], 1, 3)
    assert [got[("b", p)][0] for p in range(3)] == [["1", "2", "3", "4", "5"], ["6", "7", "8", "9", "10"], ["11", "12"]]
    assert numbered == [12]


def test_families_of_a_class_are_not_stored_per_job(spark, monkeypatch):
    stored = []

    def spy(df):
        out = cut_lineage(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(landscape, "cut_lineage", spy)
    rng = np.random.default_rng(7)
    vectors = {i: [float(x) for x in rng.normal(size=4)] for i in range(320) if i % 16}
    jobs = [(f"j{n}", "c", json.dumps(request(patents(str(n), k=1), cpc("A")))) for n in range(20)]
    tables = Tables(
        spark.createDataFrame([(str(i), f"t{i}") for i in range(320)], "family_id string, title string"),
        spark.createDataFrame([(str(i), "A") for i in range(320)], "family_id string, code string"),
        spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>"),
    )
    out = landscape.run_jobs(spark.createDataFrame(jobs, "job_uid string, client_uid string, search_vectors string"), tables)
    rows = out.items.collect()
    assert len(rows) == 20 * 320 == len({(r["job_uid"], r["family_id"]) for r in rows})
    assert all(r["is_seed"] and r["title"] == f"t{r['family_id']}" for r in rows)
    assert max(stored) <= 320  # classes, families, jobs, and what is a job's own, but no job for each of its families
    points = np.array(list(vectors.values()))
    centred = points - points.mean(axis=0)
    places = dict(zip(vectors, np.abs(centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T)))
    for r in rows:
        assert np.allclose(np.abs([r["x"], r["y"]]), places.get(int(r["family_id"]), 0.0), atol=1e-9)
    assert {r["neighbor_count"] for r in out.results.collect()} == {320}
