"""Registered queries: every operator over the whole of the test tables.

Lists and dates are given as text, so that results compare the same way in any engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patentkin.functions.classification import cpc_pieces
from patentkin.functions.names import normalize_applicant
from patentkin.functions.priority import authority_priority
from patentkin.functions.text import combined_text, row_size, safe_id
from patentkin.functions.vectors import cosine_distance, cosine_similarity, parse_vector
from patentkin.operators import applicants, classification, encoding, families, filters, job_filters, pending, shards, tenants
from patentkin.operators import landscapes as land
from patentkin.operators import neighbours as near
from patentkin.operators import requests as req
from patentkin.operators.layout import layout, neighbour_graph
from patentkin.operators.projection import project_pca
from patentkin.operators.skew import local_folder, store_columns as cut_lineage
from patentkin.plans.landscape import Tables, run_jobs
from patentkin.sources.samples import sample
from patentkin.streaming import embedding as embedding_stream
from patentkin.streaming import jobs as job_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SHARD_BYTES = 2**20
PAGE_ROWS = 50


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


# --- inputs ---------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return families.score(sample(spark, sf, "patents"))


def _families(spark: SparkSession, sf: str) -> DataFrame:
    return families.rollup(_scored(spark, sf))


def _codes(spark: SparkSession, sf: str) -> DataFrame:
    return classification.cpc_index(_families(spark, sf), sample(spark, sf, "cpc_titles"))


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return sample(spark, sf, "export_embeddings")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _embeddings(spark, sf).select(F.col("id").alias("seed_id"))


def _jobs(spark: SparkSession, sf: str, view: str = "ip_landscapes") -> DataFrame:
    return job_stream.to_run(sample(spark, sf, view)).withColumnRenamed("uid", "job_uid")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return req.parse_requests(_jobs(spark, sf))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    return table.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), "embedding")


def _work_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir where that is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/work-{uuid.uuid4().hex}" if shared else local_folder(spark.sparkContext.master, "work-")


def _text(values: str) -> Column:
    return F.expr(f"array_join(transform({values}, v -> coalesce(cast(v AS string), '-')), '|')")


def _lists_text(column: str) -> Column:
    return F.expr(
        f"array_join(transform({column}, e -> concat(coalesce(e.name, '-'), '#', coalesce(cast(e.list_uid AS string), '-'), 'x', e.times)), '|')"
    )


# --- families -------------------------------------------------------------------------------


@_query
def family_scored(spark: SparkSession, sf: str) -> DataFrame:
    strict = F.coalesce(authority_priority(F.col("authority"), strict=True), F.lit(-1)).alias("authority_strict")
    return _scored(spark, sf).select("id", "authority_priority", strict, "kind_priority", "content_priority")


@_query
def family_representative(spark: SparkSession, sf: str) -> DataFrame:
    rep = _scored(spark, sf).groupBy("family_id").agg(families.representative().alias("rep"))
    return rep.select(
        "family_id", F.col("rep.id").alias("rep_id"), F.col("rep.authority").alias("rep_authority"),
        F.col("rep.kind").alias("rep_kind"), F.col("rep.publication_date").cast("string").alias("rep_pub_date"),
    )


@_query
def family_members(spark: SparkSession, sf: str) -> DataFrame:
    return _families(spark, sf).select("family_id", _text("family_members").alias("family_members"))


@_query
def family_authorities(spark: SparkSession, sf: str) -> DataFrame:
    return _families(spark, sf).select("family_id", _text("family_authorities").alias("family_authorities"))


@_query
def family_dates(spark: SparkSession, sf: str) -> DataFrame:
    dates = [families.first_date("A").alias("application"), families.first_date("B").alias("granted")]
    return _scored(spark, sf).groupBy("family_id").agg(*dates).selectExpr(
        "family_id", "cast(application AS string) AS first_application_pub_date",
        "cast(granted AS string) AS first_grant_pub_date",
    )


@_query
def family_unions(spark: SparkSession, sf: str) -> DataFrame:
    return _families(spark, sf).select("family_id", *[_text(c).alias(c) for c in ("cpc", "applicants", "inventors")])


@_query
def family_best_text(spark: SparkSession, sf: str) -> DataFrame:
    best = [families.best_text(c).alias(c) for c in ("title", "abstract")]
    return _scored(spark, sf).groupBy("family_id").agg(*best).selectExpr(
        "family_id", "title.text AS best_title", "abstract.text AS best_abstract"
    )


@_query
def family_rollup(spark: SparkSession, sf: str) -> DataFrame:
    lists = ("family_members", "family_authorities", "cpc", "applicants", "inventors")
    dates = ("first_application_pub_date", "first_grant_pub_date", "rep_pub_date")
    return _families(spark, sf).select(
        "family_id", "title", "abstract", "rep_id", "rep_authority", "rep_kind",
        *[_text(c).alias(c) for c in lists], *[F.col(c).cast("string").alias(c) for c in dates],
    )


# --- classification -------------------------------------------------------------------------


def _expanded(spark: SparkSession, sf: str, digits: int) -> DataFrame:
    raw = sample(spark, sf, "patents").select(F.explode("cpc_classes").alias("raw_code")).distinct()
    return raw.select("raw_code", F.explode(cpc_pieces(F.col("raw_code"), digits)).alias("p")).select("raw_code", "p.*")


@_query
def cpc_expand(spark: SparkSession, sf: str) -> DataFrame:
    return _expanded(spark, sf, 3)


@_query
def cpc_expand_whole_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _expanded(spark, sf, 4)


@_query
def cpc_index(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(spark, sf)


@_query
def family_cpc_titles(spark: SparkSession, sf: str) -> DataFrame:
    fam = cut_lineage(_families(spark, sf).select("family_id", "cpc"))
    titled = classification.with_cpc_titles(fam, classification.cpc_index(fam, sample(spark, sf, "cpc_titles")))
    text = "array_join(transform(cpc_titles, t -> concat(t.code, ':', t.title, ':', t.level)), '|') AS cpc_titles"
    return titled.selectExpr("family_id", text)


@_query
def cpc_exact_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return classification.cpc_seeds(req.requested_codes(_requests(spark, sf)), _codes(spark, sf))


# --- applicants -----------------------------------------------------------------------------


@_query
def applicant_norm(spark: SparkSession, sf: str) -> DataFrame:
    raw = sample(spark, sf, "patents").select(F.explode("applicants").alias("raw")).distinct()
    return raw.select("raw", normalize_applicant(F.col("raw")).alias("applicant"))


@_query
def applicant_family(spark: SparkSession, sf: str) -> DataFrame:
    return applicants.applicant_family(_families(spark, sf)).select(
        "applicant", "family_id", _text("raw_variants").alias("raw_variants")
    )


@_query
def applicant_candidates(spark: SparkSession, sf: str) -> DataFrame:
    by_family = applicants.applicant_family(_families(spark, sf))
    return applicants.applicant_candidates(by_family).select(
        "applicant", "family_count", _text("variants").alias("variants")
    )


# --- pending families, shards, embeddings ------------------------------------------------------


@_query
def pending_families(spark: SparkSession, sf: str) -> DataFrame:
    return pending.pending_families(_families(spark, sf), _embeddings(spark, sf))


@_query
def pending_page(spark: SparkSession, sf: str) -> DataFrame:
    return pending.pending_families(_families(spark, sf), _embeddings(spark, sf), PAGE_ROWS)


@_query
def backlog(spark: SparkSession, sf: str) -> DataFrame:
    return pending.backlog(_families(spark, sf), _embeddings(spark, sf)).select("families_pending")


def _ready(spark: SparkSession, sf: str) -> DataFrame:
    """Every ready family, stored or not."""
    return pending.pending_families(_families(spark, sf), _embeddings(spark, sf).where(F.lit(False)))


@_query
def combined_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = combined_text(F.col("title"), F.col("abstract"))
    return _ready(spark, sf).select("family_id", text.alias("combined_text"))


@_query
def row_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _ready(spark, sf).select("family_id", row_size(F.col("title"), F.col("abstract")).alias("row_size"))


@_query
def shard_plan(spark: SparkSession, sf: str) -> DataFrame:
    return shards.assign_shards(_ready(spark, sf), SHARD_BYTES).select("family_id", "shard")


@_query
def shard_plan_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same plan from many small ranges, worked through side by side."""
    return shards.assign_shards(_ready(spark, sf), SHARD_BYTES // 16, rows_per_range=20).select("family_id", "shard")


@_query
def shard_plan_large_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The plan where some families have 99 % of the target and some more than the target."""
    number = F.col("family_id") % 97
    heavy = F.when(number == 5, F.repeat(F.lit("x"), SHARD_BYTES * 99 // 100)).when(number == 50, F.repeat(F.lit("x"), 2 * SHARD_BYTES))
    ready = _ready(spark, sf).withColumn("abstract", F.coalesce(heavy, "abstract"))
    return shards.assign_shards(ready, SHARD_BYTES).select("family_id", "shard")


@_query
def embedding_insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    encoded = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return encoding.new_embeddings(encoded.unionByName(encoded), _embeddings(spark, sf)).select(
        "id", F.size("embedding").alias("dimension")
    )


@_query
def parse_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    text = sample(spark, sf, "vector_texts")
    numbers = F.transform(parse_vector(F.col("text")), lambda n: n.cast("bigint"))
    return text.withColumn("numbers", numbers).select("l_orderkey", "l_linenumber", "text", _text("numbers").alias("numbers"))


@_query
def vectors_of_families(spark: SparkSession, sf: str) -> DataFrame:
    ids = _families(spark, sf).select(safe_id(F.col("family_id")).alias("id"))
    return near.vectors_for(ids, _embeddings(spark, sf)).select(
        "id", F.size("embedding").alias("dimension"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first_value")
    )


@_query
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _labelled(spark, sf).select(
        F.col("group").alias("doc"), F.col("id").alias("pos"), (F.col("id") % 3).cast("int").alias("mask"),
        F.col("embedding").alias("vec"),
    )
    pooled = encoding.mean_pool(tokens.withColumn("mask", F.least("mask", F.lit(1))))
    return pooled.select("doc", F.posexplode("embedding").alias("dim", "v")).select(
        "doc", "dim", F.round(F.col("v").cast("double"), 5).alias("v")
    )


@_query
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    vectors = encoding.embed(_ready(spark, sf))
    return vectors.select("id", F.posexplode("embedding").alias("dim", "v")).select(
        "id", "dim", F.round(F.col("v").cast("double"), 5).alias("v")
    )


@_query
def embedding_stream_run(spark: SparkSession, sf: str) -> DataFrame:
    """Pending families written as shards, embedded by the stream, and run a second time for nothing."""
    folder = _work_folder(spark)
    waiting = pending.pending_families(_families(spark, sf), _embeddings(spark, sf))
    shards.write_shards(shards.assign_shards(waiting, SHARD_BYTES), f"{folder}/shards")
    for turn in range(2):
        embedding_stream.start_embedding(
            spark, f"{folder}/shards", f"{folder}/vectors", f"{folder}/checkpoint-{turn}"
        ).awaitTermination()
    stored = embedding_stream.stored_embeddings(spark, f"{folder}/vectors")
    return stored.groupBy("id").agg(F.count("*").alias("times"))


def _failing_model(first_letter: str):
    """The stand-in model, which stops at a text that begins with the letter."""
    make = encoding.token_hash_model()

    def make_failing():
        predict = make()

        def run(texts):
            if any(t.lower().startswith(first_letter) for t in texts):
                raise ValueError("the model stopped")
            return predict(texts)

        return run

    return make_failing


@_query
def embedding_stream_recovered(spark: SparkSession, sf: str) -> DataFrame:
    """Pending families drained by a run that dies on the way, drained again, compacted and drained once more."""
    folder = _work_folder(spark)
    waiting = pending.pending_families(_families(spark, sf), _embeddings(spark, sf))
    shards.write_shards(shards.assign_shards(waiting, SHARD_BYTES), f"{folder}/shards")
    sink = f"{folder}/vectors"

    def drain(checkpoint: str, model: Callable | None = None) -> None:
        embedding_stream.start_embedding(
            spark, f"{folder}/shards", sink, f"{folder}/{checkpoint}", model, shards_per_batch=1
        ).awaitTermination()

    try:
        drain("checkpoint", _failing_model("e"))
    except StreamingQueryException:
        pass  # what it committed stays, and the batch it died in is done again
    drain("checkpoint")
    embedding_stream.compact_embeddings(spark, sink)
    drain("another")
    stored = embedding_stream.stored_embeddings(spark, sink)
    return stored.groupBy("id").agg(F.count("*").alias("times"), F.max(F.size("embedding")).alias("dimension"))


# --- neighbours -----------------------------------------------------------------------------


@_query
def similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    after = table.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return table.join(after, "vec_id").select(
        "vec_id", F.round(cosine_similarity(a, b), 6).alias("similarity"), F.round(cosine_distance(a, b), 6).alias("distance")
    )


@_query
def knn_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return near.knn_by_id(_seeds(spark, sf), _embeddings(spark, sf), 10)


@_query
def knn_by_id_in_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same with queries beyond the broadcast limit, through the metric index in small cells."""
    return near.knn_by_id(_seeds(spark, sf), _embeddings(spark, sf), 10, broadcast_bytes=0, cell_rows=64)


@_query
def knn_by_vector(spark: SparkSession, sf: str) -> DataFrame:
    queries = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), "embedding")
    found = near.knn_by_vector(queries, _embeddings(spark, sf), 5)
    return found.withColumn("distance", F.round(F.greatest("distance", F.lit(0.0)), 6))


@_query
def knn_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbours of every family for a client, with metadata, watch flag and lists."""
    found = near.knn_by_id(_seeds(spark, sf), _embeddings(spark, sf), 10)
    asked = found.withColumn("client_uid", (F.col("seed_id") % 5).cast("string"))
    known = tenants.enrich(
        asked, _families(spark, sf), sample(spark, sf, "ip_patent_sonars"),
        sample(spark, sf, "ip_patent_lists"), sample(spark, sf, "ip_patent_list_items"),
    )
    return known.select(
        "seed_id", "client_uid", "family_id", "similarity", "rank", "title", "abstract",
        _text("family_authorities").alias("family_authorities"),
        F.col("first_application_pub_date").cast("string").alias("first_application_pub_date"),
        "sonar_is_active", _lists_text("lists").alias("lists"),
    )


@_query
def sonars_active(spark: SparkSession, sf: str) -> DataFrame:
    return tenants.active_sonars(sample(spark, sf, "ip_patent_sonars"))


@_query
def list_memberships(spark: SparkSession, sf: str) -> DataFrame:
    held = tenants.list_memberships(sample(spark, sf, "ip_patent_lists"), sample(spark, sf, "ip_patent_list_items"))
    return held.select("client_uid", "patent_family_id", _lists_text("lists").alias("lists"))


@_query
def neighbour_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Every label is a job whose seeds are its vectors."""
    seeds = _labelled(spark, sf).select(F.col("group").alias("job_uid"), F.col("id").alias("seed_id"))
    vectors = _labelled(spark, sf).select("id", "embedding")
    job_seeds = seeds.withColumn("k", F.lit(5))
    found = near.knn_by_id(seeds.select("seed_id"), vectors, 5)
    merged = land.merge_neighbours(land.job_neighbours(job_seeds, found), seeds.withColumnRenamed("seed_id", "family_id"))
    return merged.select("job_uid", "family_id", "similarity", _text("source_seeds").alias("source_seeds"))


# --- landscape jobs ---------------------------------------------------------------------------


@_query
def safe_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sample(spark, sf, "id_texts").select("event_id", "text", safe_id(F.col("text")).cast("string").alias("id"))


@_query
def jobs_to_run(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("job_uid", "client_uid", "search_vectors")


@_query
def job_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).select("job_uid", "error")


@_query
def job_k(spark: SparkSession, sf: str) -> DataFrame:
    return req.k_of(_requests(spark, sf))


@_query
def job_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return req.collect_seeds(cut_lineage(_requests(spark, sf)), _codes(spark, sf))


@_query
def job_without_seeds(spark: SparkSession, sf: str) -> DataFrame:
    requests = cut_lineage(_requests(spark, sf))
    return req.without_seeds(requests, req.collect_seeds(requests, _codes(spark, sf)))


def _tables(spark: SparkSession, sf: str) -> Tables:
    fam = _families(spark, sf)
    codes = classification.cpc_index(fam, sample(spark, sf, "cpc_titles"))
    return Tables(fam, codes, _embeddings(spark, sf), sample(spark, sf, "ip_patent_list_items"))


@_query
def landscape_items(spark: SparkSession, sf: str) -> DataFrame:
    items = run_jobs(_jobs(spark, sf), _tables(spark, sf)).items
    return items.select("job_uid", "family_id", "title", "is_seed")


@_query
def job_filter_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with requests whose filters no table can answer."""
    requests = req.parse_requests(_jobs(spark, sf, "filtered_landscapes"))
    return job_filters.check_filters(requests).select("job_uid", "error")


@_query
def job_depth_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of requests with codes at every depth."""
    requests = job_filters.check_filters(req.parse_requests(_jobs(spark, sf, "filtered_landscapes")))
    return req.collect_seeds(requests, _codes(spark, sf))


@_query
def landscape_filtered_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of requests with filters and depths."""
    tables = _tables(spark, sf)
    stored = replace(tables, families=cut_lineage(tables.families), codes=cut_lineage(tables.codes))
    items = run_jobs(_jobs(spark, sf, "filtered_landscapes"), stored).items
    return items.select("job_uid", "family_id", "title", "is_seed")


@_query
def landscape_document_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of requests whose documents are searched too; families and documents are embedded by one model."""
    fam = _families(spark, sf)
    codes = classification.cpc_index(fam, sample(spark, sf, "cpc_titles"))
    tables = Tables(fam, codes, cut_lineage(encoding.embed(_ready(spark, sf))))
    items = run_jobs(_jobs(spark, sf), tables, model=encoding.token_hash_model()).items
    return items.select("job_uid", "family_id", "title", "is_seed")


@_query
def landscape_item_owners(spark: SparkSession, sf: str) -> DataFrame:
    """How many stored items each client has, and of how many jobs."""
    items = run_jobs(_jobs(spark, sf), _tables(spark, sf)).items
    return items.groupBy("client_uid").agg(F.count("*").alias("items"), F.count_distinct("job_uid").alias("jobs"))


@_query
def landscape_output(spark: SparkSession, sf: str) -> DataFrame:
    """Items of every document in their order, read back from its JSON text, and whether `neighbors` equals `items`."""
    results = run_jobs(_jobs(spark, sf), _tables(spark, sf)).results
    kind = "array<struct<family_id:string,title:string,x:double,y:double,is_seed:boolean>>"
    body = F.from_json("output", f"v int, items {kind}, neighbors {kind}, neighbor_count long")
    shown = F.transform("body.items", lambda i: F.concat_ws(":", i["family_id"], i["is_seed"].cast("string"), i["title"]))
    return results.withColumn("body", body).select(
        "uid", "status", "message", "part", "parts", "neighbor_count", F.array_join(shown, "|").alias("items"),
        (F.col("body.items") == F.col("body.neighbors")).alias("same"),
    )


@_query
def landscape_output_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Items of documents in parts of 50 items, at their places, with coordinates as given to them."""
    items = run_jobs(_jobs(spark, sf), _tables(spark, sf)).items
    given = items.withColumns({"x": F.col("family_id").cast("double") / 8, "y": F.length("title").cast("double")})
    kind = "array<struct<family_id:string,x:double,y:double>>"
    read = land.to_output(given, max_items=50).withColumn("items", F.from_json("output", f"v int, items {kind}")["items"])
    return read.select("job_uid", "part", "parts", "neighbor_count", F.posexplode("items").alias("place", "i")).select(
        "job_uid", "part", "parts", "neighbor_count", "place", "i.*"
    )


@_query
def landscape_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Number of items per document, read back from its JSON text."""
    results = run_jobs(_jobs(spark, sf), _tables(spark, sf)).results.where("status = 'done'")
    return results.selectExpr(
        "uid AS job_uid", "neighbor_count", "json_array_length(get_json_object(output, '$.items')) AS items",
        "get_json_object(output, '$.items[0].family_id') AS first_family_id",
        "cast(get_json_object(output, '$.v') AS int) AS v",
    )


@_query
def landscape_status(spark: SparkSession, sf: str) -> DataFrame:
    status = run_jobs(_jobs(spark, sf), _tables(spark, sf)).status
    return status.groupBy("uid").agg(F.count("*").alias("steps"), F.max_by("status", "progress").alias("status"))


@_query
def project_pca_by_label(spark: SparkSession, sf: str) -> DataFrame:
    placed = project_pca(_labelled(spark, sf))
    return placed.select("group", "id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("x", "y")])


@_query
def layout_graph(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_graph(_labelled(spark, sf)).withColumn("weight", F.round("weight", 6))


@_query
def layout_positions(spark: SparkSession, sf: str) -> DataFrame:
    points = _labelled(spark, sf)
    return layout(neighbour_graph(points), project_pca(points))


@_query
def status_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = sample(spark, sf, "status_log")
    return job_stream.latest_status(log)


@_query
def job_stream_run(spark: SparkSession, sf: str) -> DataFrame:
    """All job records through the file stream; the last status of every job."""
    folder = _work_folder(spark)
    sample(spark, sf, "ip_landscapes").write.mode("overwrite").parquet(f"{folder}/records")
    records = job_stream.read_jobs(spark, f"{folder}/records", source_format="parquet")
    job_stream.start_jobs(
        records, f"{folder}/sink", f"{folder}/checkpoint", lambda: _tables(spark, sf)
    ).awaitTermination()
    return job_stream.current_status(spark, f"{folder}/sink")


@_query
def job_stream_late_events(spark: SparkSession, sf: str) -> DataFrame:
    """Three versions of every job record in three batches, the second older than the first.

    The third, for every third job, has lost its request. Of a job that ended in an error no items
    are left, and a compaction half-way changes nothing.
    """
    folder = _work_folder(spark)
    records = sample(spark, sf, "ip_landscapes").withColumn("commit_seq", F.lit(20).cast("bigint"))
    lost = F.lit(None).cast("string")
    older = records.withColumn("commit_seq", F.lit(10).cast("bigint")).withColumn("search_vectors", lost)
    newer = records.where("cast(uid AS bigint) % 3 = 0").withColumn("commit_seq", F.lit(30).cast("bigint"))
    tables = _tables(spark, sf)
    stored = replace(tables, families=cut_lineage(tables.families), codes=cut_lineage(tables.codes))
    for turn, batch in enumerate((records, older, newer.withColumn("search_vectors", lost))):
        batch.write.mode("append").parquet(f"{folder}/records")
        stream = job_stream.read_jobs(spark, f"{folder}/records", source_format="parquet")
        job_stream.start_jobs(stream, f"{folder}/sink", f"{folder}/checkpoint", lambda: stored).awaitTermination()
        if turn == 1:
            job_stream.compact_jobs(spark, f"{folder}/sink")
    items = job_stream.current_items(spark, f"{folder}/sink").groupBy(F.col("job_uid").alias("uid")).agg(F.count("*").alias("items"))
    status = job_stream.current_status(spark, f"{folder}/sink")
    return status.join(items, "uid", "left").withColumn("items", F.coalesce("items", F.lit(0)))


@_query
def applicant_similar(spark: SparkSession, sf: str) -> DataFrame:
    """All applicants against all: pairs of names that share enough trigrams."""
    names = applicants.applicant_family(_families(spark, sf)).select(F.col("applicant").alias("name"))
    found = applicants.similar_names(names, names, filters.FUZZY_THRESHOLD).where("a < b")
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


# --- filters ----------------------------------------------------------------------------------


def _filter(name: str, spec: dict) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        fam = _families(spark, sf)
        kept = filters.apply_filters(
            fam, spec, classification.cpc_index(fam, sample(spark, sf, "cpc_titles")),
            applicants.applicant_family(fam), sample(spark, sf, "ip_patent_list_items"),
        )
        return kept.select("family_id", "rep_id")

    QUERIES[f"filter_{name}"] = run


_filter("publication_date", {"date": {"field": "publication", "from": "1995-01-01", "to": "2009-12-31"}})
_filter("grant_date", {"date": {"field": "grant", "from": "2001-01-01"}})
_filter("authority", {"authority": ["US", "JP"]})
_filter("kind", {"kindCodes": ["B1", "A1"]})
_filter("assignee", {"assignee": {"include": ["Acme Holdings"], "exclude": ["KYOTO ROBOTICS Inc"]}})
_filter("assignee_fuzzy", {"assignee": {"include": ["societe generalle"], "fuzzy": True}})
_filter("inventor", {"inventor": {"include": ["Inv 3"], "exclude": ["Inv 5"]}})
_filter("applicant", {"applicant": {"include": ["src3 Group", "src4 Group"]}})
_filter("cpc", {"cpcInclude": ["F16H", "A61K"], "cpcExclude": ["B60W5/00"]})
_filter("family_size", {"familySize": {"min": 2, "max": 3}})
_filter("collection", {"collections": ["3", "7"]})
_filter("text", {"textMustContain": ["an"], "textMustNotContain": ["The"]})


@_query
def filter_cpc_children(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_code(_codes(spark, sf), "f16", "children")


@_query
def filter_cpc_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_code(_codes(spark, sf), "f 16h", "subtree")


@_query
def filter_seed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Families near the documents of the requests, all embedded by one model."""
    docs = filters.seed_documents(cut_lineage(_requests(spark, sf)))
    found = filters.document_neighbours(docs, cut_lineage(encoding.embed(_ready(spark, sf))))
    return found.select("job_uid", "family_id", F.round("similarity", 4).alias("similarity"))
