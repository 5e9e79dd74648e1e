"""Landscape jobs from a stream of changed job records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patentkin.operators.projection import project_pca
from patentkin.operators.skew import broadcast_if_small, store_columns as cut_lineage
from patentkin.plans.landscape import Tables, run_jobs
from patentkin.sources.tables import JOBS
from patentkin.streaming.sink import Committed, batch_folder, commit, compact, run_of, stored_rows

ITEMS = "job_uid string, family_id string, title string, x double, y double, is_seed boolean, client_uid string"
STATUS = "uid string, status string, progress int, message string"
RESULTS = f"{STATUS}, part int, parts int, output string, neighbor_count bigint"
CHANGES = "job_uid string, client_uid string, search_vectors string"
CODEC = "zstd"  # documents are JSON text and hold every item twice
_LEAST = -(2**63)


def to_run(records: DataFrame) -> DataFrame:
    """Records that ask for a calculation and can be named."""
    return records.where((F.col("_status") == "to_calculate") & (F.coalesce("uid", F.lit("")) != ""))


def read_jobs(spark: SparkSession, path: str, schema: str = JOBS, source_format: str = "json") -> DataFrame:
    """Stream of the job records that ask for a calculation."""
    return to_run(spark.readStream.format(source_format).schema(schema).load(path))


def latest_record(records: DataFrame) -> DataFrame:
    """(job_uid, client_uid, search_vectors): the newest record of every job in a batch.

    The order is that of `commit_seq`, the number or time of the change at its source, where the
    records carry one: `created_at` is set once and can't tell two changes of a job apart.
    """
    changes = [c for c in ("commit_seq",) if c in records.columns]
    newest = F.max(F.struct(*changes, "created_at", "search_vectors", "client_uid"))
    return (
        records.groupBy(F.col("uid").alias("job_uid")).agg(newest.alias("r"))
        .select("job_uid", "r.client_uid", "r.search_vectors")
    )


def newest_changes(records: DataFrame) -> DataFrame:
    """Of a stream of job records those that are newer than every earlier one of their job, in this batch or before.

    The newest change of every job is kept as state with the stream's checkpoint. Changes are in the order of their
    commit_seq, or of their created_at where they have none. A change that arrives late, or with the same
    commit_seq again, in a later batch is left out. created_at is set once, so of changes without a
    commit_seq only those with an earlier one are; one that carries neither always counts.

    The state is that of a grouped maximum, so no job costs a call of Python. The time of a batch, which stays the same
    if the batch is repeated, tells whether the maximum came with it; it has to grow from batch to batch.
    """
    sequence = F.col("commit_seq") if "commit_seq" in records.columns else F.lit(None).cast("bigint")
    seen = F.unix_micros(F.current_timestamp())
    place = F.coalesce(sequence, F.lit(_LEAST))
    change = F.struct(
        place.alias("place"), F.coalesce(F.unix_micros("created_at"), F.lit(_LEAST)).alias("created"),
        F.when(place == _LEAST, seen).otherwise(-seen).alias("turn"),  # of equal places the first batch counts, or without one the last
        "search_vectors", "client_uid", sequence.alias("commit_seq"), "created_at",
    )
    newest = records.select("uid", change.alias("c")).groupBy("uid").agg(F.max("c").alias("c"))
    return newest.where(F.abs("c.turn") == seen).select("uid", "c.commit_seq", "c.created_at", "c.search_vectors", "c.client_uid")


def write_results(results: DataFrame, status: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Results and status rows of one batch. A repeated batch replaces its own files."""
    results.write.mode("overwrite").option("compression", CODEC).parquet(batch_folder(f"{path}/results", run, batch_id))
    status.write.mode("overwrite").option("compression", CODEC).parquet(batch_folder(f"{path}/status", run, batch_id))


def _stored(spark: SparkSession, sink: str, table: str, schema: str, state: Committed | None = None) -> DataFrame:
    return stored_rows(spark, f"{sink}/manifest", f"{sink}/{table}", table, schema, state)


def current_results(spark: SparkSession, sink: str, state: Committed | None = None) -> DataFrame:
    """The committed results of the newest run and batch of every job."""
    return newest_rows(_stored(spark, sink, "results", RESULTS, state), "uid")


def current_items(spark: SparkSession, sink: str, state: Committed | None = None) -> DataFrame:
    """The committed items of the newest run and batch of every job, as its results name it.

    A job whose newest run failed has no items, whatever an older run left.
    """
    newest = current_results(spark, sink, state).where("status = 'done'")
    newest = newest.select(F.col("uid").alias("job_uid"), "run_id", "batch_id").distinct()
    items = _stored(spark, sink, "items", ITEMS, state)
    return _without(items, items.select("job_uid", "run_id", "batch_id").distinct().join(newest, ["job_uid", "run_id", "batch_id"], "left_anti"))


def current_status(spark: SparkSession, sink: str) -> DataFrame:
    """(uid, status, progress, message): the last committed step of every job."""
    return latest_status(_stored(spark, sink, "status", STATUS))


def compact_jobs(spark: SparkSession, sink: str) -> str:
    """One folder with the newest run of every job in the place of all committed batches."""
    return compact(spark, f"{sink}/manifest", f"{sink}/compacted", {
        "items": lambda state: current_items(spark, sink, state),
        "results": lambda state: current_results(spark, sink, state),
        "status": lambda state: newest_rows(_stored(spark, sink, "status", STATUS, state), "uid"),
    })


def _without(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored rows but those of the runs `gone`, a row each. Runs that no longer count are mostly few, and then no row is shuffled."""
    gone = cut_lineage(gone)
    return stored if gone.isEmpty() else stored.join(broadcast_if_small(gone), gone.columns, "left_anti")


def newest_rows(stored: DataFrame, job: str = "job_uid") -> DataFrame:
    """Stored rows of the newest run and batch of every job."""
    written = F.struct("run_id", "batch_id")
    runs = stored.select(job, "run_id", "batch_id").distinct()
    newest = runs.groupBy(job).agg(F.max(written).alias("newest"))
    older = runs.join(newest, job).where(written < F.col("newest")).select(job, "run_id", "batch_id")
    return _without(stored.where(F.col(job).isNotNull()), older)


def latest_status(status: DataFrame) -> DataFrame:
    """(uid, status, progress, message): the last step of every job."""
    order = [c for c in ("run_id", "batch_id", "progress") if c in status.columns]
    last = F.max_by(F.struct("status", "progress", "message"), F.struct(*order))
    return status.groupBy("uid").agg(last.alias("s")).select("uid", "s.*")


def start_jobs(
    records: DataFrame, sink: str, checkpoint: str, tables: Callable[[], Tables],
    project: Callable[[DataFrame], DataFrame] = project_pca, once: bool = True,
) -> StreamingQuery:
    """Run the jobs of every micro-batch together and write items, results and status under `sink`.

    `tables` is asked per batch, so a batch sees the tables as they are then. A change of a job
    that is older than one already seen is left out, whatever batch it comes in. A job is run at
    least once; a batch that is repeated after a failure overwrites what it wrote, a batch counts
    from its entry in the manifest on, and a run with another checkpoint leaves it alone
    (`current_items`, `current_results` and `current_status` read the last results of every job).
    The requests of a batch are kept under `changes`.
    """
    spark = records.sparkSession
    name = run_of(spark, checkpoint)
    manifest = f"{sink}/manifest"

    def run(batch: DataFrame, batch_id: int) -> None:
        # Through a folder, so that the stateful plan runs once and the jobs in a session with adaptive execution,
        # which that of a stream is without.
        changes = batch_folder(f"{sink}/changes", name, batch_id)
        latest_record(batch).write.mode("overwrite").parquet(changes)
        jobs = spark.read.schema(CHANGES).parquet(changes)
        if jobs.isEmpty():
            return
        out = run_jobs(jobs, tables(), project)
        out.items.write.mode("overwrite").option("compression", CODEC).parquet(batch_folder(f"{sink}/items", name, batch_id))
        write_results(out.results, out.status, sink, name, batch_id)
        commit(spark, manifest, name, batch_id)

    writer = newest_changes(records).writeStream.outputMode("update").foreachBatch(run)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
