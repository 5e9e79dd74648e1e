"""Embedding of pending families, shard by shard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patentkin.operators.encoding import embed, new_embeddings
from patentkin.operators.skew import cut_lineage
from patentkin.sources.tables import EMBEDDINGS, PENDING
from patentkin.streaming.sink import Committed, Manifest, batch_folder, compact, run_of, stored_rows

FOLD_BATCHES = 32


def stored_embeddings(spark: SparkSession, sink: str, state: Committed | None = None) -> DataFrame:
    """(id, embedding, run_id, batch_id) committed so far."""
    return stored_rows(spark, f"{sink}-manifest", sink, "vectors", EMBEDDINGS, state)


def compact_embeddings(spark: SparkSession, sink: str) -> str:
    """One folder with one vector per family, the first one stored, in the place of all committed batches."""

    def first(state: Committed) -> DataFrame:
        origin = F.struct("run_id", "batch_id", "embedding")
        stored = stored_embeddings(spark, sink, state).groupBy("id").agg(F.min(origin).alias("o"))
        return stored.select("id", "o.embedding", "o.run_id", "o.batch_id")

    return compact(spark, f"{sink}-manifest", f"{sink}-compacted", {"vectors": first})


def _stored_ids(spark: SparkSession, sink: str, manifest: Manifest | None = None) -> Callable[[], DataFrame]:
    """A function that gives (id, run_id, batch_id) of all that is committed when it is called.

    A batch is a folder, and a run has as many as it had batches. Once FOLD_BATCHES new ones stand there
    their ids are put to those known before, so that no call has to open all the folders of a long run.
    """
    manifest = manifest or Manifest(spark, f"{sink}-manifest")
    known, base, held = None, None, set()

    def ids() -> DataFrame:
        nonlocal known, base, held
        state = manifest.state()
        if state.base != base:
            known, base, held = None, state.base, set()
        new = [b for b in state.batches if b not in held]
        rest = Committed(base if known is None else None, [], new)
        out = stored_embeddings(spark, sink, rest).select("id", "run_id", "batch_id")
        out = out if known is None else out.unionByName(known)
        if len(new) >= FOLD_BATCHES:
            out = known = cut_lineage(out.repartition("id"))
            held.update(new)
        return out

    return ids


def start_embedding(
    spark: SparkSession, source: str, sink: str, checkpoint: str, make_predict_fn: Callable | None = None,
    shards_per_batch: int = 100, done_shards: str = "off", archive: str | None = None,
) -> StreamingQuery:
    """Embed every family of the Parquet shards under `source` that has no vector yet, then stop.

    Families already stored are left out before the model sees them, so a second run writes nothing
    and a repeated batch replaces only its own rows; what other runs with other checkpoints and
    sources have stored stays. `done_shards` says what happens to a finished
    shard: "off" keeps it, "delete" and "archive" take it away; a failed batch keeps its shards.
    A batch counts once it is entered in the manifest, so half-written ones are neither read nor in the way.
    """
    name = run_of(spark, checkpoint)
    manifest = Manifest(spark, f"{sink}-manifest")
    stored_ids = _stored_ids(spark, sink, manifest)

    reader = spark.readStream.schema(PENDING).option("maxFilesPerTrigger", shards_per_batch)
    reader = reader.option("recursiveFileLookup", "true").option("cleanSource", done_shards)
    if archive:
        reader = reader.option("sourceArchiveDir", archive)

    def run(batch: DataFrame, batch_id: int) -> None:
        own = (F.col("run_id") == name) & (F.col("batch_id") == batch_id)
        rows = batch.withColumnRenamed("family_id", "id")
        # a few tasks for each split of the batch; the ids of a single split are few
        parts = batch.rdd.getNumPartitions()
        ids = rows.select("id")
        earlier = stored_ids().where(~own).join(F.broadcast(ids) if parts == 1 else ids, "id", "left_semi")
        pending = new_embeddings(rows.repartition(4 * max(parts, 1), "id"), earlier)
        encoded = embed(pending.withColumnRenamed("id", "family_id"), make_predict_fn)
        encoded.write.mode("overwrite").parquet(batch_folder(sink, name, batch_id))
        manifest.commit(name, batch_id)

    return (
        reader.parquet(source)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
