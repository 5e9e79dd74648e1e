"""Hot keys, checked broadcasts and cut lineage: what several operators need at scale."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, NullType, StructType

HOT_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20
RELEASE_BYTES = 32 * 2**20


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys with more than `hot_rows` rows. There are at most rows / hot_rows of them."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > hot_rows).select(F.col(key).alias("hot_key"))


def salt(identity: Column, buckets: int) -> Column:
    """Bucket that depends on the row only, so that a repeated task salts alike."""
    return F.pmod(F.xxhash64(identity), F.lit(buckets)).cast("int")


def is_small(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether the text form of `df` is measured below `max_bytes`, BROADCAST_BYTES if none are given."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    size = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]
    return size <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint when its text form is measured below `max_bytes`.

    Larger sides come back without the hint, and Spark joins them by shuffle with its
    skew handling.
    """
    return F.broadcast(df) if is_small(df, max_bytes) else df


def local_folder(master: str, prefix: str) -> str:
    """A temporary folder of this machine, for local sessions only."""
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def _checkpoint_folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or local_folder(context.master, "checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder named by spark.checkpoint.dir.

    Without one a temporary folder serves a local session; on a cluster executors could not see it.
    """
    _checkpoint_folder(df)
    return df.checkpoint()


def _has_column_form(kind: DataType) -> bool:
    """Whether Parquet holds the type as it is."""
    if isinstance(kind, StructType):
        names = [f.name.lower() for f in kind]
        return bool(names) and len(names) == len(set(names)) and all(_has_column_form(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return _has_column_form(kind.elementType)
    if isinstance(kind, MapType):
        return _has_column_form(kind.keyType) and _has_column_form(kind.valueType)
    return not isinstance(kind, (NullType, CalendarIntervalType))


def store_columns(df: DataFrame) -> DataFrame:
    """`cut_lineage` as compressed Parquet in the same folder, and without the shuffle files that led to it.

    A checkpoint holds serialised rows uncompressed, several times as many bytes, and reads all columns of them. Spark deletes
    shuffle files once the plan they belong to is collected as garbage, which on a large driver may be never, so after a
    large table the collection is asked for. Rows that Parquet can't hold are checkpointed.
    """
    if not _has_column_form(df.schema):
        return cut_lineage(df)
    session, folder = df.sparkSession, f"{_checkpoint_folder(df)}/columns-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(folder)
    del df
    out = session.read.schema(schema).parquet(folder)
    path = session._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(session._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    if size >= RELEASE_BYTES:
        session._jvm.System.gc()
    return out
