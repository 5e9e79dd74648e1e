"""Classification codes of families: expanded, titled, indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.functions.classification import cpc_pieces, normal_code, parent_code
from patentkin.operators.skew import broadcast_if_small, store_columns as cut_lineage

BLOCK_ROWS = 1_024  # of jobs, and of families, that meet in one group of the join
TASK_PAIRS = 2**19  # that a task gives out about; blocks are small but for their pairs, so Spark would put many in one task
MAX_TASKS = 10_000


def family_codes(fam: DataFrame, group_digits: int = 3) -> DataFrame:
    """(family_id, code): every ancestor of every code of a family, once.

    A family is one row, so its codes are made distinct inside the row and nothing is shuffled.
    """
    pieces = F.flatten(F.transform("cpc", lambda c: cpc_pieces(c, group_digits)))
    codes = F.array_distinct(F.transform(pieces, lambda p: p["code"]))
    return fam.select("family_id", F.explode(codes).alias("code"))


def cpc_index(fam: DataFrame, cpc_titles: DataFrame, group_digits: int = 3) -> DataFrame:
    """Inverted index (family_id, code, title, level) over the codes that have a title."""
    titles = cpc_titles.groupBy(F.col("cpc_code").alias("code")).agg(
        F.min("title").alias("title"), F.min_by("level", "title").alias("level")
    )
    return family_codes(fam, group_digits).join(broadcast_if_small(titles), "code").select(
        "family_id", "code", "title", "level"
    )


def with_cpc_titles(fam: DataFrame, index: DataFrame) -> DataFrame:
    """Families with `cpc_titles`, their titled codes in code order ([] where there are none)."""
    lists = index.groupBy("family_id").agg(
        F.array_sort(F.collect_list(F.struct("code", "title", "level"))).alias("cpc_titles")
    )
    joined = fam.join(lists, "family_id", "left")
    none = F.array().cast(joined.schema["cpc_titles"].dataType)
    return joined.withColumn("cpc_titles", F.coalesce("cpc_titles", none))


def cpc_seeds(requested: DataFrame, index: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(job_uid, family_id) of the families under the requested codes, for all codes and depths in one join.

    Classes meet their jobs last, in blocks of both, so the pairs, which can be as many as jobs times
    families, are not shuffled. Pairs (job_uid, family_id) of `without` are left out.
    """
    jobs, held = code_classes(requested, index)
    return class_pairs(jobs, held, without)


def code_classes(requested: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job_uid, class) of the jobs that request codes, and (class, family_id) of the families under the codes of a class.

    Jobs that request the same codes are one class, whose families are found and made distinct once.

    exact, and where `requested` has no `depth`: families that carry the code as written. The index
    holds ancestors, so a subclass finds its whole subtree. subtree: the same for the code in normal
    spelling. children: families that carry a code one level below it. For that every code of the
    index also stands under its parent, so that a level down is an equal key too.
    """
    depth = F.col("depth") if "depth" in requested.columns else F.lit("exact")
    code = F.when(depth == "exact", F.col("code")).otherwise(normal_code(F.col("code")))
    wanted = requested.select("job_uid", F.struct(code.alias("code"), (depth == "children").alias("below")).alias("key"))
    listed = wanted.groupBy("job_uid").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    listed = cut_lineage(listed.withColumn("class", F.sha2(F.to_json("keys"), 256)))
    jobs = listed.select("job_uid", "class")
    wanted = broadcast_if_small(listed.dropDuplicates(["class"]).select("class", F.inline("keys")))
    keys = F.array(
        F.struct(F.col("code"), F.lit(False).alias("below")), F.struct(parent_code(F.col("code")).alias("code"), F.lit(True).alias("below"))
    )
    posted = index.select("family_id", F.inline(keys))
    return jobs, cut_lineage(posted.join(wanted, ["code", "below"]).select("class", "family_id").distinct())


def class_pairs(jobs: DataFrame, held: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Jobs (job_uid, class, …) with the families (class, family_id, …) of their class, without the class and the pairs `without`."""
    left, right = class_blocks(jobs, held, without)
    kept = F.col("not_these").isNull() | ~F.array_contains("not_these", F.col("family_id"))
    columns = ["job_uid", "family_id", *[c for c in (*jobs.columns, *held.columns) if c not in ("job_uid", "family_id", "class")]]
    return left.join(right, ["class", "g", "h"]).where(kept).select(*columns)


def class_blocks(
    jobs: DataFrame, held: DataFrame, without: DataFrame | None = None, job_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Jobs and families of `class_pairs` in blocks (class, g, h); a job has its families of `without` in `not_these`.

    A block has BLOCK_ROWS families and BLOCK_ROWS jobs, or `job_rows`.
    """

    def sizes(df: DataFrame, name: str, rows: int = BLOCK_ROWS) -> DataFrame:
        return df.groupBy("class").agg(F.ceil(F.count("*") / rows).cast("int").alias(name), F.count("*").alias(f"{name}_rows"))

    def block(column: str, number: str):
        return F.pmod(F.xxhash64(column), F.col(number)).cast("int")

    def every(number: str):
        return F.explode(F.sequence(F.lit(0), F.col(number) - 1))

    blocks = cut_lineage(sizes(jobs, "jobs", job_rows or BLOCK_ROWS).join(sizes(held, "families"), "class"))
    pairs = blocks.agg(F.sum(F.col("jobs_rows").cast("double") * F.col("families_rows")).alias("n")).first()["n"] or 0
    tasks = int(min(pairs // TASK_PAIRS + 1, MAX_TASKS))
    left = jobs.join(blocks, "class").select(*jobs.columns, block("job_uid", "jobs").alias("g"), every("families").alias("h"))
    right = held.join(blocks, "class").select(every("jobs").alias("g"), block("family_id", "families").alias("h"), *held.columns)
    if without is None:
        kind = held.schema["family_id"].dataType.simpleString()
        left = left.withColumn("not_these", F.lit(None).cast(f"array<{kind}>"))
        return tuple(side.repartition(tasks, "class", "g", "h") for side in (left, right))
    ids = jobs.select(F.col("job_uid").alias("own"), "class").distinct()
    own = without.select("job_uid", "family_id").join(ids, F.col("job_uid").eqNullSafe(F.col("own"))).join(held.select("class", "family_id"), ["class", "family_id"])
    own = own.join(blocks, "class").groupBy("own", F.col("class").alias("own_class"), block("family_id", "families").alias("own_h"))
    # no more than the families of a block
    own = own.agg(F.collect_set("family_id").alias("not_these"))
    same = F.col("job_uid").eqNullSafe(F.col("own")) & (F.col("class") == F.col("own_class")) & (F.col("h") == F.col("own_h"))
    left = left.join(own, same, "left").drop("own", "own_class", "own_h")
    return tuple(side.repartition(tasks, "class", "g", "h") for side in (left, right))
