"""Applicants of families under one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.functions.names import normalize_applicant, trigrams
from patentkin.operators.skew import cut_lineage


def applicant_family(fam: DataFrame) -> DataFrame:
    """(applicant, family_id, raw_variants): the spellings of an applicant within a family."""
    raw = fam.select("family_id", F.explode("applicants").alias("raw"))
    named = raw.withColumn("applicant", normalize_applicant(F.col("raw"))).where(F.col("applicant").isNotNull())
    return named.groupBy("applicant", "family_id").agg(F.array_sort(F.collect_set("raw")).alias("raw_variants"))


def applicant_candidates(by_family: DataFrame) -> DataFrame:
    """(applicant, family_count, variants), largest first.

    Counting per spelling first spreads an applicant with very many families over all tasks;
    only its distinct spellings meet in the second step.
    """
    spellings = by_family.select("applicant", F.posexplode("raw_variants").alias("pos", "variant"))
    per_spelling = spellings.groupBy("applicant", "variant").agg(
        F.count_if(F.col("pos") == 0).alias("families")  # one first spelling per family
    )
    return (
        per_spelling.groupBy("applicant")
        .agg(
            F.sum("families").cast("int").alias("family_count"),
            F.array_sort(F.collect_list("variant")).alias("variants"),
        )
        .orderBy(F.desc("family_count"), "applicant")
    )


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): names of `left` and `right` whose trigram sets have a Jaccard similarity of `threshold` or more.

    An inverted join for many names at a time. The trigrams of every distinct name are built once
    and put in order of rarity over both sides. Of two names that are similar enough, the first
    n - ceil(threshold * n) + 1 trigrams have one in common, so only these are posted and the most
    frequent trigrams are mostly left out; a pair also has to be within the bound on sizes. Both
    sets of a pair that meets are then compared in full. Names without a letter or digit are like none.
    """
    names = left.select("name", F.lit(True).alias("in_left")).unionByName(right.select("name", F.lit(False).alias("in_left")))
    names = names.where("name is not null").groupBy("name").agg(
        F.max("in_left").alias("in_left"), F.max(~F.col("in_left")).alias("in_right")
    )
    sets = cut_lineage(names.withColumn("grams", trigrams(F.col("name"))).where(F.size("grams") > 0))
    listed = sets.select("name", F.explode("grams").alias("gram"))
    # written out, so that the join can be split at a trigram that very many names have
    counts = cut_lineage(listed.groupBy("gram").agg(F.count("*").alias("n")))
    ranked = listed.join(counts, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("ranked"))
    size = F.size("ranked")
    least = threshold - 1e-9  # of products, for their last bit
    prefix = F.slice("ranked", F.lit(1), (size - F.ceil(size * least) + 1).cast("int"))
    posted = ranked.select("name", size.alias("size"), F.explode(prefix).alias("p")).select("name", "size", F.col("p.gram").alias("gram"))
    posted = cut_lineage(posted.join(sets.select("name", "in_left", "in_right"), "name"))
    a = posted.where("in_left").select("gram", F.col("name").alias("a"), F.col("size").alias("a_size"))
    b = posted.where("in_right").select("gram", F.col("name").alias("b"), F.col("size").alias("b_size"))
    near = (F.col("a_size") >= F.col("b_size") * least) & (F.col("b_size") >= F.col("a_size") * least)
    pairs = a.join(b, "gram").where(near).select("a", "b").distinct()
    with_sets = pairs.join(sets.select(F.col("name").alias("a"), F.col("grams").alias("a_grams")), "a").join(
        sets.select(F.col("name").alias("b"), F.col("grams").alias("b_grams")), "b"
    )
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    either = F.size("a_grams") + F.size("b_grams") - both
    return with_sets.select("a", "b", (both / either).alias("similarity")).where(F.col("similarity") >= threshold)
