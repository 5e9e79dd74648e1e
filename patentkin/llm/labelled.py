"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patentkin.operators.skew import cut_lineage


#: Characters of the sample for each class; what the fits hold on the driver is a multiple of it.
SAMPLE_CHARS = 16 * 2**20
STRETCHES = 16


def fair_length(lengths: list[int], total: int) -> int:
    """The greatest length at which texts of these lengths, cut to it, have `total` characters or fewer together."""
    left = total
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) > left:
            return left // (len(lengths) - k)
        left -= n
    return max(lengths, default=0)


def spread(text: Column, length: Column) -> Column:
    """`text`, or of one longer than `length` so many characters in STRETCHES stretches from its beginning to its end."""
    n = F.char_length(text)
    each = F.floor(length / STRETCHES).cast("int")
    step = F.floor((n - each) / (STRETCHES - 1)).cast("int")
    last = (length - (STRETCHES - 1) * each).cast("int")
    parts = [F.substr(text, (k * step + 1).cast("int"), each) for k in range(STRETCHES - 1)]
    return F.when(n <= length, text).otherwise(F.concat(*parts, F.substr(text, n - last + 1, last)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, column: str, learned_from: Column, each: int, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """(doc_id, text, label) of at most `each` ids per value of labels.`column`, by the order of a hash of the id.

    Repeated labels of an id are averaged and rounded up. The chosen ids are at most 2 x each, so
    they are broadcast. Of several rows of an id the least text stands for it. Where the texts of
    a class have more than `chars` characters together, and so more than half as many words, the
    longest are thinned, all to one length, the greatest that fits: stretches from all over the text
    stay, its end included. That is for the fit only.
    """
    known = labels.where(F.col(column).isin(0, 1) & learned_from).groupBy("doc_id").agg(F.avg(column).alias("a"))
    known = known.select("doc_id", F.when(F.col("a") >= 0.5, 1).otherwise(0).alias("label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 1").orderBy(*by_hash).limit(each).unionAll(known.where("label = 0").orderBy(*by_hash).limit(each))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    # written out, as the lengths (a number for each chosen id) come to the driver first
    rows = cut_lineage(rows)
    lengths: dict[int, list[int]] = {0: [], 1: []}
    for r in rows.select("label", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).collect():
        lengths[r["label"]].append(r["n"])
    most = F.when(F.col("label") == 1, fair_length(lengths[1], chars)).otherwise(fair_length(lengths[0], chars))
    return rows.select("doc_id", spread(F.col("text"), most.cast("int")).alias("text"), "label")
