"""Repeated runs of lines, by prefix doubling over line sequences (operator 6).

The texts are one sequence of lines in the order of (doc_id, text), with a gap after each document.
Prefix doubling names the run of 2^k lines at every place, from the names of its two halves; the
name is the first place of an equal run, so equal names are equal runs, as equal ranks are in a
suffix array. Only names that occur twice are kept, so the work shrinks with every step. Runs of
any other length are named by the two runs of 2^k lines that cover them.

Suffixes that agree on a run of L lines are one longest-common-prefix interval. A run counts when
it has `min_words` words. Every maximal repeated run is the union of its shortest such runs that
start at some line and that end at some line, so these are looked up instead of all lengths, and
doubling ends where the longest of them is covered: after log2(min_words) steps at most, since
blank lines take no part. Of each interval the first copy stays and all later ones go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patentkin.llm import order
from patentkin.llm.columns import nested, restored
from patentkin.llm.sized import cut_sized
from patentkin.llm.text import BLANK_SEPARATED, LINES, LINES_AGAIN, slices, words
from patentkin.operators.skew import cut_lineage

MIN_WORDS = 50


def _key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _shortest_runs(counts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the shortest runs of min_words words from each line on, and up to each line."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    end = np.searchsorted(sums, sums[:-1] + min_words)
    start = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
    ahead, behind = np.flatnonzero(end <= n), np.flatnonzero(start >= 0)
    runs = np.unique(
        np.concatenate([ahead * (n + 1) + end[ahead] - ahead, start[behind] * (n + 1) + behind + 1 - start[behind]])
    )
    return runs // (n + 1), runs % (n + 1)


def _sequences(docs: DataFrame, min_words: int) -> DataFrame:
    """Per row of docs its lines that are not blank: place in the text, two hashes; and the runs to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                line, again, word = (words(texts, x) for x in (LINES, LINES_AGAIN, BLANK_SEPARATED))
                rows = []
                for d in range(part.num_rows):
                    a, b = line.first[d], line.first[d + 1]
                    owned = word.start[word.first[d] : word.first[d + 1]]
                    counts = np.searchsorted(owned, line.end[a:b]) - np.searchsorted(owned, line.start[a:b])
                    full = np.flatnonzero(counts)
                    feeds = np.flatnonzero(line.data[line.offsets[d] : line.offsets[d + 1]] == 10) + line.offsets[d]
                    start, length = _shortest_runs(counts[full], min_words)
                    rows.append((
                        len(full), np.searchsorted(feeds, line.start[a:b][full]), line.hash[a:b][full].view(np.int64),
                        again.hash[a:b][full].view(np.int64), start, length,
                    ))
                n, *lists = zip(*rows, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(n, pa.int64())]
                    + [pa.array(list(x), pa.list_(k)) for x, k in zip(lists, kinds, strict=True)],
                    ["doc_id", "key", "n", "line", "a", "b", "start", "length"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    lists = "line array<int>, a array<long>, b array<long>, start array<int>, length array<int>"
    return docs.select("doc_id", _key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, n long, {lists}")


def _numbered(seqs: DataFrame) -> DataFrame:
    """`seqs` once per (doc_id, key), with the place `at` of its first line in the sequence of all texts."""
    part = order.bucket(F.col("doc_id"), order.tops(seqs, "doc_id"))
    placed = seqs.withColumn("part", part)
    sizes = {r["part"]: r["size"] for r in placed.groupBy("part").agg(F.sum(F.col("n") + 1).alias("size")).collect()}
    starts, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    window = W.partitionBy("part").orderBy("doc_id", "key")
    before = F.sum(F.col("n") + 1).over(window.rowsBetween(W.unboundedPreceding, -1))
    first = F.get(F.lit(starts or [0]).cast("array<bigint>"), F.col("part"))
    same = F.lag("doc_id").over(window).eqNullSafe(F.col("doc_id")) & (F.lag("key").over(window) == F.col("key"))
    return (
        placed.withColumn("again", F.coalesce(same, F.lit(False)) & (F.row_number().over(window) > 1))
        .withColumn("at", first + F.coalesce(before, F.lit(0)))
        .where("not again")
        .drop("again", "part")
    )


def _by_merge(df: DataFrame) -> DataFrame:
    """A side of a join whose size follows the lines: sorted and merged, not gathered on the driver for a broadcast."""
    return df.hint("merge")


def _named(pairs: DataFrame) -> DataFrame:
    """(pos, name) of all places whose pair (x, y) occurs twice or more; the name is the first of these places."""
    # written out, so that the join can be split at frequent lines
    groups = cut_sized(
        pairs.groupBy("x", "y").agg(F.min("pos").alias("name"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    return cut_sized(pairs.join(_by_merge(groups), ["x", "y"]).select("pos", "name"))


def _later_lines(numbered: DataFrame) -> DataFrame:
    """(pos) of the lines in later copies of repeated runs."""
    lines = numbered.select("at", F.posexplode(F.arrays_zip("a", "b")).alias("i", "h"))
    names = _named(lines.select((F.col("at") + F.col("i")).alias("pos"), F.col("h.a").alias("x"), F.col("h.b").alias("y")))
    runs = numbered.select("at", F.explode(F.arrays_zip("start", "length")).alias("r"))
    runs = runs.select((F.col("at") + F.col("r.start")).alias("pos"), F.col("r.length").alias("length"))
    # a run is looked up only where its first line is a repeated one
    runs = cut_sized(runs.join(_by_merge(names.select("pos")), "pos", "left_semi"))
    longest = runs.agg(F.max("length").alias("m")).first()["m"] or 0
    found = None
    width = 1
    while width <= longest:
        here = runs.where((F.col("length") >= width) & (F.col("length") < 2 * width))
        tail = names.select((F.col("pos") + width).alias("end"), F.col("name").alias("y"))
        covered = cut_sized(
            here.withColumn("end", F.col("pos") + F.col("length"))
            .join(_by_merge(names.withColumnRenamed("name", "x")), "pos")
            .join(_by_merge(tail), "end")
            .select("pos", "length", "x", "y")
        )
        # equal runs have equal lengths, since the length follows from the lines
        firsts = cut_sized(covered.groupBy("x", "y", "length").agg(F.min("pos").alias("first")))
        later = covered.join(_by_merge(firsts), ["x", "y", "length"]).where("pos > first").select("pos", "length")
        found = later if found is None else found.unionAll(later)
        if 2 * width <= longest:
            right = names.select((F.col("pos") - width).alias("pos"), F.col("name").alias("y"))
            names = _named(names.select("pos", F.col("name").alias("x")).join(_by_merge(right), "pos"))
        width *= 2
    if found is None:
        return runs.select("pos").limit(0)
    return found.select(F.explode(F.expr("sequence(pos, pos + length - 1)")).alias("pos")).distinct()


def mark_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of `docs` with `deleted`: the numbers of the lines, from 0, that are later copies.

    Lines are what stands between line feeds; blank ones are passed over. A run of consecutive
    lines with `min_words` words or more is deleted where an equal run stands earlier in the order
    of (doc_id, text), in the same document or another one. Lines are compared byte by byte (by
    hashes of 128 bits). Null and empty texts have no lines. Rows with the same doc_id and text are
    one document: they get the same result. A null doc_id comes first in the order. Columns other
    than doc_id and text are passed on; one called `deleted` is replaced.
    """
    numbered = cut_lineage(_numbered(cut_lineage(_sequences(docs, min_words))))
    later = _later_lines(numbered)
    places = numbered.select("doc_id", "key", "at", F.posexplode("line").alias("i", "line"))
    places = places.select("doc_id", "key", (F.col("at") + F.col("i")).alias("pos"), "line")
    gone = cut_lineage(
        places.join(_by_merge(later), "pos").groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("line")).alias("deleted"))
    )
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), F.col("deleted").alias("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    kept = [c for c in docs.columns if c != "deleted"]
    marked = docs.select(*kept, _key().alias("text_key")).join(gone, same, "left")
    return marked.select(*kept, F.coalesce("gone", F.array().cast("array<int>")).alias("deleted"))


def without_lines(text: str = "text", deleted: str = "deleted") -> Column:
    """Column: the text without its deleted lines; a text that loses no line stays as it is."""
    lines = F.split(F.col(text), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(deleted))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return F.when(F.size(deleted) == 0, F.col(text)).otherwise(rest)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without later copies of repeated runs of lines, and without rows of which only blanks are left.

    Rows that lose no line stay as they are, empty and null texts included. An n_chars column
    follows the new text. All other columns, of any name and type, are passed on as they are.
    """
    own = ("doc_id", "text", "n_chars")
    marked = mark_lines(nested(docs, *own), min_words).withColumn("new_text", without_lines())
    kept = marked.where((F.size("deleted") == 0) | F.col("new_text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        chars = F.char_length("new_text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.size("deleted") == 0, F.col("n_chars")).otherwise(chars))
    return restored(kept.withColumn("text", F.col("new_text")), docs, *own)
