"""Spelling variants of frequent words (operator 12), by PartEnum signatures.

A word's letters are a multiset, taken as a binary vector with one dimension for every (letter,
how often so far). Words that differ by one inserted, deleted or replaced letter have vectors at a
Hamming distance of two at most. The dimensions are dealt into PARTS parts; two differences touch
at most two parts, so both vectors agree on all the others. A signature is one choice of
PARTS - 2 parts with what the vector holds there; words meet in an equi-join on the signature,
which loses no pair, and are verified by edit distance.

A signature that many words share is split before the join by the half of the word that one edit
leaves as it is, which loses no pair either, so that no list is compared all with all.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patentkin.llm.text import constants, mix, slices
from patentkin.operators.skew import cut_lineage

PARTS = 7
DISTANCE = 2
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
HOT_WORDS = 64
#: Runs of letters, with the accented ones of Latin-1. Only A-Z are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CHOICES = list(itertools.combinations(range(PARTS), PARTS - DISTANCE))
_PART_SEED = constants(PARTS, 21)
_CHOICE_SEED = constants(len(_CHOICES), 22)


def thinned(doc_id: Column, run: Column, one_in: int) -> Column:
    """`run` without the letter that the checksum of document and run points at, where `one_in` divides it."""
    checksum = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    at = F.pmod(checksum, F.length(run)).cast("int")
    without = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(F.pmod(checksum, F.lit(one_in)) == 0, without).otherwise(run)


def word_counts(docs: DataFrame, one_in: int, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of whole texts, counted inside the tasks first."""
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0)))
    runs = docs.where("text is not null").select("doc_id", run.alias("run"))
    words = runs.select(thinned(F.col("doc_id"), F.col("run"), one_in).alias("word"))
    long_enough = words.where(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def letter_signatures(words: list[str]) -> np.ndarray:
    """One row of signatures per word, a column for each choice of parts."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    place = np.arange(len(codes))
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    times = place - np.maximum.accumulate(np.where(new, place, 0)) if len(codes) else place
    dimension = mix((codes.astype(np.uint64) << np.uint64(32)) + times.astype(np.uint64))
    held = np.zeros((PARTS, len(words)), dtype=np.uint64)
    np.add.at(held, ((codes + 3 * times) % PARTS, owner), dimension)
    held = mix(held + _PART_SEED[:, None])
    chosen = [mix(held[list(c)].sum(axis=0, dtype=np.uint64) + s) for c, s in zip(_CHOICES, _CHOICE_SEED, strict=True)]
    return np.stack(chosen, axis=1)


def signatures(words: DataFrame) -> DataFrame:
    """(signature, word, n): every word under each of its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                found = letter_signatures(part.column("word").to_pylist())
                row = pa.array(np.repeat(np.arange(part.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.ravel().view(np.int64)), part.column("word").take(row), part.column("n").take(row)],
                    ["signature", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "signature long, word string, n long")


def _halves() -> Column:
    """What a word keeps under one edit, for pairs whose longer word has its length and one more.

    In a pair whose longer word has length q, either the first (q - 1) // 2 letters are equal in
    both, or the last q - 1 - (q - 1) // 2.
    """
    keys = []
    for longer in (F.length("word"), F.length("word") + 1):
        head = F.floor((longer - 1) / 2).cast("int")
        tail = longer - 1 - head
        word = F.col("word")
        keys.append(F.concat_ws("\t", longer.cast("string"), F.lit("head"), F.substr(word, F.lit(1), head)))
        keys.append(F.concat_ws("\t", longer.cast("string"), F.lit("tail"), F.substr(word, F.length("word") - tail + 1, tail)))
    return F.array(*keys)


def near_pairs(words: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """(word, near, near_n): both directions of all pairs one edit apart, each once."""
    posted = signatures(words)
    counts = posted.groupBy("signature").agg(F.count("*").alias("members"))
    # a signature of one word pairs nothing
    shared = counts.where("members > 1").select("signature", (F.col("members") > hot_words).alias("hot"))
    key = F.explode(F.when(F.col("hot"), _halves()).otherwise(F.array(F.lit("")))).alias("half")
    lists = cut_lineage(posted.join(shared, "signature").select("signature", "word", "n", key))
    left = lists.select("signature", "half", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = lists.select("signature", "half", F.col("word").alias("b"), F.col("n").alias("b_n"))
    close = F.abs(F.length("a") - F.length("b")) <= 1
    met = left.join(right, ["signature", "half"]).where((F.col("a") < F.col("b")) & close & (F.levenshtein("a", "b", 1) == 1))
    pairs = met.select("a", "a_n", "b", "b_n").distinct()
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
        )
    )
    return pairs.select(both.alias("pair")).select("pair.*")


def roots(links: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root) for links (word, form), where counts grow by `ratio` along every link and end at `most`.

    The pointers are doubled, so the rounds are the logarithm of the longest chain of forms.
    """
    longest = max(1, math.ceil(math.log(max(most, ratio), ratio)))
    found = links.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        found = cut_lineage(found)
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found


def spelling_groups(
    docs: DataFrame, one_in: int = 199, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters of whole texts, lower-cased in A-Z; where `one_in` divides the
    checksum of `<doc_id>:<run>` the run loses one letter. Words have `min_length` letters and
    occur `min_count` times or more over all rows. n_near counts the words one edit away; form is
    the most frequent of them (ties: the smallest in code-point order) if it occurs at least
    `ratio` times as often as the word, else null; root is the last form that forms lead to, or
    the word itself.

    A null text has no words, an empty one none either; a null doc_id counts as an empty one. Every
    row counts, repeated ones and those of one id too. Other columns are not read. A table without
    words gives no rows. `ratio` has to be 2 or more, so that forms never run in circles.
    """
    words = cut_lineage(word_counts(docs, one_in, min_length, min_count))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    good = -F.col("best.n") >= ratio * F.col("n")
    with_forms = cut_lineage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"),
        )
    )
    links = with_forms.where("form is not null")
    most = links.agg(F.max("form_n").alias("most")).first()["most"] or 1
    last = roots(links, most, ratio)
    return with_forms.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
