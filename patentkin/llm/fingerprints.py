"""Document fingerprints that add up (operator 1): homomorphic multiset hashes, in DataFrame functions only.

A document is the multiset of its paragraphs, the parts between line feeds. Each paragraph is
hashed to a vector of EXACT 32-bit numbers, and a document's vector is the sum of these modulo
2^32: it does not depend on the order, and paragraphs are put in or taken out by adding or
subtracting their vectors. For likeness, a paragraph's words and marks are read as runs of RUN
tokens, one from each token on, so an edit changes only the runs it touches, whatever the
punctuation; equal runs of a paragraph are numbered. A run falls into one of PARTS parts by its hash and adds 2 x LANES random bits there,
so the counts of set bits, less half the number of runs of the part, estimate how much two
documents share: the cosine of their run counts, with a standard error of 1 / sqrt(2 x LANES x
PARTS) for documents with many runs. A fingerprint is the exact vector, the numbers of runs and
the counts of each part, two to a number, in hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patentkin.llm import order

EXACT = 8
LANES = 32
PARTS = 4
RUN = 3
#: Words of at most 16 letters and digits, or what is left of a longer one; letters of scripts without blanks and marks by themselves.
TOKENS = r"[A-Za-z0-9À-ÖØ-öø-ÿ[\p{L}\p{M}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]]{1,16}|\S"
_LOW = 0xFFFFFFFF
_ONES = 0x0000000100000001


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _sums(first: Column, run: Column, filled: Column) -> list[Column]:
    """Sums over the runs of a document's paragraphs; `first` marks the first row of a paragraph."""
    zero = F.lit(0).cast("long")
    exact = []
    for k in range(EXACT // 2):
        for half in (_low(F.col(f"h{k}")), F.shiftrightunsigned(F.col(f"h{k}"), 32)):
            exact.append(F.sum(F.when(first, half).otherwise(zero)).alias(f"e{len(exact)}"))
    count = F.sum(F.when(filled, 1).otherwise(0)).cast("long").alias("runs")
    lanes = [
        F.sum(F.when(filled, F.shiftrightunsigned(run, k).bitwiseAND(F.lit(_ONES))).otherwise(zero)).alias(f"l{k}")
        for k in range(LANES)
    ]
    return [*exact, count, *lanes]


def _numbered(runs: str) -> Column:
    """Hashes of the runs of a paragraph with their number among equal ones, from a sorted array.

    Without it, the square of a word repeated a hundred times would outweigh the rest of a text.
    """
    same = lambda x, at: (at >= 0) & (F.get(runs, at) == x)
    steps = F.transform(F.sequence(F.lit(30), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    start = lambda x, at: F.aggregate(steps, at, lambda low, by: F.when(same(x, low - by), low - by).otherwise(low))
    return F.transform(runs, lambda x, at: F.when(same(x, at - 1), F.xxhash64(x, at - start(x, at))).otherwise(x))


def fingerprints(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key..., f) for the `text` of each key of `texts`, f a struct of exact, runs and lanes.

    Rows are summed where they are read, so PARTS rows for each key and task are shuffled at most.
    Rows of one key count as one document; a null text is empty. A paragraph with fewer than RUN
    tokens is one run, one without a token has none.
    """
    paragraphs = texts.select(*key, F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph"))
    # the hashes go on instead of the paragraph, which would be copied for each of its runs
    hashed = [F.xxhash64(F.lit(k), "paragraph").alias(f"h{k}") for k in range(EXACT // 2)]
    names = [f"h{k}" for k in range(EXACT // 2)]
    tokens = paragraphs.select(*key, *hashed, F.regexp_extract_all("paragraph", F.lit(TOKENS), F.lit(0)).alias("tokens"))
    run = lambda x, k: F.xxhash64(x, *[F.get("tokens", k + lag) for lag in range(1, RUN)])
    every = F.slice(F.transform("tokens", run), F.lit(1), F.greatest(F.lit(1), F.size("tokens") - (RUN - 1)))
    runs = tokens.select(*key, *names, F.sort_array(every).alias("runs"))
    runs = runs.select(*key, *names, F.posexplode_outer(_numbered("runs")).alias("at", "run"))
    first, filled = F.coalesce(F.col("at") == 0, F.lit(True)), F.col("run").isNotNull()
    runs = runs.select(*key, *names, first.alias("first"), filled.alias("filled"), "run")
    of = F.xxhash64("run").bitwiseAND(F.lit(PARTS - 1)).cast("int").alias("of")
    summed = runs.groupBy(*key, of).agg(*_sums(F.col("first"), F.col("run"), F.col("filled")))
    lanes = F.array(*[F.col(f"l{k}") for k in range(LANES)]).alias("lanes")
    sums = [F.sum(f"e{k}").alias(f"e{k}") for k in range(EXACT)]
    parts = summed.withColumn("part_", F.struct("runs", lanes)).groupBy(*key).agg(*sums, F.map_from_entries(F.collect_list(F.struct("of", "part_"))).alias("parts"))
    none = F.struct(F.lit(0).cast("long").alias("runs"), F.array_repeat(F.lit(0).cast("long"), LANES).alias("lanes"))
    every = parts.withColumn("parts", F.array(*[F.coalesce(F.col("parts")[k], none) for k in range(PARTS)]))
    exact = F.array(*[_low(F.col(f"e{k}")) for k in range(EXACT)]).alias("exact")
    return every.select(*key, F.struct(exact, F.col("parts.runs").alias("runs"), F.flatten("parts.lanes").alias("lanes")).alias("f"))


def as_text(f: Column) -> Column:
    """A fingerprint in hexadecimal."""
    show = lambda width: lambda x: F.lpad(F.lower(F.hex(x)), width, "0")
    return F.concat(*[F.array_join(F.transform(f[c], show(width)), "") for c, width in (("exact", 8), ("runs", 16), ("lanes", 16))])


def _combined(f: Column, part: Column, step) -> Column:
    return F.struct(
        F.zip_with(f["exact"], part["exact"], lambda x, y: _low(step(x, y))).alias("exact"),
        F.zip_with(f["runs"], part["runs"], step).alias("runs"),
        F.zip_with(f["lanes"], part["lanes"], step).alias("lanes"),
    )


def insert(f: Column, part: Column) -> Column:
    """The fingerprint after putting in the paragraphs of `part`."""
    return _combined(f, part, lambda x, y: x + y)


def delete(f: Column, part: Column) -> Column:
    """The fingerprint after taking the paragraphs of `part` out again."""
    return _combined(f, part, lambda x, y: x - y)


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, z: s + z)


def _vector(f: Column) -> Column:
    """Twice each count less the number of runs of its part (v), and the sum of their squares."""
    runs = F.flatten(F.transform(f["runs"], lambda n: F.array_repeat(n, LANES)))
    lows = F.zip_with(f["lanes"], runs, lambda x, n: (2 * _low(x) - n).cast("double"))
    highs = F.zip_with(f["lanes"], runs, lambda x, n: (2 * F.shiftrightunsigned(x, 32) - n).cast("double"))
    square = lambda v: F.struct(v.alias("v"), _total(F.transform(v, lambda p: p * p)).alias("square"))
    return F.transform(F.array(F.concat(lows, highs)), square)[0]


def _likeness(a: Column, b: Column, x: Column, y: Column) -> Column:
    """As `likeness`, with the vectors x and y of the fingerprints a and b."""
    dot = _total(F.zip_with(x["v"], y["v"], lambda p, q: p * q))
    norm = F.sqrt(x["square"] * y["square"])
    cosine = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm))).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(cosine)


def likeness(a: Column, b: Column) -> Column:
    """Between 0 and 1 for two fingerprints: 1 if they are equal, else the estimated cosine of their run counts."""
    return _likeness(a, b, _vector(a), _vector(b))


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows of docs and, for each bucket of consecutive ids, the row that follows its last one (tail).

    Order: descending doc_id, then text; a null doc_id comes last; after the last row comes the first.
    """
    tops = order.tops(docs, "doc_id")
    known = F.lit(tops or [0]).cast("array<bigint>")
    part = order.bucket(F.col("doc_id"), tops)
    # the top of a bucket follows the bucket above; the very first row follows the lowest bucket
    is_top = (F.col("doc_id") == F.get(known, part)) if tops else F.lit(True)
    above = F.when(part == len(tops) - 1, F.lit(0)).otherwise(part + 1) if tops else F.lit(0)
    where = F.array_compact(F.array(F.struct(part.alias("part"), F.lit(0).alias("tail")), F.when(is_top, F.struct(above.alias("part"), F.lit(1).alias("tail")))))
    placed = docs.select("doc_id", "text", F.explode(where).alias("w")).select("doc_id", "text", "w.part", "w.tail")
    window = W.partitionBy("part").orderBy("tail", F.desc_nulls_last("doc_id"), "text")
    return placed.select("part", "tail", F.row_number().over(window).alias("row"), "doc_id", "text", F.lead("text").over(window).alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs its fingerprint, that of an edited text, and their likeness.

    The edited text has its last third (rounded down, in code points) replaced by as many, or all,
    of the first code points of the next document in descending doc_id; after the last comes the
    first. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (likeness to the next document). Null texts are empty. Rows with equal ids follow
    each other in the order of their texts; null ids come last. Other columns are not read.
    """
    key = ["part", "tail", "row"]
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next", F.lit(""))
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - third), F.substring(after, F.lit(1), third))
    rows = _with_next(docs)
    # both texts of a row stay in its partition, so no step below shuffles texts again
    both = F.array(
        F.struct(F.lit(0).alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("sha"), n.cast("long").alias("n")),
        F.when(F.col("tail") == 0, F.struct(F.lit(1).alias("kind"), edited.alias("text"), F.sha2(edited, 256).alias("sha"), n.cast("long").alias("n"))),
    )
    texts = rows.select(*key, "doc_id", F.explode(F.array_compact(both)).alias("t"))
    texts = texts.select("part", "tail", "row", "doc_id", "t.kind", "t.sha", "t.n", "t.text")
    prints = fingerprints(texts, [*key, "kind", "doc_id", "sha", "n"]).withColumn("v", _vector(F.col("f")))
    window = W.partitionBy("part").orderBy("tail", "row", "kind")
    lead = lambda column, k, name: F.lead(column, k).over(window).alias(name)
    # order in a bucket: own, edited, own, edited, ..., then the tail
    found = prints.select(
        "tail", "kind", "doc_id", "n", F.col("f").alias("own"), "v",
        lead("f", 1, "edited"), lead("v", 1, "edited_v"), lead("sha", 1, "edited_sha256"), lead("f", 2, "after"), lead("v", 2, "after_v"),
    ).where("tail = 0 and kind = 0")
    return found.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        _likeness(F.col("own"), F.col("edited"), F.col("v"), F.col("edited_v")).alias("near_edited"),
        _likeness(F.col("own"), F.col("after"), F.col("v"), F.col("after_v")).alias("near_next"),
    )
