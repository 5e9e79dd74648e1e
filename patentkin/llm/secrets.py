"""Secrets in texts (operator 3): credential parts linked by place, in DataFrame functions only.

Strong findings are reported as they are: assignments to a secret name (`assign`), access
identifiers (`access`) and long hexadecimal runs (`hex`). Weak candidates are reported only beside
complementary parts: an account name or other identifier (`id`) beside a secret, a bare random
token (`token`) beside an identifier, an endpoint (`endpoint`) beside both. Beside means that the
intervals, widened by REACH code points, meet. The interval join is an equi-join on the document
and on bins of the text, so a part is compared with the few parts of its own and neighbouring bins.

Matches of each pattern are leftmost and do not overlap. Their places follow from the lengths of
the matches and of the texts between them, summed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patentkin.operators.skew import cut_lineage

REACH = 200
BIN = 512

_ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind: (pattern, group whose length counts, least length, role, strong)
PATTERNS = {
    "assign": (_ASSIGN, 2, 12, "secret", True),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, "id", True),
    "hex": (r"[0-9a-f]{16,}", 0, 16, "secret", True),
    "id": (r"(?i:client_?id|user_?name|account|login)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)", 1, 3, "id", False),
    "token": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 0, 24, "secret", False),
    "endpoint": (r"[a-z][a-z0-9+.-]*://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 8, "endpoint", False),
}
#: What a whole match has to hold besides: a bare run is random only with all three kinds of signs.
HELD = {"token": ("[0-9]", "[a-z]", "[A-Z]")}
ORDER = {kind: k for k, kind in enumerate(PATTERNS)}
BASE = ("assign", "access", "hex")


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, at, gap, size, counted): the text before each match, its length, and the group's."""
    pattern, group, _, _, _ = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("size"), counted.alias("counted"))

    def row(x: Column, i: Column) -> Column:
        length = F.char_length(x["counted"])
        for sign in HELD.get(kind, ()):
            length = F.when(x["size"].rlike(sign), length).otherwise(0)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.char_length(x["gap"]).alias("gap"),
            F.char_length(x["size"]).alias("size"), length.alias("counted"),
        )

    none = F.expr("cast(array() as array<struct<kind:string,at:int,gap:int,size:int,counted:int>>)")
    return F.when(text.rlike(pattern), F.transform(zipped, row)).otherwise(none)


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, kind, start, stop) of every match of every pattern, once per document and key."""
    text = F.coalesce("text", F.lit(""))
    every = F.concat(*[_matches(F.col("text"), kind) for kind in PATTERNS])
    keyed = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    rows = keyed.select("doc_id", "key", F.inline(every)).dropDuplicates(["doc_id", "key", "kind", "at"])
    before = W.partitionBy("doc_id", "key", "kind").orderBy("at")
    # the last row of a kind is the text behind its last match, without a match
    stop = F.sum(F.col("gap").cast("long") + F.coalesce("size", F.lit(0))).over(before)
    least = F.create_map(*[F.lit(x) for kind, p in PATTERNS.items() for x in (kind, p[2])])
    placed = rows.withColumn("stop", stop).where("size is not null").where(F.col("counted") >= least[F.col("kind")])
    return placed.select("doc_id", "key", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")


def _linked(found: DataFrame) -> DataFrame:
    """Weak parts that have their complementary parts within reach."""
    role = F.create_map(*[F.lit(x) for kind, p in PATTERNS.items() for x in (kind, p[3])])
    weak = found.where(~F.col("kind").isin(*BASE)).withColumn("role", role[F.col("kind")])
    reach = lambda c, by: F.floor((F.col(c) + by) / BIN)
    asked = weak.select(
        "doc_id", "key", "kind", "role", "start", "stop", F.explode(F.sequence(reach("start", -REACH), reach("stop", REACH))).alias("bin")
    )
    other = found.select(
        F.col("doc_id").alias("other_id"), F.col("key").alias("other_key"), role[F.col("kind")].alias("other"),
        F.col("start").alias("low"), F.col("stop").alias("high"),
        F.explode(F.sequence(reach("start", 0), reach("stop", 0))).alias("other_bin"),
    )
    near = (
        F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("key") == F.col("other_key")) & (F.col("bin") == F.col("other_bin"))
        & (F.col("role") != F.col("other")) & (F.col("low") < F.col("stop") + REACH) & (F.col("start") < F.col("high") + REACH)
    )
    has = lambda r: F.max((F.col("other") == r).cast("int")) == 1
    seen = asked.join(other, near).groupBy("doc_id", "key", "kind", "role", "start", "stop").agg(has("id").alias("id"), has("secret").alias("secret"))
    wanted = F.when(F.col("role") == "id", F.col("secret")).when(F.col("role") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return seen.where(wanted).select("doc_id", "key", "kind", "start", "stop")


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    base_sha256 is the hash of the strong findings as kind:start:end, ordered by start and then by
    kind, joined by commas; spans has these and the linked weak ones in the same form. Places are
    code points, the end is exclusive. Null and empty texts have no findings. Rows with the same
    doc_id and text have the same findings. Other columns are not read.
    """
    found = cut_lineage(parts(docs))
    every = found.where(F.col("kind").isin(*BASE)).unionByName(_linked(found))
    rank = F.create_map(*[F.lit(x) for kind, k in ORDER.items() for x in (kind, k)])
    entry = F.struct("start", rank[F.col("kind")].alias("rank"), "stop", "kind")
    lists = every.groupBy("doc_id", "key").agg(
        *[F.sum((F.col("kind") == kind).cast("long")).alias(f"n_{kind}") for kind in BASE],
        F.sort_array(F.collect_list(entry)).alias("entries"),
    )
    show = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    joined = lambda entries: F.array_join(F.transform(entries, show), ",")
    base = F.filter("entries", lambda x: x["rank"] < len(BASE))
    lists = lists.select(
        F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"), *[f"n_{kind}" for kind in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("entries")).alias("spans"),
    )
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key"))
    return keyed.join(lists, same, "left").select(
        "doc_id", *[F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in BASE],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
