"""Near-duplicates by an inverted join over MinHash signature coordinates (operator 2).

Every document class (documents with equal shingle sets) is posted under each of its
coordinate-value pairs. Two classes are candidates when at least `THRESHOLD` of `COORDINATES`
coordinates agree. The join needs only a prefix of the postings: ordered by the length of their
lists, the first COORDINATES - THRESHOLD + 1 of two such classes must have one in common. Values
that no other class has fill the prefix first, so a document that shares only a frequent passage
is never posted under it.

Lists are merged in two passes. The first compares all members with the least one of their list,
which is linear and joins groups of copies at once. The second skips every list whose members are
in one component by then; in the others it counts the collisions of all members, in blocks of
bounded size, and of those that reach the threshold with a member of another component works out
the overlaps of their full shingle sets. It gives out only links that connect different components,
fewer than a block has members. Candidates of the first pass are confirmed on full sets too.

At a similarity of exactly 0.8 a pair has 27 or more of 48 equal coordinates with a chance of
about 0.99997; it grows quickly with the similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patentkin.llm.columns import REST, nested, restored
from patentkin.llm.graph import components
from patentkin.llm.sized import cut_sized
from patentkin.llm.text import BLANK_SEPARATED, constants, mix, shingle_set, slices, words
from patentkin.operators.skew import cut_lineage

COORDINATES = 48
THRESHOLD = 27
PREFIX = COORDINATES - THRESHOLD + 1
BLOCK = 2_048
_STEP = 2**16
_FACTORS = constants(COORDINATES, 4)
_TAG = np.uint64(63)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each coordinate; its last six bits are the coordinate's number."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, min(_STEP, len(shingles)))
    for low in range(0, len(shingles), step):
        part = shingles[low : low + step]
        rows = max(1, 2**18 // len(part))
        for at in range(0, COORDINATES, rows):
            least = (part[None, :] * _FACTORS[at : at + rows, None]).min(axis=1)
            out[at : at + rows] = np.minimum(out[at : at + rows], least)
    return (mix(out) & ~_TAG) | np.arange(COORDINATES, dtype=np.uint64)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batch, "text"):
        found = words(part.column("text"), BLANK_SEPARATED)
        yield part, [shingle_set(found.hash[a:b], size) for a, b in zip(found.first, found.first[1:], strict=False)]


def describe(docs: DataFrame, size: int) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, set_a and set_b (two sums that name the set), sig, marks (16 bits of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                n = np.array([len(s) for s in sets], dtype=np.int64)
                a = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                b = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                sig = [signature(s) if len(s) else None for s in sets]
                marks = [None if x is None else (x >> np.uint64(48)).astype(np.uint16).tobytes() for x in sig]
                sig = [None if x is None else x.view(np.int64) for x in sig]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(a), pa.array(b)]
                    + [pa.array(sig, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sig", "marks"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_shingles long, set_a long, set_b long, sig array<long>, marks binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """Per row of docs: node (its doc_id) and its full shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["node", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"node {kind}, shingles array<long>")


def prefix_postings(sigs: DataFrame) -> DataFrame:
    """(key, node): each class under the shortest lists of its signature, PREFIX of them at most.

    A list of one class pairs with nothing, so it takes a place in the prefix without being posted.
    """
    posted = sigs.select("node", F.explode("sig").alias("key"))
    # written out, so that a join with it can be split at long lists
    lists = cut_sized(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = posted.join(lists, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    alone = F.lit(COORDINATES) - F.size("keys")
    kept = shared.where(alone < PREFIX).select("node", F.explode(F.slice("keys", 1, PREFIX - alone)).alias("k"))
    return kept.select(F.col("k.key").alias("key"), "node")


def _matched(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) with THRESHOLD or more equal coordinates."""
    one = pairs.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    two = one.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    return two.where(F.size(F.array_intersect("sig_a", "sig_b")) >= THRESHOLD).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets overlap by `percent` or more."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return two.where(100 * both.cast("long") >= percent * either.cast("long")).select("a", "b")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a symmetric link matrix connects, fewer than it has rows."""
    unseen = np.ones(len(linked), dtype=bool)
    edges = []
    for root in range(len(linked)):
        waiting = [root] if unseen[root] else []
        unseen[root] = False
        while waiting:
            at = waiting.pop()
            found = np.flatnonzero(linked[at] & unseen)
            unseen[found] = False
            edges.extend((at, int(x)) for x in found)
            waiting.extend(found.tolist())
    return edges


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of different sets: products of 0/1 columns for the values that two sets or more hold."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    kept = shared[place]
    owner, column = owner[kept], column[place[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2_048):
        a, b = np.searchsorted(column, [low, low + 2_048])
        ones = np.zeros((len(sets), 2_048), dtype=np.float32)
        ones[owner[a:b], column[a:b] - low] = 1
        out += ones @ ones.T
    return out


def _open_between(side: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which pairs of a cell are to be compared here: of different components, and not of one side only."""
    open_ = component[:, None] != component[None, :]
    return open_ & ((side[:, None] <= 1) & (side[None, :] >= 1) | (side[:, None] >= 1) & (side[None, :] <= 1))


def _in_cells(cells: DataFrame, work: Callable[[pa.Table, list[int]], pa.RecordBatch], schema: str) -> DataFrame:
    """`work` on the rows of whole cells, many small ones at a time: it gets a table and where its cells begin and end.

    A cell has two blocks at most, so a task holds that and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            new = np.zeros(table.num_rows, dtype=bool)
            for name in ("key", "i", "j"):
                value = table[name].to_numpy()
                new[1:] |= value[1:] != value[:-1]
            bounds = [0, *np.flatnonzero(new).tolist()]
            # the last cell may go on in the next batch
            if len(bounds) > 1:
                yield work(table.slice(0, bounds[-1]).combine_chunks(), bounds)
            rest = table.slice(bounds[-1])
        if rest is not None:
            yield work(rest.combine_chunks(), [0, rest.num_rows])

    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    component = table["component"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return table["side"].to_numpy(), component


def _colliding(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
    """The members of cells that have THRESHOLD or more coordinates in common with one they are to be compared with."""
    marks = np.frombuffer(b"".join(table["marks"].to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)
    side, component = _sides(table)
    hit = np.zeros(table.num_rows, dtype=bool)
    for low, high in zip(bounds, bounds[1:], strict=False):
        open_ = _open_between(side[low:high], component[low:high])
        if not open_.any():
            continue
        own = marks[low:high]
        rows = max(1, 2**20 // (COORDINATES * len(own)))
        for at in range(0, len(own), rows):
            equal = (own[at : at + rows, None, :] == own[None, :, :]).sum(axis=2, dtype=np.uint8)
            hit[low + at : low + at + len(equal)] = ((equal >= THRESHOLD) & open_[at : at + rows]).any(axis=1)
    kept = table.filter(pa.array(hit)).select(["key", "i", "j", "side", "node", "component"]).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], kept.column_names)


def _cell_pairs(percent: int) -> Callable[[pa.Table, list[int]], pa.RecordBatch]:
    def run(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        """Links of different components, on full sets, that connect what the members of each cell connect."""
        node = table["node"].combine_chunks()
        column = table["shingles"].combine_chunks()
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)
        side, component = _sides(table)
        pairs: list[tuple[int, int]] = []
        for low, high in zip(bounds, bounds[1:], strict=False):
            open_ = _open_between(side[low:high], component[low:high])
            if not open_.any():
                continue
            sets = [values[offsets[k] : offsets[k + 1]] for k in range(low, high)]
            sizes = np.array([len(s) for s in sets], dtype=np.float64)
            both = overlaps(sets)
            either = sizes[:, None] + sizes[None, :] - both
            pairs += [(low + i, low + j) for i, j in _forest(open_ & (100 * both >= percent * either))]
        ends = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([node.take(ends[0]), node.take(ends[1])], ["a", "b"])

    return run


def _open_pairs(postings: DataFrame, sigs: DataFrame, sets: DataFrame, tied: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside the lists that are not in one component yet.

    A list is cut into ceil(n / BLOCK) blocks and worked through by pairs of blocks, so no task
    holds more than two blocks. 96 bytes a member are enough to count the coordinates two members
    share; only sets of members that reach the threshold with another one are sent after them.
    """
    kind = dict(postings.dtypes)["node"]
    named = postings.join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # written out, so that the join can be split at long lists
    open_lists = cut_sized(
        named.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    posted = named.join(open_lists, "key").join(sigs.select("node", "marks"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    grid = posted.withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = grid.select(
        "key",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2).alias("side"),
        "node", "component", "marks",
    )
    schema = f"key long, i int, j int, side int, node {kind}, component {kind}"
    colliding = cut_lineage(_in_cells(cells, _colliding, schema))
    found = _in_cells(colliding.join(sets, "node"), _cell_pairs(percent), f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, set to a temporary one only where none is named."""
    cut_lineage(spark.range(1))
    return spark.sparkContext.getCheckpointDir()


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the documents that a lower doc_id of their component stands for.

    Of several rows with one doc_id and text one stays, the least by its other columns written as
    JSON. Rows without doc_id all stay. Columns of any name and type are passed on as they are.
    """
    dropped = near_duplicates(docs, size, percent).where("not kept").select("doc_id").distinct()
    left = nested(docs, "doc_id", "text").join(dropped, "doc_id", "left_anti")
    repeated = cut_lineage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    # only rows of repeated ids are grouped, and equal ones are merged where they are read
    one = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(REST, F.to_json(REST)).alias(REST))
    single = left.join(repeated, "doc_id", "left_anti").select("doc_id", "text", REST)
    return restored(single.unionAll(one.select("doc_id", "text", REST)), docs, "doc_id", "text")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but blanks after lower-casing A-Z; a document's set are its distinct
    runs of `size` words, or the whole of a shorter text. Documents are linked when the overlap of
    their sets is at least `percent` of the union. component_id is the least doc_id that links reach.

    Null or empty texts have an empty set and link with nothing. Rows of one doc_id count as one
    document that has the links of all its rows. A row without doc_id is kept, has no component and
    links with nothing. Other columns are not read.
    """
    base = cut_lineage(describe(docs, size))
    classes = cut_lineage(
        base.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("node"))
    )
    keys = ["set_a", "set_b", "n_shingles"]
    sigs = cut_lineage(
        base.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", *keys], "left_semi")
        .dropDuplicates(["doc_id", *keys])
        .select(F.col("doc_id").alias("node"), "sig", "marks")
    )
    postings = cut_sized(prefix_postings(sigs))
    pivots = cut_sized(postings.groupBy("key").agg(F.min("node").alias("a")))
    stars = postings.join(pivots, "key").where("a < node").select("a", F.col("node").alias("b")).distinct()

    nodes = postings.select(F.col("node").alias("doc_id")).distinct()
    sets = cut_lineage(shingle_sets(docs.join(nodes.hint("shuffle_hash"), "doc_id", "left_semi"), size))

    links = cut_sized(_confirmed(_matched(stars, sigs), sets, percent))
    joined_so_far = components(links)
    more = cut_sized(_open_pairs(postings, sigs, sets, joined_so_far, percent))
    # copies hang on the least id of their class, and so do rows of one doc_id with different sets
    same = (
        base.where("n_shingles > 0 and doc_id is not null").select("doc_id", *keys)
        .join(classes, keys).select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    )
    # what the first pass has joined goes in as stars instead of links
    stars = joined_so_far.select(F.col("component").alias("a"), F.col("node").alias("b"))
    tied = components(stars.unionAll(more).unionAll(same))
    joined = base.drop("sig", "marks").join(tied.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
