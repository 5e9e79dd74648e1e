"""Packing documents into token sequences by linear grouping (operator 10).

Only the histogram of piece lengths, at most `capacity` numbers, comes to the driver. There the
large lengths are put into groups of equal cardinality and rounded up to the largest of their
group; configurations of these few sizes are chosen one after another, each the fullest that holds
the largest size left, as often as the groups allow; actual lengths are substituted, which leaves
room; and the small lengths are put into the fullest sequences that still take them. All of it
works on ranges of equal pieces and equal sequences, never on single ones. The plan says, for the
ranks of each length, which sequences they go to, so the pieces are placed by one lookup.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patentkin.operators.skew import cut_lineage

CAPACITY = 2_048
GROUPS = 1_024
SMALL_SHARE = 8
RANK_ROWS = 200_000
END_ID = 0
SPECIAL = "<|endoftext|>"
_IRREGULAR = re.compile(r"\s\s")


class Encoder:
    """Ids of the byte-level vocabulary, as its `tokenizers` file gives them.

    Texts without two blanks in a row and without the special token are encoded from the rank file
    of the same vocabulary, with the look-ahead of its pattern left out, since it decides nothing
    there. This is about nine times as fast. All other texts go through the `tokenizers` file.
    """

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        self.file = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")
        self.quick = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL not in text and not _IRREGULAR.search(text):
            return self.quick.encode_to_numpy(text, disallowed_special=())
        if self.whole is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.file)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. The first piece of a longer document is the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    owner.append(row)
                    piece.append(k)
                    start.append(low)
                    length.append(high - low)
                    crc.append(zlib.crc32(ids[low:high].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _fullest(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Multiset of the sizes, at most as many as are left, with the largest sum that fits."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for g, size in enumerate(sizes):
        for _ in range(min(left[g], room // size)):
            more = (reach | reach << size) & mask
            if more == reach:
                break
            steps.append((g, reach))
            reach = more
    target = reach.bit_length() - 1
    taken = []
    for g, before in reversed(steps):
        if not before >> target & 1:
            taken.append(g)
            target -= sizes[g]
    return taken


def _groups(counts: list[int], smallest: int, capacity: int, groups: int) -> list[list[tuple[int, int, int]]]:
    """Large pieces in falling length, in groups of equal cardinality: ranges (length, first rank, number)."""
    total = sum(counts[smallest:capacity])
    share = max(1, -(-total // groups))
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for length in range(capacity - 1, smallest - 1, -1):
        rank = 0
        while rank < counts[length]:
            if not room:
                out.append([])
                room = share
            take = min(room, counts[length] - rank)
            out[-1].append((length, rank, take))
            rank += take
            room -= take
    return out


class _Plan:
    """Rows (length, first rank, number, first sequence, offset), and open sequences by the room they have."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.sequences = 0

    def new(self, number: int) -> int:
        self.sequences += number
        return self.sequences - number

    def leave(self, room: int, first: int, number: int) -> None:
        if room and number:
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((first, number))

    def take(self, length: int, most: int) -> tuple[int, int, int] | None:
        """Up to `most` sequences of the smallest room that takes the length: (room, first, number)."""
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, number = self.open[room].pop()
        if number > most:
            self.open[room].append((first + most, number - most))
            number = most
        if not self.open[room]:
            self.rooms.pop(at)
        return room, first, number


def plan_sequences(counts: list[int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces go: counts[l] pieces of length l, for l up to capacity."""
    plan = _Plan()
    smallest = capacity // SMALL_SHARE + 1
    if counts[capacity]:
        plan.rows.append((capacity, 0, counts[capacity], plan.new(counts[capacity]), 0))
    grouped = _groups(counts, smallest, capacity, groups)
    sizes = [g[0][0] for g in grouped]
    left = [sum(n for _, _, n in g) for g in grouped]
    queues = [list(reversed(g)) for g in grouped]
    for largest in range(len(grouped)):
        while left[largest]:
            left[largest] -= 1
            chosen = [largest, *sorted(_fullest(sizes[largest:], left[largest:], capacity - sizes[largest]))]
            chosen = [largest] + [largest + g for g in chosen[1:]]
            left[largest] += 1
            uses = {g: chosen.count(g) for g in chosen}
            times = min(left[g] // n for g, n in uses.items())
            for g, n in uses.items():
                left[g] -= n * times
            while times:
                # actual pieces: as many sequences at once as have the same lengths
                number = times
                for g, n in uses.items():
                    number = min(number, max(1, queues[g][-1][2] // n))
                first, offset = plan.new(number), 0
                for g in chosen:
                    need, done = number, 0
                    length, rank, have = queues[g][-1]
                    if number == 1 or have >= need:
                        plan.rows.append((length, rank, need, first + done, offset))
                        queues[g][-1] = (length, rank + need, have - need)
                        if not queues[g][-1][2]:
                            queues[g].pop()
                    offset += length
                plan.leave(capacity - offset, first, number)
                times -= number
    for length in range(smallest - 1, 0, -1):
        rank, n = 0, counts[length]
        while n:
            found = plan.take(length, max(1, n))
            if found is None:
                per = capacity // length
                number = max(1, n // per)
                found = (capacity, plan.new(number), number)
            room, first, number = found
            per = min(room // length, n)
            used = max(1, min(number, n // per))
            plan.leave(room, first + used, number - used)
            for k in range(per):
                plan.rows.append((length, rank, used, first, capacity - room + k * length))
                rank += used
            n -= per * used
            plan.leave(room - per * length, first, used)
    return plan.rows


def _ranked(rows: DataFrame, counts: list[int]) -> DataFrame:
    """`rows` with the rank of each among those of its length; a frequent length is ranked in parts."""
    parts = [max(1, -(-n // RANK_ROWS)) for n in counts]
    part = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.get(F.lit(parts).cast("array<bigint>"), F.col("length").cast("int")))
    placed = rows.withColumn("part", part)
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sums = placed.groupBy("length", "part").agg(F.count("*").alias("n"))
    # at most capacity + rows / RANK_ROWS rows
    sums = F.broadcast(sums.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")))
    inner = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = placed.withColumn("inner", inner).join(sums, ["length", "part"])
    return numbered.withColumn("rank", F.col("before") + F.col("inner") - 1).drop("part", "before", "inner")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """One row per piece of every row of `docs`: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a closing id; a null text is empty. One longer than the capacity is
    cut from its end into full pieces, so the first piece may be shorter. Pieces lie gapless in
    their sequence from offset 0. Repeated rows and ids are documents of their own. An empty table
    gives no rows. Other columns are not read.
    """
    cut = cut_lineage(pieces(docs, vocabulary, capacity))
    counts = [0] * (capacity + 1)
    for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    rows = np.array(sorted(plan_sequences(counts, capacity, groups)), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] << 50 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 50 | rank, side="right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return _ranked(cut, counts).select(*cut.columns, "rank").mapInArrow(place, schema)
