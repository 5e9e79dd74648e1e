"""Benchmark passages in documents, by a prefix-filtered set join (operator 4).

A window is `size` consecutive words of an item (a shorter item is one window). A document holds a
window only if it holds each of its shingles, so one necessary token, the first in the order of
rarity, is enough of a prefix. Rarity is counted over all documents. Documents are probed for
these prefix shingles; a match fixes where the window would lie, positional and length bounds drop
what would not fit, and the window is verified word by word.

The benchmark is worked through in blocks of bounded size, each broadcast; one block is the usual
case. The documents are never shuffled for the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.llm.columns import nested, restored
from patentkin.llm.text import ALPHANUMERIC, slices, windows, words
from patentkin.operators.skew import cut_lineage

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 16 * 2**20
_FILTER = 2**18


class Index(NamedTuple):
    """Windows of one block of items: their words, and their prefix shingles in order of the hash."""

    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]
    shingle: np.ndarray
    size: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def _windows(items: pa.Table, size: int) -> tuple[list[np.ndarray], list[list[str]]]:
    """Distinct windows as word hashes, and the ids of the items that hold each."""
    seen: dict[bytes, int] = {}
    rows: list[np.ndarray] = []
    held: list[dict[str, None]] = []
    for batch in items.to_batches():
        found = words(batch.column("text"), ALPHANUMERIC)
        for d, item in enumerate(batch.column("item_id").to_pylist()):
            own = found.hash[found.first[d] : found.first[d + 1]]
            for at in range(len(own) - size + 1) if len(own) >= size else range(min(1, len(own))):
                row = own[at : at + size]
                w = seen.setdefault(row.tobytes(), len(rows))
                if w == len(rows):
                    rows.append(row)
                    held.append({})
                if item is not None:
                    held[w][str(item)] = None
    return rows, [list(h) for h in held]


def _shingles_of(rows: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Distinct shingles of all windows by their size, which is below SHINGLE for very short items."""
    by_size: dict[int, list[np.ndarray]] = {}
    for row in rows:
        q = min(SHINGLE, len(row))
        by_size.setdefault(q, []).append(windows(row, q))
    return {q: np.unique(np.concatenate(x)) for q, x in by_size.items()}


def _probe(hashes: np.ndarray, q: int, wanted: np.ndarray, quick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word position, place in `wanted`) of the shingles of size q that are in the sorted `wanted`."""
    own = windows(hashes, q)
    maybe = np.flatnonzero(quick[(own & np.uint64(_FILTER - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(wanted, own[maybe]), len(wanted) - 1)
    hit = wanted[place] == own[maybe]
    return maybe[hit], place[hit]


def _quick(wanted: np.ndarray) -> np.ndarray:
    table = np.zeros(_FILTER, dtype=bool)
    table[(wanted & np.uint64(_FILTER - 1)).astype(np.int64)] = True
    return table


def _shingle_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle occurs in all documents; the result is as long as the block's shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        quick = {q: _quick(x) for q, x in wanted.items()}
        total = {q: np.zeros(len(x), dtype=np.int64) for q, x in wanted.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"), ALPHANUMERIC)
                for q, x in wanted.items():
                    _, place = _probe(found.hash, q, x, quick[q])
                    total[q] += np.bincount(place, minlength=len(x))
        for q, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), q), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at])], ["q", "place", "n"]
            )

    counted = docs.select("text").mapInArrow(run, "q int, place long, n long").groupBy("q", "place").agg(F.sum("n").alias("n"))
    out = {q: np.zeros(len(x), dtype=np.int64) for q, x in wanted.items()}
    for row in counted.toPandas().itertuples():
        out[row.q][row.place] = row.n
    return out


def _index(docs: DataFrame, items: pa.Table, size: int) -> Index | None:
    rows, held = _windows(items, size)
    if not rows:
        return None
    wanted = _shingles_of(rows)
    counts = _shingle_counts(docs, wanted)
    prefix = []
    for w, row in enumerate(rows):
        q = min(SHINGLE, len(row))
        own = windows(row, q)
        rarity = counts[q][np.searchsorted(wanted[q], own)]
        at = int(np.lexsort((own, rarity))[0])
        prefix.append((q, own[at], w, at))
    prefix.sort(key=lambda x: (x[0], x[1]))
    table = np.zeros((len(rows), size), dtype=np.uint64)
    for w, row in enumerate(rows):
        table[w, : len(row)] = row
    q, shingle, window, offset = (np.array(x) for x in zip(*prefix, strict=True))
    return Index(table, np.array([len(r) for r in rows]), held, shingle.astype(np.uint64), q, window, offset)


def _matches(hashes: np.ndarray, first: np.ndarray, index: Index, probes: dict) -> tuple[np.ndarray, np.ndarray]:
    """(start word, window) of every occurrence of a window inside one document of the slice."""
    starts, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for q, (wanted, quick, low, count) in probes.items():
        at, place = _probe(hashes, q, wanted, quick)
        n = count[place]
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(low[place], n) + rank
        at, window = np.repeat(at, n), index.window[entry]
        start = at - index.offset[entry]
        # positional and length bounds: the window lies in the document of its prefix shingle
        doc = np.searchsorted(first, at, side="right") - 1
        fits = (start >= first[doc]) & (start + index.lengths[window] <= first[doc + 1])
        start, window = start[fits], window[fits]
        same = np.ones(len(start), dtype=bool)
        for lag in range(index.rows.shape[1]):
            inside = lag < index.lengths[window]
            same &= ~inside | (hashes[np.minimum(start + lag, len(hashes) - 1)] == index.rows[window, lag])
        starts.append(start[same])
        found.append(window[same])
    return np.concatenate(starts), np.concatenate(found)


def _probes(index: Index) -> dict:
    out = {}
    for q in np.unique(index.size):
        inside = np.flatnonzero(index.size == q)
        wanted, low, count = np.unique(index.shingle[inside], return_index=True, return_counts=True)
        out[int(q)] = (wanted, _quick(wanted), inside[0] + low, count)
    return out


def _hits(docs: DataFrame, index: Index | None) -> DataFrame:
    """Per row of docs: n_words, the merged hit runs of words (start, end) and the items they come from."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        probes = _probes(index) if index else {}
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"), ALPHANUMERIC)
                first, n = found.first, part.num_rows
                start, window = _matches(found.hash, first, index, probes) if index else ((), ())
                runs, items = [[] for _ in range(n)], [{} for _ in range(n)]
                if len(start):
                    order = np.argsort(start, kind="stable")
                    for s, w in zip(start[order].tolist(), window[order].tolist(), strict=True):
                        d = int(np.searchsorted(first, s, side="right")) - 1
                        low, high = s - int(first[d]), s - int(first[d]) + int(index.lengths[w])
                        items[d].update(dict.fromkeys(index.items[w]))
                        if runs[d] and low <= runs[d][-1]:
                            runs[d][-1] = max(runs[d][-1], high)
                        else:
                            runs[d] += [low, high]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(found.counts, pa.int64()),
                     pa.array(runs, pa.list_(pa.int64())), pa.array([list(x) for x in items], pa.list_(pa.string()))],
                    ["doc_id", "key", "n_words", "runs", "items"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, key long, n_words long, runs array<long>, items array<string>")


def _merge_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """The results of several blocks for one document as one."""
    spans = sorted((int(r[k]), int(r[k + 1])) for r in rows["runs"] for k in range(0, len(r), 2))
    merged: list[int] = []
    for low, high in spans:
        if merged and low <= merged[-1]:
            merged[-1] = max(merged[-1], high)
        else:
            merged += [low, high]
    items = sorted({x for held in rows["items"] for x in held})
    head = rows.iloc[:1]
    return pd.DataFrame({"doc_id": head["doc_id"], "key": head["key"], "runs": [merged], "items": [items]})


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items (their ids, sorted as strings), contaminated.

    Words are runs of letters, digits and anything beyond ASCII after lower-casing A-Z. A word is
    hit inside any occurrence of a window of the benchmark. Null and empty texts have no words, on
    either side. Items of one id are one item; an item without id hits words and is not listed.
    Repeated documents have a row each. Other columns are not read.
    """
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(blocks))
    parts = [
        _hits(docs, _index(docs, items.where(block == b).toArrow() if blocks > 1 else items.toArrow(), size))
        for b in range(blocks)
    ]
    hits = parts[0]
    if blocks > 1:
        kind = dict(docs.dtypes)["doc_id"]
        found = parts[0].select("doc_id", "key", "runs", "items")
        for part in parts[1:]:
            found = found.unionAll(part.select("doc_id", "key", "runs", "items"))
        found = cut_lineage(
            found.where("size(runs) > 0").groupBy("doc_id", "key")
            .applyInPandas(_merge_runs, f"doc_id {kind}, key long, runs array<long>, items array<string>")
            .select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), F.col("runs").alias("r"), F.col("items").alias("i"))
        )
        same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))
        hits = parts[0].join(found, same, "left").select(
            "doc_id", "n_words",
            F.coalesce("r", F.array().cast("array<long>")).alias("runs"),
            F.coalesce("i", F.array().cast("array<string>")).alias("items"),
        )
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)), F.lit(0).cast("long"),
        lambda n, k: n + F.get(F.col("runs"), k + 1) - F.get(F.col("runs"), k),
    )
    n_hit = F.when(F.size("runs") == 0, F.lit(0).cast("long")).otherwise(covered)
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sort_array("items").alias("items"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """`docs` without contaminated documents. Rows of one doc_id go together; columns of any name and type are passed on."""
    hit = contamination(docs, benchmark, size).where("contaminated").select("doc_id").distinct()
    hit = hit.select(F.col("doc_id").alias("hit_id"))
    left = nested(docs, "doc_id").join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_anti")
    return restored(left, docs, "doc_id")
