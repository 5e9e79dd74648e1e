"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow batch.

A batch is worked through in slices of a few MB of text, and a text longer than a slice in
pieces cut between words, so memory follows the slice and the word count, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 * 2**20
PIECE_BYTES = 2**20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 2**32)) * step) | np.uint64(1)


_BYTE = constants(256, 1)
_BASE = int(constants(1, 2)[0])
_LAGS = constants(16, 3)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 2**64))
        done += take
    return out


class Alphabet:
    """Which bytes belong to words, with A-Z folded to a-z unless told otherwise, and a value for each byte."""

    def __init__(self, word_bytes: np.ndarray, fold: bool = True, values: np.ndarray = _BYTE):
        self.word = word_bytes
        case = np.arange(256)
        case[65:91] += 32 * fold
        self.values = values[case]


def _all_but(ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = False
    return out


#: `[^\x20\x09-\x0D]+` after lower-casing A-Z.
BLANK_SEPARATED = Alphabet(_all_but([(0x20, 0x20), (0x09, 0x0D)]))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALPHANUMERIC = Alphabet(_all_but([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]))
#: Lines between line feeds, by two independent hashes.
LINES = Alphabet(_all_but([(0x0A, 0x0A)]), fold=False)
LINES_AGAIN = Alphabet(_all_but([(0x0A, 0x0A)]), fold=False, values=constants(256, 6))


class Words(NamedTuple):
    """Words of a slice. Document d owns words first[d] to first[d + 1]; start and end are byte places in `data`."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(data) else data
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most `limit` bytes in `column`, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


_POWERS = _powers(_BASE, 2**16)
_INVERSE = _powers(pow(_BASE, -1, 2**64), 2**16)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        _POWERS, _INVERSE = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
    return _POWERS, _INVERSE


def _piece_words(data: np.ndarray, breaks: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one piece; no word goes over a break."""
    inside = alphabet.word[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    start[inner] = inside[inner]
    end[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    powers, inverse = _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(alphabet.values[data] * powers[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def words(texts: pa.Array, alphabet: Alphabet) -> Words:
    """All words of whole texts."""
    data, offsets = text_bytes(texts)
    starts, ends, hashes = [], [], []
    low = 0
    while low < len(data):
        high = min(low + PIECE_BYTES, len(data))
        if high < len(data):
            # cut after the last separator of the piece, or else after the word that fills it
            gaps = np.flatnonzero(~alphabet.word[data[low:high]])
            if len(gaps):
                high = low + int(gaps[-1]) + 1
            else:
                while high < len(data) and alphabet.word[data[high]]:
                    ahead = np.flatnonzero(~alphabet.word[data[high : high + PIECE_BYTES]])
                    high = high + int(ahead[0]) if len(ahead) else min(high + PIECE_BYTES, len(data))
        s, e, h = _piece_words(data[low:high], offsets - low, alphabet)
        starts.append(s + low)
        ends.append(e + low)
        hashes.append(h)
        low = high
    start = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    return Words(np.searchsorted(start, offsets), start, end, value, data, offsets)


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of word sequences of one length from the hashes of their words."""
    total = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for lag, part in enumerate(parts):
        total += part * _LAGS[lag]
    return mix(total)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return sequence_hash([hashes[lag : lag + n] for lag in range(size)])


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one document; a shorter one, if not empty, is a single shingle."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(size, len(hashes))))
