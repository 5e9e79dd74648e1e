"""Token counts of whole texts (operator 11).

The tokenizer runs inside Arrow functions that give back lengths only: no ids leave a task. Texts
are encoded in batches of about equal bytes, whatever the number of rows, and a long text is split
at places where no token can reach across, so the lengths of its parts add up to its own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patentkin.llm import text as texts

BATCH_BYTES = 2**18
PART_CHARS = 2**14
LIMIT = 4_096
ANCHOR = "\n"
_GAP = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class PieceCounter:
    """Counts of a sentencepiece model.

    A merge is a piece of the vocabulary, so no merge goes over two neighbouring characters that
    stand side by side in no piece: between them a text may be cut. The library puts a blank before
    every text, which a later part must not get, so later parts are encoded behind an anchor that
    no piece holds, and the anchor's own tokens are taken off. A model that changes characters
    before it looks for pieces is given whole texts.
    """

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=file)
        pieces = [
            self.model.id_to_piece(k)
            for k in range(self.model.vocab_size())
            if not (self.model.is_control(k) or self.model.is_byte(k) or self.model.is_unknown(k))
        ]
        self.joined = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        anchored = any(ANCHOR in p for p in pieces)
        probe = f"  a{ANCHOR}ｂ é"
        plain = self.model.normalize(probe) == "▁" + probe.replace(" ", "▁")
        self.splits = plain and not anchored
        self.offset = len(self.model.encode(ANCHOR)) if self.splits else 0

    def cut(self, text: str, low: int, high: int) -> int:
        """The last safe place in (low, high], else the first after it, else the end."""
        spaced = text[low : high + 1].replace(" ", "▁")
        for at in range(len(spaced) - 1, 0, -1):
            if spaced[at - 1 : at + 1] not in self.joined:
                return low + at
        for at in range(high + 1, len(text)):
            if text[at - 1 : at + 1].replace(" ", "▁") not in self.joined:
                return at
        return len(text)

    def part(self, text: str, low: int, high: int) -> tuple[str, int]:
        return (ANCHOR + text[low:high], self.offset) if low else (text[low:high], 0)

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(parts, num_threads=1)]


class WordCounter:
    """Counts of a `tokenizers` file, whose words end before a blank between two letters: the safe places.

    A tokenizer that puts a blank before texts, cuts them or fills them up is given whole texts,
    and so is one with added tokens that hold a blank.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.model.no_truncation()
        self.model.no_padding()
        rules = json.loads(self.model.to_str())
        added = rules.get("added_tokens") or []
        stages = json.dumps([rules.get("pre_tokenizer"), rules.get("normalizer")])
        self.splits = '"add_prefix_space": true' not in stages and "Metaspace" not in stages and not any(
            " " in a["content"] or a["lstrip"] or a["rstrip"] for a in added
        )

    def cut(self, text: str, low: int, high: int) -> int:
        last = None
        for last in _GAP.finditer(text, low + 1, high):
            pass
        found = last or _GAP.search(text, high)
        return found.start() if found else len(text)

    def part(self, text: str, low: int, high: int) -> tuple[str, int]:
        return text[low:high], 0

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch(parts, add_special_tokens=False)]


@cache
def counter(name: str) -> PieceCounter | WordCounter:
    """The counter for a public vocabulary file, loaded once per worker."""
    import public_tokenizers

    file = public_tokenizers.path(name)
    return PieceCounter(file) if name.endswith(".model") else WordCounter(file)


def split_parts(text: str, count: PieceCounter | WordCounter, size: int) -> Iterator[tuple[str, int]]:
    """Parts of about `size` characters, each with the number of tokens to take off."""
    low = 0
    while low < len(text):
        high = len(text)
        if count.splits and high - low > size:
            high = count.cut(text, low, low + size)
        yield count.part(text, low, high)
        low = high


def _lengths(values: Iterator[str], rows: int, count: PieceCounter | WordCounter) -> np.ndarray:
    """Tokens of every text, encoded in batches of about BATCH_BYTES."""
    out = np.zeros(rows, dtype=np.int64)
    parts: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        if parts:
            np.add.at(out, owners, count.lengths(parts))
            parts.clear()
            owners.clear()

    for row, value in enumerate(values):
        for part, extra in split_parts(value, count, PART_CHARS):
            out[row] -= extra
            parts.append(part)
            owners.append(row)
            size += len(part.encode())
            if size >= BATCH_BYTES:
                flush()
                size = 0
    flush()
    return out


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the library for whole texts, without begin, end or added special tokens.
    Strings in a text that look like special tokens are taken as the library does by default. A
    null or empty text has no bytes and no tokens. Rows are counted each on their own, so repeated
    rows and ids, null ids and ids of any type stay as they are. Other columns are not read; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            for part in texts.slices(batch, "text"):
                column = part.column("text")
                values = (value.as_py() or "" for value in column)
                tokens = _lengths(values, part.num_rows, count)
                n_bytes = np.diff(texts.text_bytes(column)[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_bytes), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
