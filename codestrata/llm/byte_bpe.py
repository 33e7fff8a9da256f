"""Encoding of texts by the ranks of a public byte-level tokenizer."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codestrata.session import spread

#: Where the vocabularies of the public tokenizers lie, unless a path is given.
VOCABULARIES = "/opt/tokenizers"

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes up to which a word is scanned for its lowest rank; longer ones use a heap, as scanning is quadratic.
SHORT = 96
#: Words remembered by a worker; when full, the memory starts anew. It changes no result.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges over one contiguous array of part boundaries, beside it the rank of each part joined with its neighbour."""
    none = 1 << 62
    bounds = list(range(len(word) + 1))
    joined = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while joined:
        least = min(joined)
        if least == none:
            break
        at = joined.index(least)
        del bounds[at + 1], joined[at]
        if at < len(joined):
            joined[at] = ranks.get(word[bounds[at] : bounds[at + 2]], none)
        if at:
            joined[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of candidate joints, for words without a length bound."""
    n = len(word)
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    live = [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if not live[i] or (j := after[i]) >= n or ranks.get(word[i : after[j]]) != rank:
            continue
        live[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : after[after[i]]])) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : after[i]])) is not None:
            heapq.heappush(heap, (r, before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Splits a text into words and encodes each, remembering the words seen."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.split, self.memory = ranks, regex.compile(PATTERN).findall, {}

    def word(self, text: str) -> list[int]:
        raw = text.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        if len(raw) <= SHORT:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known, put = self.memory.get, ids.extend
        for w in self.split(text or ""):
            put(known(w) or self.word(w))
        return ids


def encode_column(documents: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", vocabularies: str = VOCABULARIES) -> DataFrame:
    """``key, ids``: one row per row of ``documents``, without special tokens; empty and null texts give an empty list.

    The ranks (about 50 000 tokens, 1 MB; a fixed file) are read on the driver and broadcast. Whole texts are encoded,
    of any length. Null keys, repeated rows and other columns are kept or ignored as they are; an empty table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load_ranks(f"{vocabularies}/{tokenizer}.tiktoken"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            offsets, parts = np.zeros(batch.num_rows + 1, np.int32), []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(t)
                parts.append(np.asarray(ids, np.int32))
                offsets[i + 1] = offsets[i] + len(ids)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    picked = spread(documents.select(documents[key].alias("key"), documents[text].alias("text")))
    return picked.mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
