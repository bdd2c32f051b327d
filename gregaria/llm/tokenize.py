"""Token ids of whole texts by a public byte-level tokenizer, by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can
be part of no token of any text, so the text may be cut there: the fragments
are encoded independently and their ids concatenated. Cuts are kept to places
where the tokenizer's own pre-splitting sees the same thing on both sides: at
the start of a character, not after white space (which the pattern joins
differently at the end of a text) and not before an apostrophe (which may open
a contraction only at the start of a piece). Fragments are short, mostly single
words, and recur, so each worker encodes a fragment once and looks it up later.
"""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from gregaria.sources.tables import spread
from gregaria.sources.workers import on_workers

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern with which this vocabulary's tokenizer splits a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_FRAGMENTS = 400_000
MEMO_BYTES = 48
BLOCK_BYTES = 1 << 20
_SHIPPED: set[tuple[str, str]] = set()


def certain_cuts(vocabulary: list[bytes]) -> np.ndarray:
    """Flags by ``first byte * 256 + second byte``: whether a text may be cut between the two."""
    cut = np.ones((256, 256), bool)
    for token in vocabulary:
        both = np.frombuffer(token, np.uint8)
        cut[both[:-1], both[1:]] = False
    cut[:, 0x80:0xC0] = False  # inside a character
    cut[:, ord("'")] = False
    spaces = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    cut[[s.encode()[-1] for s in spaces], :] = False
    return cut.ravel()


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cuts = certain_cuts(list(ranks))
        self.memo: dict[bytes, list[int]] = {}

    def fragments(self, data: bytes) -> Iterator[list[bytes]]:
        """The text's fragments in turn, a bounded number at a time, so that a very long text needs no more memory than its bytes and ids."""
        at = np.frombuffer(data, np.uint8)
        start = 0
        for low in range(0, len(data), BLOCK_BYTES):
            part = at[low : low + BLOCK_BYTES + 1].astype(np.uint16)
            ends = (np.flatnonzero(self.cuts[(part[:-1] << 8) | part[1:]]) + (low + 1)).tolist()
            if ends:
                yield [data[i:j] for i, j in zip([start, *ends], ends)]
                start = ends[-1]
        if start < len(data):
            yield [data[start:]]

    def _ids(self, fragment: bytes) -> list[int]:
        ids = self.plain(fragment.decode("utf-8", "replace"))
        if len(fragment) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_FRAGMENTS:
                self.memo.clear()
            self.memo[fragment] = ids
        return ids

    def encode(self, text: str | bytes | None) -> np.ndarray:
        """Ids of the whole text as ordinary text; none for an empty or null one."""
        data = text.encode("utf-8", "replace") if isinstance(text, str) else text
        if not data:
            return np.empty(0, np.int32)
        known, ids = self.memo.get, self._ids
        parts = [np.fromiter(chain.from_iterable([known(f) or ids(f) for f in block]), np.int32) for block in self.fragments(data)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, from its host's file or, where there is none, the one shipped with the session."""
    return Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def _with_ranks(rows: DataFrame, path: str) -> DataFrame:
    """``rows``, once the rank file of the driver's host is shipped to the workers of its session."""
    context = rows.sparkSession.sparkContext
    if (context.applicationId, path) not in _SHIPPED and os.path.exists(path):
        context.addFile(path)
        _SHIPPED.add((context.applicationId, path))
    return on_workers(spread(rows))


def encode_texts(rows: DataFrame, key: str, text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """``key, ids``: the token ids of ``text`` for every row, an empty list for empty and null texts.

    Each row is worked on where it lies; repeated and null keys are kept, other
    columns are not read. ``path`` is the rank file, on the hosts of the executors or on
    the driver's, from which it is shipped.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts = batch.column(text).cast(pa.large_binary())
            ids = [encode(value.as_py()) for value in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=[key, "ids"])

    return _with_ranks(rows.select(key, text), path).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(rows: DataFrame, keep: list[str], text: str = "text", path: str = BYTE_BPE) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of every row; 0 for empty and null texts."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts = batch.column(text).cast(pa.large_binary())
            counts = pa.array([len(encode(value.as_py())) for value in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), counts], names=[*keep, "n_tokens"])

    return _with_ranks(rows.select(*keep, text), path).mapInArrow(run, f"{kinds}, n_tokens bigint")
