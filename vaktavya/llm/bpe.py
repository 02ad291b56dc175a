"""Token ids of whole texts by a byte-level BPE vocabulary, merged with a segment tree.

The pattern of the vocabulary cuts a text into pieces; merges never cross pieces. Over the byte
positions of a piece stands a segment tree whose nodes hold the least rank of any pair that begins
below them. The leftmost least pair is found by walking down from the root; a merge changes the
pair that starts at the merged place and the one before it and removes the swallowed one, three point
updates of logarithmic cost. A piece of n bytes costs O(n log n), however long it is: runs of
blanks or base64 have no quadratic case. A worker keeps the ids of pieces that it has met.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie, and the one that p8 uses.
FOLDER = os.environ.get("VAKTAVYA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps, and the longest one it keeps. Beyond that all is forgotten; results don't depend on it.
KEPT, KEPT_BYTES = 400_000, 64
_NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes and ranks of a rank file."""
    return ranks_of(Path(path).read_bytes())


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Bytes and ranks of the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    ends = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))  # where the part before it starts
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while tree[1] != _NONE:
        least, i = tree[1], 1
        while i < size:
            i *= 2
            if tree[i] != least:
                i += 1
        i -= size
        j = ends[i]
        k = ends[j]
        ends[i] = k
        put(j, _NONE)
        if k < n:
            before[k] = i
            put(i, get(piece[i : ends[k]], _NONE))
        else:
            put(i, _NONE)
        if before[i] >= 0:
            put(before[i], get(piece[before[i] : k], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Pieces(dict):
    """Ids of pieces met so far."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        ids = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids, with a memory of pieces."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.pieces = regex.compile(PATTERN).findall
        self.known = Pieces(ranks)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one. A lone surrogate counts as U+FFFD."""
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text or ""))))


_ENCODERS: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """Rows (``key``, ids) of every text, whole and without special tokens; their strings are ordinary text.

    A null text and an empty one both have no ids (an empty list, not null). Repeated rows stay,
    null keys too. The driver reads the vocabulary, a file of bounded size, and sends it to the executors.
    """
    path = os.path.join(folder, vocabulary)
    kind = dict(df.dtypes)[key]

    content = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(ranks_of(content.value)))
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column("_text").to_pylist():
                flat.extend(encoder.encode(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), ids], names=["_key", "ids"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)
