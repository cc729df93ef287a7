"""Byte-level BPE with a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its byte position; each inner node the least of its two children as
(rank, position), so the root names the leftmost pair of least rank. A merge joins two live neighbours: the leaf of the
absorbed part dies, and the leaves of the merged part and of its left neighbour get new ranks: three point updates of
logarithmic cost, so a piece of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame

from marginalia.llm.common import sliced, unlike

#: Pieces of a text taken at once, so that a very long text never becomes one list.
CHUNK = 1 << 16
#: Encoded pieces that a worker keeps.
CACHE = 400_000

_NONE = 1 << 62
_SHIFT = 40  # a key is rank << _SHIFT | position


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The rank of each token of a rank file (a base64 token and its rank on each line)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: always the leftmost pair of least rank is merged next."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << _SHIFT | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    end = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n))  # where the live part before the one that starts here starts
    while (best := tree[1]) != _NONE:
        i = best & ((1 << _SHIFT) - 1)
        j = end[i]
        k = end[i] = end[j]
        before[k] = i
        rank = get(piece[i : end[k]]) if k < n else None
        updates = [(j, _NONE), (i, _NONE if rank is None else rank << _SHIFT | i)]
        if i:
            h = before[i]
            rank = get(piece[h:k])
            updates.append((h, _NONE if rank is None else rank << _SHIFT | h))
        for at, key in updates:
            at += size
            if tree[at] == key:
                continue
            tree[at] = key
            while at > 1:
                other = tree[at ^ 1]
                if other < key:
                    key = other
                at >>= 1
                if tree[at] == key:
                    break
                tree[at] = key
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Cache(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; emptied when it is full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = merge(piece.encode("utf-8", "replace"), self.ranks)
        found = b"".join([x.to_bytes(4, "little") for x in ids])
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = found
        return found


class Codec:
    """Encodes and decodes with the ranks of one file, as ordinary text: no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.cache = _Cache(self.ranks)

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text, a bounded number of pieces at a time."""
        if len(text) <= 4 * CHUNK:
            yield b"".join(map(self.cache.__getitem__, self.pattern.findall(text)))
            return
        pieces = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(pieces, CHUNK)):
            yield b"".join(map(self.cache.__getitem__, some))

    def encode(self, text: str) -> list[int]:
        return [int.from_bytes(p[i : i + 4], "little") for p in self.parts(text) for i in range(0, len(p), 4)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids that are little-endian unsigned 32-bit integers."""
        import numpy as np

        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def shared_codec(data: bytes, mark: bytes, pattern: str) -> Codec:
    """One codec, with its cache, for each worker process; mark is a digest of the rank file's data."""
    if (mark, pattern) not in _codecs:
        _codecs[mark, pattern] = Codec(parse_ranks(data), pattern)
    return _codecs[mark, pattern]


def _of_file(path: str, pattern: str) -> Callable[[], Codec]:
    """Reads a rank file here; tasks carry its bytes, a megabyte or so, as executors need not have the file."""
    with open(path, "rb") as f:
        data = f.read()
    mark = hashlib.sha256(data).digest()
    return lambda: shared_codec(data, mark, pattern)


def map_texts(df: DataFrame, each: Callable[[str], tuple], keep: list[str], text: str, fields: list[tuple[str, str]]) -> DataFrame:
    """keep, and the fields (name and type) that each(text) returns, for every row; a null text counts as empty."""
    arrow = {"long": "int64", "string": "string", "array<int>": "list"}

    def run(batches):
        import pyarrow as pa

        types = [pa.list_(pa.int32()) if arrow[t] == "list" else pa.type_for_alias(arrow[t]) for _, t in fields]
        for batch in sliced(batches):
            rows = [each(t or "") for t in batch.column(len(keep)).to_pylist()]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *(n for n, _ in fields)])

    own = df.select(*[df[c] for c in keep], df[text].cast("string").alias(unlike(keep, "__text")))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{n} {t}" for n, t in fields)])
    return own.mapInArrow(run, schema)


def tokenize(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep and `ids`, an array of token ids, for every row of df.

    Each match of the pattern is encoded by itself. Null and empty texts give an empty array; equal rows stay as many
    rows; other columns of df play no part, whatever their names; an empty table gives an empty one.
    """

    own = _of_file(path, pattern)

    def each(t: str) -> tuple:
        return (own().encode(t),)

    return map_texts(df, each, keep, text, [("ids", "array<int>")])


def round_trip(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the
    bytes that the ids decode to) for every row; rows as in tokenize. One pass, no shuffle; memory is bounded by one
    batch of texts and the worker's cache of pieces."""

    of_file = _of_file(path, pattern)

    def each(t: str) -> tuple:
        own = of_file()
        n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
        for part in own.parts(t):
            n += len(part) // 4
            ids.update(part)
            back.update(own.decode(part))
        return n, ids.hexdigest(), back.hexdigest()

    return map_texts(df, each, keep, text, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
