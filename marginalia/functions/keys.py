"""FNV-1a, 64 bits, of whole texts. In Arrow batches: as an expression each character would cost a struct and thirty nodes."""

from __future__ import annotations

import decimal

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASIS, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1
#: Shorter texts are cheaper by a loop; longer ones are taken in parts of this many bytes.
SHORT, PART = 100, 1 << 16

_powers: list[np.ndarray] = []


def _descending(n: int) -> np.ndarray:
    """PRIME to the powers n to 1, modulo 2**64."""
    if not _powers:
        _powers.append(np.multiply.accumulate(np.full(PART, PRIME, np.uint64))[::-1].copy())
    return _powers[0][PART - n :]


def _part(h: int, x: np.ndarray) -> int:
    """h after the bytes x. (h ^ b) is h + d, where d hangs on the lowest byte of h alone, so the hash is a sum of d times powers
    of the prime. The lowest bytes come bit by bit: as the prime is odd, bit k of the next is bit k of this, of b and what lower
    bits carry, each added without carry, that is a running exclusive or."""
    low = np.zeros(len(x) + 1, np.uint8)
    for k in range(8):
        carried = ((low[:-1] ^ x) & ((1 << k) - 1)) * np.uint8(PRIME & 255)
        bits = np.empty(len(x) + 1, np.uint8)
        bits[0] = h >> k & 1
        bits[1:] = (x ^ carried) >> k & 1
        low |= np.bitwise_xor.accumulate(bits) << k
    d = (low[:-1] ^ x).astype(np.int64) - low[:-1]
    powers = _descending(len(x))
    return (h * int(powers[0]) + int((d.view(np.uint64) * powers).sum(dtype=np.uint64))) & MASK


def fnv(text: bytes) -> int:
    h = BASIS
    if len(text) < SHORT:
        for b in text:
            h = (h ^ b) * PRIME & MASK
        return h
    x = np.frombuffer(text, np.uint8)
    for at in range(0, len(x), PART):
        h = _part(h, x[at : at + PART])
    return h


@F.pandas_udf(T.DecimalType(20, 0))
def fnv_of(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else decimal.Decimal(fnv(t.encode())) for t in text], dtype=object)
