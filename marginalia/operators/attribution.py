"""Which bytes of a file an edit wrote. Offsets are bytes, so this works on binary, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import lexicon as L


def shared_bytes(old: bytes, new: bytes) -> tuple[int, int]:
    """Bytes that two texts begin with, and, of the rest, that they end with. Halving finds each in few comparisons."""

    def common(n: int, same) -> int:
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if same(mid) else (lo, mid - 1)
        return lo

    shorter = min(len(old), len(new))
    prefix = common(shorter, lambda k: old[:k] == new[:k])
    return prefix, common(shorter - prefix, lambda k: old[len(old) - k :] == new[len(new) - k :])


def locate_bytes(source: bytes, text: bytes, most: int = L.SPANS) -> list[tuple[int, int]]:
    """The places of text, from left to right, none over another. An empty text is nowhere."""
    out, at = [], 0
    while text and len(out) < most and (at := source.find(text, at)) >= 0:
        out.append((at, at + len(text)))
        at += len(text)
    return out


def written_spans(source: bytes, edits: list[tuple[bytes, bytes]]) -> list[tuple[int, int]]:
    """The spans that edits (old, new) wrote, each without what it shares with the old text; no more edits once there are
    as many spans as a scan takes."""
    out: list[tuple[int, int]] = []
    for old, new in edits:
        if not new or len(out) >= L.SPANS:
            continue
        prefix, suffix = shared_bytes(old, new)
        out += [(a + prefix, b - suffix) for a, b in locate_bytes(source, new) if prefix + suffix < b - a]
    return out


def _bytes(x) -> bytes:
    return bytes(x) if x is not None else b""


@F.pandas_udf(T.StructType([T.StructField("prefix", T.IntegerType()), T.StructField("suffix", T.IntegerType())]))
def _shared(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shared_bytes(_bytes(a), _bytes(b)) for a, b in zip(old, new)], columns=["prefix", "suffix"])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _locate(source: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in locate_bytes(_bytes(s), _bytes(t))] for s, t in zip(source, text)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _written(source: pd.Series, whole: pd.Series, edits: pd.Series) -> pd.Series:
    def spans(s, all_of_it, es):
        if all_of_it:
            return [(0, len(s))]
        return written_spans(s, [((e["old"] or "").encode(), (e["new"] or "").encode()) for e in (es if es is not None else [])])

    return pd.Series([[{"start": a, "end": b} for a, b in spans(_bytes(s), w, e)] for s, w, e in zip(source, whole, edits)], dtype=object)


def written(source: Column, whole: Column, edits: Column) -> Column:
    """The spans of a file that a write made: all of it, or what edits (an array of old and new) put there."""
    return _written(source.cast("binary"), whole, edits)


def shared(old: Column, new: Column) -> Column:
    return _shared(old.cast("binary"), new.cast("binary"))


def locate(source: Column, text: Column) -> Column:
    return _locate(source.cast("binary"), text.cast("binary"))


def narrow(spans: Column, prefix: Column, suffix: Column) -> Column:
    """Spans without their shared ends; those that have nothing left go. Built-in expressions only."""
    cut = F.transform(spans, lambda s: F.struct((s["start"] + prefix).alias("start"), (s["end"] - suffix).alias("end")))
    return F.filter(cut, lambda s: s["start"] < s["end"])
