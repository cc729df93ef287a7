"""Masks template actions, so that what is left parses as the language it is in; no offset moves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def masked(text: bytes) -> bytes:
    """Each {{...}} within a paragraph as spaces (line ends stay); an opener without a closer hides nothing, and no more is
    looked for in its paragraph."""
    if b"{{" not in text:
        return text
    out = []
    for n, paragraph in enumerate(text.split(b"\n\n")):
        if n:
            out.append(b"\n\n")
        done, at = [], 0
        while (start := paragraph.find(b"{{", at)) >= 0 and (end := paragraph.find(b"}}", start)) >= 0:
            action = paragraph[start : end + 2]
            done += [paragraph[at:start], b"\n".join(b" " * len(x) for x in action.split(b"\n"))]
            at = end + 2
        out += [*done, paragraph[at:]]
    return b"".join(out)


@F.pandas_udf(T.BinaryType())
def _masked(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else masked(bytes(t)))


def mask(text: Column) -> Column:
    return _masked(text.cast("binary"))
