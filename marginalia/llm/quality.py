"""Quality rules: fixed base rules, then boosted trees over document statistics with monotone constraints."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import gbt
from marginalia.llm.common import sliced, unlike

#: Labelled rows that the model is fitted on at most: those of least hash, so a bounded sample that any run draws alike.
MAX_LABELLED = 20_000
#: The verdict: kept if the trees give at least this probability of quality 1.
KEEP = 0.5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "capitals", "shouts", "digits", "distinct", "line_words", "ends", "log_lines", "top_word"]
#: More of these never makes a document better; a larger share of distinct words never makes it worse.
MONOTONE = {FEATURES.index("symbols"): -1, FEATURES.index("dup_lines"): -1, FEATURES.index("repeats"): -1, FEATURES.index("capitals"): -1, FEATURES.index("shouts"): -1, FEATURES.index("top_word"): -1, FEATURES.index("distinct"): 1}

_UPPER, _LETTER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789"


def _count(b: bytes, chars: bytes) -> int:
    return len(b) - len(b.translate(None, chars))


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics and the features of a whole text; a null text has no words and no lines."""
    text = text or ""
    b = text.encode("utf-8", "replace")
    words = b.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = _count(b, b"#*$%&|<>")
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n >= 3:
        grams = Counter(zip(words, words[1:], words[2:]))
        if len(grams) < n - 2:
            seen = bytearray(n)
            for i, gram in enumerate(zip(words, words[1:], words[2:])):
                if grams[gram] > 1:
                    seen[i : i + 3] = b"\1\1\1"
            repeated = sum(seen)
    base = [n, word_chars, symbols, dup_lines, repeated]
    w, k = max(n, 1), max(len(lines), 1)
    counts = Counter(words)
    features = [
        math.log1p(n), word_chars / w, symbols / w, dup_lines / k, repeated / w, _count(b, _UPPER) / max(_count(b, _LETTER), 1), _count(b, b"!?") / w, _count(b, _DIGIT) / max(word_chars, 1),
        len(counts) / w, n / k, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, math.log1p(len(lines)), max(counts.values(), default=0) / w,
    ]
    return base, features


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, also=None) -> DataFrame:
    """text, y and draw (a hash that splits the sample) of at most `most` labelled rows: those of least hash of doc_id.

    Only the bounded sample of labels is broadcast. Null labels and ids take no part; a label row that is repeated counts
    as often as it is there.
    """
    rows = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).filter("__id is not null and y is not null")
    if also is not None:
        rows = rows.filter(also(F.col("__id")))
    few = rows.withColumn("draw", F.xxhash64("__id", F.lit(17))).orderBy("draw").limit(most)
    own = docs.select(F.col("doc_id").alias("__doc"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(few), F.col("__doc") == F.col("__id")).select("text", "y", "draw")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> gbt.Trees:
    """Trees for labels.quality over the statistics of at most `most` labelled documents."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            made = [statistics(t)[1] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = labelled_sample(docs, labels, "quality", most).select("text", "y").mapInArrow(run, "x array<double>, y int").collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return gbt.fit(x, np.array([float(r.y) for r in rows]), MONOTONE, trees=50)


def judge(docs: DataFrame, model: gbt.Trees, keep: list[str], threshold: float = KEEP) -> DataFrame:
    """keep, the base statistics, base_failed, kept and quality (the trees' probability) for every row.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. kept: false if base_failed,
    else the trees' verdict. Null and empty texts have no words, so they fail; equal rows stay as many rows; other columns
    play no part; an empty table gives an empty one. One pass without a shuffle.
    """

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            found = [statistics(t) for t in batch.column(len(keep)).to_pylist()]
            base = np.array([f[0] for f in found], dtype=np.int64).reshape(len(found), len(BASE))
            good = model.probability(np.array([f[1] for f in found]).reshape(len(found), len(FEATURES)))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            columns = [*batch.columns[: len(keep)], *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(~failed & (good >= threshold)), pa.array(good)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *BASE, "base_failed", "kept", "quality"])

    own = docs.select(*[docs[c] for c in keep], docs["text"].cast("string").alias(unlike(keep, "__text")))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in BASE), "base_failed boolean, kept boolean, quality double"])
    return own.mapInArrow(run, schema)
