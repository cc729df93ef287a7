"""Toxicity: boosted trees over dense features of a whole text, calibrated by isotonic regression.

The lexicon has two parts: insults of common use, and words and word beginnings that labelled toxic documents have far
more often than other ones, so it follows whatever languages the labels cover. It is learned on two halves of the sample:
trees and calibration see each document through the lexicon of the other half, and new documents that of both. The
calibration reads each document by trees that were fitted without it; the model's own trees are fitted to all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm import gbt
from marginalia.llm.common import freeze, sliced
from marginalia.llm.quality import labelled_sample

#: Labelled rows that are learned from at most: those of least hash.
MAX_LABELLED = 20_000
#: Parts of the sample, each of which is read for the calibration by trees of the others.
FOLDS = 4
#: A term is taken if it is so many times as frequent in toxic documents as in others.
LIFT = 8.0

COMMON = frozenset(
    "idiot idiots idiotic moron morons moronic stupid loser losers pathetic scum worthless trash clown clowns disgusting dumb dumbass jerk imbecile fool "
    "ugly filth filthy garbage bastard bitch asshole shit fuck fucking crap whore slut retard vermin cretin freak lowlife parasite degenerate "
    "idiota imbécil estúpido estúpida basura asqueroso imbécile crétin débile abruti ordure connard salope merde dummkopf abschaum arschloch scheiße trottel widerlich"
    .split()
)
_SECOND = re.compile(r"(?<!\w)(?:you|your|yours|yourself|u|ur|du|dich|dir|dein|deine|ihr|euch|tu|te|toi|ton|ta|vous|votre|tú|ti|tus|usted|ustedes)(?!\w)")
_LEET = str.maketrans("013457@$!|8", "oieastasiib", "*.-_ ")
_HIDDEN = re.compile(r"(?<=[a-z])[0134578@$*!|]+(?=[a-z])")
_TOKEN = re.compile(r"[a-z0134578@$*!|]+")
_SPACED = re.compile(r"(?<!\w)[a-z](?:[ .\-_*][a-z]){3,}(?!\w)")
_LETTERS = re.compile(r"[^\W\d_]+")

FEATURES = ["common", "log_common", "words", "log_words", "starts", "log_starts", "near_you", "capitals", "exclaims", "asks", "marks", "hidden", "hidden_hits", "length"]
MONOTONE = {FEATURES.index(x): 1 for x in ("common", "log_common", "words", "log_words", "starts", "log_starts", "near_you", "hidden_hits")}
_UPPER, _LETTER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"\"'()*,-./:;<=>@[\\]^_`{|}~#$%&+"


def terms(text: str) -> set[str]:
    """The words of a text in lower case, and their beginnings of 4 to 6 letters, marked by a star."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in (4, 5, 6) if len(w) > k}


@dataclass
class Lexicon:
    """Matches all its terms at once: an automaton reads the text once and names only what it finds."""

    learned: list[str]
    _made: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"learned": self.learned, "_made": None}

    def automaton(self):
        if self._made is None:
            import ahocorasick

            own = ahocorasick.Automaton()
            kinds: dict[str, int] = dict.fromkeys(COMMON, 1)
            for t in self.learned:
                word, kind = (t[:-1], 4) if t.endswith("*") else (t, 2)
                kinds[word] = kinds.get(word, 0) | kind
            for word, kind in kinds.items():
                own.add_word(word, (len(word), kind))
            own.make_automaton()
            self._made = own
        return self._made

    def features(self, text: str | None) -> list[float]:
        """The features of a whole text; a null one is empty."""
        text = text or ""
        b = text.encode("utf-8", "replace")
        n, low = len(b.split()), text.lower()
        w, end = max(n, 1), len(low)
        common = words = starts = near = 0
        for at, (size, kind) in self.automaton().iter(low):
            first = at - size + 1
            if first and low[first - 1].isalpha():
                continue
            inside = at + 1 < end and low[at + 1].isalpha()
            if inside:
                kind &= 4
            if kind:
                common += kind & 1
                words += kind >> 1 & 1
                starts += kind >> 2 & 1
                near += _SECOND.search(low, max(0, first - 40), min(end, at + 40)) is not None
        hidden = hidden_hits = 0
        if _HIDDEN.search(low):
            for token in _TOKEN.findall(low):
                if _HIDDEN.search(token):
                    hidden += 1
                    hidden_hits += any(t.translate(_LEET) in COMMON for t in (token, token.rstrip("!|*"), token.strip("0134578@$*!|")))
        for m in _SPACED.finditer(low):
            hidden += 1
            hidden_hits += m.group().translate(_LEET) in COMMON
        count = lambda chars: len(b) - len(b.translate(None, chars))
        hits = common + words + starts
        return [
            common / w, math.log1p(common), words / w, math.log1p(words), starts / w, math.log1p(starts), near / max(hits, 1), count(_UPPER) / max(count(_LETTER), 1),
            count(b"!") / w, count(b"?") / w, count(_MARKS) / w, hidden / w, math.log1p(hidden_hits), math.log1p(n),
        ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: gbt.Trees
    calibration: gbt.Isotonic

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return self.calibration(self.trees.margin(x))


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5: rows where it is 0 are held out, never learned from. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _learn_terms(sample: DataFrame) -> list[list[str]]:
    """The terms learned without the first half, without the second half, and from both. A term is one that at least 3 and one
    in 500 of the toxic documents have, so a sample of bounded texts has a bounded number of them."""

    def counts(batches, known: frozenset | None):
        import pyarrow as pa

        found: Counter = Counter()
        for batch in sliced(batches):
            for t, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = terms(t or "")
                found.update((x, half) for x in (mine if known is None else mine & known))
        keys = list(found)
        columns = [pa.array([t for t, _ in keys], pa.string()), pa.array([h for _, h in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "half", "n"])

    def table(of: int, known: frozenset | None):
        made = sample.filter(F.col("y") == of).select("text", "half").mapInArrow(lambda it: counts(it, known), "term string, half int, n long")
        by_half = [F.coalesce(F.sum(F.when(F.col("half") == h, F.col("n"))), F.lit(0)).alias(f"n{h}") for h in (0, 1)]
        return made.groupBy("term").agg(*by_half, F.sum("n").alias("n"))

    sizes = {(r.y, r.half): r.n for r in sample.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    every = sum(n for (y, _), n in sizes.items() if y == 1)
    often = {r.term: (r.n1, r.n0, r.n) for r in table(1, None).filter(F.col("n") >= max(3, int(0.002 * every))).collect()}
    other = {r.term: (r.n1, r.n0, r.n) for r in table(0, frozenset(often)).collect()}
    out = []
    for k, halves in enumerate([(1,), (0,), (0, 1)]):
        toxic, clean = (sum(sizes.get((y, h), 0) for h in halves) for y in (1, 0))
        if not toxic or not clean:
            out.append([])
            continue
        lift = {t: (n[k] + 0.5) / (toxic + 1) / ((other.get(t, (0, 0, 0))[k] + 0.5) / (clean + 1)) for t, n in often.items() if n[k] >= max(2, int(0.002 * toxic))}
        out.append(sorted(t for t in lift if lift[t] >= LIFT))
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model of labels.toxic, from at most `most` labelled documents whose remainder is not 0. Without labels of both
    kinds it is a constant, their mean, or 0 without any."""
    rows = labelled_sample(docs, labels, "toxic", most, lambda i: remainder(i) != 0)
    sample = freeze(rows.withColumn("half", F.pmod("draw", F.lit(2)).cast("int")), "toxic-sample")
    lexicons = [Lexicon(t) for t in _learn_terms(sample)]

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            made = [lexicons[h].features(t) for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(2), batch.column(3)], names=["x", "y", "draw"])

    found = sample.select("text", "half", "y", "draw").mapInArrow(run, "x array<double>, y int, draw long").collect()
    x = np.array([r.x for r in found]).reshape(len(found), len(FEATURES))
    y = np.array([float(r.y) for r in found])
    trees = gbt.fit(x, y, MONOTONE)
    if not len(y) or y.min() == y.max():
        return Model(lexicons[2], trees, gbt.Isotonic(np.zeros(1), np.array([y.mean() if len(y) else 0.0])))
    fold, margin = np.array([r.draw // 2 % FOLDS for r in found]), np.empty(len(y))
    for f in range(FOLDS):
        margin[fold == f] = gbt.fit(x[fold != f], y[fold != f], MONOTONE).margin(x[fold == f])
    return Model(lexicons[2], trees, gbt.isotonic(margin, y))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep and score, the calibrated probability of toxicity, for every row.

    Only the text counts, all of it; null and empty texts get the score that a text without words gets; equal rows stay as
    many rows; other columns play no part; an empty table gives an empty one. One pass without a shuffle.
    """

    own = docs.select(*[docs[c] for c in keep], *([] if "text" in keep else [docs["text"]]))
    at = own.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            made = pa.array(model.score(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=[*keep, "score"])

    return own.mapInArrow(run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"]))
