"""The structural rules, as Columns over a comment's text and the names of the code under it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import prose as P

REASONS = {
    "leftover": "code that was commented out; remove it or bring it back",
    "echo": "repeats the line below in words; say what the line cannot",
    "tautology": "repeats the line below in words; say what the line cannot",
    "compat": "explains its own history; that belongs to the change, not to the code",
    "hollow": "documentation that adds nothing past its first sentence",
    "phrase": "explains its own history; that belongs to the change, not to the code",
}


def echoes(text: Column, names: Column, sentences: Column | None = None) -> Column:
    """One sentence, of at least two words that carry it, half of which (counting repeats) the line spells itself. sentences says
    how many there are, if that is known."""

    def by(words: Column) -> Column:
        hits = P.let(names, lambda n: F.size(F.filter(words, lambda w: F.array_contains(n, w))))
        return (F.size(words) >= 2) & (hits * 2 >= F.size(words))

    return ((P.sentences(text) if sentences is None else sentences) <= 1) & P.let(P.content(text), by)


def restates(text: Column, names: Column, buried: Column, last: Column) -> Column:
    """One sentence of at least two words, over the last line of a body or sharing a word with its line."""

    def by(words: Column) -> Column:
        return (F.size(words) >= 2) & ((buried & last) | F.arrays_overlap(words, names))

    return (P.sentences(text) <= 1) & P.let(P.content(text), by)


def hollow_score(found: Column, sentences: Column) -> Column:
    """By how many of the sentences are hollow."""
    return 0.4 + 0.3 * found / sentences


def inspect(leftover: Column, echo: Column, hollow: Column, sentences: Column) -> Column:
    """The first rule that fires, as a struct of class and score; null if none does. hollow is the array of sentences."""
    verdict = lambda name, score: F.struct(F.lit(name).alias("class"), score.cast("double").alias("score"))
    found = F.when(leftover, verdict("leftover", F.lit(1.0))).when(echo, verdict("echo", F.lit(0.95)))
    padded = P.let(F.size(hollow), lambda n: F.when(n >= 2, verdict("hollow", hollow_score(n, sentences))))
    return found.otherwise(padded)
