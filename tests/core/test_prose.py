"""Prose functions on lines of our own, one DataFrame for each function."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import prose as P

FNV, PRIME = 0xCBF29CE484222325, 0x100000001B3


def apply(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


TABLE = {
    "strip": [("// hello", "hello"), ("  /// deep", "deep"), ("//! inner", "inner"), ("/* block */", "block"), (" * item", "item"), ('"""doc"""', "doc"), ("r'''raw'''", "raw"), ("# - dash", "- dash"), ("--sql", "sql"), ("plain", "plain"), (" # nbsp ", "nbsp"), ("", "")],
    "indented": [("//   x = 1", "  x = 1"), ("\t# y", "y"), ("#\tz", "\tz"), ("/* a */", "a "), ("plain ", "plain")],
    "dedent": [("  a\n    b\n", "a\n  b\n"), ("a\n  b", "a\n  b"), ("\tx\n\n\ty", "x\n\ny"), ("", ""), ("   \n  a", " \na")],
    "notice": [("Copyright 2020", True), ("one\n  SPDX-License-Identifier: X", True), ("the copyright year", False), ("", False)],
    "directive": [("#!/bin/sh", True), ("//go:build x", True), ("# noqa", True), ('# {"a": 1}', True), ("// NOLINT", True), ("# a note", False), ("/* eslint-disable */", True), ("# https://x.y", True)],
    "normalize": [("Hello, World!", " hello world "), ("", " "), ("--", " "), ("a1-b2", " a1 b2 ")],
    "sentences": [("One. Two.", 2), ("e.g. this", 0), ("See v1.2. Then go", 0), ("J. Smith wrote it.", 1), ("What? no", 0), ('He said "stop." Then left.', 2), ("no end", 0), ("", 0)],
    "split": [("One. Two", ["One.", "Two"]), ("a  b.\nC d!", ["a b.", "C d!"]), ("", []), ("etc. and so on.", ["etc. and so on."])],
    "code": [("x = 1", True), ("return early", True), ("the end", False), ("(if true", True), ("done;", True), ("", False)],
    "content": [("the items of lists", ["item", "list"]), ("a an if", []), ("class pass", ["clas", "pas"])],
    "pieces": [("HTTPServer", ["h", "t", "t", "p", "server"]), ("snake_case2x", ["snake", "case2x"]), ("lowerCamel", ["lower", "camel"]), ("", [])],
    "structured": [("@param x", True), ("- item", True), ("see :returns: y", True), ("plain words", False)],
    "compat": [("Kept for old users.", True), ("for compatibility", True), ("compatible", False), ("backwards-compatibility here", True)],
}


@pytest.mark.parametrize("name", sorted(TABLE))
def test_functions(spark, name):
    texts, want = zip(*TABLE[name])
    assert apply(spark, getattr(P, name), texts) == list(want)


def test_split_is_sentences_or_one_more(spark):
    texts = ["One. Two. three", "A b. C", "no", "End."]
    ended, pieces = apply(spark, P.sentences, texts), apply(spark, lambda t: F.size(P.split(t)), texts)
    assert all(p - e in (0, 1) for e, p in zip(ended, pieces))


def test_site_key_is_fnv1a(spark):
    texts = ["Hello world", "", "a" * 50, "hello, WORLD"]

    def fnv(text):
        h = FNV
        for b in text.encode():
            h = (h ^ b) * PRIME % 2**64
        return h

    norms = apply(spark, P.normalize, texts)
    assert [int(x) for x in apply(spark, P.site_key, texts)] == [fnv(n) for n in norms]


def test_eliminates(spark):
    names = P.spelled(F.lit("func MustRun"))
    assert apply(spark, lambda t: P.eliminates(t, names), ["it must hold", "never null", "costs O(n)", "plain"]) == [False, True, True, False]


def test_hollow_needs_two(spark):
    names = P.spelled(F.lit("func ParseValue(data)"))
    texts = ["Parses. The design is simple and easy. Parse the value data here.", "Parses. The design is simple and easy. It rejects commas.", "Parses the value data."]
    found = apply(spark, lambda t: F.transform(P.hollow_sentences(P.split(t), names), lambda x: x["why"]), texts)
    assert found == [["assessment", "echo"], [], []]
