"""The recognisers of commented-out code, on bodies of our own."""

import pytest

from marginalia.operators import leftover as LO


@pytest.mark.parametrize(("body", "want"), [("f(", ")"), ("a{b[", "]}"), ('say("(")', ""), ("`{`", ""), ("x)", ""), ("(]", ")"), ('"\\"("(', ")")])
def test_balance(body, want):
    assert LO.balance(body) == want


CASES = [
    ("python", "x = 1", True),
    ("python", "total += 2", True),
    ("python", "import os", True),
    ("python", "return", True),
    ("python", "run(fast)", True),
    ("python", "for x in y:\n    pass", True),
    ("python", "the value is not set", False),
    ("python", "ready", False),
    ("python", "a < b", False),
    ("python", "a = b", False),
    ("python", "DEBUG=False in production", False),
    ("dockerfile", "RUN apt-get update", True),
    ("dockerfile", "run this before the build", False),
    ("dockerfile", "NOTE keep the order", False),
    ("yaml", "replicas: 3", True),
    ("yaml", "spec:\n  replicas: 3", True),
    ("yaml", "- one\n- two", True),
    ("yaml", "Note: this holds", False),
    ("yaml", "the default: keep it small", False),
    ("yaml", "plain words", False),
    ("go", "x := 1", True),
    ("go", "fmt.Println(x)", True),
    ("go", "if err != nil {\n\treturn err\n}", True),
    ("go", "for i := 0; i < 3; i++ {", True),
    ("go", "<-done", True),
    ("go", "ch <- v", True),
    ("go", "count++", True),
    ("go", "a, b = b, a", True),
    ("go", "return nil", True),
    ("go", "len(x)", False),
    ("go", "string(b)", False),
    ("go", "x", False),
    ("go", "x == y", False),
    ("go", "package main", False),
    ("go", "f() = 1", False),
    ("go", "the next call wins", False),
    ("go", "return early when the list is empty", False),
    ("go", "note: this", False),
    ("javascript", "const a = b;", True),
    ("javascript", "call(a, b);", True),
    ("javascript", "if the list = empty then stop", False),
    ("c", "int x = 1;", True),
    ("c", "return the size;", False),
    ("java", "foo.bar(baz);", True),
    ("rust", "let x = y;", True),
    ("bash", "x=1", False),
    ("ruby", "x = 1", False),
    ("make", "X = 1", False),
    ("unknown", "x = 1", False),
]


@pytest.mark.parametrize(("language", "body", "want"), CASES)
def test_recognise(language, body, want):
    assert LO.recognise(language, body) is want


def test_empty_value_above_makes_an_example():
    assert LO.recognise("yaml", "key: 1", "values: {}", 2) is False
    assert LO.recognise("yaml", "key: 1", "values: {}", 0) is True
    assert LO.recognise("yaml", "key: 1", "values: {a: 1}", 2) is True


def test_long_bodies_are_left_alone():
    assert LO.recognise("python", "x = 1\n" * 4000) is False
