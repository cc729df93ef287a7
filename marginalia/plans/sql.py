"""The prose functions once more, as DuckDB SQL expressions, for the oracles."""

from __future__ import annotations

import re

from marginalia.functions import lexicon as L
from marginalia.functions.prose import SPACE, any_of


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def among(words: list[str]) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def let(value: str, body) -> str:
    """body(name) with name bound to value."""
    let.n += 1
    name = f"v{let.n}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


let.n = 0


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(rf'\A[{SPACE}]+|[{SPACE}]+\z')}, '', 'g')"


def fields(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(f'[{SPACE}]+')}), lambda w: w <> '')"


def rlike(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def drop(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, '')"


def strip(x: str) -> str:
    out = trim(drop(trim(x), rf"\A{any_of(L.MARKERS)}"))
    for c in L.CLOSERS:
        out = drop(out, rf"{re.escape(c)}\z")
    return trim(out)


def indented(x: str) -> str:
    return drop(drop(drop(drop(x, r"\A[ \t]+"), rf"\A{any_of(L.MARKERS)} ?"), r"[ \t]+\z"), r"\*/\z")


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def notice(x: str) -> str:
    return f"len(list_filter({lines(x)}, lambda x: {rlike(f'lower({trim('x')})', rf'\A{any_of(L.NOTICES)}')})) > 0"


def directive(x: str) -> str:
    bare = drop(trim(x), r"\A[/*#\-! \t]+")
    json = f"(starts_with({bare}, '{{') and ends_with({drop(bare, r'[ \t]+\z')}, '}}'))"
    return f"(starts_with({trim(x)}, '#!') or {json} or {rlike(f'lower({bare})', rf'\A{any_of(L.DIRECTIVES)}')})"


def normalize(x: str) -> str:
    words = f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), '\\A | \\z', '', 'g')"
    return f"(case when {words} = '' then ' ' else ' ' || {words} || ' ' end)"


def terminates(word: str, after: str) -> str:
    shorn = drop(word, r"[\"')\]`]+\z")
    core = drop(shorn, r"[.!?]+\z")
    number = f"({rlike(core, r'\A[0-9.vV]+\z')} and {rlike(core, '[0-9]')})"
    return f"({rlike(shorn, r'[.!?]\z')} and not {rlike(core, r'\A[A-Z]\z')} and lower({core}) not in {among(L.ABBREVIATIONS)} and not {number} and ({after} is null or not {rlike(after, r'\A[a-z]')}))"


def ends(f: str) -> str:
    """Places (from 1) of the fields that end a sentence."""
    return f"list_filter(range(1, len({f}) + 1), lambda i: {terminates(f'{f}[i]', f'{f}[i + 1]')})"


def sentences(x: str) -> str:
    return let(fields(x), lambda f: f"len({ends(f)})")


def split(x: str) -> str:
    def cut(f: str) -> str:
        return let(
            ends(f),
            lambda e: f"list_filter(list_transform(range(1, len({e}) + 2), lambda k: array_to_string({f}[coalesce({e}[k - 1], 0) + 1 : coalesce({e}[k], len({f}))], ' ')), lambda p: p <> '')",
        )

    return let(fields(x), cut)


def code(x: str) -> str:
    first = f"regexp_replace(lower({fields(x)}[1]), '\\A[(:]+|[(:]+\\z', '', 'g')"
    return f"({rlike(x, '[={};]')} or coalesce({first} in {among(L.KEYWORDS)}, false))"


def stem(x: str) -> str:
    return drop(x, r"s\z")


def content(x: str) -> str:
    words = f"list_filter(string_split({normalize(x)}, ' '), lambda w: len(w) >= 3 and w not in {among(L.STOP)})"
    return f"list_transform({words}, lambda w: {stem('w')})"


def pieces(x: str) -> str:
    spaced = f"regexp_replace({x}, '(\\p{{Lu}})', ' \\1', 'g')"
    return f"list_filter(regexp_split_to_array(lower({spaced}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '')"


def spelled(x: str) -> str:
    return f"list_distinct(list_transform({pieces(x)}, lambda w: {stem('w')}))"


def structured(x: str) -> str:
    return f"({rlike(trim(x), rf'\A{any_of(L.OPENERS)}')} or {rlike(trim(x), any_of(L.TAGS))})"


def eliminates(x: str, names: str) -> str:
    return f"(contains({x}, 'O(') or len(list_filter(string_split({normalize(x)}, ' '), lambda w: w in {among(L.ELIMINATORS)} and not list_contains({names}, {stem('w')}))) > 0)"


def compat(x: str) -> str:
    return rlike(normalize(x), f" {any_of(L.COMPAT)} ")


def site_key(x: str) -> str:
    chars = f"list_transform(string_split({normalize(x)}, ''), lambda c: ascii(c)::hugeint)"
    step = "((h - h % 4294967296 + xor((h % 4294967296)::bigint, b::bigint)::hugeint) * 1099511628211) % 18446744073709551616"
    return f"list_reduce({chars}, lambda h, b: {step}, 14695981039346656037::hugeint)"
