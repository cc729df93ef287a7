"""Prose with marks between its words is no JavaScript, whatever assignment it quotes."""

import pytest

from marginalia.operators import leftover as LO

PROSE = [
    '4734663219866878$$$ token = "40d78a45"### La%%% de.### 126.57.31.34%%%',
    'Shti*** ntre*** and&&& with*** in%%% ron&&& token = "4efe2d42"### ed%%% tion&&&',
    "one | two | three. | four | key = five | six.",
    "thirty%%% = forty",
    "a = b ### c",
    "7$ = price",
]
CODE = [
    "a === b ? c() : d();", "x ??= y?.z?.[0] ?? w;", "const f = async (...xs) => xs.length ** 2;", "this.#count += 1;", "class A { #n = 1; static #m = 2; }",
    's.replace(/[|=]+/g, "-");', "$el.value = `${a}|${b}`;", "for (let i = 0; i < n; i++) { t[i] = -i * 2; }", "a.b = !c && !!d || ~e;", "const {a, ...rest} = o;", "x = y\n  .map(f)\n  .filter(g);",
]


@pytest.mark.parametrize("body", PROSE)
def test_prose(body):
    assert LO.recognise("javascript", body) is False


@pytest.mark.parametrize("body", CODE)
def test_code(body):
    assert LO.recognise("javascript", body) is True
    assert LO.recognise("typescript", body) is True
