"""A file as large as the scanner takes any, of statements with comments between: seconds, not minutes."""

import time

import pytest

from marginalia.sources import scan

SIZE = 2 << 20
PIECES = {
    "python": b"class A%d:\n    # says what f does\n    def f(self, a):\n        # adds a to it\n        return self.b + a\n\n",
    "go": b"// F%d closes it.\nfunc F(a int) int {\n\t// adds one\n\treturn a + 1\n}\n\n",
    "yaml": b"# about it\nkey%d:\n  # inner\n  a: 1\n",
    "rust": b"    /// field\n    pub f%d: u64,\n",
    "c": b"/* c */ x%d; ",
    "bash": b"x%d=1 # c\n",
}


def file_of(language, size=SIZE):
    piece = PIECES[language]
    body = b"".join(piece % i for i in range(size // (len(piece) + 4)))
    return b"pub struct S {\n" + body + b"}\n" if language == "rust" else body


@pytest.mark.parametrize("language", sorted(PIECES))
def test_a_large_file_takes_seconds(language):
    content = file_of(language)
    began = time.time()
    found = scan.nodes_of(content, language)
    assert time.time() - began < 15 and len(found) > 20_000


def test_comments_of_nested_blocks():
    content = b"func a() {\n// c\n" * 20_000 + b"}\n" * 20_000
    began = time.time()
    assert all(x["buried"] for x in scan.nodes_of(content, "go"))
    assert time.time() - began < 15


@pytest.mark.parametrize("language", sorted(PIECES))
def test_places_and_columns(language):
    """Offsets and columns against plain counting."""
    content = file_of(language, 3000) + "é # ß // ß\n".encode()
    for x in scan.nodes_of(content, language):
        raw = content[x["start"] : x["end"]]
        assert raw.decode("utf-8", "replace") == x["raw"]
        line = content.rfind(b"\n", 0, x["start"]) + 1
        assert (x["row"], x["col"]) == (content.count(b"\n", 0, x["start"]), x["start"] - line)
        assert x["trailing"] == bool(content[line : x["start"]].strip())
        assert (x["end_row"], x["end_col"]) == (content.count(b"\n", 0, x["end"]), x["end"] - content.rfind(b"\n", 0, x["end"]) - 1)
