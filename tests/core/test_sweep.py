"""Source files of our own through the whole sweep."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import attribution as A
from marginalia.operators import audit
from marginalia.sources import scan as S
from marginalia.sources import templates
from marginalia.sources.languages import language

FILES = {
    "a.py": '''"""Module words."""
import os


def total(items):
    """Totals. The design is simple and easy to use. It totals the given items value."""

    # x = compute(1)
    y = 1
    # return the items total
    return items_total
''',
    "b.go": """// Copyright 2020 Someone
// x := 1

package b

// Close the thing.
func Close() {
\t// fmt.Println(x)
\tcloseThing() // trailing note
\tx := `// not one`
}
""",
    "c.yaml": "# replicas: 3\nspec:\n  a: {{ x # y }}\n  b: 2\n",
    "d.js": "/* block\n * of two */\nexport function f() {\n  // call(a, b);\n  g('// no');\n}\n// kept for old callers\n",
    "e.rs": "/* outer /* inner */ still */\nfn f() { let s = r#\"// no\"#; } // yes\n",
    "f.sh": 'echo "# no" # yes\ncat <<EOF\n# no\nEOF\n',
    "Dockerfile": "FROM x\n# RUN apt update\nRUN y\n",
    "skip.md": "# heading\n",
    "broken.py": "def f(:\n# still seen\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("src")
    (out / ".git").mkdir()
    (out / ".git" / "x.py").write_text("# x = 1\n")
    for name, text in FILES.items():
        (out / name).write_text(text)
    return str(out)


def test_nodes(spark, folder):
    found = S.scan(audit.files(spark, folder)).collect()
    raw = {}
    for r in found:
        assert r.error is None
        name = r.path.rpartition("/")[2]
        content = FILES[name].encode()
        assert content[r.start : r.end].decode() == r.raw or name == "c.yaml"
        raw.setdefault(name, []).append(r.raw)
    assert raw["b.go"] == ["// Copyright 2020 Someone", "// x := 1", "// Close the thing.", "// fmt.Println(x)", "// trailing note"]
    assert raw["e.rs"] == ["/* outer /* inner */ still */", "// yes"] and raw["f.sh"] == ["# yes"] and raw["c.yaml"] == ["# replicas: 3"]
    assert raw["d.js"] == ["/* block\n * of two */", "// call(a, b);", "// kept for old callers"] and raw["broken.py"] == ["# still seen"] and "skip.md" not in raw
    by = {r.raw: r for r in found}
    assert by["// fmt.Println(x)"].buried and not by["// Close the thing."].buried and by["// trailing note"].trailing
    assert by["// Close the thing."].under.kind == "definition" and by['"""Module words."""'].docstring


def test_findings(spark, folder):
    found = {(r.path.rpartition("/")[2], r.line): r["class"] for r in audit.sweep(spark, folder).collect()}
    assert found == {
        ("a.py", 6): "hollow", ("a.py", 8): "leftover", ("a.py", 10): "echo", ("b.go", 8): "leftover", ("c.yaml", 1): "leftover", ("d.js", 4): "leftover", ("d.js", 7): "phrase",
        ("Dockerfile", 2): "leftover",
    }


def test_spans_narrow_a_sweep(spark, folder):
    nodes = S.scan(audit.files(spark, folder)).filter(F.col("path").endswith("b.go"))
    at = FILES["b.go"].index("fmt")
    spans = nodes.select("path").distinct().withColumns({"start": F.lit(at), "end": F.lit(at + 1)})
    assert [r.line for r in audit.comments(nodes, spans).collect()] == [8]


def test_offsets_are_bytes():
    found = S.nodes_of("é = 'ü' # ß\n".encode(), "python")
    assert [(x["start"], x["end"], x["col"]) for x in found] == [(10, 14, 10)]


def test_scanner_is_linear_enough():
    import time

    began = time.time()
    S.nodes_of(b"# a line of words\n" * 40000, "yaml")
    S.nodes_of(("{" * 16000 + "}" * 16000).encode(), "go")
    assert time.time() - began < 20


@pytest.mark.parametrize(
    ("text", "want"),
    [(b"a {{ x }} b", b"a         b"), (b"{{ a\nb }}", b"    \n    "), (b"{{ a\n\nb }} {{ c }}", b"{{ a\n\nb }}        "), (b"{{ x\n{{ y }}", b"    \n       "), (b"none", b"none")],
)
def test_mask(text, want):
    assert templates.masked(text) == want and len(want) == len(text)


@pytest.mark.parametrize(("old", "new", "want"), [(b"abc", b"abXc", (2, 1)), (b"", b"x", (0, 0)), (b"aa", b"aaa", (2, 0)), (b"same", b"same", (4, 0)), ("é".encode(), "è".encode(), (1, 0))])
def test_shared(old, new, want):
    assert A.shared_bytes(old, new) == want


def test_written():
    assert A.written_spans(b"x one y one", [(b"on", b"one")]) == [(4, 5), (10, 11)]
    assert A.written_spans(b"abc", [(b"abc", b"abc"), (b"x", b"")]) == []
    assert len(A.locate_bytes(b"a" * 100, b"a")) == 64


def test_languages(spark):
    want = {"x/main.go": "go", "A.PY": "python", "Dockerfile.dev": "dockerfile", "api.Dockerfile": "dockerfile", "Makefile.md": None, "_h.tpl": "yaml", "noext": None, ".bashrc": None, "Makefile.local": "make", "a.d.ts": "typescript"}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.v for r in df.select("p", language(F.col("p")).alias("v")).collect()} == want
