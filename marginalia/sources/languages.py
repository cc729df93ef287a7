"""Which language a path is read as: a broadcast dimension, and the precedence of its lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: extensions, how its leftovers are judged, whether it has functions, is templated, has docstrings.
LANGUAGES = {
    "bash": ("bash sh", None, True),
    "c": ("c h", "strict", True),
    "c++": ("cc cpp cxx hh hpp", "strict", True),
    "dockerfile": ("", "evidence", False),
    "go": ("go", "legal", True),
    "hcl": ("hcl tf tfvars", "strict", False),
    "java": ("java", "strict", True),
    "javascript": ("cjs js jsx mjs", "strict", True),
    "make": ("mk", None, False),
    "php": ("php", "strict", True),
    "python": ("py pyi", "evidence", True),
    "ruby": ("rb", None, True),
    "rust": ("rs", "strict", True),
    "tsx": ("tsx", "strict", True),
    "typescript": ("cts mts ts", "strict", True),
    "yaml": ("gotmpl j2 tftpl tpl yaml yml", "evidence", False),
}
BY_EXTENSION = {e: name for name, (exts, _, _) in LANGUAGES.items() for e in exts.split()}
BY_NAME = {"Containerfile": "dockerfile", "Dockerfile": "dockerfile", "GNUmakefile": "make", "Makefile": "make", "makefile": "make"}
#: The order in which qualified names are tried.
QUALIFIED = ["Dockerfile", "Containerfile", "Makefile", "makefile", "GNUmakefile"]
FOREIGN = sorted("adoc csv htm html json lock markdown md pdf png rst sum svg txt xml".split())


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def language(path: Column) -> Column:
    """The language of a path, or null: by its whole name, its extension, never for foreign formats, by a qualified name."""
    name = F.element_at(F.split(F.regexp_replace(path, r"(?<=.)/+\z", ""), "/"), -1)
    dotted = F.regexp_extract(name, r"\.([^.]*)\z", 1)
    extension = F.when(name.contains("."), F.lower(dotted)).otherwise("")
    out = F.coalesce(_map(BY_NAME, name), _map(BY_EXTENSION, extension))
    qualified = F.lit(None).cast("string")
    for q in reversed(QUALIFIED):
        qualified = F.when(name.startswith(q + ".") | name.endswith("." + q), BY_NAME[q]).otherwise(qualified)
    return F.coalesce(out, F.when(~extension.isin(FOREIGN), qualified))
