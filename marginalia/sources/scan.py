"""Source files to comment nodes: a lexer for each family of languages, and what the rules need of the code around them.

No parse tree is kept. A node says where a comment lies, whether it is in a function or is a docstring, and what stands
under it: the kind of statement, whether it is one line, whether only comments follow it in its block, the words it spells,
and those of the declaration it documents. Offsets are bytes. A file that can't be read as its language gives what its
lexer finds; an error gives a row with the error's name and nothing else.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.sources.templates import masked

SCHEMA = (
    "path string, language string, row int, col int, end_row int, end_col int, start long, end long, raw string, buried boolean, docstring boolean, trailing boolean, "
    "blank_before boolean, under struct<kind:string,one_line:boolean,last:boolean,words:array<string>>, declared array<string>, above string, written boolean, error string"
)

HASH = {"bash", "dockerfile", "hcl", "make", "python", "ruby", "yaml"}
SLASH = {"c", "c++", "go", "hcl", "java", "javascript", "php", "rust", "tsx", "typescript"}
_FUNCTION = {
    "go": r"\bfunc\b", "rust": r"\bfn\b|\|[^|]*\|\s*$", "php": r"\bfunction\b|\bfn\b", "javascript": r"\bfunction\b|=>\s*$|^\s*(?:async\s+|static\s+|get\s+|set\s+)*[\w$#]+\s*\([^;]*\)\s*$",
    "c": r"\)\s*(?:const\s*)?$", "java": r"\)\s*(?:throws[\w\s,.]+)?$|->\s*$", "bash": r"\(\)\s*$|\bfunction\b",
}
_CONTROL = re.compile(r"\s*(?:\}\s*)?(?:else\s+)?(?:if|for|while|switch|catch|do|try|else|foreach|match|loop|select|synchronized)\b")
_DEFINES = re.compile(
    r"\s*(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|static|final|abstract|async|unsafe|const|inline|extern|virtual|override)\s+)*"
    r"(?:func|function\*?|fn|def|class|struct|enum|trait|impl|interface|type|module|const|let|var|record)\b"
)
_KEEPS = re.compile(r"\s*(?:pub\s+)?(?:type|struct|enum)\b")
_C_FUNCTION = re.compile(r"[A-Za-z_][\w\s*&<>:,~\[\]]*\([^;{}]*\)\s*(?:const\s*)?(?:throws[\w\s,.]+)?[{;]")
_INK = re.compile(r"[^ \t\r\n]")
_RAW_STRING, _CHARACTER = re.compile(r'b?r(#*)"'), re.compile(r"'(?:\\.[^'\n]*|[^'\\\n])'")
_HEREDOC = re.compile(r"<<[-~]?\s*['\"]?(\w+)['\"]?")


@dataclass
class Node:
    start: int
    end: int
    buried: bool = False
    docstring: bool = False
    under: dict | None = None
    declared: list[str] = field(default_factory=list)


def pieces(text: str) -> list[str]:
    """The words of identifiers: cut before each capital and at all but letters and digits."""
    out: list[str] = []
    for run in re.findall(r"[^\W_]+", text):
        word = ""
        for ch in run:
            if ch.isupper() and word:
                out.append(word)
                word = ""
            word += ch
        out.append(word)
    return [w.lower() for w in out if w]


def stem(word: str) -> str:
    return word[:-1] if word.endswith("s") else word


def spelled(text: str) -> list[str]:
    """What a declaration spells: the stemmed pieces of its names, and the names whole."""
    names = re.findall(r"\w+", text)
    return sorted({stem(w) for w in pieces(text)} | {stem(n.lower()) for n in names})


def _slash(src: str, language: str) -> tuple[list[Node], list[tuple[int, int]]]:
    """Comments of a language with // and /* */, and the spans of its strings."""
    nodes, strings, i, n = [], [], 0, len(src)
    hashes = language in ("php", "hcl")
    while i < n:
        ch, two = src[i], src[i : i + 2]
        if two == "//" or (ch == "#" and hashes and src[i : i + 2] != "#["):
            end = src.find("\n", i)
            end = n if end < 0 else end
            nodes.append(Node(i, end))
            i = end
        elif two == "/*":
            depth, j = 1, i + 2
            while j < n and depth:  # only Rust nests them
                if src.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                elif language == "rust" and src.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                else:
                    j += 1
            nodes.append(Node(i, j))
            i = j
        elif language == "rust" and ch in "br" and (m := _RAW_STRING.match(src, i)) and (i == 0 or not (src[i - 1].isalnum() or src[i - 1] == "_")):
            end = src.find('"' + m[1], m.end())
            strings.append((i, i := n if end < 0 else end + 1 + len(m[1])))
        elif ch == '"' or (ch == "`" and language in ("go", "javascript", "typescript", "tsx")) or (ch == "'" and language in ("javascript", "typescript", "tsx", "php")):
            j = i + 1
            while j < n and src[j] != ch and not (src[j] == "\n" and ch != "`" and language != "php"):
                j += 2 if src[j] == "\\" and not (ch == "`" and language == "go") else 1
            strings.append((i, i := min(n, j + 1)))
        elif ch == "'" and (m := _CHARACTER.match(src, i)):
            strings.append((i, i := m.end()))
        else:
            i += 1
    return nodes, strings


def _hashes(src: str, language: str) -> tuple[list[Node], list[tuple[int, int]]]:
    nodes, strings, at, heredoc = [], [], 0, None
    for line in src.split("\n"):
        if heredoc:
            strings.append((at, at + len(line)))
            heredoc = None if line.strip() == heredoc else heredoc
            at += len(line) + 1
            continue
        i, quote = 0, ""
        while i < len(line):
            ch = line[i]
            if quote:
                i += 1 if ch == "\\" and quote == '"' else 0
                quote = "" if ch == quote else quote
            elif ch in "\"'" and not (ch == "'" and language == "yaml" and i and line[i - 1].isalnum()):
                quote = ch
            elif ch == "#" and (not i or line[i - 1] in " \t;&|()" or language in ("make", "hcl")) and not (language == "dockerfile" and line[:i].strip()):
                nodes.append(Node(at + i, at + len(line.rstrip("\r"))))
                break
            elif ch == "<" and language in ("bash", "ruby", "hcl") and (m := _HEREDOC.match(line, i)):
                heredoc, i = m[1], m.end() - 1
            i += 1
        at += len(line) + 1
    return nodes, strings


def _python(src: str) -> list[Node]:
    """Comments by the tokenizer; docstrings, functions and statements by the grammar, where the file has one."""
    starts = [0]
    for line in src.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    nodes = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(src).readline):
            if t.type == tokenize.COMMENT:
                nodes.append(Node(starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        nodes = _hashes(src, "python")[0]
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError):
        return nodes
    lines = src.split("\n")
    place = lambda row, col: starts[row - 1] + (col if lines[row - 1].isascii() else len(lines[row - 1].encode()[:col].decode("utf-8", "ignore")))
    inside, statements = [], []

    def walk(node: ast.AST, buried: bool, owner: ast.AST | None) -> None:
        for _, value in ast.iter_fields(node):
            block = value if isinstance(value, list) else [value]
            for k, child in enumerate(block):
                if not isinstance(child, ast.AST):
                    continue
                function = isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda)
                if isinstance(child, ast.stmt):
                    first = min([child.lineno, *(d.lineno for d in getattr(child, "decorator_list", []))])
                    at = place(first, child.col_offset if first == child.lineno else child.col_offset)
                    statements.append((at, place(child.end_lineno, child.end_col_offset), child, k + 1 == len(block), first == child.end_lineno))
                    doc = k == 0 and isinstance(child, ast.Expr) and isinstance(child.value, ast.Constant) and isinstance(child.value.value, str)
                    if doc and value is getattr(node, "body", None):
                        made = Node(at, place(child.end_lineno, child.end_col_offset), buried, True)
                        made.declared = _signature(src, owner, place)
                        nodes.append(made)
                if function:
                    inside.append((place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)))
                if isinstance(child, ast.AST):
                    walk(child, buried or function, child if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) else owner)

    try:
        walk(tree, False, None)
    except RecursionError:
        return nodes
    under: dict[int, tuple] = {}
    for a, *rest in statements:
        under.setdefault(a, tuple(rest))
    buried = _covered(inside)
    for node in nodes:
        if not node.docstring:
            node.buried = buried(node.start)
        m = _INK.search(src, node.end)
        if m and m.start() in under:
            end, child, last, one = under[m.start()]
            defines = isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)
            node.under = {"kind": "definition" if defines else "statement", "one_line": one, "last": last, "words": _words(src[m.start() : end]) if one else []}
            if defines and not node.docstring:
                node.declared = _signature(src, child, place)
    return sorted(nodes, key=lambda x: x.start)


def _words(text: str) -> list[str]:
    """What a statement of one line spells; of longer ones no rule asks."""
    return sorted({stem(w) for w in pieces(text)})


def _covered(spans: list[tuple[int, int]]):
    """Whether a place lies inside one of the spans, by halving: of the spans that begin before it, the furthest end decides."""
    spans = sorted(spans)
    begins, furthest = [a for a, _ in spans], []
    for _, b in spans:
        furthest.append(max(b, furthest[-1]) if furthest else b)
    return lambda at: (k := bisect_left(begins, at)) > 0 and furthest[k - 1] > at


def _stops(code: str, ends_at_line: bool):
    """Where the statement that begins at a place ends. One walk over all brackets notes, for each of the nested levels, the
    places at which a statement of it ends: after a semicolon, at the end of a line where that counts, after a block that
    ends its line, before the bracket that closes the level."""
    stack, stops = [0], [([], [])]  # of each level: places, and the ends that they mean
    turns, levels = [0], [0]  # from which place on which level holds

    def stop(level: int, at: int, end: int) -> None:
        stops[level][0].append(at)
        stops[level][1].append(end)

    for m in re.finditer(r"[(\[{)\]};\n]" if ends_at_line else r"[(\[{)\]};]", code):
        ch, p = m[0], m.start()
        if ch in "([{":
            stack.append(len(stops))
            stops.append(([], []))
        elif ch in ")]}":
            stop(stack[-1], p, p)
            if len(stack) == 1:
                continue
            stack.pop()
            if ch == "}" and code[p + 1 : p + 2] in ("\n", ""):
                stop(stack[-1], p, p + 1)
        else:
            stop(stack[-1], p, p + (ch == ";"))
            continue
        turns.append(p + 1)
        levels.append(stack[-1])

    def end(at: int) -> int:
        places, ends = stops[levels[bisect_right(turns, at) - 1]]
        k = bisect_left(places, at)
        return ends[k] if k < len(ends) else len(code)

    return end


def _signature(src: str, owner: ast.AST | None, place) -> list[str]:
    if owner is None:
        return []
    a, b = place(owner.lineno, owner.col_offset), place(owner.body[0].lineno, owner.body[0].col_offset)
    return spelled(src[a:b])


def _around(src: str, nodes: list[Node], strings: list[tuple[int, int]], language: str) -> None:
    """Fills in buried, under and declared for languages of braces, from a copy of the source without comments and strings."""
    bare = list(src)
    for a, b in [(x.start, x.end) for x in nodes] + strings:
        part = src[a:b]
        bare[a:b] = " " * len(part) if "\n" not in part else [c if c == "\n" else " " for c in part]
    code = "".join(bare)
    header = re.compile(_FUNCTION.get({"tsx": "javascript", "typescript": "javascript", "c++": "c"}.get(language, language), r"(?!)"))
    functions, stack, since = [], [], 0
    for m in re.finditer(r"[{};]", code):
        if m[0] == "{":
            head = code[since : m.start()].split("\n\n")[-1]
            stack.append((m.start(), bool(header.search(head)) and not _CONTROL.match(head)))
        elif m[0] == "}" and stack:
            at, function = stack.pop()
            if function:
                functions.append((at, m.start()))
        since = m.end()
    functions += [(at, len(code)) for at, function in stack if function]
    buried = _covered(functions)
    taken = {x.start for x in nodes}
    end = _stops(code, language in ("go", "javascript", "typescript", "tsx", "bash", "ruby", "hcl", "yaml", "make", "dockerfile"))
    parens = [m.start() for m in re.finditer(r"\(", code)] if language in ("c", "c++", "java") else []
    rest = re.compile(r"[ \t\r\n;]*")
    for node in nodes:
        node.buried = buried(node.start)
        ink = _INK.search(src, node.end)
        if not ink or ink.start() in taken:
            continue
        at = ink.start()
        k = stop = end(at)
        while k > at and src[k - 1].isspace():
            k -= 1
        if k == at:
            continue
        line = src.find("\n", at, k)
        after = rest.match(code, stop).end()
        defines = bool(_DEFINES.match(src, at, k))
        if not defines and parens:
            p = bisect_left(parens, at)
            defines = p < len(parens) and parens[p] < k and bool(_C_FUNCTION.match(src, at, k)) and not _CONTROL.match(src, at, k)
        node.under = {"kind": "definition" if defines else "statement", "one_line": line < 0, "last": code[after : after + 1] in ("}", ""), "words": _words(src[at:k]) if line < 0 else []}
        if defines:
            body = code.find("{", at, stop)
            keeps = language == "go" and _KEEPS.match(src, at, k)
            node.declared = spelled(code[at : stop if keeps or body < 0 else body])


def nodes_of(content: bytes, language: str) -> list[dict]:
    """All comment nodes of a file, in order."""
    text = (masked(content) if language == "yaml" else content).decode("utf-8", "surrogateescape")
    if language == "python":
        found = _python(text)
    elif language in SLASH:
        found, strings = _slash(text, language)
        _around(text, found, strings, language)
    else:
        found, strings = _hashes(text, language)
        _around(text, found, strings, language)
    size = lambda a, b: len(text[a:b].encode("utf-8", "surrogateescape"))
    out, at, row, byte, before = [], 0, 0, 0, 0
    line = line_byte = 0  # where the line begins, in characters and in bytes
    for x in found:
        row += text.count("\n", at, x.start)
        newline = text.rfind("\n", at, x.start) + 1
        if newline:
            line, line_byte = newline, byte + size(at, newline)
        byte += size(at, x.start)
        raw = text[x.start : x.end]
        end_row = row + raw.count("\n")
        made = {
            "row": row, "col": byte - line_byte, "end_row": end_row, "start": byte, "end": byte + size(x.start, x.end), "raw": raw.encode("utf-8", "surrogateescape").decode("utf-8", "replace"),
            "buried": x.buried, "docstring": x.docstring, "trailing": _INK.search(text, line, x.start) is not None, "blank_before": _INK.search(text, before, x.start) is None,
            "under": x.under, "declared": x.declared, "above": _line_above(text, x.start) if language == "yaml" else "",
        }
        last = raw.rfind("\n") + 1
        if last:
            line, line_byte = x.start + last, byte + size(x.start, x.start + last)
        made["end_col"] = made["end"] - line_byte
        out.append(made)
        if made["blank_before"]:
            before = x.end
        at, row, byte = x.end, end_row, made["end"]
    return out


def _line_above(text: str, at: int) -> str:
    """The last line before a place that isn't blank, as far as its last ink."""
    while at > 0 and text[at - 1] in " \t\r\n":
        at -= 1
    return text[text.rfind("\n", 0, at) + 1 : at]


def _touched(spans: list[dict]):
    """Whether a stretch shares a byte with one of the spans."""
    own = sorted((s["start"], s["end"]) for s in spans)
    begins, furthest = [a for a, _ in own], []
    for _, b in own:
        furthest.append(max(b, furthest[-1]) if furthest else b)
    return lambda a, b: (k := bisect_left(begins, b)) > 0 and furthest[k - 1] > a


def scan(files: DataFrame) -> DataFrame:
    """A row for each comment node of files (path, language, content as binary). Larger files than the limit and those
    without a language are skipped before any Python sees them. Files may have spans, an array of start and end: written says
    whether a node shares a byte with one of them; without the column, every node is."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([
            ("path", pa.string()), ("language", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("end_row", pa.int32()), ("end_col", pa.int32()), ("start", pa.int64()),
            ("end", pa.int64()), ("raw", pa.string()), ("buried", pa.bool_()), ("docstring", pa.bool_()), ("trailing", pa.bool_()), ("blank_before", pa.bool_()),
            ("under", pa.struct([("kind", pa.string()), ("one_line", pa.bool_()), ("last", pa.bool_()), ("words", pa.list_(pa.string()))])),
            ("declared", pa.list_(pa.string())), ("above", pa.string()), ("written", pa.bool_()), ("error", pa.string()),
        ])
        for batch in batches:
            rows = []
            for path, language, content, *spans in zip(*(c.to_pylist() for c in batch.columns)):
                touched = _touched(spans[0] or []) if spans else lambda a, b: True
                try:
                    rows += [{"path": path, "language": language, "written": touched(x["start"], x["end"]), **x} for x in nodes_of(content, language)]
                except Exception as e:  # one file must not end a sweep; it is counted by its row
                    rows.append({"path": path, "language": language, "error": type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    own = files.filter(F.col("language").isNotNull() & (F.octet_length("content") <= L.FILE_BYTES))
    return own.select("path", "language", F.col("content").cast("binary"), *(["spans"] if "spans" in files.columns else [])).mapInArrow(run, SCHEMA)
