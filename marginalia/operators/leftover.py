"""Recognises code that was commented out. Cheap gates are Columns; what has to be parsed goes to Python, and only that.

Python bodies are read by the language's own parser. For the other languages small recognisers stand in for a grammar: they
accept statements by shape and refuse whatever puts two operands side by side, as prose does.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import lexicon as L
from marginalia.functions import prose as P
from marginalia.sources.languages import LANGUAGES

_PAIRS = {"{": "}", "(": ")", "[": "]"}
#: Go's built-in functions and types, whose call alone is no statement.
DROPPED = frozenset(
    "any append bool byte cap complex complex64 complex128 error float32 float64 imag int int8 int16 int32 int64 len make max min new real rune string uint uint8 uint16 "
    "uint32 uint64 uintptr unsafe.Add unsafe.Alignof unsafe.Offsetof unsafe.Sizeof unsafe.Slice unsafe.SliceData unsafe.String unsafe.StringData".split()
)


def balance(body: str) -> str:
    """The closers that a body lacks, innermost first. Double quotes and backquotes hide brackets; a wrong closer is passed over."""
    open_: list[str] = []
    quote, i = "", 0
    while i < len(body):
        ch = body[i]
        if quote:
            i += ch == "\\"
            quote = "" if ch == quote else quote
        elif ch in '"`':
            quote = ch
        elif ch in _PAIRS:
            open_.append(_PAIRS[ch])
        elif open_ and ch == open_[-1]:
            open_.pop()
        i += 1
    return "".join(reversed(open_))


_VALUES = (ast.Constant, ast.List, ast.Dict, ast.Set, ast.Tuple, ast.Call, ast.Attribute, ast.UnaryOp, ast.JoinedStr, ast.ListComp, ast.Lambda)
_STATEMENTS = (
    ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Return, ast.Raise, ast.Assert, ast.Delete, ast.Global, ast.Nonlocal, ast.With,
    ast.AsyncWith, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.Call,
)


def python_code(body: str) -> bool:
    """A statement that does something, a call, or a name that is set to a value; comparisons and bare names are prose."""
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    for node in ast.walk(tree):
        if isinstance(node, _STATEMENTS) or (isinstance(node, ast.Assign | ast.AugAssign | ast.AnnAssign) and isinstance(node.value, _VALUES)):
            return True
    return False


def docker_code(body: str) -> bool:
    head = body.split()
    return bool(head) and head[0] in L.DOCKER and len(head) > 1


_PAIR = re.compile(r"^(\s*(?:- +)*)([^\s#:{}\[\],&*!|>'\"%@`-][^:#]*?|\"[^\"]*\"|'[^']*'|-\S[^:#]*?)\s*:(?:\s+(.*))?$")
_ITEM = re.compile(r"^(\s*)-(?:\s+(.*))?$")
_EMPTY_ABOVE = re.compile(r"^(\s*)[\w.-]+:\s*(?:\{\s*\}|\[\s*\])\s*$")


def yaml_config(body: str, above: str = "", col: int = 0) -> bool:
    """Configuration: nested, or pairs whose values are single words; not titles, and not what documents an empty value above."""
    if (m := _EMPTY_ABOVE.match(above or "")) and col > len(m[1]):
        return False
    pairs, items, nested, indents, block = [], 0, False, [], None
    for line in body.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        width = len(line) - len(line.lstrip(" "))
        if block is not None and width > block:
            continue
        block = None
        value = None
        if m := _PAIR.match(line):
            value = (m[3] or "").strip()
            pairs.append((m[2].strip("\"'"), value))
            nested |= bool(items) and "-" in m[1] or value[:1] in ("{", "[")
        elif m := _ITEM.match(line):
            items += 1
            value = (m[2] or "").strip()
            nested |= bool(pairs)
        elif not (indents and width > indents[-1]) and not line.strip()[:1] in "{[":
            return False
        elif line.strip()[:1] in "{[":
            items += 1
        if indents and width > indents[-1] and value is not None:
            nested = True
        indents.append(width)
        if value and value[:1] in "|>":
            block = width
    if not pairs:
        return items > 0
    if all(k[:1].isascii() and k[:1].isupper() for k, _ in pairs):
        return False
    return nested or all(v and " " not in v for _, v in pairs)


_TOKEN = re.compile(r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'|[^\W\d]\w*|\d[\w.]*|<-|:=|\+\+|--|&&|\|\||&\^|<<=?|>>=?|[-+*/%&|^=!<>]=|=>|->|::|\.\.\.|\S')
_OPERAND = re.compile(r'^(?:["`\'\w])')
_GLUE = {"go": "func map chan struct interface range case default return if else for switch select go defer var const type import package goto break continue fallthrough".split()}
_GLUE["other"] = (
    "abstract as async await auto bool boolean break byte case catch char class const continue crate debug def default delete do double dyn else enum export extends extern final "
    "finally float fn for foreach from function if impl implements import in include inline instanceof int interface let long loop match mod module move mut namespace new of package "
    "private protected pub public ref resource return short signed static string struct super switch template this throw throws trait try type typedef typeof unsafe unsigned use using "
    "val var variable virtual void volatile where while yield".split()
)


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S))


def _fits(tokens: list[str], glue: list[str], typed: bool) -> bool:
    """Whether no two operands stand side by side; with `typed`, a type may stand before the name that it declares."""
    for i, (a, b) in enumerate(zip(tokens, tokens[1:])):
        if not (_OPERAND.match(a) and _OPERAND.match(b)) or a in glue or b in glue:
            continue
        after = tokens[i + 2] if i + 2 < len(tokens) else ";"
        before = tokens[i - 1] if i else ";"
        if not (typed and after in ("=", ";", "(", ",", ")", "[", ":", "{") and before in (";", "{", "}", "(", ",", "*", "&", ">", "]", "<")):
            return False
    return True


def _statements(tokens: list[str], lines: bool) -> list[list[str]]:
    out: list[list[str]] = [[]]
    depth = 0
    for t in tokens:
        if t == "\n" or t == ";":
            clause = t == ";" and out[-1][:1] and out[-1][0] in ("for", "if", "switch") and "{" not in out[-1]
            if clause:
                out[-1].append(t)
            elif depth == 0 and (lines or t == ";"):
                out.append([])
            continue
        depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
        out[-1].append(t)
    return [s for s in out if s]


def go_code(body: str) -> bool:
    """Statements that Go would compile: calls that aren't conversions, assignments to what can be set, declarations and control."""
    text = body + balance(body)
    text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    tokens: list[str] = []
    for line in text.split("\n"):
        tokens += [*_TOKEN.findall(line), "\n"]
    if not _even([t for t in tokens if t != "\n"]):
        return False
    return _go_block(tokens, True) and any(t != "\n" for t in tokens)


def _even(tokens: list[str]) -> bool:
    stack = []
    for t in tokens:
        if t in _PAIRS:
            stack.append(_PAIRS[t])
        elif t in (")", "]", "}"):
            if not stack or stack.pop() != t:
                return False
    return not stack


def _go_block(tokens: list[str], top: bool) -> bool:
    return all(_go_statement(s) for s in _statements(tokens, True))


_GO_START = frozenset("break case const continue default defer fallthrough for func go goto if import return select switch type var else".split())


def _go_statement(s: list[str]) -> bool:
    head = s[0]
    if head == "package" or s[-1] in ("+", "-", "*", "/", "=", ".", ",", "&&", "||", ":="):
        return False
    if head in ("}", ")"):
        return len(s) == 1 or _go_statement(s[1:])
    if head in _GO_START:
        if "{" in s and head in ("if", "for", "switch", "select", "func", "else", "go", "defer"):
            at = s.index("{")
            return _fits(s[1:at], _GLUE["go"], head == "func") and _go_block(_inner(s, at), False)
        if head in ("var", "const", "type", "func", "import"):
            return len(s) > 1 and len([1 for a, b in zip(s[1:], s[2:]) if a[0].isalpha() and b[0].isalpha()]) <= 2 and (head == "import" or "=" in s or len(s) <= 6 or "{" in s or "(" in s)
        if head in ("break", "continue", "fallthrough", "goto"):
            return len(s) <= 2
        return _fits(s[1:], _GLUE["go"], False) and (head != "return" or len(s) == 1 or _OPERAND.match(s[1]) is not None or s[1] in ("-", "!", "&", "*", "(", "[", "<-", "+", "^"))
    if len(s) > 1 and s[1] == ":" and head.isidentifier():
        return len(s) > 2 and s[2] in ("for", "switch", "select") and _go_statement(s[2:])
    if head == "<-":
        return len(s) > 1 and _fits(s[1:], _GLUE["go"], False)
    depth = 0
    for i, t in enumerate(s):
        depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
        if depth == 0 and (t in ("=", ":=") or (len(t) > 1 and t.endswith("=") and t not in ("==", "!=", "<=", ">="))):
            return i + 1 < len(s) and _go_targets(s[:i]) and _fits(s[i + 1 :], _GLUE["go"], False)
        if depth == 0 and t in ("++", "--"):
            return i + 1 == len(s) and _go_targets(s[:i])
        if depth == 0 and t == "<-" and i:
            return i + 1 < len(s) and _fits(s[:i], _GLUE["go"], False) and _fits(s[i + 1 :], _GLUE["go"], False)
    if s[-1] != ")" or not _fits(s, _GLUE["go"], False):
        return False
    depth, at = 0, len(s) - 1
    while at >= 0:
        depth += (s[at] == ")") - (s[at] == "(")
        if depth == 0:
            break
        at -= 1
    callee = "".join(s[:at])
    return at > 0 and re.match(r"^[\w.()\[\]\"'`,&*{}:<>/+-]+$", callee) is not None and callee not in DROPPED and not any(t in ("+", "-", "&&", "||", "==", "!=", "<", ">") for t in _flat(s[:at]))


def _flat(s: list[str]) -> list[str]:
    out, depth = [], 0
    for t in s:
        depth += (t in _PAIRS) - (t in (")", "]", "}"))
        if depth == 0:
            out.append(t)
    return out


def _go_targets(s: list[str]) -> bool:
    if not s:
        return False
    parts: list[list[str]] = [[]]
    depth = 0
    for t in s:
        depth += (t in _PAIRS) - (t in (")", "]", "}"))
        if t == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    for p in parts:
        while p and p[0] in ("*", "("):
            p = p[1:]
        if not p or not p[0].isidentifier() or not _fits(p, [], False) or (p[-1] == ")" and "(" in p):
            return False
    return True


def _inner(s: list[str], at: int) -> list[str]:
    """Tokens of a block as lines: its line ends are gone, so a statement ends where two operands would meet."""
    out, depth = [], 0
    for a, b in zip(s[at + 1 : -1], [*s[at + 2 : -1], ";"]):
        out.append(a)
        depth += (a in _PAIRS) - (a in (")", "]", "}"))
        if depth == 0 and (_OPERAND.match(a) or a in (")", "]", "}", "++", "--")) and _OPERAND.match(b) and a not in _GLUE["go"] and b != "else":
            out.append(";")
    return out


_SCRIPT = frozenset(["javascript", "typescript", "tsx"])
_SCRIPT_TOKEN = re.compile(
    r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])*\'|(?:[^\W\d]|\$)[\w$]*|\d[\w.]*|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\*\*|<<|>>|[-+*/%&|^]=|\S'
)
_SCRIPT_REGEX = re.compile(r"([(,=:\[!&|?{};]\s*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Marks of JavaScript that can't begin an operand, and those after which one has to come.
_INFIX = frozenset("= += -= *= /= %= &= |= ^= **= <<= >>= >>>= &&= ||= ??= . ?. * % ** & | ^ && || ?? == === != !== <= >= << >> >>> => ?".split())
_AWAITING = (_INFIX - {"*", "?"}) | {"+", "-", "!", "~"}


def _script_joins(body: str, language: str) -> bool:
    """Whether the marks of JavaScript stand where they may: operands between operators, names after dots, `#` before a private
    name only. A `$` belongs to names."""
    infix = _INFIX - {"|", "&"} if language != "javascript" else _INFIX  # types may begin with these
    text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", _SCRIPT_REGEX.sub(r'\1""', body), flags=re.S)
    for line in text.split("\n"):
        tokens = _SCRIPT_TOKEN.findall(line)
        for i, a in enumerate(tokens):
            b = tokens[i + 1] if i + 1 < len(tokens) else None
            named = b is None or b[0].isalpha() or b[0] in "_$"
            if a == "\\" or (a == "#" and (b is None or not named)):
                return False
            if b is None:
                continue
            if (a in (".", "?.") and not named and b not in ("#", "[", "(", "`")) or (a == "." and b in ("[", "(", "`")):
                return False
            if a in _AWAITING and (b in infix or b in (",", ";", ")", "]", "}")):
                return False
            if (b == "#" or (b[0] in "$_" or b[0].isalpha()) and a[0].isdigit()) and _OPERAND.match(a) and a not in _GLUE["other"] + ["get", "set"]:
                return False
    return True


def strict_code(body: str, language: str) -> bool:
    """For languages whose statements end in marks: balanced, shaped like statements, and nothing that reads as prose."""
    if language in _SCRIPT and not _script_joins(body, language):
        return False
    tokens = _tokens(body)
    if not tokens or not _even(tokens) or not any(t in "=;{}()" for t in tokens if len(t) == 1):
        return False
    if not _fits(tokens, _GLUE["other"], language in ("c", "c++", "java", "rust", "typescript", "tsx")):
        return False
    if tokens[-1] in ("=", "+", "-", "*", "/", ",", ".", ":", "?", "!"):
        return False
    if language in ("c", "c++", "java", "php", "rust"):
        return tokens[-1] in (";", "}") or tokens[0] == "#"
    return True


def recognise(language: str, body: str, above: str = "", col: int = 0) -> bool:
    mode = LANGUAGES.get(language, ("", None, False))[1]
    if len(body.encode("utf-8", "replace")) > L.PARSED_BYTES or mode is None:
        return False
    if language == "python":
        return python_code(body)
    if language == "dockerfile":
        return docker_code(body)
    if language == "yaml":
        return yaml_config(body, above, col)
    return go_code(body) if language == "go" else strict_code(body, language)


def candidate(language: Column, text: Column, docstring: Column, trailing: Column) -> Column:
    """The cheap half: a mode that can fire, and for strict languages a text that looks like source."""
    of = lambda mode: language.isin([n for n, (_, m, _) in LANGUAGES.items() if m == mode])
    return ~docstring & ~trailing & (of("evidence") | of("legal") | (of("strict") & P.code(text)))


def mark(comments: DataFrame, maybe: Column | None = None) -> DataFrame:
    """comments (with language, body, above and col) with leftover: whether the body is code. Of rows that `maybe` (see
    candidate()) leaves out, Python never sees the body."""
    names = [c for c in comments.columns if c != "leftover"]
    bound = F.lit(True) if maybe is None else maybe
    body = F.when(bound & (F.octet_length("body") <= L.PARSED_BYTES), P.dedent(F.col("body")))
    own = comments.select(*names, body.alias("__body"))
    at = [own.columns.index(c) for c in ("language", "__body", "above", "col")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in at))
            made = pa.array([b is not None and recognise(a or "", b, c or "", d or 0) for a, b, c, d in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], made], names=[*names, "leftover"])

    schema = T.StructType([own.schema[c] for c in names] + [T.StructField("leftover", T.BooleanType())])
    return own.mapInArrow(run, schema)
