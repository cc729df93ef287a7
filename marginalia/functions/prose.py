"""Prose as Columns: markers, sentences, words. Built-in expressions only, but for keys, so all else stays in the JVM.

Each function takes and returns Columns. White space is Unicode's, given as an explicit class, since what \\s and trim()
mean differs between engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions.keys import fnv_of

#: The inside of a character class of white space.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: The same characters by their property, in patterns for Java alone: there a class of ten parts is ten tests for each character.
_WHITE = r"\p{IsWhite_Space}"
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def any_of(words: list[str]) -> str:
    """A pattern for any of some literal words, tried in their order."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound to a name: it is worked out once, even where body uses it within another lambda."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once for each row, whatever uses them later. A generator of one row stands between,
    since the optimiser would copy a column's expression into each filter and each other column that reads it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def fields(text: Column) -> Column:
    """The runs of anything but white space."""
    return F.filter(F.split(_spaced(text), " "), lambda w: w != "")


def _spaced(text: Column) -> Column:
    """The runs of anything but white space, with one space between."""
    return F.trim(F.regexp_replace(text, rf"{_WHITE}+", " "))


def first_field(text: Column) -> Column:
    """The first run of anything but white space; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"\A{_WHITE}*+([^{_WHITE}]++)", 1), F.lit(""))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def strip(line: Column) -> Column:
    """A raw line without its comment marker: of the markers only the first that fits, of each closer only one."""
    bare = trim(F.regexp_replace(trim(line), rf"\A{any_of(L.MARKERS)}", ""))
    # The closers are taken from the end in their order, so at most one of each stands there in the order turned round.
    closed = lambda out: F.when(_any(out.endswith(c) for c in L.CLOSERS), trim(F.regexp_replace(out, _CLOSED, ""))).otherwise(out)
    return let(bare, closed)


#: What strip() takes from the end.
_CLOSED = "".join(f"(?:{re.escape(c)})?" for c in reversed(L.CLOSERS)) + r"\z"


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def bare(line: Column) -> Column:
    """Whether strip() leaves nothing of a raw line."""
    return trim(line).rlike(rf"\A(?>{any_of(L.MARKERS)}|){_WHITE}*+{_CLOSED}")


def indented(line: Column) -> Column:
    """A raw line without its marker and one space after it; what indentation follows stays."""
    blanks = F.lit(" \t")
    out = F.rtrim(F.regexp_replace(F.ltrim(line, blanks), rf"\A{any_of(L.MARKERS)} ?", ""), blanks)
    return let(out, lambda x: F.when(x.endswith("*/"), F.substr(x, F.lit(1), F.char_length(x) - 2)).otherwise(x))


def dedent(text: Column) -> Column:
    """Without the indentation that all lines but blank ones share."""

    def width(line: Column) -> Column:
        return F.char_length(line) - F.char_length(F.regexp_replace(line, r"\A[ \t]+", ""))

    def cut(parts: Column) -> Column:
        shared = F.array_min(F.transform(F.filter(parts, lambda x: trim(x) != ""), width))
        return let(shared, lambda n: F.transform(parts, lambda x: F.when((n > 0) & (F.octet_length(x) >= n), F.substring(x, n + 1, F.char_length(x))).otherwise(x)))

    return let(lines(text), lambda parts: F.array_join(cut(parts), "\n"))


def notice(body: Column) -> Column:
    """Whether a line opens with the mark of a licence or copyright notice."""
    return body.rlike(rf"(?:\A|\n)[{_WHITE}&&[^\n]]*+(?i:{any_of(L.NOTICES)})")


def directive(line: Column) -> Column:
    """Whether a raw line is for a machine: a shebang, a pragma, a JSON object, a link."""

    def told(own: Column) -> Column:
        def by(bare: Column) -> Column:
            json = bare.startswith("{") & F.rtrim(bare, F.lit(" \t")).endswith("}")
            return json | F.lower(F.substring(bare, 1, _DIRECTIVE)).rlike(rf"\A{any_of(L.DIRECTIVES)}")

        return own.startswith("#!") | let(F.regexp_replace(own, r"\A[/*#\-! \t]+", ""), by)

    return let(trim(line), told)


#: No directive is longer.
_DIRECTIVE = max(map(len, L.DIRECTIVES))


def pragma(raw: Column) -> Column:
    """Whether every line of a comment that says anything is a directive."""
    return F.forall(lines(raw), lambda x: bare(x) | directive(x))


def normalize(text: Column) -> Column:
    """Lower case; everything but a-z and 0-9 is one space; a space at either end."""
    # A mark at either end joins the run of others there, so every end is one space; a text of nothing else is one.
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), "[^a-z0-9]+", " ")


#: What may follow the mark that ends a sentence within its word.
_CLOSERS = r"[\"')\]`]"


def _ending(white: str) -> str:
    """A pattern for a word that ends a sentence, and what stands before it: in a mark, closed or not, neither a capital alone nor an
    abbreviation nor a number, and before a word that doesn't begin with a small letter. white is the class of what stands between words.
    A word without a mark is read once, and nothing is tried at each of its places, so time is in proportion to the text."""
    end = rf"(?:{white}|\z)"
    marked = rf"(?=[^{white}.!?]*+(?=[.!?])[^{white}]*[.!?]{_CLOSERS}*+(?={end})(?!{white}+[a-z]))"
    kept = rf"(?!(?:[A-Z]|(?i:{any_of(L.ABBREVIATIONS)}))[.!?]++{_CLOSERS}*+{end})(?![.vV]*+[0-9][0-9.vV]*+[.!?]*+{_CLOSERS}*+{end})"
    return rf"(?:\A|{white}){marked}{kept}[^{white}]*+"


def sentences(text: Column) -> Column:
    """How many sentences end in a text."""
    return F.size(F.regexp_extract_all(text, F.lit(_ending(_WHITE)), F.lit(0)))


def ended(pieces_: Column) -> Column:
    """How many of the sentences of split() end: all, or all but the last."""
    return F.size(pieces_) - F.when(F.size(pieces_) == 0, 0).otherwise(1 - sentences(F.get(pieces_, F.size(pieces_) - 1)))


def split(text: Column) -> Column:
    """The sentences of a text, each joined by single spaces; a tail that doesn't end is one more."""
    # Where single spaces are all white space, a new line can mark the ends.
    marked = F.regexp_replace(_spaced(text), rf"({_ending(' ')})(?= )", "$1\n")
    return F.filter(F.split(marked, "\n "), lambda p: p != "")


def opening(pieces: Column) -> Column:
    return F.slice(pieces, 1, L.OPENING)


def code(text: Column) -> Column:
    """Whether a text is shaped like source: an operator anywhere, or a keyword first."""
    first = F.regexp_replace(F.lower(first_field(text)), r"\A[(:]+|[(:]+\z", "")
    return text.rlike("[={};]") | F.coalesce(first.isin(L.KEYWORDS), F.lit(False))


def stem(word: Column) -> Column:
    return F.when(word.endswith("s"), F.substr(word, F.lit(1), F.char_length(word) - 1)).otherwise(word)


def content(text: Column) -> Column:
    """The words that carry a text: no stop words, none of fewer than three letters, one final s dropped."""
    words = F.filter(F.split(normalize(text), " "), lambda w: (F.char_length(w) >= 3) & ~w.isin(L.STOP))
    return F.transform(words, stem)


def pieces(identifier: Column) -> Column:
    """The words of an identifier: cut before each capital and at everything but letters and digits."""
    spaced = F.regexp_replace(identifier, r"(\p{Lu})", " $1")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def spelled(code_text: Column) -> Column:
    """The stemmed words of all identifiers of a stretch of source."""
    return F.array_distinct(F.transform(pieces(code_text), stem))


def structured(sentence: Column) -> Column:
    """Whether a sentence is a list item, a prompt or a documentation tag."""
    return trim(sentence).rlike(rf"\A{any_of(L.OPENERS)}") | sentence.rlike(rf"(?=[@\\:#>]){any_of(L.TAGS)}")


def eliminates(sentence: Column, names: Column) -> Column:
    """Whether a sentence rules something out, by a word that the declaration doesn't spell itself."""
    hit = let(names, lambda n: F.exists(F.split(normalize(sentence), " "), lambda w: w.isin(L.ELIMINATORS) & ~F.array_contains(n, stem(w))))
    return sentence.contains("O(") | hit


def compat(text: Column) -> Column:
    """Whether a text justifies itself by history, in one of a few phrases."""
    return normalize(text).rlike(f" {any_of(L.COMPAT)} ")


def site_key(text: Column) -> Column:
    """FNV-1a, 64 bits, of the normalised text, as decimal(20,0)."""
    return fnv_of(normalize(text))


def hollow_sentences(pieces_: Column, names: Column) -> Column:
    """Of the sentences after the first, those that only respell the declaration ("echo") or rate it ("assessment"), as
    structs of at, why and text; fewer than two count as none."""

    def one(s: Column, i: Column) -> Column:
        def by(words: Column) -> Column:
            new = lambda w: ~w.isin(L.EVALUATIVE + L.SCAFFOLD) & ~F.array_contains(names, w)
            rating, novel = F.size(F.filter(words, lambda w: w.isin(L.EVALUATIVE))), F.size(F.filter(words, new))
            why = F.when(rating > 0, "assessment").otherwise("echo")
            # The first new word settles most sentences; names may be many, so they are searched for one word, not for each.
            fits = (F.size(words) >= 3) & (~F.coalesce(F.exists(words, new), F.lit(False)) | ((rating >= 2) & (novel < rating)))
            fits = fits & ~structured(s) & ((rating > 0) | ~eliminates(s, names))
            return F.when(fits, F.struct((i + 1).cast("int").alias("at"), why.alias("why"), s.alias("text")))

        return F.when(i > 0, let(content(s), by))

    given = names

    def all_of(bound: Column) -> Column:
        nonlocal names
        names = bound
        return F.filter(F.transform(pieces_, one), lambda x: x.isNotNull())

    found = let(given, all_of)
    return let(found, lambda x: F.when(F.size(x) >= 2, x).otherwise(F.slice(x, 1, 0)))
