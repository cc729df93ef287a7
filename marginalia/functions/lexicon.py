"""Word lists and constants of the audit. They are behaviour: matched as sets, kept in alphabetical order."""

from __future__ import annotations


def _words(text: str) -> list[str]:
    return sorted(set(text.split()))


#: Comment markers in the order in which they are tried.
MARKERS = ['r"""', 'f"""', 'b"""', '"""', "r'''", "f'''", "'''", "///", "//!", "//", "/*", "#!", "#", "--", "*"]
CLOSERS = ["*/", '"""', "'''"]

NOTICES = sorted(
    ["spdx-license-identifier", "licensed under", "copyright", "this software is provided", "redistribution and use", "permission to use", "permission is hereby granted"],
)

DIRECTIVES = sorted(
    _words(
        "@ts- auto-generated autogenerated biome-ignore c8_ cgo checkov: clang-format codegen coding: coverage: deprecated: eslint- export flake8 fmt: "
        "generated_by gocyclo golangci gosec go: +build http:// https:// isort: istanbul lint: mypy: noinspection nolint noqa nosec oxlint- pragma: prettier- "
        "pylint: pyre- pyright: pytype: revive: ruff: safety: shellcheck sourcery spell-checker staticcheck tflint- ts-expect-error ts-ignore type:",
    ),
)
DIRECTIVES = [d.replace("_", " ") for d in DIRECTIVES]

ABBREVIATIONS = _words("al approx ca cf dr e.g eq etc fig i.e mr no resp st viz vs")

KEYWORDS = _words(
    "assert async await break case catch class console.log const continue def defer del echo elif else enum export finally fmt.printf fmt.println fn for from "
    "func function global go if impl import include interface lambda let match module nonlocal package panic pass print printf println private protected public "
    "raise require return static struct switch throw trait try type use val var while with yield",
)

STOP = _words(
    "a all an and any are as at be by can could do does down each else every for from here if in into is it its may might must new no not of on or our out self "
    "shall should so that the then there this to up we what when where which will with would",
)

SCAFFOLD = _words(
    "about accept add afterwards allow argument begin build call caller code contain convert create data design each end field finally first follow function get "
    "given handle helper hold implementation initially instance item iterate just know lastly look loop make method need new next object operation over parameter "
    "part pas pass perform pointer proces provide purpose read reader receive receiver represent result return returns run second see set simply start step store "
    "struct subsequently take then thing third turn type understand usage use user utility value want way work wrap wrapper write",
)

EVALUATIVE = _words(
    "basically best better convenient designed easy efficient elegant ergonomic essentially explanatory fast good handy helpful intended intuitive meant neat nice "
    "obvious powerful quick readable robust seamless simple straightforward useful",
)

ELIMINATORS = _words(
    "after amortized before block blocks cannot concurrent deadlock dropped during empty err error errors exactly except fail fails failure goroutine held if ignored "
    "instead invalid leak least lock most must negative never nil no none not nothing null nullptr once only otherwise overflow own panic panics rather required "
    "retain reused safe shall since truncated twice undefined unless unsafe until whatever when whenever wherever while without zero",
)

OPENERS = ["#=>", "*", "+", "-", "=>", ">>>", "@", "\\"]
TAGS = sorted(
    [f"@{t}" for t in _words("author code deprecated example exception link param property return see since throws type")]
    + [f"\\{t}" for t in _words("brief param return throws")]
    + [f":{t}:" for t in _words("ivar param raises returns rtype")]
    + ["#=>", ">>>"],
)

COMPAT = sorted(["old callers", "legacy callers", "left for", "kept for", "for compatibility", "backward compatibility", "backwards compatibility"])

#: Python statements and values that make a comment code.
DOCKER = _words("ADD ARG CMD COPY CROSS_BUILD ENTRYPOINT ENV EXPOSE FROM HEALTHCHECK LABEL MAINTAINER ONBUILD RUN SHELL STOPSIGNAL USER VOLUME WORKDIR")

# Limits that change results.
OPENING = 3
EXAMINED = 64
SPANS = 64
BUDGET = 3
REMEMBERED = 4096
STALE_HOURS = 24
FILE_BYTES = 2 << 20
PARSED_BYTES = 16 << 10
CLIP_BYTES = 1536

# The head.
PRECISION, WINDOW, CLEAR, PER_DRAW, BURIED = 0.85, 0.02, 0.005, 0.005, 0.03
