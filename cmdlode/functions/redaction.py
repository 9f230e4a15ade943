"""Scrubbing secrets from command text.

The rules follow RE2 reading: ``\\b``, ``\\s`` and ``\\S`` are ASCII, and case
folding also folds U+017F to ``s`` and U+212A to ``k``. Java reads ``\\b`` by
Unicode, which would let a secret pass after a non-ASCII letter, so boundaries
and blanks are written out.
"""

from __future__ import annotations

import re
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from cmdlode.params import PLACEHOLDER

_WORD = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_BLANK = r"[\t\n\f\r ]"
_SOLID = r"[^\t\n\f\r ]"
_EXTRA = r"\x{17f}\x{212a}"
_NAME = rf"[A-Z0-9_{_EXTRA}]"


def _fold(words: str) -> str:
    """Add the two non-ASCII case variants to the letters of a literal."""
    return words.replace("s", r"[s\x{17f}]").replace("k", r"[k\x{212a}]")


# --- fixed values: names of secrets -------------------------------------------
FLAG_NAMES = ("password", "passwd", "pwd", "token", "secret", "api[-_]?key", "apikey", "access[-_]?key", "auth")
ASSIGN_NAMES = ("token", "secret", "password", "passwd", "api_?key")
# ------------------------------------------------------------------------------
_FLAG_NAMES = "|".join(map(_fold, FLAG_NAMES))
_ASSIGN_NAMES = "|".join(map(_fold, ASSIGN_NAMES))
_SCHEMES = f"{_fold('bearer')}|{_fold('basic')}"

_END = rf"(?!{_WORD})"


def _lead(text: str) -> str:
    """``text`` at the start of a word. The boundary is looked at behind the literal, which fails first at
    most places: the shape rules take 1.6 s over 3,000 documents of the test tables on one core so, and
    3.4 s with the boundary in front."""
    return rf"{text}(?<!{_WORD}{text})"


# --- fixed values: the scrubbing rules, applied in this order ----------------
NAMED_RULES = (
    # value of a secret-looking option
    (rf"(?i)(^|{_BLANK})(--?(?:{_FLAG_NAMES})[= ]){_SOLID}+", "$1$2" + PLACEHOLDER),
    # value of a secret-looking assignment
    # (the look-ahead skips names without a value before any backtracking)
    (
        rf"(?i){_EDGE}(?={_NAME}++=)({_NAME}*(?:{_ASSIGN_NAMES}){_NAME}*=){_SOLID}+",
        "$1" + PLACEHOLDER,
    ),
    # authorization header
    (
        rf"(?i)(authorization:{_BLANK}*(?:{_SCHEMES}){_BLANK}+)[A-Za-z0-9._~+/={_EXTRA}-]+",
        "$1" + PLACEHOLDER,
    ),
)
SHAPE_RULES = (
    (rf"{_lead('gh[pousr]_')}[A-Za-z0-9]{{20,}}{_END}", PLACEHOLDER),
    (rf"{_lead('github_pat_')}[A-Za-z0-9_]{{20,}}{_END}", PLACEHOLDER),
    (rf"{_lead('xox[baprs]-')}[A-Za-z0-9-]{{10,}}{_EDGE}", PLACEHOLDER),
    (rf"{_lead('AKIA')}[0-9A-Z]{{16}}{_END}", PLACEHOLDER),
    (rf"{_lead('(?:sk|pk|rk)_')}(?:live|test)_[A-Za-z0-9]{{16,}}{_END}", PLACEHOLDER),
    (
        rf"{_lead('eyJ')}[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{5,}}{_EDGE}",
        PLACEHOLDER,
    ),
)
# Every match of a named rule contains one of these in lower case, or a letter
# that only folds to ASCII; every match of a shape rule one of the others.
NAMED_HINTS = (
    "passw", "pwd", "token", "secret", "apikey", "api_key", "api-key",
    "accesskey", "access_key", "access-key", "-auth", "authorization:", "ſ",
)
SHAPE_HINTS = (
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "AKIA", "_live_", "_test_", "eyJ",
)
# -----------------------------------------------------------------------------

Rules = tuple[tuple[str, str], ...]


def _apply(c: Column, rules: Rules) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def _any(c: Column, literals: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for literal in literals:
        found = found | c.contains(literal)
    return found


def _longest(choices: list[frozenset[str]]) -> frozenset[str] | None:
    """Of sets of literals, one of each of which must occur, the one that is the hardest to meet."""
    return max(choices, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _needed(items) -> frozenset[str] | None:
    """Literals one of which is in every match of a parsed pattern; null if none is found."""
    choices, run = [], ""
    for kind, value in [*items, (None, None)]:
        if kind is parser.LITERAL:
            run += chr(value)
            continue
        if run:
            choices.append(frozenset([run]))
            run = ""
        inner = None
        if kind is parser.SUBPATTERN:
            inner = _needed(value[-1])
        elif kind is parser.BRANCH:
            parts = [_needed(part) for part in value[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _needed(value[2])
        elif kind is parser.ATOMIC_GROUP:
            inner = _needed(value)
        if inner:
            choices.append(inner)
    return _longest(choices)


def needed_literals(pattern: str) -> tuple[tuple[str, ...], bool] | None:
    """ASCII literals one of which every match contains, and whether case is ignored.

    Null where none is sure: the pattern has none, or uses what Python's parser of regular
    expressions reads otherwise than Java's or not at all. The rule then meets every row.
    """
    if re.search(r"\\[QE]|\(\?[^:=!<]*x|&&|\[[^\]]*\[", pattern):  # quoting, comments, classes of classes
        return None
    try:
        parsed = parser.parse(pattern)
    except (re.error, ValueError, OverflowError):
        return None
    found = _needed(parsed)
    if not found or not all(x.isascii() for x in found):
        return None
    folded = bool(parsed.state.flags & re.IGNORECASE) or "(?i" in pattern or re.search(r"\(\?[a-z]*i", pattern) is not None
    return tuple(sorted({x.lower() if folded else x for x in found})), folded


def _extra(c: Column, scrubbed: Column, low: Column, rules: Rules) -> Column:
    """The caller's rules on rows that hold a literal they need, or on all if one needs none.

    Literals are looked for in the text before scrubbing. That is enough unless a replacement makes
    one: if it holds a literal, or is so short that what stands beside it could join.
    """
    exact: set[str] = set()
    folded: set[str] = set()
    for pattern, _ in rules:
        needed = needed_literals(pattern)
        if needed is None:
            return _apply(scrubbed, rules)
        (folded if needed[1] else exact).update(needed[0])
    made = [PLACEHOLDER, *[re.sub(r"\$\d", "", replacement) for _, replacement in rules]]
    if len(rules) > 1 and not all(made) or any(x in text.lower() for text in made for x in folded) or any(x in text for text in made for x in exact):
        return _apply(scrubbed, rules)
    some = _any(c, tuple(sorted(exact))) | _any(low, tuple(sorted(folded)))
    return F.when(some, _apply(scrubbed, rules)).otherwise(scrubbed)


def redact(c: Column, extra_rules: Rules = (), lowered: Column | None = None) -> Column:
    """Replace likely secrets with the placeholder.

    Byte searches for the hints decide which rule group can match at all, so
    most rows never meet a regular expression. A replacement cannot create a
    hint: it puts the placeholder between what stays. For long texts pass
    ``lowered``, the lower-case text computed once. ``extra_rules`` are Java
    patterns applied last; their own literals guard them in the same way.
    """
    low = F.lower(c) if lowered is None else lowered
    named = F.when(_any(low, NAMED_HINTS), _apply(c, NAMED_RULES)).otherwise(c)
    scrubbed = F.when(_any(c, SHAPE_HINTS), _apply(named, SHAPE_RULES)).otherwise(named)
    return _extra(c, scrubbed, low, extra_rules) if extra_rules else scrubbed
