"""Normalising and classifying command text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlode.params import DEFAULTS, HELP_FLAGS, HELP_TOOLS, SAFE_TOOL, TOOL_SUFFIXES, WRAPPERS, Params

# Unicode white space other than the plain blank, as one character class body.
_RARE_WS = r"\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WS = f"[ {_RARE_WS}]"
# The same characters by code point: control characters, and the wider ones.
_CONTROL_WS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_WIDE_WS = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read without evaluating them again.

    Catalyst pushes a filter below the projection that computes its columns and
    copies their expressions into it, at every step anew. Filters stop at the
    output of a generator, so costly text expressions pass through one.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _contains_any(c: Column, characters: list[int]) -> Column:
    found = F.lit(False)
    for code in characters:
        found = found | c.contains(chr(code))
    return found


def trim_ws(c: Column) -> Column:
    """Trim all Unicode white space (plain ``trim`` only removes blanks)."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(_WS), F.regexp_replace(c, rf"^{_WS}+|{_WS}+\z", "")).otherwise(c)


def normalize(c: Column) -> Column:
    """Collapse white-space runs to one blank and trim.

    Byte searches decide whether there is anything to collapse; most text
    never meets the regular expression.
    """
    wide = (F.octet_length(c) != F.char_length(c)) & _contains_any(c, _WIDE_WS)
    untidy = c.contains("  ") | _contains_any(c, _CONTROL_WS) | wide
    collapsed = F.regexp_replace(c, rf"{_WS}{{2,}}|[{_RARE_WS}]", " ")
    return F.btrim(F.when(untidy, collapsed).otherwise(c))


def clip_bytes(c: Column, limit: int | None) -> Column:
    """The first ``limit`` bytes, or all; a character cut in half becomes U+FFFD."""
    if limit is None:
        return c
    head = F.substring(F.encode(c, "UTF-8"), 1, limit).cast("string")
    return F.when(F.octet_length(c) > limit, F.make_valid_utf8(head)).otherwise(c)


def strip_prefixes(c: Column, wrappers: tuple[str, ...] = WRAPPERS) -> Column:
    """Drop leading assignments and wrapper words of normalised text.

    The possessive quantifier keeps the match a loop, so thousands of leading
    assignments cannot exhaust the stack.
    """
    prefixes = "|".join(["[^ =][^ ]*=[^ ]*", *map(re.escape, wrappers)])
    return F.regexp_replace(c, rf"^(?:(?:{prefixes})(?: |\z))++", "")


def base_name(c: Column) -> Column:
    """Tool name of a token: no quotes, no directories, no known suffix."""
    suffixes = "".join(f"(?:{re.escape(s)})?" for s in reversed(TOOL_SUFFIXES))
    leaf = F.regexp_replace(F.btrim(c, F.lit("\"'")), r"(?s)^.*[/\\]", "")
    return F.regexp_replace(leaf, rf"{suffixes}\z", "")


def with_classification(df: DataFrame, cmd: str, params: Params = DEFAULTS) -> DataFrame:
    """Add ``tool``, ``help_target`` and ``is_help`` for normalised text ``cmd``.

    ``tool`` is empty when nothing is left after the prefixes. ``help_target``
    is null unless the row is a help lookup.
    """
    flags = "|".join(re.escape(f) for f in HELP_FLAGS)
    rest, tool = F.col("_rest"), F.col("tool")
    asks_page = tool.isin(*HELP_TOOLS)
    page = F.when(rest.contains(" "), base_name(F.lower(F.substring_index(rest, " ", -1))))
    target = F.when(asks_page, page).when(rest.rlike(rf" (?:{flags})(?: |\z)"), tool)
    df = compute_once(df, _rest=strip_prefixes(F.col(cmd), params.wrappers))
    df = compute_once(df, tool=base_name(F.lower(F.substring_index(rest, " ", 1))))
    df = compute_once(df, help_target=target).drop("_rest")
    return df.withColumn("is_help", F.col("help_target").isNotNull())


def is_usage(params: Params = DEFAULTS) -> Column:
    """Rows (after ``with_classification``) that count as use of a tool."""
    return ~F.col("is_help") & (F.col("tool") != "") & ~F.col("tool").isin(*params.noise_tools)


def is_help_lookup(params: Params = DEFAULTS) -> Column:
    """Rows (after ``with_classification``) that count as a help lookup."""
    target = F.col("help_target")
    return F.col("is_help") & (target != "") & ~target.isin(*params.noise_tools)


def with_tool_of(df: DataFrame, cmd: str, out: str = "tool_of", params: Params = DEFAULTS) -> DataFrame:
    """Add the tool a raw command belongs to; empty for help, noise or nothing."""
    keep = df.columns
    named = df.select(*[F.col(c).alias(f"_in_{c}") for c in keep])
    classified = with_classification(compute_once(named, _cmd=normalize(F.col(f"_in_{cmd}"))), "_cmd", params)
    return classified.select(
        *[F.col(f"_in_{c}").alias(c) for c in keep],
        F.when(is_usage(params), F.col("tool")).otherwise("").alias(out),
    )


def has_arguments(c: Column) -> Column:
    """True for normalised text of two or more tokens."""
    return c.contains(" ")


def is_safe_tool(c: Column) -> Column:
    return F.lower(c).rlike(SAFE_TOOL)
