"""Counting: usage, help lookups, command frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlode.functions.redaction import redact
from cmdlode.functions.text import (
    compute_once,
    has_arguments,
    is_help_lookup,
    is_usage,
    normalize,
    with_classification,
)
from cmdlode.operators.ranking import top_per_group
from cmdlode.params import DEFAULTS, Params


def classify_commands(commands: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``commands(scope, source, pos, command)`` with ``cmd`` normalised and classified."""
    cleaned = compute_once(commands, cmd=normalize(F.col("command")))
    cleaned = cleaned.where(F.col("cmd") != "").select("scope", "source", "pos", "cmd")
    return with_classification(cleaned, "cmd", params)


def usage_rows(classified: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Rows that count as use of a tool: ``(scope, source, tool, pos, cmd)``."""
    return classified.where(is_usage(params)).select("scope", "source", "tool", "pos", "cmd")


def tool_usage(classified: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(scope, tool, total)``: uses per tool."""
    return classified.where(is_usage(params)).groupBy("scope", "tool").agg(F.count("*").alias("total"))


def help_lookups(classified: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(scope, tool, help_lookups)``: help lookups per target tool."""
    return (
        classified.where(is_help_lookup(params))
        .groupBy("scope", F.col("help_target").alias("tool"))
        .agg(F.count("*").alias("help_lookups"))
    )


def command_counts(classified: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(scope, tool, cmd, count)``: how often each command was typed.

    Help lookups are counted in the same pass, under the tool they ask about and
    with a null ``cmd``; hits and totals both derive from this one shuffle.
    """
    used, asked = is_usage(params), is_help_lookup(params)
    return (
        classified.where(used | asked)
        .select(
            "scope",
            F.when(used, F.col("tool")).otherwise(F.col("help_target")).alias("tool"),
            F.when(used, F.col("cmd")).alias("cmd"),
        )
        .groupBy("scope", "tool", "cmd")
        .agg(F.count("*").alias("count"))
    )


def usage_with_help(counts: DataFrame) -> DataFrame:
    """``(scope, tool, total, help_lookups)``, including tools only asked about.

    The full outer join of ``tool_usage`` and ``help_lookups``, as one more
    aggregate over ``command_counts``.
    """
    used = F.when(F.col("cmd").isNotNull(), F.col("count")).otherwise(0)
    asked = F.when(F.col("cmd").isNull(), F.col("count")).otherwise(0)
    return counts.groupBy("scope", "tool").agg(
        F.sum(used).alias("total"), F.sum(asked).alias("help_lookups")
    )


def help_only_tools(counts: DataFrame) -> DataFrame:
    """``(scope, tool)`` of tools that were looked up but never used."""
    return usage_with_help(counts).where(F.col("total") == 0).select("scope", "tool")


def greatest_hits(counts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(scope, tool, rank, command, count)``: most repeated commands per tool.

    Redaction follows counting: two raw commands that read the same once
    scrubbed stay two rows.
    """
    hits = counts.where((F.col("count") >= params.min_hits) & has_arguments(F.col("cmd")))
    hits = hits.select("scope", "tool", redact(F.col("cmd"), params.extra_rules).alias("command"), "count")
    best = [F.col("count").desc(), F.col("command").asc()]
    return top_per_group(hits, ["scope", "tool"], best, params.max_hits)


def repeated_lines(
    lines: DataFrame, keys: list[str], text: str, params: Params = DEFAULTS
) -> DataFrame:
    """Most repeated multi-word lines of any text, per ``keys``; not redacted."""
    counted = (
        compute_once(lines, line=normalize(F.col(text)))
        .where(F.col("line") != "")
        .groupBy(*keys, "line")
        .agg(F.count("*").alias("count"))
        .where((F.col("count") >= params.min_hits) & has_arguments(F.col("line")))
    )
    best = [F.col("count").desc(), F.col("line").asc()]
    return top_per_group(counted, keys, best, params.max_hits)


def source_counts(commands: DataFrame) -> DataFrame:
    """``(scope, source, n_commands)`` with totals: null source = all of a scope,
    null scope = everything."""
    return commands.rollup("scope", "source").agg(F.count("*").alias("n_commands"))


def scan_summary(commands: DataFrame, status: DataFrame, journal: DataFrame, shown: DataFrame) -> DataFrame:
    """What a scan read and wrote, one row a scope: ``(scope, n_commands, n_sources, n_failed, n_journal, n_sheets)``.

    A source counts as found if one of its files was read; ``status`` is that of
    ``load_histories``, ``shown`` has a row for each sheet. Each input is counted before the
    counts meet. A location that does not exist has no scope and is in the row of the null scope.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    good = F.col("error").isNull()
    counts = {
        "n_commands": commands.select("scope", one.alias("n")),
        "n_sources": status.where(good).select("scope", "source").distinct().select("scope", one.alias("n")),
        "n_failed": status.where(~good).select("scope", one.alias("n")),
        "n_journal": journal.select("scope", one.alias("n")),
        "n_sheets": shown.select("scope", one.alias("n")),
    }
    parts = None
    for name, rows in counts.items():
        counted = rows.groupBy("scope").agg(F.sum("n").alias("n"))
        part = counted.select("scope", *[(F.col("n") if name == other else none).alias(other) for other in counts])
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("scope").agg(*[F.sum(name).alias(name) for name in counts])
