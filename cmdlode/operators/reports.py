"""Merging inferred and measured evidence into per-tool reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlode.functions.format import journal_line, status_text
from cmdlode.functions.text import is_safe_tool
from cmdlode.operators.ranking import top_per_group
from cmdlode.params import DEFAULTS, Params

HARD_WON = ["rank", "command", "attempts", "certified", "cost_ms", "cwd", "ts", "label"]


def certify(heuristic: DataFrame, rollup: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Merge inferred hard-won commands with certified fights and rank again.

    ``heuristic`` comes from ``hard_won`` (already cut), ``rollup`` from
    ``fight_rollup``. Result: ``(scope, tool, rank, command, attempts,
    certified, cost_ms, cwd, ts)``.
    """
    keys = ["scope", "tool", "command"]
    guessed = heuristic.select(*keys, F.col("attempts").alias("_guess"))
    merged = guessed.join(rollup.withColumn("_fought", F.lit(True)), keys, "full_outer").select(
        *keys,
        F.greatest("_guess", "attempts").alias("attempts"),
        F.coalesce("_fought", F.lit(False)).alias("certified"),
        F.coalesce("cost_ms", F.lit(0)).alias("cost_ms"),
        F.coalesce("cwd", F.lit("")).alias("cwd"),
        "ts",
    )
    best = [F.col("certified").desc(), F.col("attempts").desc(), F.col("command").asc()]
    return top_per_group(merged, ["scope", "tool"], best, params.max_hard_won)


def tool_reports(
    usage: DataFrame, hard_won: DataFrame, hits: DataFrame, journal_totals: DataFrame
) -> DataFrame:
    """``(scope, tool, total, help_lookups, hard_won, hits)`` with ranked arrays.

    A tool of the history keeps its history total; one seen only in the journal
    is reported, with its journal total, when it has a fight. Both arrays are
    short: their inputs are cut per tool. ``hard_won`` carries the project
    ``label`` that ``with_project`` adds.
    """
    keys = ["scope", "tool"]
    won = hard_won.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*HARD_WON))).alias("hard_won"))
    hit = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "command", "count"))).alias("hits")
    )
    journal = journal_totals.withColumnRenamed("total", "_journal")
    joined = usage.join(won, keys, "full_outer").join(journal, keys, "left").join(hit, keys, "left")
    return joined.select(
        *keys,
        F.coalesce("total", "_journal").alias("total"),
        F.coalesce("help_lookups", F.lit(0)).alias("help_lookups"),
        F.coalesce("hard_won", F.array().cast(won.schema["hard_won"].dataType)).alias("hard_won"),
        F.coalesce("hits", F.array().cast(hit.schema["hits"].dataType)).alias("hits"),
    )


def ordered_reports(reports: DataFrame) -> DataFrame:
    """Reports by scope, most used tool first."""
    return reports.orderBy("scope", F.col("total").desc(), "tool")


def with_content(reports: DataFrame) -> DataFrame:
    """Reports that get a sheet: something to show and a safe name."""
    return reports.where((F.size("hard_won") + F.size("hits") > 0) & is_safe_tool(F.col("tool")))


def biggest_fights(reports: DataFrame, params: Params = DEFAULTS, per_scope: bool = True) -> DataFrame:
    """Tools by the attempts of their first hard-won command; the top few.

    Ties go to the tool used more, then by name. ``per_scope=False`` ranks the
    whole fleet at once.
    """
    first = reports.where((F.size("hard_won") > 0) & is_safe_tool(F.col("tool"))).select(
        "scope", "tool", F.element_at("hard_won", 1).alias("_first"), "total"
    )
    named = first.select(
        "scope", "tool", "_first.command", "_first.attempts", "_first.certified", "_first.cost_ms", "total"
    )
    best = [F.col("attempts").desc(), F.col("total").desc(), F.col("tool").asc()]
    if per_scope:
        return top_per_group(named, ["scope"], best, params.top_fights)
    return named.orderBy(*best, "scope").limit(params.top_fights)


def first_tool(reports: DataFrame) -> DataFrame:
    """``(scope, tool)``: the first tool with content of each scope."""
    best = [F.col("total").desc(), F.col("tool").asc()]
    return top_per_group(with_content(reports), ["scope"], best, 1).select("scope", "tool")


def journal_tail(journal: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The latest rows of each scope with status and listing line."""
    latest = top_per_group(journal, ["scope"], [F.col("seq").desc()], params.tail_rows, "_back")
    listed = journal_line(
        F.col("ts"), F.col("shell"), F.col("exit"), F.col("dur_ms"), F.col("cmd")
    )
    return (
        latest.withColumn("status", status_text(F.col("exit")))
        .withColumn("line", listed)
        .drop("_back")
        .orderBy("scope", "seq")
    )
