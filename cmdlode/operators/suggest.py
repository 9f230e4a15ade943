"""Failures to past solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlode.functions.format import suggestion_line
from cmdlode.functions.text import compute_once
from cmdlode.operators.projects import with_project
from cmdlode.operators.ranking import top_per_group
from cmdlode.params import DEFAULTS, Params


def victories(hard_won: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(scope, tool, rank, cmd, attempts, cost_ms, cwd, ts)``: certified only."""
    certified = hard_won.where("certified").withColumnRenamed("rank", "_order")
    cut = top_per_group(certified, ["scope", "tool"], [F.col("_order")], params.max_victories)
    return cut.select(
        "scope", "tool", "rank", F.col("command").alias("cmd"), "attempts", "cost_ms", "cwd", "ts"
    )


def victories_by_tool(
    won: DataFrame, roots: DataFrame | None = None, params: Params = DEFAULTS
) -> DataFrame:
    """``(scope, tool, victories)``: at most ``max_victories`` structs per tool."""
    keyed = with_project(won, roots, params=params)
    entry = F.struct("rank", "cmd", "attempts", "cost_ms", "project_key", "ts")
    return keyed.groupBy("scope", "tool").agg(F.collect_list(entry).alias("victories"))


def failures(usage: DataFrame, roots: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Failed rows of ``journal_usage`` with their project."""
    return with_project(usage.where(F.col("exit") != 0), roots, params=params)


def suggest(failed: DataFrame, by_tool: DataFrame) -> DataFrame:
    """Best past victory for each failure, if there is one.

    ``failed`` needs ``(scope, tool, cmd, project_key)``; its columns are kept
    and ``suggested, attempts, cost_ms, won_at, line`` added. Same project
    first, then more attempts, then report order; never the failed command.

    Victories are arrays of one row per key, so a failure never multiplies and
    the same expression serves batch and stream. The join carries no hint:
    adaptive execution broadcasts the victories when their measured size
    allows, and otherwise splits a hot key's failures over tasks.
    """
    failed_cmd, place = F.col("cmd"), F.col("project_key")
    options = F.transform(
        F.filter("victories", lambda v: v["cmd"] != failed_cmd),
        lambda v: F.struct(
            F.coalesce(v["project_key"] == place, F.lit(False)).cast("int").alias("same"),
            v["attempts"].alias("attempts"),
            (-v["rank"]).alias("order"),
            v["cmd"].alias("cmd"),
            v["cost_ms"].alias("cost_ms"),
            v["ts"].alias("ts"),
        ),
    )
    picked = compute_once(failed.join(by_tool, ["scope", "tool"]), _best=F.array_max(options))
    picked = picked.where(F.col("_best").isNotNull())
    return picked.select(
        *failed.columns,
        F.col("_best.cmd").alias("suggested"),
        F.col("_best.attempts").alias("attempts"),
        F.col("_best.cost_ms").alias("cost_ms"),
        F.col("_best.ts").alias("won_at"),
        suggestion_line(F.col("_best.cmd"), F.col("_best.attempts"), F.col("_best.cost_ms")).alias("line"),
    )
