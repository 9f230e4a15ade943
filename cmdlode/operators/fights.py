"""Fights: runs of failures closed by a success, from a journal of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlode.functions.redaction import redact
from cmdlode.functions.similarity import with_same_intent
from cmdlode.functions.text import compute_once, is_usage, normalize, with_classification
from cmdlode.operators.sequence import linked_runs
from cmdlode.params import DEFAULTS, Params

_FIELDS = ["ts", "cmd", "exit", "dur_ms", "cwd"]


def journal_usage(journal: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Journal rows that count as use of a tool, scrubbed, with ``tool``.

    Scrubbing comes before classifying, and again on stored rows: normalising
    can bring an option and its value next to each other.
    """
    cleaned = compute_once(journal.withColumnRenamed("cmd", "_raw"), _text=normalize(F.col("_raw")))
    cleaned = compute_once(cleaned.where(F.col("_text") != ""), cmd=redact(F.col("_text"), params.extra_rules))
    cleaned = with_classification(cleaned.drop("_raw", "_text"), "cmd", params)
    return cleaned.where(is_usage(params)).select("scope", "tool", "shell", "seq", *_FIELDS)


def shell_totals(usage: DataFrame) -> DataFrame:
    """``(scope, tool, shell, total, first_seq)`` over journal usage."""
    return usage.groupBy("scope", "tool", "shell").agg(
        F.count("*").alias("total"), F.min("seq").alias("first_seq")
    )


def journal_totals(totals: DataFrame) -> DataFrame:
    """``(scope, tool, total)``: ``shell_totals`` over all shells."""
    return totals.groupBy("scope", "tool").agg(F.sum("total").alias("total"))


def fights(usage: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(scope, tool, shell, seq, command, attempts, cost_ms, cwd, ts)``.

    A success always empties the run, so a row continues a run exactly when its
    direct predecessor failed, shares its intent and is recent enough.
    """
    limit = params.max_fight_gap_s * 1_000_000

    def link(df: DataFrame, prev: str, cur: str, out: str) -> DataFrame:
        gap = f"timestampdiff(MICROSECOND, {prev}.ts, {cur}.ts)"
        goes_on = f"({prev}.exit <> 0 AND {gap} <= {limit})"
        return with_same_intent(df, f"{prev}.cmd", f"{cur}.cmd", out, goes_on, params)

    won = (F.col("last.exit") == 0) & (F.col("n") > 1)
    runs = linked_runs(usage, ["scope", "tool", "shell"], "seq", _FIELDS, link, won, None, params)
    micros = F.timestamp_diff("MICROSECOND", F.col("first.ts"), F.col("last.ts"))
    cost = F.call_function("div", micros, F.lit(1000)) + F.col("last.dur_ms")
    return runs.select(
        "scope",
        "tool",
        "shell",
        F.col("last.seq").alias("seq"),
        F.col("last.cmd").alias("command"),
        F.col("n").alias("attempts"),
        F.greatest(F.lit(0).cast("bigint"), cost).alias("cost_ms"),
        F.col("last.cwd").alias("cwd"),
        F.col("last.ts").alias("ts"),
    )


def fight_rollup(fought: DataFrame, totals: DataFrame) -> DataFrame:
    """``(scope, tool, command, attempts, cost_ms, cwd, ts)``, one row per command.

    Place and time come from the last fight in processing order: shells in
    order of first appearance (``totals.first_seq``), then journal order.
    """
    placed = fought.join(totals.drop("total"), ["scope", "tool", "shell"])
    latest = F.max_by(F.struct("cwd", "ts"), F.struct("first_seq", "seq"))
    return (
        placed.groupBy("scope", "tool", "command")
        .agg(
            F.max("attempts").alias("attempts"),
            F.sum("cost_ms").alias("cost_ms"),
            latest.alias("_latest"),
        )
        .select("scope", "tool", "command", "attempts", "cost_ms", "_latest.cwd", "_latest.ts")
    )
