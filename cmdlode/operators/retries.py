"""Retry chains: near-identical neighbours in a command history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlode.functions.redaction import redact
from cmdlode.functions.similarity import with_similar
from cmdlode.operators.ranking import top_per_group
from cmdlode.operators.sequence import linked_runs
from cmdlode.params import DEFAULTS, Params


def retry_chains(usage: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(scope, source, tool, cmd, attempts)``: chains of two or more attempts.

    Neighbours of one tool chain when they sit at most ``chain_window`` entries
    apart and look similar; the last command is the one that worked.
    """
    window, size = params.chain_window, params.bucket_rows

    def link(df: DataFrame, prev: str, cur: str, out: str) -> DataFrame:
        near = f"{cur}.pos - {prev}.pos <= {window}"
        return with_similar(df, f"{prev}.cmd", f"{cur}.cmd", out, near, params)

    edge = (F.col("first.pos") - F.col("bucket") * size < window) | (
        (F.col("bucket") + 1) * size - F.col("last.pos") <= window
    )
    runs = linked_runs(
        usage, ["scope", "source", "tool"], "pos", ["cmd"], link, F.col("n") >= 2, edge, params
    )
    return runs.select(
        "scope", "source", "tool", F.col("last.cmd").alias("cmd"), F.col("n").alias("attempts")
    )


def best_attempts(chains: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(scope, tool, command, attempts)``: longest chain per scrubbed command."""
    return (
        chains.select("scope", "tool", redact(F.col("cmd"), params.extra_rules).alias("command"), "attempts")
        .groupBy("scope", "tool", "command")
        .agg(F.max("attempts").alias("attempts"))
    )


def hard_won(chains: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``(scope, tool, rank, command, attempts)``: hardest commands per tool."""
    best = [F.col("attempts").desc(), F.col("command").asc()]
    return top_per_group(best_attempts(chains, params), ["scope", "tool"], best, params.max_hard_won)
