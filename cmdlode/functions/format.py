"""Text shown to people: durations, costs, status and suggestion lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def duration(ms: Column) -> Column:
    """``45s``, ``23m`` or ``1h05m``; always rounded towards zero."""
    seconds, minutes, hours = _div(ms, 1000), _div(ms, 60_000), _div(ms, 3_600_000)
    return (
        F.when(ms < 60_000, F.concat(seconds.cast("string"), F.lit("s")))
        .when(ms < 3_600_000, F.concat(minutes.cast("string"), F.lit("m")))
        .otherwise(F.format_string("%dh%02dm", hours, minutes % 60))
    )


def cost_note(certified: Column, cost_ms: Column) -> Column:
    """What a hard-won command cost; empty for inferred ones."""
    return (
        F.when(~certified, "")
        .when(cost_ms < 1000, " (certified)")
        .otherwise(F.concat(F.lit(" ("), duration(cost_ms), F.lit(" of fighting, certified)")))
    )


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def status_text(exit_code: Column) -> Column:
    return F.when(exit_code == 0, "ok").otherwise(F.concat(F.lit("exit "), exit_code.cast("string")))


def journal_line(ts: Column, shell: Column, exit_code: Column, dur_ms: Column, cmd: Column) -> Column:
    """One line of a journal listing."""
    return F.format_string(
        "%s  %-8s %-7s %6dms  %s",
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        shell,
        status_text(exit_code),
        dur_ms,
        cmd,
    )


def suggestion_line(cmd: Column, attempts: Column, cost_ms: Column) -> Column:
    """What to tell the user: the command, its attempts, its cost from 1 s on."""
    cost = F.when(cost_ms >= 1000, F.concat(F.lit(", "), duration(cost_ms))).otherwise("")
    return F.concat(
        F.lit("remembered → "), cmd,
        F.lit("   (won after "), attempts.cast("string"), F.lit(" attempts"), cost, F.lit(")"),
    )
