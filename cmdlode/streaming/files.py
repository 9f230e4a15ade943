"""Histories and journals as streams, while shells append to their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlode.sources.growing import stream_lines
from cmdlode.sources.histories import COMMANDS, Probe
from cmdlode.sources.journal import parse_journal


def stream_history(spark: SparkSession, probe: Probe, progress: str, max_bytes: int | None = None) -> DataFrame:
    """``commands(scope, source, pos, command)`` of a history as it grows.

    ``pos`` is the byte at which a command starts in its file, so it orders commands as the batch
    form's does, with gaps. A PowerShell command is complete when its last line is; the last
    line of a file counts once it is ended. ``progress`` is a folder of this stream alone.
    """
    continuation = "`" if probe.format == "pwsh" else ""
    lines = stream_lines(spark, probe.path, progress, continuation, max_bytes)
    kept = COMMANDS[probe.format](lines)
    return kept.select("scope", F.lit(probe.source).alias("source"), F.col("position").alias("pos"), "command")


def stream_journal(spark: SparkSession, path: str, progress: str, max_bytes: int | None = None) -> DataFrame:
    """Journal rows of JSON-lines files as they grow; ``seq`` is a row's byte in its file."""
    lines = stream_lines(spark, path, progress, max_bytes=max_bytes)
    return parse_journal(lines.withColumnRenamed("position", "line_no"))
