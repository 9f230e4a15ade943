"""The journal of command outcomes: capture, store, read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlode.functions.format import month_key
from cmdlode.functions.redaction import redact
from cmdlode.functions.text import clip_bytes, compute_once, trim_ws
from cmdlode.params import DEFAULTS, Params
from cmdlode.sources.lines import read_lines, scope_of

JOURNAL_SCHEMA = (
    "scope string, seq bigint, ts timestamp, cmd string, exit int, dur_ms bigint, cwd string, shell string"
)
JOURNAL_STATUS = "scope string, path string, n_lines bigint, error string"
_LINE_SCHEMA = (
    "ts timestamp, cmd string, exit int, dur_ms bigint, cwd string, shell string, _corrupt string"
)
_ZERO_TIME = "0001-01-01 00:00:00"


def decode_b64(payload: Column) -> Column:
    """Text of a base64 payload; null when it is not valid. Line breaks in it do not count,
    padding must be complete."""
    packed = F.regexp_replace(trim_ws(payload), "[\r\n]+", "")
    strict = packed.rlike(r"^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(strict, F.try_to_binary(packed, F.lit("base64")).cast("string"))


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def resolve_capture(events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Capture events to ``text`` and ``cwd``; ``problem`` names what is wrong, or is null.

    Takes ``cmd_b64, stdin, cwd, cwd_b64`` beside any other columns. An encoded
    command wins over piped text, and is an error when it cannot be decoded. An
    encoded directory wins over the plain one, which is used when it cannot.
    """
    encoded, piped = F.col("cmd_b64"), F.col("stdin")
    text = F.when(_given(encoded), decode_b64(encoded)).otherwise(clip_bytes(piped, params.max_stdin_bytes))
    place = F.when(_given(F.col("cwd_b64")), decode_b64(F.col("cwd_b64")))
    problem = F.when(
        F.col("text").isNull(), F.when(_given(encoded), "invalid payload").otherwise("no command")
    )
    most = params.max_stdin_bytes
    piped_cut = F.lit(False) if most is None else ~_given(encoded) & (F.octet_length(piped) > most)
    return (
        compute_once(events, text=text, piped_cut=F.coalesce(piped_cut, F.lit(False)))
        .withColumn("cwd", F.coalesce(place, F.col("cwd"), F.lit("")))
        .withColumn("problem", problem)
        .drop("cmd_b64", "stdin", "cwd_b64")
    )


def rejected(resolved: DataFrame) -> DataFrame:
    """Capture events without a usable command."""
    return resolved.where(F.col("problem").isNotNull())


def accepted(resolved: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Journal rows of usable events: trimmed, cut, then scrubbed; empty ones dropped.

    Works on batches and streams. ``ts`` defaults to now. ``month`` is the
    storage partition. ``was_cut`` marks commands that a limit has shortened.
    """
    whole = trim_ws(F.col("text"))
    cut = clip_bytes(whole, params.max_cmd_bytes)
    over = F.lit(False) if params.max_cmd_bytes is None else F.octet_length(whole) > params.max_cmd_bytes
    return (
        compute_once(resolved.where(F.col("problem").isNull()), _cut=cut, _over=over)
        .where(F.col("_cut") != "")
        .withColumn("cmd", redact(F.col("_cut"), params.extra_rules))
        .withColumn("ts", F.coalesce(F.col("ts"), F.current_timestamp()))
        .withColumn("month", month_key(F.col("ts")))
        .withColumn("was_cut", F.col("piped_cut") | F.col("_over"))
        .drop("text", "problem", "piped_cut", "_cut", "_over")
    )


def append_journal(rows: DataFrame, path: str, format: str = "parquet") -> None:
    """Append accepted rows below ``path``, one folder per month."""
    rows.write.mode("append").partitionBy("month").format(format).save(path)


def parse_journal(lines: DataFrame) -> DataFrame:
    """Numbered JSON lines to journal rows; unusable lines are skipped.

    Absent fields read as zero values. Line numbers become ``seq``.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    row = F.when(F.ltrim(F.col("line"), F.lit(" \t\r\n")).startswith("{"), F.from_json("line", _LINE_SCHEMA, options))
    parsed = compute_once(lines.withColumnRenamed("line_no", "seq"), _row=row).where(F.col("_row._corrupt").isNull() & (F.col("_row.cmd") != ""))
    zero = F.lit(_ZERO_TIME).cast("timestamp")
    return parsed.select(
        "scope",
        "seq",
        F.coalesce("_row.ts", zero).alias("ts"),
        F.col("_row.cmd").alias("cmd"),
        F.coalesce("_row.exit", F.lit(0)).alias("exit"),
        F.coalesce("_row.dur_ms", F.lit(0).cast("bigint")).alias("dur_ms"),
        F.coalesce("_row.cwd", F.lit("")).alias("cwd"),
        F.coalesce("_row.shell", F.lit("")).alias("shell"),
    )


def load_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Journal rows of all JSON-lines files under ``path`` (a folder or glob of files), and their status.

    ``seq`` follows file name, then line, within each scope. ``status(scope, path, n_lines, error)``
    has a row for each file. One that cannot be read to its end is left out whole and reported. A
    missing location is an empty journal, with one row of its path and no scope.
    """
    try:
        lines, files = read_lines(spark, path, together=True)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        missing = spark.createDataFrame([(None, path, 0, problem.getCondition())], JOURNAL_STATUS)
        return spark.createDataFrame([], JOURNAL_SCHEMA), missing
    return parse_journal(lines), files.select(scope_of(F.col("path")).alias("scope"), "path", "n_lines", "error")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``load_journal``; ask that for what could not be read."""
    return load_journal(spark, path)[0]
