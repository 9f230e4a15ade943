"""Shell history formats.

Parsers take numbered lines ``(scope, source, line_no, line)`` and return
``commands(scope, source, pos, command)``; ``pos`` counts the kept commands of
a source from 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cmdlode.functions.text import compute_once, trim_ws
from cmdlode.operators.sequence import dense_positions
from cmdlode.params import DEFAULTS, Params
from cmdlode.sources.lines import counted_lines, scope_of

COMMANDS_SCHEMA = "scope string, source string, pos bigint, command string"
STATUS_SCHEMA = "scope string, source string, path string, n_lines bigint, error string"


def _positioned(kept: DataFrame, lines: DataFrame, params: Params, sizes: DataFrame | None = None) -> DataFrame:
    """Number what was kept; the lines, which are no fewer, tell which files are hot without parsing.

    ``sizes(scope, source, n)`` saves reading the lines for that.
    """
    if sizes is None:
        sizes = lines.groupBy("scope", "source").agg(F.count("*").alias("n"))
    bucket = F.floor(F.col("line_no") / F.lit(params.bucket_rows))
    placed = dense_positions(kept, ["scope", "source"], ["line_no"], bucket, "pos", params, sizes, F.col("line_no"))
    return placed.select("scope", "source", "pos", "command")


def bash_commands(lines: DataFrame) -> DataFrame:
    """One command per line; ``#<digits>`` lines are time stamps."""
    return compute_once(lines, command=trim_ws(F.col("line"))).where(
        (F.col("command") != "") & ~F.col("command").rlike(r"^#[0-9]+\z")
    )


def zsh_commands(lines: DataFrame) -> DataFrame:
    """Plain lines, or ``: <start>:<elapsed>;<command>``."""
    text = F.col("_text")
    after = F.expr("substring(_text, locate(';', _text) + 1)")
    extended = F.when(text.contains(";"), trim_ws(after))
    kept = compute_once(lines, _text=trim_ws(F.col("line")))
    kept = compute_once(kept, command=F.when(text.startswith(": "), extended).otherwise(text))
    return kept.where(F.col("command") != "").drop("_text")


def fish_commands(lines: DataFrame) -> DataFrame:
    """Only the ``- cmd: `` lines count."""
    mark = "- cmd: "
    kept = compute_once(lines, _text=trim_ws(F.col("line"))).where(F.col("_text").startswith(mark))
    kept = compute_once(kept, command=trim_ws(F.expr(f"substring(_text, {len(mark) + 1})")))
    return kept.where(F.col("command") != "").drop("_text")


def pwsh_commands(records: DataFrame) -> DataFrame:
    """Records of one or more lines, all but the last ending in a backtick."""
    bare = F.transform(F.split("line", "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    parts = F.transform(bare, lambda x: trim_ws(F.when(x.endswith("`"), F.left(x, F.length(x) - 1)).otherwise(x)))
    kept = compute_once(records, command=trim_ws(F.array_join(parts, " ")))
    return kept.where(F.col("command") != "")


def parse_bash(lines: DataFrame, params: Params = DEFAULTS, sizes: DataFrame | None = None) -> DataFrame:
    return _positioned(bash_commands(lines), lines, params, sizes)


def parse_zsh(lines: DataFrame, params: Params = DEFAULTS, sizes: DataFrame | None = None) -> DataFrame:
    return _positioned(zsh_commands(lines), lines, params, sizes)


def parse_fish(lines: DataFrame, params: Params = DEFAULTS, sizes: DataFrame | None = None) -> DataFrame:
    return _positioned(fish_commands(lines), lines, params, sizes)


def parse_pwsh(lines: DataFrame, params: Params = DEFAULTS, sizes: DataFrame | None = None) -> DataFrame:
    """Lines ending in a backtick continue on the next line.

    Continuations are joined inside buckets of line numbers; only the pieces at
    bucket ends meet in a second grouping.
    """
    keys = ["scope", "source"]
    open_end = F.col("line").endswith("`")
    part = trim_ws(F.when(open_end, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")))
    base = lines.select(
        *keys,
        F.floor(F.col("line_no") / F.lit(params.bucket_rows)).cast("bigint").alias("bucket"),
        "line_no",
        open_end.alias("_open"),
        part.alias("_part"),
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("line_no")
    # Null at the head of a bucket: not known yet whether it starts a command.
    begins = F.when(~F.lag("_open").over(inside), F.col("line_no"))
    marked = base.withColumn("_begins", begins).withColumn(
        "_start", F.last("_begins", ignorenulls=True).over(inside)
    )
    pieces = marked.groupBy(*keys, "bucket", "_start").agg(
        F.min("line_no").alias("line_no"),
        F.array_sort(F.collect_list(F.struct("line_no", "_part"))).alias("_parts"),
        F.max_by("_open", "line_no").alias("_open"),
    )
    # A piece can cross when it heads its bucket or ends open (only the last
    # piece of a bucket or of the file can).
    alone = F.when(F.col("_start").isNotNull() & ~F.col("_open"), F.col("_start"))
    across = Window.partitionBy(*keys, "_alone").orderBy("line_no")
    goes_on = F.coalesce(F.lag("_open").over(across), F.lit(False)) & F.col("_start").isNull()
    joined = (
        pieces.withColumn("_alone", alone)
        .withColumn("_head", F.when(~goes_on, F.col("line_no")))
        .withColumn("_head", F.last("_head", ignorenulls=True).over(across))
        .groupBy(*keys, "_alone", "_head")
        .agg(F.array_sort(F.flatten(F.collect_list("_parts"))).alias("_parts"))
    )
    text = F.array_join(F.transform("_parts", lambda p: p["_part"]), " ")
    kept = joined.select(*keys, F.col("_head").alias("line_no"), text.alias("_text"))
    kept = compute_once(kept, command=trim_ws(F.col("_text")))
    return _positioned(kept.where(F.col("command") != ""), lines, params, sizes)


# Line by line, for streams; of ``pwsh`` each row is a whole record.
COMMANDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pwsh": pwsh_commands,
    "bash": bash_commands,
    "zsh": zsh_commands,
    "fish": fish_commands,
}
PARSERS: dict[str, Callable[..., DataFrame]] = {
    "pwsh": parse_pwsh,
    "bash": parse_bash,
    "zsh": parse_zsh,
    "fish": parse_fish,
}


@dataclass(frozen=True)
class Probe:
    """One history location: a source name, its format and a path or glob."""

    source: str
    format: str
    path: str


# --- fixed values: name of each landed history --------------------------------
# As the shells name them, without the leading dot: Spark skips hidden files.
LANDED_HISTORIES = (
    ("pwsh", "ConsoleHost_history.txt"),
    ("bash", "bash_history"),
    ("zsh", "zsh_history"),
    ("fish", "fish_history"),
)
# ------------------------------------------------------------------------------


def discover(
    root: str, scoped: bool = True, landed: tuple[tuple[str, str], ...] = LANDED_HISTORIES
) -> list[Probe]:
    """Probes for histories landed below ``root``, in one ``scope=...`` folder per scope.

    ``landed`` names each history's format and its file, folder or glob there.
    """
    base = f"{root.rstrip('/')}/scope=*" if scoped else root.rstrip("/")
    return [Probe(name, name, f"{base}/{place}") for name, place in landed]


def read_history(spark: SparkSession, probe: Probe, params: Params = DEFAULTS) -> DataFrame:
    """``commands`` of one probe; broken files are left out."""
    return _read(spark, probe, params)[0]


def _read(spark: SparkSession, probe: Probe, params: Params, listed: dict | None = None) -> tuple[DataFrame, DataFrame]:
    lines, files, counted = counted_lines(spark, probe.path, listed=listed)
    lines = lines.withColumn("source", F.lit(probe.source))
    scope, source = scope_of(F.col("path")).alias("scope"), F.lit(probe.source).alias("source")
    status = files.select(scope, source, "path", "n_lines", "error")
    return PARSERS[probe.format](lines, params, counted.select(scope, source, "n")), status


def load_histories(
    spark: SparkSession, probes: list[Probe], params: Params = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """All readable files of all probes as ``(commands, status)``.

    ``status(scope, source, path, n_lines, error)`` has a row for each file. One that
    cannot be read to its end is left out whole and reported; the others are kept. A
    probe whose location does not exist has one row with its path and no scope.
    """
    commands = spark.createDataFrame([], COMMANDS_SCHEMA)
    status = spark.createDataFrame([], STATUS_SCHEMA)
    listed: dict = {}
    for probe in probes:
        try:
            read, files = _read(spark, probe, params, listed)
        except AnalysisException as problem:
            missing = [(None, probe.source, probe.path, 0, problem.getCondition() or str(problem))]
            status = status.unionByName(spark.createDataFrame(missing, STATUS_SCHEMA))
            continue
        commands, status = commands.unionByName(read), status.unionByName(files)
    return commands, status


def source_status(commands: DataFrame, status: DataFrame) -> DataFrame:
    """``status`` with ``n_commands`` of the file's scope and source, 0 where none was read."""
    counted = commands.groupBy("scope", "source").agg(F.count("*").alias("n_commands"))
    return status.join(counted, ["scope", "source"], "left").select(
        "scope", "source", "path", "n_lines", F.coalesce("n_commands", F.lit(0)).alias("n_commands"), "error"
    )
