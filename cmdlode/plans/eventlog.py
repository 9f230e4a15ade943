"""A command log derived from the ``events`` table.

One user is one scope. Every event becomes one command with its outcome, so the
log grows with the table. The texts make wrappers, noise, help lookups, secrets
and both path styles occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlode.operators.sequence import dense_positions
from cmdlode.params import DEFAULTS, Params

SHELLS = ("bash", "zsh", "fish", "pwsh")
TOOLS = ("git", "docker", "npm", "kubectl", "curl", "ls", "man")
TASKS = ("run", "runs", "logs")


def _pick(words: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def _command(user: Column, event: Column) -> Column:
    tool, number = _pick(TOOLS, user % 7), (event % 10).cast("string")
    page = F.when(event % 19 == 0, "man").otherwise(F.concat(F.lit("man "), _pick(TOOLS, event % 5)))
    asked = F.when(event % 17 == 0, " --help").otherwise("")
    plain = F.concat(tool, F.lit(" "), _pick(TASKS, event % 3), F.lit(" --k "), number, asked)
    wrapper = F.when(event % 11 == 0, "sudo ").otherwise("")
    secret = F.when(event % 13 == 0, F.concat(F.lit("API_TOKEN=t"), event.cast("string"), F.lit(" ")))
    return F.concat(wrapper, F.coalesce(secret, F.lit("")), F.when(tool == "man", page).otherwise(plain))


def _directory(user: Column, event: Column) -> Column:
    who, proj = (user % 50).cast("string"), (event % 3).cast("string")
    return (
        F.when(event % 4 == 0, F.concat(F.lit("C:\\Users\\U"), who, F.lit("\\Proj"), proj, F.lit("\\src")))
        .when(event % 4 == 1, F.concat(F.lit("/mnt/c/Users/u"), who, F.lit("/proj"), proj, F.lit("/src/")))
        .when(event % 4 == 2, F.concat(F.lit("/home/u"), who, F.lit("/proj"), proj))
        .otherwise("")
    )


def event_rows(events: DataFrame) -> DataFrame:
    """Log rows without ``seq``; works on a stream as well."""
    user, event = F.col("user_id"), F.col("event_id")
    return events.select(
        user.cast("string").alias("scope"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        _command(user, event).alias("cmd"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("dur_ms"),
        _directory(user, event).alias("cwd"),
        _pick(SHELLS, user % 4).alias("shell"),
    )


def event_log(spark: SparkSession, sf_dir: str, params: Params = DEFAULTS) -> DataFrame:
    """``journal`` rows (plus ``event_id``), numbered by time within each scope."""
    rows = event_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    hour = F.floor(F.unix_micros("ts") / F.lit(3_600_000_000))
    return dense_positions(rows, ["scope"], ["ts", "event_id"], hour, "seq", params, place=F.unix_micros("ts"))


def as_commands(log: DataFrame) -> DataFrame:
    """The same log as a shell history: ``commands(scope, source, pos, command)``."""
    return log.select(
        "scope", F.col("shell").alias("source"), F.col("seq").alias("pos"), F.col("cmd").alias("command")
    )


def project_roots(log: DataFrame) -> DataFrame:
    """``roots(scope, root)``: the project folder of every Windows-style directory."""
    return (
        log.where(F.col("cwd").startswith("C:"))
        .select("scope", F.regexp_replace("cwd", r"\\src\z", "").alias("root"))
        .distinct()
    )
