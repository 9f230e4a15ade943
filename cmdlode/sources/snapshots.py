"""Small tables replaced as a whole: victories and sheets.

Each write is a new snapshot folder, and after it a manifest beside it with the names and
sizes of its files. Readers take the newest snapshot that agrees with its manifest, which
takes a listing and no scan; pages carry checksums that are verified as they are read. So a
job that dies half-way, a file that is cut or lost, or a job that reads what it replaces,
loses nothing but the newest state.
"""

from __future__ import annotations

import json
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlode.operators.sheets import SHEET_SCHEMA
from cmdlode.store import entries, read_text, write_text

VICTORY_SCHEMA = (
    "scope string, tool string, rank int, cmd string, attempts bigint, cost_ms bigint, "
    "cwd string, ts timestamp"
)
_PREFIX, _MANIFEST = "snapshot=", "manifest="


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the entries below ``path`` with this prefix."""
    names = entries(spark, path)
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def _data_files(spark: SparkSession, path: str) -> dict[str, int]:
    """Sizes of the data files of a snapshot."""
    return {name: size for name, size in entries(spark, path).items() if not name.startswith(("_", "."))}


def write_snapshot(df: DataFrame, path: str) -> None:
    """Store ``df`` as the newest snapshot below ``path``."""
    spark, base = df.sparkSession, path.rstrip("/")
    number = max(_numbers(spark, path, _PREFIX) + _numbers(spark, path, _MANIFEST), default=0) + 1
    df.write.option("parquet.page.write-checksum.enabled", "true").parquet(f"{base}/{_PREFIX}{number}")
    write_text(spark, f"{base}/{_MANIFEST}{number}", json.dumps(_data_files(spark, f"{base}/{_PREFIX}{number}")))


def newest_snapshot(spark: SparkSession, path: str) -> int | None:
    """Number of the newest snapshot that is whole; null, with a warning, when none of them is."""
    base = path.rstrip("/")
    for number in reversed(_numbers(spark, path, _MANIFEST)):
        try:
            if json.loads(read_text(spark, f"{base}/{_MANIFEST}{number}")) == _data_files(spark, f"{base}/{_PREFIX}{number}"):
                return number
            problem = "differs from its manifest"
        except (Py4JJavaError, ValueError, TypeError) as error:
            problem = f"cannot be read ({type(error).__name__})"
        warnings.warn(f"snapshot {number} below {path} {problem}; the one before it is used", stacklevel=2)
    return None


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest snapshot that is whole; empty when there is none."""
    number = newest_snapshot(spark, path)
    if number is None:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true")
    return reader.parquet(f"{path.rstrip('/')}/{_PREFIX}{number}")


def read_victories(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path, VICTORY_SCHEMA)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path, SHEET_SCHEMA)


def export_markdown(sheets: DataFrame, path: str) -> None:
    """Sheets as text files, one folder per scope and tool, replacing earlier ones."""
    text = F.regexp_replace("markdown", r"\n\z", "")
    sheets.select("scope", "tool", text.alias("value")).write.mode("overwrite").partitionBy(
        "scope", "tool"
    ).text(path)
