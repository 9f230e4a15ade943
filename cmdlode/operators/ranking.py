"""Top rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, out: str = "rank"
) -> DataFrame:
    """The first ``limit`` rows of each group, numbered from 1 in ``out``.

    Catalyst turns the filter on the row number into a group limit before the
    shuffle, so a hot group sends at most ``limit`` rows per task.
    """
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= limit)
