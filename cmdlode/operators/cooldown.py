"""Rate limit: speak at most once per key and cooldown.

Greedy: only a row that is let through restarts the clock, so whether a row
passes depends on all rows before it. The work is still split:

* After an hour (bucket) without rows the next row always passes. Stretches
  between such pauses are independent.
* A short stretch is folded as one sorted array.
* A long stretch is never brought into one task. Every row has one successor,
  the first row at least a cooldown later. The rows that pass are the chain of
  successors of the first one, found by doubling the step each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cmdlode.params import DEFAULTS, Params
from cmdlode.session import stored

# A stretch of up to this many distinct instants is folded in one array.
FOLD_ROWS = 10_000
_CELLS = 60


def apply_cooldown(
    rows: DataFrame,
    keys: list[str],
    ts: str = "ts",
    order: str = "seq",
    params: Params = DEFAULTS,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """The rows that pass, per ``keys`` in (``ts``, ``order``) order.

    ``order`` is unique within ``keys``.
    """
    width = params.cooldown_s * 1_000_000
    rows = stored(rows, "limited")  # read twice: for the instants and for the result
    # Of rows at one instant only the first can pass.
    instants = (
        rows.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), order)
        .groupBy(*keys, "_t")
        .agg(F.min(order).alias(order))
    )
    instants = stored(instants.withColumn("_hour", _floor(F.col("_t"), width)), "instants")
    hours = instants.groupBy(*keys, "_hour").agg(F.count("*").alias("_n"))
    by_hour = Window.partitionBy(*keys).orderBy("_hour")
    paused = F.coalesce(F.col("_hour") - F.lag("_hour").over(by_hour) > 1, F.lit(True))
    stretches = hours.withColumn("_opens", F.when(paused, F.col("_hour"))).withColumn(
        "_stretch", F.last("_opens", ignorenulls=True).over(by_hour)
    )
    size = F.sum("_n").over(Window.partitionBy(*keys, "_stretch"))
    stretches = stretches.withColumn("_size", size).drop("_n", "_opens")
    placed = instants.join(stretches, [*keys, "_hour"])
    passed = _fold(placed.where(F.col("_size") <= fold_rows), keys, order, width)
    if not stretches.where(F.col("_size") > fold_rows).isEmpty():
        long = placed.where(F.col("_size") > fold_rows).select(*keys, "_t", "_stretch", order)
        passed = passed.unionByName(_follow(stored(long, "stretches"), keys, order, width))
    return rows.join(passed, [*keys, order], "left_semi")


def _floor(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("bigint")


def _fold(placed: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """Walk each short stretch as an array: ``keys`` and ``order`` of rows that pass."""
    times = F.array_sort(F.collect_list(F.struct("_t", F.col(order).alias("id"))))
    none = F.array().cast("array<struct<_t:bigint,id:bigint>>")

    def step(done: Column, row: Column) -> Column:
        early = row["_t"] - F.element_at(done, -1)["_t"] < width
        return F.when((F.size(done) > 0) & early, done).otherwise(F.array_append(done, row))

    walked = placed.groupBy(*keys, "_stretch").agg(F.aggregate(times, none, step).alias("_passed"))
    return walked.select(*keys, F.explode("_passed").alias("_row")).select(
        *keys, F.col("_row.id").alias(order)
    )


def successors(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys, _t, _to``: the first instant at least ``width`` later, if any.

    Instants and the points they look for meet in small time cells; what a cell
    cannot answer comes from the first instant of the next filled cell.
    """
    cell = max(1, width // _CELLS)
    found = rows.select(
        *keys, F.col("_t").alias("_at"), F.col("_t").alias("_found"), F.lit(None).cast("bigint").alias("_t")
    )
    asked = rows.select(
        *keys, (F.col("_t") + width).alias("_at"), F.lit(None).cast("bigint").alias("_found"), "_t"
    )
    both = found.unionByName(asked).withColumn("_cell", _floor(F.col("_at"), cell))
    # Latest first, instants before questions at the same point.
    back = (
        Window.partitionBy(*keys, "_cell")
        .orderBy(F.col("_at").desc(), F.col("_found").isNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    answered = both.withColumn("_here", F.last("_found", ignorenulls=True).over(back))
    firsts = both.groupBy(*keys, "_cell").agg(F.min("_found").alias("_first"))
    later = (
        Window.partitionBy(*keys).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    onward = firsts.select(
        *keys, "_cell", F.last("_first", ignorenulls=True).over(later).alias("_next")
    )
    return (
        answered.where(F.col("_t").isNotNull())
        .join(onward, [*keys, "_cell"])
        .select(*keys, "_t", F.coalesce("_here", "_next").alias("_to"))
        .where(F.col("_to").isNotNull())
    )


def _follow(rows: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """Follow successors from the start of each long stretch, doubling the step.

    After round r every passing row of rank below 2^r is known. Only jumps that
    can still be used are kept: from known rows and from rows jumped to.
    """
    start = rows.groupBy(*keys, "_stretch").agg(F.min("_t").alias("_t"))
    known = stored(start.select(*keys, "_t"), "known")
    jumps = stored(successors(rows, keys, width), "jumps")
    while True:
        onto = jumps.join(known, [*keys, "_t"]).select(*keys, F.col("_to").alias("_t")).distinct()
        fresh = stored(onto.join(known, [*keys, "_t"], "left_anti"), "fresh")
        if fresh.isEmpty():
            break
        known = stored(known.unionByName(fresh), "known")
        landed = jumps.select(*keys, F.col("_to").alias("_t"))
        useful = landed.unionByName(known).distinct()
        # A step of the doubled jump starts at a useful row and ends where the
        # jump from its landing place ends.
        second = jumps.select(*keys, F.col("_t").alias("_to"), F.col("_to").alias("_end"))
        jumps = stored(
            jumps.join(useful, [*keys, "_t"], "left_semi")
            .join(second, [*keys, "_to"])
            .select(*keys, "_t", F.col("_end").alias("_to")),
            "jumps",
        )
    return rows.join(known, [*keys, "_t"], "left_semi").select(*keys, order)
