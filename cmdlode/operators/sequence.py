"""Runs of linked neighbours in ordered data, without one task per key.

A plain window over a key would bring all of a hot key's rows into one task.
Here the sequence is first cut into buckets of the order column. Runs are found
inside each bucket, and only the runs at bucket ends meet in a second window
that joins those which continue across a boundary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cmdlode.params import DEFAULTS, Params
from cmdlode.session import discard, stored

# link(df, prev, cur, out): add boolean ``out``, true where the row struct
# ``cur`` continues the run that the row struct ``prev`` belongs to.
Link = Callable[[DataFrame, str, str, str], DataFrame]


def linked_runs(
    rows: DataFrame,
    keys: list[str],
    order: str,
    fields: list[str],
    link: Link,
    keep: Column,
    may_cross: Column | None = None,
    params: Params = DEFAULTS,
) -> DataFrame:
    """Maximal runs of linked neighbours, one row per kept run.

    ``order`` is a BIGINT, unique within ``keys``. The result has ``keys``,
    ``n`` and the structs ``first`` and ``last`` of the run's end rows
    (``fields`` plus ``order``). ``keep`` selects runs by these columns.
    ``may_cross`` may name, by the same columns plus ``bucket``, the partial
    runs at a bucket end that can continue at all; by default all can.
    """
    cur = F.struct(F.col(order), *[F.col(f) for f in fields if f != order]).alias("_cur")
    bucket = F.floor(F.col(order) / F.lit(params.bucket_rows)).cast("bigint")
    base = rows.select(*keys, bucket.alias("bucket"), cur)

    # Inside buckets.
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.col(f"_cur.{order}"))
    stepped = base.withColumn("_prev", F.lag("_cur").over(inside)).withColumn(
        "_row", F.row_number().over(inside)
    )
    linked = link(stepped, "_prev", "_cur", "_linked").drop("_prev")
    starts = linked.withColumn("_starts", ~F.coalesce(F.col("_linked"), F.lit(False)))
    opened = F.when(F.col("_starts"), F.struct(F.col("_row").alias("row"), F.col("_cur").alias("cur")))
    marked = starts.withColumn(
        "_open", F.last(opened, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_next_starts", F.lead("_starts").over(inside))
    pieces = marked.where(F.coalesce(F.col("_next_starts"), F.lit(True))).select(
        *keys,
        "bucket",
        (F.col("_row") - F.col("_open.row") + 1).cast("bigint").alias("n"),
        F.col("_open.cur").alias("first"),
        F.col("_cur").alias("last"),
        ((F.col("_open.row") == 1) | F.col("_next_starts").isNull()).alias("_at_end"),
    )
    crossing = F.col("_at_end") if may_cross is None else F.col("_at_end") & may_cross
    pieces = pieces.withColumn("_crossing", crossing).where(F.col("_crossing") | keep)

    # Across buckets. Finished runs keep a group of their own, so that a hot
    # key only brings its bucket ends together.
    alone = F.when(~F.col("_crossing"), F.col(f"first.{order}"))
    pieces = pieces.withColumn("_alone", alone).drop("_at_end")
    across = Window.partitionBy(*keys, "_alone").orderBy(F.col(f"first.{order}"))
    met = pieces.withColumn("_before", F.lag("last").over(across)).withColumn(
        "_cum", F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, 0))
    )
    # Two pieces of one bucket were already found apart.
    apart = F.lag("bucket").over(across) == F.col("bucket")
    met = met.withColumn("_prev", F.when(~apart, F.col("_before"))).drop("_before")
    joined = link(met, "_prev", "first", "_linked").drop("_prev")
    joined = joined.withColumn("_starts", ~F.coalesce(F.col("_linked"), F.lit(False)))
    opened = F.when(
        F.col("_starts"), F.struct((F.col("_cum") - F.col("n")).alias("base"), F.col("first").alias("cur"))
    )
    joined = joined.withColumn(
        "_open", F.last(opened, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_next_starts", F.lead("_starts").over(across))
    return (
        joined.where(F.coalesce(F.col("_next_starts"), F.lit(True)))
        .select(
            *keys,
            (F.col("_cum") - F.col("_open.base")).cast("bigint").alias("n"),
            F.col("_open.cur").alias("first"),
            F.col("last"),
        )
        .where(keep)
    )


# Hot keys are broadcast up to this many; each is a key value and a flag.
_BROADCAST_KEYS = 50_000


def hot_keys(rows: DataFrame, keys: list[str], params: Params = DEFAULTS) -> DataFrame:
    """Keys with more rows than one task should sort; there are few by definition."""
    return rows.groupBy(*keys).count().where(F.col("count") > params.hot_key_rows).select(*keys)


_MOST_CUTS = 255
_ACCURACY = 10_000


def _ranges(split: DataFrame, keys: list[str], place: Column | None, params: Params) -> DataFrame:
    """Add ``_range`` to rows with ``_hot`` and ``_bucket``: 0, or the part of a bucket with very many rows.

    Such buckets are cut at quantiles of ``place``, into parts of about equally many rows.
    """
    if place is None:
        return split.withColumn("_range", F.lit(0))
    within = [*keys, "_bucket"]
    full = split.where("_hot").groupBy(*within).agg(F.count("*").alias("_n")).where(F.col("_n") > params.hot_key_rows)
    full = stored(full, "full")
    found = full.agg(F.count("*").alias("buckets"), F.max("_n").alias("most")).first()
    if found["buckets"] == 0:
        discard(full)
        return split.withColumn("_range", F.lit(0))
    parts = min(_MOST_CUTS + 1, -(-4 * found["most"] // max(1, params.hot_key_rows)))
    shares, small = [i / parts for i in range(1, parts)], found["buckets"] <= _BROADCAST_KEYS
    placed = split.withColumn("_place", place)
    sample = placed.where("_hot").join(F.broadcast(full) if small else full, within)
    cuts = sample.groupBy(*within).agg(F.percentile_approx("_place", shares, _ACCURACY).alias("_cuts"))
    cuts = stored(cuts, "cuts")
    joined = placed.join(F.broadcast(cuts) if small else cuts, within, "left")
    part = F.size(F.filter("_cuts", lambda cut: cut < F.col("_place")))
    return joined.withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts", "_place")


def dense_positions(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    out: str,
    params: Params = DEFAULTS,
    sizes: DataFrame | None = None,
    place: Column | None = None,
) -> DataFrame:
    """Number the rows of each key from 0 in the given order.

    A count per key, which reads only the key columns, looks for hot keys first. A table
    ``sizes`` of the keys and ``n``, no less than the rows of each, saves that count.
    Without any, one window does. Otherwise hot keys are numbered per ``bucket``
    (a BIGINT that never decreases along the order) and shifted by the size of
    the buckets before it; all other keys form one bucket. ``place``, a finer BIGINT of that
    kind, lets a bucket with very many rows be cut further; only rows of one place stay together.
    """
    if sizes is None:
        hot = hot_keys(rows, keys, params)
    else:
        hot = sizes.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") > params.hot_key_rows).select(*keys)
    found = hot.limit(_BROADCAST_KEYS + 1).count()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if found == 0:
        return rows.withColumn(out, (number - 1).cast("bigint"))
    hot = stored(hot, "hot").withColumn("_hot", F.lit(True))
    if found <= _BROADCAST_KEYS:
        hot = F.broadcast(hot)
    split = rows.join(hot, keys, "left").withColumn(
        "_bucket", F.when(F.col("_hot"), bucket).otherwise(F.lit(0)).cast("bigint")
    )
    split = _ranges(split, keys, place, params)
    sizes = split.where(F.col("_hot")).groupBy(*keys, "_bucket", "_range").count()
    before = Window.partitionBy(*keys).orderBy("_bucket", "_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_bucket", "_range", F.sum("count").over(before).alias("_shift"))
    number = F.row_number().over(Window.partitionBy(*keys, "_bucket", "_range").orderBy(*order))
    return (
        split.join(shifts, [*keys, "_bucket", "_range"], "left")
        .withColumn(out, (number - 1 + F.coalesce(F.col("_shift"), F.lit(0))).cast("bigint"))
        .drop("_hot", "_bucket", "_range", "_shift")
    )
