"""Sinks that do per micro-batch what a plain stream cannot.

Each batch writes into folders of its own number, replacing what a failed attempt has
left there, so a batch that is run again changes nothing. What a batch needs from
the one before (the time reached, the folders that hold the result) is in a small file with
that batch's number, so nothing is listed; files two batches old go.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from cmdlode.functions.format import month_key
from cmdlode.operators.fights import journal_usage
from cmdlode.operators.suggest import failures, suggest, victories_by_tool
from cmdlode.params import DEFAULTS, Params
from cmdlode.session import discard, stored
from cmdlode.sources.journal import accepted, rejected, resolve_capture
from cmdlode.sources.snapshots import newest_snapshot, read_victories
from cmdlode.store import delete, read_text, write_text


def _each(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def _note(spark: SparkSession, path: str, number: int):
    """What the batch ``number`` has noted below ``path``; null if it has not."""
    text = read_text(spark, f"{path}/batch-{number}.json")
    return None if text is None else json.loads(text)


def _keep_note(spark: SparkSession, path: str, number: int, content) -> None:
    write_text(spark, f"{path}/batch-{number}.json", json.dumps(content))
    delete(spark, f"{path}/batch-{number - 2}.json")


def ingest_by_month(events: DataFrame, path: str, checkpoint: str, params: Params = DEFAULTS) -> DataStreamWriter:
    """Capture events to ``path/journal`` (``load=<batch>/month=<month>``) and ``path/rejected``.

    A batch is read and resolved once for both. Events without a time get that of their batch as
    the checkpoint has it, so a batch that is run again gives the same rows and months.
    """

    def write(batch: DataFrame, number: int) -> None:
        resolved = resolve_capture(batch, params).persist()
        rows = accepted(resolved, params).withColumn("month", month_key(F.col("ts")))
        rows.write.mode("overwrite").partitionBy("month").parquet(f"{path}/journal/load={number}")
        rejected(resolved).write.mode("overwrite").parquet(f"{path}/rejected/load={number}")
        resolved.unpersist()

    stamped = events.withColumn("ts", F.coalesce(F.col("ts"), F.current_timestamp()))
    return _each(stamped, checkpoint, write)


def split_late(journal: DataFrame, lateness: str, path: str, checkpoint: str) -> DataStreamWriter:
    """Rows by whether a watermark of ``lateness`` would discard them, to ``path/late=<true or false>``.

    A row is late if it lies further behind the latest row of all batches before its own
    than ``lateness``; this is the watermark's own rule. The source is read once: streams that
    order rows by a watermark read ``timely_rows`` of this path, and find none late there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, notes = batch.sparkSession, f"{path}/_clock"
        reached = _note(spark, notes, number - 1)
        limit = F.timestamp_micros(F.lit(reached).cast("bigint")) - F.expr(f"INTERVAL {lateness}")
        tagged = batch.withColumn("late", F.coalesce(F.col("ts") < limit, F.lit(False)))
        tagged = tagged.withColumn("batch", F.lit(number)).persist()
        latest = tagged.agg(F.unix_micros(F.max("ts"))).first()[0]
        for late in (False, True):
            rows = tagged.where(F.col("late") == F.lit(late)).drop("late")
            rows.write.mode("overwrite").parquet(f"{path}/late={str(late).lower()}/load={number}")
        tagged.unpersist()
        _keep_note(spark, notes, number, max((x for x in (reached, latest) if x is not None), default=None))

    return _each(journal, checkpoint, write)


def timely_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of the rows that ``split_late`` has found in time. A load is one folder of files; all files
    that have come are read in one batch, so its rows stay together."""
    return spark.readStream.schema(schema).parquet(f"{path}/late=false/load=*")


def fresh_suggestions(
    journal: DataFrame,
    victories_path: str,
    path: str,
    checkpoint: str,
    roots: DataFrame | None = None,
    params: Params = DEFAULTS,
) -> DataStreamWriter:
    """Suggestions from the newest victories at each micro-batch, below ``path``.

    A rebuild that stores new victories is seen by the next batch. Victories are brought into the
    form that failures join once for each snapshot; while it stays the newest, a batch lists its
    manifest and reads nothing of it but that form. For the rate limit, read ``path`` as a stream
    and pass it through ``stream_cooldown``.
    """
    held: dict[int | None, DataFrame] = {}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = newest_snapshot(spark, victories_path)
        if newest not in held:
            discard(*held.values())
            held.clear()
            held[newest] = stored(victories_by_tool(read_victories(spark, victories_path), roots, params), "bytool")
        failed = failures(journal_usage(batch, params), roots, params)
        suggest(failed, held[newest]).write.mode("overwrite").parquet(f"{path}/load={number}")

    return _each(journal, checkpoint, write)


# --- results kept by key ------------------------------------------------------

BUCKETS = 64


def merge_by_key(
    changes: DataFrame, keys: list[str], path: str, checkpoint: str, buckets: int = BUCKETS
) -> DataStreamWriter:
    """A result with one row a key, from a stream in update mode; read it with ``read_merged``.

    The result lies in hash buckets of the keys. A batch reads and writes the buckets that its rows
    touch, into a folder of its number; a note of the batch says which folder holds which bucket.
    A batch that is run again starts from the note before it, so it changes nothing. Folders that
    neither of the last two notes names go.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, notes = batch.sparkSession, f"{path}/_notes"
        base = {int(k): v for k, v in (_note(spark, notes, number - 1) or {}).items()}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.withColumn("_bucket", bucket).persist()
        touched = sorted(row["_bucket"] for row in rows.select("_bucket").distinct().collect())  # at most ``buckets``
        merged = rows
        old = [f"{path}/data/batch={base[b]}/_bucket={b}" for b in touched if b in base]
        if old:
            kept = spark.read.schema(batch.schema).parquet(*old)
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
            kept = kept.alias("o").join(batch.select(*keys).distinct().alias("n"), same, "left_anti")
            merged = rows.unionByName(kept.withColumn("_bucket", bucket))
        merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/batch={number}")
        rows.unpersist()
        before = _note(spark, notes, number - 2) or {}
        held = base | dict.fromkeys(touched, number)
        _keep_note(spark, notes, number, held)
        write_text(spark, f"{path}/_newest", json.dumps({"number": number, "schema": batch.schema.jsonValue()}))
        for folder in set(before.values()) - set(base.values()) - set(held.values()):
            delete(spark, f"{path}/data/batch={folder}")

    return _each(changes, checkpoint, write).outputMode("update")


def read_merged(spark: SparkSession, path: str) -> DataFrame | None:
    """The result of ``merge_by_key`` as of its last batch; null before the first one."""
    text = read_text(spark, f"{path}/_newest")
    if text is None:
        return None
    newest = json.loads(text)
    held = _note(spark, f"{path}/_notes", newest["number"])
    schema = StructType.fromJson(newest["schema"])
    folders = [f"{path}/data/batch={number}/_bucket={bucket}" for bucket, number in held.items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
