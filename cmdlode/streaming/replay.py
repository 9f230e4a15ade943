"""Run a streaming query over a stored log, in time order, to the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cmdlode.session import work_folder

ROWS_PER_SLICE = 20_000_000


def replay(
    log: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    rows_per_slice: int = ROWS_PER_SLICE,
    keys: list[str] | None = None,
    sink: Callable[[DataFrame, str], DataStreamWriter] | None = None,
) -> DataFrame | None:
    """The rows ``transform`` emits when ``log`` (with ``ts``) arrives as a stream.

    In ``append`` mode these are all rows. In ``update`` mode ``keys`` name the rows: every
    batch adds what it changed, with the number of the batch, and the newest row of each
    key counts. In ``complete`` mode every batch stores the whole result, and the last one
    counts. Results do not depend on how the log is sliced. A ``sink`` of the stream and a
    folder for its checkpoint replaces all this; then nothing is returned.

    The log is cut into slices of time of bounded size. One slice is made
    available at a time and the query runs until it is used up, so state passes
    from slice to slice and no batch holds more than a slice.
    """
    if mode == "update" and not keys and sink is None:
        raise ValueError("update mode needs the keys of its rows")
    spark = log.sparkSession
    folder = work_folder(spark, "replay")
    arrivals, staged, out = f"{folder}/arrivals", f"{folder}/staged", f"{folder}/out"
    micros = F.unix_micros("ts")
    size = log.count()
    slices = max(1, -(-size // rows_per_slice))
    if slices > 1:
        shares = [i / slices for i in range(1, slices)]
        cuts = log.select(F.percentile_approx(micros, shares, 100_000)).first()[0]
        slot = sum((F.when(micros > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
        log.withColumn("_slice", slot).write.partitionBy("_slice").parquet(staged)
    for number in range(slices):
        if slices == 1:
            part = log
        else:
            part = spark.read.parquet(staged).where(F.col("_slice") == number).drop("_slice")
        part.write.mode("append").parquet(arrivals)
        stream = transform(spark.readStream.schema(log.schema).parquet(arrivals))
        if sink is not None:
            sink(stream, f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
            continue
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
        writer = writer.option("checkpointLocation", f"{folder}/progress")
        if mode == "append":
            writer = writer.format("parquet").option("path", out)
        else:
            # A batch that is repeated after a failure replaces its own folder.
            writer = writer.foreachBatch(
                lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
            )
        writer.start().awaitTermination()
    if sink is not None:
        return None
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    batches = spark.read.parquet(out)
    if mode == "complete":
        last = batches.agg(F.max("batch")).first()[0]
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={last}")
    newest = batches.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_row"))
    return newest.select("_row.*")
