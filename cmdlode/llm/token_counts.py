"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once and counted by length, with partial counts before the
shuffle. What comes after works on the histogram, which has a row for each length that
occurs: suffix sums give, for every context limit at once, how many documents reach
it, how many tokens these hold, and the total if every document is cut at the limit.

Defined results: a null text has no tokens, like an empty one. An empty table has an
empty histogram; totals of it are 0 and quantiles null. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cmdlode.llm.tokenize import in_parts, read_vocabulary, shared_encoder


def encoded_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, keep: tuple[str, ...] = (), names_are_text: bool = True) -> DataFrame:
    """``keep`` columns and ``length`` (bigint), the number of ids of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = shared_encoder(shared.value, names_are_text)
        for batch in batches:
            width = encoder.dtype.itemsize
            lengths = [len(ids) // width for part in in_parts(batch["_text"]) for ids in encoder.encode(part)]
            yield batch.drop(columns="_text").assign(length=lengths)

    kept = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema if f.name != "_text")
    return kept.mapInPandas(count, f"{fields}length bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """``length, n_docs``."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def length_report(hist: DataFrame) -> DataFrame:
    """The histogram and, taking each length as a context limit:

    ``n_fit`` documents no longer than it, ``n_over`` longer ones, ``tokens_fit`` in the
    former, ``tokens_cut`` in all documents cut at it, ``total``, and ``quantile``, the share
    of documents up to it. The windows run over distinct lengths, not over documents.
    """
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    sums = (
        hist.withColumn("tokens", F.col("length") * F.col("n_docs"))
        .withColumn("n_fit", F.sum("n_docs").over(up))
        .withColumn("n_over", F.coalesce(F.sum("n_docs").over(down), F.lit(0).cast("bigint")))
        .withColumn("tokens_fit", F.sum("tokens").over(up))
        .withColumn("tokens_over", F.coalesce(F.sum("tokens").over(down), F.lit(0).cast("bigint")))
    )
    return sums.select(
        "length", "n_docs", "n_fit", "n_over", "tokens_fit",
        (F.col("tokens_fit") + F.col("length") * F.col("n_over")).alias("tokens_cut"),
        (F.col("tokens_fit") + F.col("tokens_over")).alias("total"),
        (F.col("n_fit") / (F.col("n_fit") + F.col("n_over"))).alias("quantile"),
    )


def at_limits(report: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, n_fit, n_over, tokens_fit, tokens_cut, total`` for any context limits."""
    asked = report.sparkSession.createDataFrame([(int(x),) for x in limits], "limit bigint")
    within = asked.join(report, F.col("length") <= F.col("limit"), "left")
    best = within.groupBy("limit").agg(F.max_by(F.struct("n_fit", "n_over", "tokens_fit"), "length").alias("at"))
    whole = report.agg(F.max("total").alias("total"), F.max(F.col("n_fit") + F.col("n_over")).alias("n")).first()
    total, n = whole["total"] or 0, whole["n"] or 0
    fit = lambda name, none: F.coalesce(F.col("at").getField(name), F.lit(none).cast("bigint"))
    return best.select(
        "limit", fit("n_fit", 0).alias("n_fit"), fit("n_over", n).alias("n_over"), fit("tokens_fit", 0).alias("tokens_fit"),
        (fit("tokens_fit", 0) + F.col("limit") * fit("n_over", n)).alias("tokens_cut"), F.lit(total).cast("bigint").alias("total"),
    )


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the least length that at least this share of documents does not exceed."""
    asked = report.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    reach = asked.join(report, F.col("quantile") >= F.col("share"), "left")
    return reach.groupBy("share").agg(F.min("length").alias("length"))
