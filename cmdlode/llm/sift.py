"""Bounded bitmaps of keys, and rows left out by such a bitmap before exact joins.

A bitmap has at most ``2**MOST_BITS`` bits (16 MB), whatever the number of keys, and is built
by an aggregate. It never misses a key of its set; other keys pass it rarely while it has
some bits a key, and more often beyond. So it only sifts: what passes is decided exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlode.llm.words import mix64
from cmdlode.session import discard, stored

MOST_BITS = 27
SPARE_BITS = 5  # 16 to 32 bits a key, as long as there are few
PROBES = 3


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bits of each key (as ``uint64``), one array for each probe."""
    with np.errstate(over="ignore"):
        first, step = mix64(keys), mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        return [(first + np.uint64(i) * step) >> np.uint64(64 - bits) for i in range(PROBES)]


@dataclass(frozen=True)
class Sift:
    bits: int
    table: Broadcast

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (64-bit integers) may be in the set."""
        found, table = np.ones(len(keys), dtype=bool), self.table.value
        for place in _places(keys.view(np.uint64), self.bits):
            found &= (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return found


def sift_of(keys: DataFrame, most_bits: int = MOST_BITS) -> Sift:
    """Bitmap of the only column of ``keys``, a bigint without nulls."""
    column = keys.columns[0]
    bits = max(6, min(most_bits, keys.count().bit_length() + SPARE_BITS))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            words = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(words.view(np.int64))], names=["at", "v"]
            )

    marked = keys.select(column).mapInArrow(marks, "at bigint, v bigint")
    found = marked.groupBy("at").agg(F.bit_or("v").alias("v")).toPandas()  # a row for each 64 bits at most
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[found["at"].to_numpy(dtype=np.int64)] = found["v"].to_numpy(dtype=np.int64).view(np.uint64)
    return Sift(bits, keys.sparkSession.sparkContext.broadcast(table))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``_id, _hash``: what decisions about rows go by. Rows alike in both have the same id and text."""
    return [F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash")]


def same_row(id_col: str = "_id", hash_col: str = "_hash") -> Column:
    """Join condition with a table whose row key is called ``id_col, hash_col``."""
    return F.col("_id").eqNullSafe(F.col(id_col)) & (F.col("_hash") == F.col(hash_col))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row`` with all columns, and its key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key(id_col, text_col))


def plain_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def without_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key ``_id, _hash`` is not in ``dropped``, which has each key once.

    Texts stay where they are: rows that a bitmap of the dropped keys does not know are kept at
    once. Of the others only the keys meet the dropped ones, and the few that were not dropped
    join their rows again.
    """
    sift = sift_of(dropped.select(F.xxhash64("_id", "_hash").alias("key")))

    @F.pandas_udf("boolean")
    def known(keys: pd.Series) -> pd.Series:
        return pd.Series(sift.holds(keys.to_numpy()))

    marked = keyed_rows(docs, id_col, text_col).withColumn("_known", known(F.xxhash64("_id", "_hash")))
    rest = marked.where("_known")
    gone = dropped.select(F.col("_id").alias("_gone_id"), F.col("_hash").alias("_gone_hash"))
    keys = rest.select("_id", "_hash").distinct().join(gone, same_row("_gone_id", "_gone_hash"), "left_anti")
    spared = stored(keys.select(F.col("_id").alias("_spared_id"), F.col("_hash").alias("_spared_hash")), "spared")
    kept = marked.where("not _known").select("_row")
    if spared.isEmpty():
        discard(spared)
    else:
        kept = kept.unionByName(rest.join(spared, same_row("_spared_id", "_spared_hash"), "left_semi").select("_row"))
    return plain_rows(kept, docs.columns)


def one_of_each(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each key ``_id, _hash`` in ``keys``; copies are combined before the shuffle."""
    wanted = keys.select(F.col("_id").alias("_one_id"), F.col("_hash").alias("_one_hash"))
    rows = keyed_rows(docs, id_col, text_col).join(wanted, same_row("_one_id", "_one_hash"), "left_semi")
    return plain_rows(rows.groupBy("_id", "_hash").agg(F.first("_row").alias("_row")), docs.columns)
