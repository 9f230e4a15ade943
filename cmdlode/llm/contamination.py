"""Benchmark decontamination by winnowing.

A *window* of an item is 13 consecutive words, or all its words if it has fewer. From
the hashes of its k-word runs a text keeps the least one of every w consecutive ones,
with ``k + w - 1`` equal to the window's length: the window's *print*. So a document that
holds a window has the same print there, and no shared window can be missed.

1. Items give windows with their prints. Equal windows of several items are one, and windows
   with the same items share one list of them. A bounded bitmap of the prints goes to workers.
2. One pass over the documents winnows each. Where the bitmap knows a print, the hit is extended
   to the window around it, which is kept as a hash. Most documents keep none, and no text is
   kept at all.
3. These windows join the items' windows on print and window. What is met, is merged into
   spans per document; items are listed by the windows met, one window for each list.

The benchmark may be of any size: it is broadcast nowhere, apart from the bitmap, which
only sifts. Items shorter than 13 words are winnowed at their own length, so documents
are winnowed once more for each such length that occurs (12 at most).

Defined results: a null text has no words; items without words have no windows. Null
ids are allowed and count as ``null``; an id given to several texts occurs if one of
them does. Repeated rows are judged alike, and rows that share an id only each by their
own text. Without documents there are no rows, without items no hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlode.llm.sift import Sift, row_key, same_row, sift_of, without_rows
from cmdlode.llm.words import WordHasher, gram_hashes, int_lists, lower_ascii, row_slices, texts_of
from cmdlode.session import discard, stored

WINDOW = 13
PERCENT = 5


def window_prints(words: np.ndarray, length: int) -> np.ndarray:
    """Print of every run of ``length`` words: the least hash of its k-word runs."""
    k = length - length // 3
    grams = gram_hashes(words, k)
    n = len(grams) - (length - k)
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    least = grams[:n]
    for i in range(1, length - k + 1):
        least = np.minimum(least, grams[i : i + n])
    return least


_WINDOWS = "item_id string, length int, window array<bigint>, print array<bigint>"


def _item_windows(most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher("alnum")
        for part in row_slices(batches, 500):
            texts = [hasher.hashes(lower_ascii(text)) for text in texts_of(part)]
            lengths = [min(most, len(words)) for words in texts]
            windows = [gram_hashes(words, n) if n else words for words, n in zip(texts, lengths)]
            prints = [window_prints(words, n) if n else words for words, n in zip(texts, lengths)]
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id"), pa.array(lengths, pa.int32()), int_lists(windows), int_lists(prints)],
                names=["item_id", "length", "window", "print"],
            )

    return run


_SIFTED = "_id bigint, _hash bigint, n_words bigint, at array<bigint>, length array<int>, window array<bigint>, print array<bigint>"


def _sift(lengths: list[int], prints: Sift) -> Callable:
    """Count words; keep the windows whose print the bitmap may know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher("alnum")
        for part in row_slices(batches, 500):
            counts, rows = [], []
            for text in texts_of(part):
                words = hasher.hashes(lower_ascii(text))
                counts.append(len(words))
                found = []
                for length in lengths:
                    own = window_prints(words, length)
                    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
                    known = np.repeat(prints.holds(own[heads]), np.diff(np.r_[heads, len(own)]))
                    at = np.flatnonzero(known)
                    if len(at):
                        found.append((at, np.full(len(at), length, np.int32), gram_hashes(words, length)[at], own[at]))
                rows.append([np.concatenate(column) for column in zip(*found)] if found else [None] * 4)
            at, sizes, windows, own = (list(column) for column in zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id"), part.column("_hash"), pa.array(counts, pa.int64()), pa.array(at, pa.list_(pa.int64())),
                    pa.array(sizes, pa.list_(pa.int32())), int_lists(windows), int_lists(own),
                ],
                names=["_id", "_hash", "n_words", "at", "length", "window", "print"],
            )

    return run


_SPANS = "_id bigint, _hash bigint, n_hit bigint, spans array<bigint>"


def merged(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """First word and word after each maximal stretch that windows cover, alternating."""
    order = np.argsort(at, kind="stable")
    starts, ends = at[order], np.maximum.accumulate((at + lengths)[order])
    first = np.r_[True, starts[1:] > ends[:-1]]
    last = np.r_[first[1:], True]
    return np.stack([starts[first], ends[last]], axis=1).ravel()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for found in batch.column("found"):
            parts = found.values
            spans.append(merged(parts.field("at").to_numpy(), parts.field("length").to_numpy()).astype(np.int64))
        hits = [int((s[1::2] - s[::2]).sum()) for s in spans]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_hash"), pa.array(hits, pa.int64()), pa.array(spans, pa.list_(pa.int64()))],
            names=["_id", "_hash", "n_hit", "spans"],
        )


def _owners(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``window, list`` for each distinct window, and ``list, item_id``.

    Windows of the same items get the same list, named after one of them. Sets of items are
    compared by their number and two independent 64-bit sums.
    """
    owners = stored(windows.select("length", "window", "print", "item_id").distinct(), "owners")
    signs = [F.bit_xor(F.xxhash64(F.lit(i), "item_id")).alias(f"sign{i}") for i in range(2)]
    signed = stored(owners.groupBy("length", "window", "print").agg(F.count("*").alias("n"), *signs), "signed")
    named = signed.groupBy("n", "sign0", "sign1").agg(F.min("window").alias("list"))
    lists = stored(signed.join(named, ["n", "sign0", "sign1"]).select("length", "window", "print", "list"), "lists")
    listed = owners.join(lists.where("window = list"), ["length", "window", "print"]).select("list", "item_id")
    discard(signed)
    return lists, listed


def judged_rows(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``_id, _hash, n_words, n_hit, items, spans, contaminated`` of every row."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id")
    raw = benchmark.select(item, "text").mapInArrow(_item_windows(window), _WINDOWS)
    windows = stored(
        raw.select("item_id", "length", F.inline(F.arrays_zip("window", "print"))).where("length > 0"), "windows"
    )
    lengths = sorted(row["length"] for row in windows.select("length").distinct().collect())  # at most ``window``
    prints = stored(windows.select("print").distinct(), "prints")
    lists, listed = _owners(windows)

    plain = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    sifted = stored(plain.mapInArrow(_sift(lengths, sift_of(prints)), _SIFTED), "sifted")
    discard(prints, windows)
    suspects = sifted.where("at is not null").dropDuplicates(["_id", "_hash"])
    places = suspects.select("_id", "_hash", F.inline(F.arrays_zip("at", "length", "window", "print")))
    met = stored(places.join(lists, ["print", "window", "length"]).select("_id", "_hash", "at", "length", "list"), "met")

    found = met.groupBy("_id", "_hash").agg(F.collect_list(F.struct("at", "length")).alias("found"))  # a document's own windows
    spans = found.mapInArrow(_merge, _SPANS)
    pairs = met.select("_id", "_hash", "list").distinct().join(listed, "list").select("_id", "_hash", "item_id").distinct()
    items = pairs.groupBy("_id", "_hash").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    items = items.select(F.col("_id").alias("_item_doc"), F.col("_hash").alias("_item_hash"), "items")
    hits = spans.join(items, same_row("_item_doc", "_item_hash"))
    hits = hits.select(F.col("_id").alias("_hit_id"), F.col("_hash").alias("_hit_hash"), "n_hit", "items", "spans")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.array()
    rows = sifted.select("_id", "_hash", "n_words").join(hits, same_row("_hit_id", "_hit_hash"), "left")
    return rows.select(
        "_id", "_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none.cast("array<string>")).alias("items"),
        F.coalesce("spans", none.cast("array<bigint>")).alias("spans"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: ``id, n_words, n_hit, items, spans, contaminated``.

    ``items`` are the ids of occurring items as strings, sorted; ``spans`` alternates
    the first word of each maximal hit stretch and the word after it.
    """
    rows = judged_rows(docs, benchmark, window, percent, id_col, text_col)
    return rows.withColumnRenamed("_id", id_col).drop("_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not contaminated; each is judged by its own text."""
    bad = judged_rows(docs, benchmark, id_col=id_col, text_col=text_col).where("contaminated")
    bad = stored(bad.select("_id", "_hash").distinct(), "contaminated")
    return without_rows(docs, bad, id_col, text_col)
