"""Words, lines and word hashes shared by the text operators.

A *word* is a maximal run outside ``[\\x20\\x09-\\x0D]``, in the JVM helpers as in
the byte helpers for Python workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \x09-\x0D]"
WORD_CHAR = r"[^ \x09-\x0D]"
_TRIMMED = " \t\n\x0b\x0c\r"

_PLACES = 64  # bytes of a word whose values come from a table
_SECTION = 1 << 20  # bytes whose values are held at once, and the rest of a word


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words; empty for an empty text. ``text`` must not be null."""
    trimmed = F.btrim(text, F.lit(_TRIMMED))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))


def count_words(text: Column) -> Column:
    """Number of words (bigint), 0 for null, without building the words.

    Every run of characters inside words becomes one character, then white space goes.
    """
    marks = F.regexp_replace(F.regexp_replace(text_or_empty(text), WORD_CHAR + "+", "x"), BLANK + "+", "")
    return F.length(marks).cast("bigint")


def row_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches of at most ``rows`` rows, to bound what a worker holds besides them."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    return (value.as_py() for value in batch.column(column))


def int_lists(values: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if v is None else v.view(np.int64) for v in values], pa.list_(pa.int64()))


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; nothing else changes."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def byte_class(is_word: str) -> np.ndarray:
    """Table of 256 flags: the bytes inside words, for ``blank`` or ``alnum`` words.

    ``blank`` words end at white space; ``alnum`` words end at every ASCII character
    that is neither digit nor letter. Bytes of other characters belong to words.
    """
    inside = np.ones(256, dtype=bool)
    if is_word == "blank":
        inside[[32, *range(9, 14)]] = False
    else:
        inside[:128] = False
        inside[[*range(48, 58), *range(97, 123)]] = True
    return inside


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _byte_values(places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A fixed random number for each byte at each place of a word."""
    return mix64((places.astype(np.uint64) << np.uint64(8) | codes) ^ np.uint64(0x9E3779B97F4A7C15))


class WordHasher:
    """64-bit hashes of all words of a text, computed over its bytes at once.

    Every byte stands for a random number of its own at its place in the word, as in tabulation
    hashing; a word's hash mixes their sum with its length. Sums come from one running sum.
    """

    def __init__(self, is_word: str):
        self.inside = byte_class(is_word)
        self._table = _byte_values(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256, dtype=np.uint64), _PLACES))

    def bounds(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of each word."""
        flags = self.inside[np.frombuffer(data, dtype=np.uint8)]
        edges = np.flatnonzero(np.diff(np.r_[False, flags, False].view(np.int8)))
        return edges[::2], edges[1::2]

    def hashes(self, data: bytes) -> np.ndarray:
        """Hashes of the words in order, computed for some words at a time to bound memory."""
        starts, ends = self.bounds(data)
        codes, before = np.frombuffer(data, dtype=np.uint8), np.cumsum(ends - starts)
        cuts = np.searchsorted(before, np.arange(0, len(data) + _SECTION, _SECTION))
        cuts = np.unique(np.r_[cuts, len(starts)])
        parts = [self._of_words(codes, starts[a:b], ends[a:b]) for a, b in zip(cuts, cuts[1:])]
        return np.concatenate([np.empty(0, dtype=np.uint64), *parts])

    def _of_words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        firsts = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
        codes = codes[places + np.repeat(starts, sizes)]
        values = self._table[np.minimum(places, _PLACES - 1) << 8 | codes]
        if sizes.max() > _PLACES:
            far = np.flatnonzero(places >= _PLACES)
            values[far] = _byte_values(places[far], codes[far].astype(np.uint64))
        with np.errstate(over="ignore"):
            return mix64(np.add.reduceat(values, firsts) ^ sizes.astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
        return mix64(out)
