"""Vector compression: each quarter of a vector becomes the index of its nearest codebook entry.

Components become integers, so every distance, sum and mean is exact and results do not
depend on the order of rows or tasks.

1. Each part of each vector gets its place on a Hilbert curve. Parts are dealt out by range
   of that place, in order, and cut into flat *blocks* of at most ``BLOCK`` rows: the
   integers of its rows, and per dimension their least, their greatest and their sum.
2. A round reads the blocks once. From a block's box each entry has a least and a greatest
   squared distance to whatever lies inside; entries whose least exceeds the smallest
   greatest cannot be nearest to any row. What remains is the block's *shortlist*. With one
   entry in it the block's stored sum is used and no row is looked at; else the rows are
   compared with the shortlist only. Tasks add up their rows by entry, Spark adds up tasks.
3. After the last round the same shortlists give every row its entry and distance.

Only codebooks travel (4 x 256 entries of a quarter vector). Repeated vectors are separate
rows and spread over blocks, as blocks are also dealt by row number.

Defined results: rows whose vector is null or holds a null, a NaN or an infinity are dropped.
Components are held within ``+-2**24`` after scaling, so no sum overflows. Vectors shorter than
the longest are read as if zeros followed, also where the length is no multiple of four. With
fewer than 256 rows codebooks have as many entries as there are rows. The first entries are
those of the least ids, null ids last, equal ids by their components. A label's error includes
all rows with this label, null labels together; it is null if it passes 64 bits. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlode.session import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 64
_LIMIT = 1 << 24
_KEY_BITS = 63


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers below ``2**bits``.

    Works on the bit planes of all rows at once, from the highest: a set bit inverts the
    lower bits of the first axis, a clear one swaps them with the first axis; then the Gray
    code of the axes is read off plane by plane.
    """
    axes = [column.astype(np.uint64) for column in cells.T]
    one = np.uint64(1)
    for plane in range(bits - 1, 0, -1):
        lower = (one << np.uint64(plane)) - one
        for i, axis in enumerate(axes):
            is_set = (axis >> np.uint64(plane)) & one > 0
            swap = np.where(is_set, 0, (axes[0] ^ axis) & lower).astype(np.uint64)
            axes[0] = np.where(is_set, axes[0] ^ lower, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), dtype=np.uint64)
    for plane in range(bits - 1, 0, -1):
        is_set = (axes[-1] >> np.uint64(plane)) & one > 0
        turn ^= np.where(is_set, (one << np.uint64(plane)) - one, 0).astype(np.uint64)
    places = np.zeros(len(cells), dtype=np.uint64)
    for plane in range(bits - 1, -1, -1):
        for axis in axes:
            places = (places << one) | (((axis ^ turn) >> np.uint64(plane)) & one)
    return places


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``row, vec_id, label, v`` of the rows that are kept, ``v`` as integers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = lambda x: F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), F.floor(x.cast("double") * SCALE))).cast("int")
    kept = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    kept = kept.where(F.col("v").isNotNull()).where(~F.coalesce(F.exists("v", bad), F.lit(True)))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", whole).alias("v"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, zeros behind short ones."""
    offsets = vectors.offsets.to_numpy()
    lengths = np.diff(offsets)
    flat = vectors.values.to_numpy()[offsets[0] : offsets[-1]]
    if (lengths == width).all():
        return flat.reshape(len(lengths), width).astype(np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _places(width: int, low: int, high: int) -> Callable:
    """Parts of vectors with their place: ``part, place, row, x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = min(width, _KEY_BITS)
        bits = max(1, min(8, _KEY_BITS // axes))
        for batch in batches:
            parts = _matrix(batch.column("v"), PARTS * width).reshape(batch.num_rows * PARTS, width)
            cells = ((parts[:, :axes] - low) << bits) // (high - low + 1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, parts.size + 1, width, dtype=np.int32)), pa.array(parts.ravel().astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(PARTS, dtype=np.int32), batch.num_rows)),
                    pa.array(hilbert_places(cells, bits).astype(np.int64)),
                    pa.array(np.repeat(batch.column("row").to_numpy(), PARTS)),
                    lists,
                ],
                names=["part", "place", "row", "x"],
            )

    return run


_BLOCKS = "part int, low array<bigint>, high array<bigint>, total array<bigint>, rows array<bigint>, flat binary"


def _blocks(width: int, block: int) -> Callable:
    """Ordered parts to blocks; a block ends with its batch or part at the latest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            x = _matrix(batch.column("x"), width)
            cuts = np.flatnonzero(np.diff(parts)) + 1
            bounds = [0, *cuts.tolist(), len(parts)]
            spans = [(i, min(i + block, b)) for a, b in zip(bounds, bounds[1:]) for i in range(a, b, block)]
            own = [x[a:b] for a, b in spans]
            lists = lambda values: pa.array(values, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(parts[a]) for a, _ in spans], pa.int32()),
                    lists([o.min(axis=0) for o in own]),
                    lists([o.max(axis=0) for o in own]),
                    lists([o.sum(axis=0) for o in own]),
                    lists([rows[a:b] for a, b in spans]),
                    pa.array([o.astype("<i4").tobytes() for o in own], pa.binary()),
                ],
                names=["part", "low", "high", "total", "rows", "flat"],
            )

    return run


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Indices of the entries that can be nearest to a point of the box, ascending."""
    gap = np.maximum(np.maximum(low - book, book - high), 0)
    reach = np.maximum(np.abs(book - low), np.abs(book - high))
    return np.flatnonzero((gap * gap).sum(axis=1) <= (reach * reach).sum(axis=1).min())


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lower one of equals, and the squared distance.

    Products are taken in doubles if all sums stay below 2**53, where they are exact, and else
    in 64-bit integers.
    """
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    far = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best].astype(np.int64)


class _Block:
    """One row of the table of blocks, with the entries that its rows can have."""

    def __init__(self, batch: pa.RecordBatch, i: int, books: np.ndarray):
        value = lambda name: batch.column(name)[i].values.to_numpy()
        self.part = batch.column("part")[i].as_py()
        self.book = books[self.part]
        self.total, self.rows = value("total"), value("rows")
        self.entries = shortlist(value("low"), value("high"), self.book)
        self._flat = batch.column("flat")[i]

    def vectors(self) -> np.ndarray:
        return np.frombuffer(self._flat.as_buffer(), dtype="<i4").reshape(len(self.rows), -1).astype(np.int64)

    def assigned(self) -> tuple[np.ndarray, np.ndarray]:
        best, far = nearest(self.vectors(), self.book[self.entries])
        return self.entries[best], far

    def add_to(self, counts: np.ndarray, sums: np.ndarray) -> None:
        if len(self.entries) == 1:
            counts[self.part, self.entries[0]] += len(self.rows)
            sums[self.part, self.entries[0]] += self.total
            return
        index, _ = self.assigned()
        np.add.at(counts[self.part], index, 1)
        np.add.at(sums[self.part], index, self.vectors())


def _sums(books: np.ndarray) -> Callable:
    """A task's rows by entry: ``part, entry, n, total``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _Block(batch, i, books).add_to(counts, sums)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)),
                pa.array(entry.astype(np.int32)),
                pa.array(counts[part, entry]),
                pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "total"],
        )

    return run


def _assign(books: np.ndarray) -> Callable:
    """Every part's entry: ``row, part, entry, error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, books)
                entry, far = block.assigned()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.rows),
                        pa.array(np.full(len(entry), block.part, dtype=np.int32)),
                        pa.array(entry.astype(np.int32)),
                        pa.array(far),
                    ],
                    names=["row", "part", "entry", "error"],
                )

    return run


def first_books(kept: DataFrame, width: int, entries: int) -> np.ndarray:
    """Parts of the rows with the least ids, as ``part, entry, dimension``."""
    least = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    vectors = np.zeros((len(least), PARTS * width), dtype=np.int64)
    for i, row in enumerate(least):
        vectors[i, : len(row["v"])] = row["v"]
    return vectors.reshape(len(least), PARTS, width).transpose(1, 0, 2).copy()


def train(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds: each entry the floored mean of its parts; unused ones stay."""
    width = books.shape[2]
    totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(books), "part int, entry int, n bigint, total array<bigint>")
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals)
        books = books.copy()
        for row in found.collect():  # as many rows as codebooks have entries
            books[row["part"], row["entry"]] = [row[f"t{i}"] // row["n"] for i in range(width)]
    return books


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and position, comma-joined."""
    return ",".join(map(str, books.ravel().tolist()))


def decoded(code: Column, books: np.ndarray) -> Column:
    """The vector that a code of ``compress`` stands for, in the scale of the input."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    index = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    parts = F.flatten(F.array(*[entries[p][index(p)] for p in range(PARTS)]))
    return F.transform(parts, lambda x: x / F.lit(float(SCALE)))


def compress(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of every kept row, and the codebooks.

    ``code`` has two hex digits for each part, ``error`` is the squared distance in scaled
    integers. Runs Spark jobs: one that writes the blocks and one for each round.
    """
    kept = stored(integer_vectors(table, id_col, vector_col, label_col), "vectors")
    seen = kept.agg(
        F.max(F.size("v")).alias("size"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")
    ).first()
    width = max(1, -(-(seen["size"] or 0) // PARTS))
    low, high = min(0, seen["low"] or 0), max(0, seen["high"] or 0)  # zeros may follow short vectors
    placed = kept.select("row", "v").mapInArrow(_places(width, low, high), "part int, place bigint, row bigint, x array<int>")
    order = ["part", "place", "row"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(ordered.select("part", "row", "x").mapInArrow(_blocks(width, block), _BLOCKS), "blocks")
    books = train(blocks, first_books(kept, width, entries), rounds) if seen["size"] is not None else np.zeros((PARTS, 0, width), np.int64)

    found = blocks.mapInArrow(_assign(books), "row bigint, part int, entry int, error bigint")
    shifted = F.expr(f"shiftleft(cast(entry as bigint), 8 * ({PARTS - 1} - part))")
    codes = found.groupBy("row").agg(F.sum(shifted).alias("_code"), F.sum("error").alias("error"))
    code = F.lower(F.lpad(F.hex("_code"), 2 * PARTS, "0"))
    coded = kept.select("row", "vec_id", "label").join(codes, "row")
    named = [F.col("vec_id").alias(id_col), F.col("label").alias(label_col)]
    return coded.select(*named, code.alias("code"), "error"), books


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the sum of the errors of all rows of its label."""
    sums = coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    joined = coded.join(sums, F.col(label_col).eqNullSafe(F.col("_label")))
    return joined.withColumn("label_error", F.expr("try_cast(_sum as bigint)")).drop("_label", "_sum")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()
