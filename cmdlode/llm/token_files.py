"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Layout of a folder:

- ``ids-00000.bin``: ids of consecutive documents, little-endian, no header.
- ``index-00000.bin``: a part of the index. Header ``<4sIIQ``: magic, levels, checkpoint
  width, keys; the bit lengths of the levels as ``u64``; their bits, packed; a running count
  of set bits (``u32``) for every checkpoint; then one slot a key.

A key is a document id and the number of its repeat, in file order. Its part is
``xxhash64`` modulo the number of parts. In a part every level has a bit array: keys
that fall on a bit alone set it, the others go to the next level. The number of set bits
before a key's bit is its slot: minimal, perfect, and found in constant time. A slot holds
a fingerprint of the key, the shard, the offset in it, the offset in the whole, and the
number of ids, so a foreign key is refused except for one in ``2**32``.

Rows are range-partitioned by id and a hash of the text and sorted; a task streams its
range into a shard under a temporary name and renames it, so a repeated task writes the
same file again. Files are written through ``pyarrow.fs`` to the folder's own file system.

Defined results: a null text has the end id only. Null ids come first; repeats of an id
are ordered by a hash of their text. An empty table has no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cmdlode.llm.tokenize import in_parts, read_vocabulary, shared_encoder
from cmdlode.llm.words import mix64
from cmdlode.session import stored

END_ID = 2
KEYS_PER_PART = 1 << 16
_MAGIC, _STEP = b"MPH1", 512
_HEAD = struct.Struct("<4sIIQ")
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("start", "<u8"), ("n_tokens", "<u8")])
_META = "shard int, doc_id bigint, copy bigint, offset bigint, n_tokens bigint"


def open_folder(folder: str):
    """File system and path of a folder URI."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _write_whole(filesystem, path: str, chunks: Iterator[bytes]) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    if filesystem.get_file_info(path).is_file:
        filesystem.delete_file(path)
    filesystem.move(temporary, path)


# --- index -------------------------------------------------------------------


def key_hashes(ids: np.ndarray, nulls: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Hashes of keys inside a part."""
    with np.errstate(over="ignore"):
        second = mix64(copies.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64) + np.uint64(1))
        return mix64(np.where(nulls, 0, ids).astype(np.int64).view(np.uint64) ^ second)


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(hashes + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)


def build_part(hashes: np.ndarray, slots: np.ndarray) -> bytes:
    """Serialised part of the index over distinct hashes and their slots (without fingerprints)."""
    left, levels = np.arange(len(hashes)), []
    position = np.empty(len(hashes), dtype=np.int64)
    before = 0
    while len(left):
        size = 64 * -(-max(64, 2 * len(left)) // 64)
        place = _places(hashes[left], len(levels), size)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, dtype=np.uint8)
        bits[place[alone]] = 1
        position[left[alone]] = before + place[alone]
        levels.append(bits)
        before += size
        left = left[~alone]
        if len(levels) > 64:
            raise ValueError("keys of an index part are not distinct")
    bits = np.concatenate(levels) if levels else np.empty(0, np.uint8)
    counts = np.r_[0, np.cumsum(bits, dtype=np.int64)]
    ordered = np.empty(len(hashes), dtype=SLOT)
    slots = slots.copy()
    slots["fingerprint"] = (hashes >> np.uint64(32)).astype(np.uint32)
    ordered[counts[position]] = slots
    head = _HEAD.pack(_MAGIC, len(levels), _STEP, len(hashes))
    sizes = np.array([len(level) for level in levels], dtype="<u8").tobytes()
    return head + sizes + np.packbits(bits).tobytes() + counts[:-1:_STEP].astype("<u4").tobytes() + ordered.tobytes()


class IndexPart:
    """A part opened for look-ups. ``read(offset, n)`` may read from a file or from memory;
    opening reads the bits (about four a key), a look-up one slot."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self._read = read
        magic, levels, self._step, self.n_keys = _HEAD.unpack(read(0, _HEAD.size))
        if magic != _MAGIC:
            raise ValueError("not an index part")
        at = _HEAD.size
        self._sizes = np.frombuffer(read(at, 8 * levels), dtype="<u8").astype(np.int64)
        at += 8 * levels
        total = int(self._sizes.sum())
        self._bits = np.unpackbits(np.frombuffer(read(at, total // 8), dtype=np.uint8))
        at += total // 8
        checks = -(-total // self._step)
        self._checks = np.frombuffer(read(at, 4 * checks), dtype="<u4").astype(np.int64)
        self._slots_at = at + 4 * checks

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """Slot number of each hash, -1 if no level has its bit."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left, before = np.arange(len(hashes)), 0
        for level, size in enumerate(self._sizes):
            place = before + _places(hashes[left], level, int(size))
            found = self._bits[place] == 1
            for i, p in zip(left[found], place[found]):
                first = p // self._step
                out[i] = self._checks[first] + int(self._bits[first * self._step : p].sum())
            left, before = left[~found], before + int(size)
        return out

    def slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether each belongs to the key (its fingerprint fits)."""
        position = self.positions(hashes)
        found = np.zeros(len(hashes), dtype=SLOT)
        for i, p in enumerate(position):
            if p >= 0:
                found[i] = np.frombuffer(self._read(self._slots_at + int(p) * SLOT.itemsize, SLOT.itemsize), dtype=SLOT)[0]
        return found, (position >= 0) & (found["fingerprint"] == (hashes >> np.uint64(32)).astype(np.uint32))


def part_of(doc_id: Column, copy: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, copy), F.lit(parts)).cast("int")


def part_of_key(doc_id: int | None, copy: int, parts: int) -> int:
    """As ``part_of``, in plain Python."""
    import xxhash

    seed = 42
    for value in (doc_id, copy):
        if value is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", value), seed)
    return (seed - (1 << 64) if seed >= 1 << 63 else seed) % parts


# --- writing -----------------------------------------------------------------


def _write_shards(folder: str, vocabulary, end_id: int, names_are_text: bool) -> Callable:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, shard = shared_encoder(vocabulary.value, names_are_text), TaskContext.get().partitionId()
        filesystem, path = open_folder(folder)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        width, rows, state = encoder.dtype.itemsize, [], {"offset": 0, "last": (), "copy": 0}

        def chunks() -> Iterator[bytes]:
            for batch in batches:
                ids = batch["doc_id"].array
                at = 0
                for part in in_parts(batch["text"]):
                    for encoded in encoder.encode(part):
                        key = (None,) if pd.isna(ids[at]) else (int(ids[at]),)
                        state["copy"] = state["copy"] + 1 if key == state["last"] else 0
                        n = len(encoded) // width + 1
                        rows.append((shard, key[0], state["copy"], state["offset"], n))
                        state["last"], state["offset"], at = key, state["offset"] + n, at + 1
                        yield encoded + end

        first = next(stream := chunks(), None)
        if first is not None:

            def whole() -> Iterator[bytes]:
                yield first
                yield from stream

            _write_whole(filesystem, f"{path}/ids-{shard:05d}.bin", whole())
            meta = pd.DataFrame(rows, columns=["shard", "doc_id", "copy", "offset", "n_tokens"])
            yield meta.astype({"doc_id": "Int64"})

    return write


def _write_parts(folder: str) -> Callable:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, path = open_folder(folder)
        held: list[pd.DataFrame] = []

        def finish() -> pd.DataFrame:
            rows = pd.concat(held)
            nulls = rows["doc_id"].isna().to_numpy()
            hashes = key_hashes(rows["doc_id"].fillna(0).to_numpy(np.int64), nulls, rows["copy"].to_numpy())
            slots = np.zeros(len(rows), dtype=SLOT)
            for name in ("shard", "offset", "start", "n_tokens"):
                slots[name] = rows[name].to_numpy()
            part = int(rows["part"].iloc[0])
            _write_whole(filesystem, f"{path}/index-{part:05d}.bin", iter([build_part(hashes, slots)]))
            return pd.DataFrame({"part": [part], "n_keys": [len(rows)]})

        for batch in batches:  # sorted by part; a part has about KEYS_PER_PART keys, by its hash
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            for part, rows in batch.groupby("part", sort=True):
                if held and held[0]["part"].iloc[0] != part:
                    yield finish()
                    held.clear()
                held.append(rows)
        if held:
            yield finish()

    return write


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    names_are_text: bool = True,
) -> DataFrame:
    """Write shards and index; returns ``part, n_keys`` of the index as written.

    ``shards`` defaults to the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    filesystem, path = open_folder(folder)
    filesystem.create_dir(path, recursive=True)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = plain.withColumn("_hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(shards, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").drop("_hash")
    meta = stored(ordered.mapInPandas(_write_shards(folder, shared, end_id, names_are_text), _META), "shards")

    totals = meta.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    # An id whose repeats go on in the next shard counts on from there; few ids do.
    counts = meta.groupBy("doc_id", "shard").agg(F.count("*").alias("n"))
    several = counts.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("_id"))
    earlier = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        counts.join(several, F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("_id", F.col("shard").alias("_in"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"))
    )
    parts = max(1, -(-meta.count() // KEYS_PER_PART))
    entries = (
        meta.join(starts, F.col("shard") == F.col("_shard"))
        .join(carried, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("shard") == F.col("_in")), "left")
        .withColumn("copy", F.col("copy") + F.coalesce("carried", F.lit(0)))
        .select("doc_id", "copy", "shard", "offset", (F.col("begin") + F.col("offset")).alias("start"), "n_tokens")
        .withColumn("part", part_of(F.col("doc_id"), F.col("copy"), parts))
        .repartition(min(parts, shards), "part").sortWithinPartitions("part")
    )
    return stored(entries.mapInPandas(_write_parts(folder), "part int, n_keys bigint"), "index")


# --- reading -----------------------------------------------------------------


class TokenReader:
    """Keyed access for one process: a look-up reads a slot and the ids, nothing else."""

    def __init__(self, folder: str, parts: int, dtype: str = "<u2"):
        self._filesystem, self._path = open_folder(folder)
        self._parts, self._dtype, self._open = parts, np.dtype(dtype), {}

    def ids(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """Ids of a document with its end id, or None if the index does not have the key."""
        number = part_of_key(doc_id, copy, self._parts)
        if number not in self._open:
            name = f"{self._path}/index-{number:05d}.bin"
            if not self._filesystem.get_file_info(name).is_file:
                return None
            file = self._filesystem.open_input_file(name)
            self._open[number] = IndexPart(lambda at, n, file=file: file.read_at(n, at))
        nulls = np.array([doc_id is None])
        hashes = key_hashes(np.array([doc_id or 0], np.int64), nulls, np.array([copy]))
        slots, fits = self._open[number].slots(hashes)
        if not fits[0]:
            return None
        with self._filesystem.open_input_file(f"{self._path}/ids-{slots[0]['shard']:05d}.bin") as file:
            width = self._dtype.itemsize
            data = file.read_at(int(slots[0]["n_tokens"]) * width, int(slots[0]["offset"]) * width)
        return np.frombuffer(data, dtype=self._dtype)


def _look_up(folder: str) -> Callable:
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, path = open_folder(folder)
        number, part = None, None
        for batch in batches:
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            for wanted, rows in batch.groupby("part", sort=True):
                if wanted != number:
                    with filesystem.open_input_file(f"{path}/index-{wanted:05d}.bin") as file:
                        data = file.read()
                    number, part = wanted, IndexPart(lambda at, n, data=data: data[at : at + n])
                nulls = rows["doc_id"].isna().to_numpy()
                hashes = key_hashes(rows["doc_id"].fillna(0).to_numpy(np.int64), nulls, rows["copy"].to_numpy())
                slots, fits = part.slots(hashes)
                if not fits.all():
                    raise ValueError(f"index part {wanted} lacks {int((~fits).sum())} keys")
                named = {name: slots[name].astype(np.int64) for name in ("shard", "offset", "start", "n_tokens")}
                yield pd.DataFrame({"doc_id": rows["doc_id"].array, **named})

    return look


def _read_ids(folder: str, width: int) -> Callable:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, path = open_folder(folder)
        number, file = None, None
        for batch in batches:
            sums = []
            for shard, offset, n in zip(batch["shard"], batch["offset"], batch["n_tokens"]):
                if shard != number:
                    number, file = shard, filesystem.open_input_file(f"{path}/ids-{shard:05d}.bin")
                ids = np.frombuffer(file.read_at(int(n) * width, int(offset) * width), dtype=f"<u{width}")
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            doc_ids = batch["doc_id"].astype("Int64")
            yield pd.DataFrame({"doc_id": doc_ids, "start": batch["start"], "n_tokens": batch["n_tokens"], "ids_crc32": sums})

    return read


def read_token_files(spark: SparkSession, folder: str, keys: DataFrame, parts: int, width: int = 2) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` for keys ``doc_id, copy``, through the index.

    Keys meet their part of the index, then the shards are read in order of offsets.
    A key that the index lacks is an error.
    """
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("copy").cast("bigint").alias("copy"))
    placed = placed.withColumn("part", part_of(F.col("doc_id"), F.col("copy"), parts))
    placed = placed.repartition(min(parts, spread), "part").sortWithinPartitions("part")
    found = placed.mapInPandas(_look_up(folder), "doc_id bigint, shard bigint, offset bigint, start bigint, n_tokens bigint")
    ordered = found.repartition(spread, "shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInPandas(_read_ids(folder, width), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def keys_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, copy`` of every row."""
    counted = docs.groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy"))


def tokenize_to_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", names_are_text: bool = True) -> DataFrame:
    """Write all documents, then read every one back by its key."""
    written = write_token_files(docs, folder, id_col=id_col, text_col=text_col, names_are_text=names_are_text)
    parts = max(1, -(-(written.agg(F.sum("n_keys").alias("n")).first()["n"] or 0) // KEYS_PER_PART))
    return read_token_files(docs.sparkSession, folder, keys_of(docs, id_col), parts)
