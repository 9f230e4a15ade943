"""MinHash near-duplicates: odd sketches sift banded candidates, full sets confirm links.

A document's set holds its distinct five-word shingles as 64-bit hashes. Documents
with equal sets form a *class*; everything after works on classes. A class has 160
MinHash values: groups of four make 40 band keys, and all of them, folded into the
parities of 1024 bits, make its odd sketch. The population count of two sketches' XOR
estimates how many values differ.

Buckets of classes with the same band key are never expanded into pairs. First every
class is compared with the leader of its buckets. Links confirmed on full sets give
components; only where a bucket then still holds several are its members compared across
them, after an exact bound from the shingles that only one of them has. So every pair
that shares a bucket is compared, is in one component already, or cannot be similar.

Two documents of similarity 0.75 share no bucket with probability (1 - 0.75^4)^40, about
3e-7, and less above; the sketch rejects only below an estimate of 0.5, more than five
deviations away. ``100 * intersection >= 75 * union`` is decided on the sets.

No text is shuffled: a bitmap of ids tells the pass over the texts whose sets are needed, and
``keep_one`` sifts rows by a bitmap of those that go.

Defined results: a null text or one without words has an empty set, links with nothing
and is kept. Null ids are allowed; a component's id is its least id that is not null.
Repeated ids are separate rows. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlode.llm.components import components
from cmdlode.llm.sift import Sift, one_of_each, row_key, sift_of, without_rows
from cmdlode.llm.words import WordHasher, gram_hashes, int_lists, lower_ascii, mix64, row_slices, texts_of
from cmdlode.session import discard, stored

SHINGLE = 5
BANDS, ROWS = 40, 4
SKETCH_BITS = 1024
PERCENT = 75
REJECT_BELOW = 0.5  # estimated similarity
CELLS = 4096

_SAMPLES = BANDS * ROWS
_MULTIPLIERS = mix64(np.arange(1, _SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_PLACES = mix64(np.arange(1, _SAMPLES + 1, dtype=np.uint64) << np.uint64(20))
_CHUNK = 1024  # shingles hashed at once: bounds a worker's memory on very long texts


def shingle_set(text: str | None, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of the whole text if it has fewer words."""
    words = hasher.hashes(lower_ascii(text))
    return np.unique(gram_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    best = np.full(_SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), _CHUNK):
            np.minimum(best, (shingles[i : i + _CHUNK, None] * _MULTIPLIERS).min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in samples.reshape(BANDS, ROWS).T:
            keys = mix64(keys ^ column)
        return keys.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the number of samples at each of the bits, as words of 64."""
    bits = np.bincount((mix64(samples ^ _PLACES) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def filled_cells(shingles: np.ndarray) -> np.ndarray:
    """Which of the cells hold a shingle, as words of 64 bits.

    A shingle in a cell that the other set leaves empty is in no intersection, so the cells
    bound the intersection from above, exactly.
    """
    bits = np.zeros(CELLS, dtype=np.uint8)
    bits[(shingles % np.uint64(CELLS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def most_odd_bits(similarity: float) -> int:
    """Population count expected for the XOR of two sketches of this similarity."""
    differing = 2 * _SAMPLES * (1 - similarity)
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * differing / SKETCH_BITS)))


_SIGNED = "_id bigint, _hash bigint, digest binary, n_shingles bigint, bands array<bigint>, sketch array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher("blank")
    for part in row_slices(batches, 500):
        digests, sizes, bands, sketches = [], [], [], []
        for text in texts_of(part):
            shingles = shingle_set(text, hasher)
            samples = min_hashes(shingles) if len(shingles) else None
            digests.append(set_digest(shingles))
            sizes.append(len(shingles))
            bands.append(None if samples is None else band_keys(samples))
            sketches.append(None if samples is None else odd_sketch(samples))
        yield pa.RecordBatch.from_arrays(
            [
                part.column("_id"), part.column("_hash"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                int_lists(bands), int_lists(sketches),
            ],
            names=["_id", "_hash", "digest", "n_shingles", "bands", "sketch"],
        )


def _sets(wanted: Sift) -> Callable:
    """Sets of the texts whose ``key`` may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher("blank")
        for part in row_slices(batches, 200):
            chosen = part.filter(pa.array(wanted.holds(part.column("key").to_numpy())))
            found = [shingle_set(text, hasher) for text in texts_of(chosen)]
            digests = pa.array([set_digest(s) for s in found], pa.binary())
            cells = int_lists([filled_cells(s) for s in found])
            yield pa.RecordBatch.from_arrays([digests, int_lists(found), cells], names=["digest", "shingles", "cells"])

    return run


def _odd_bits(a: Column, b: Column) -> Column:
    counts = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(counts, F.lit(0), lambda total, n: total + n)


def _like(a: Column, b: Column) -> Column:
    return _odd_bits(a, b) <= most_odd_bits(REJECT_BELOW)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes whose full sets are similar enough."""
    one = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("in_a"))
    two = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("in_b"))
    both = F.size(F.array_intersect("in_a", "in_b")).cast("bigint")
    enough = 100 * both >= PERCENT * (F.size("in_a") + F.size("in_b") - both)
    return pairs.join(one, "a").join(two, "b").where(enough).select("a", "b")


def _members(classes: DataFrame) -> DataFrame:
    """``band, digest, leader`` for buckets of several classes.

    The leader of a bucket is the class that shares most buckets with most others: of a
    family of variants, the one nearest to all of them.
    """
    placed = classes.select("digest", F.explode("bands").alias("band"))
    counts = placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(placed.join(counts, "band"), "shared")
    fame = shared.groupBy("digest").agg(F.sum("n").alias("fame"))
    best = shared.join(fame, "digest").groupBy("band").agg(F.max(F.struct("fame", "digest")).alias("_best"))
    leaders = best.select("band", F.col("_best.digest").alias("leader"))
    members = stored(shared.select("band", "digest").join(leaders, "band"), "members")
    discard(shared)
    return members


def _across(members: DataFrame, roots: DataFrame, sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of buckets that hold several components, not compared so far, that may be similar.

    A shingle that no other open class has is in no intersection. So of ``n`` shingles only
    ``usable`` can be shared, and ``7 * shared >= 3 * (n_a + n_b)`` must still hold (the limit of
    0.75, without the division). This leaves out variants with many changes of their own, before
    any pair is made; other pairs pass the bound of their cells and the sketches inside the join.
    """
    labelled = members.join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "digest"))
    open_members = stored(_mixed(labelled.where("digest <> leader").select("band", "digest", "root")), "open")
    ids = open_members.select("digest").distinct()
    held = sets.join(ids, "digest", "left_semi")
    each = held.select("digest", F.explode("shingles").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("digest").alias("digest")).where("c = 1")
    alone = alone.groupBy("digest").agg(F.count("*").alias("alone"))
    filled = F.aggregate("cells", F.lit(0), lambda total, c: total + F.bit_count(c))
    usable = held.select("digest", F.size("shingles").alias("n"), "cells", filled.alias("filled")).join(alone, "digest", "left")
    usable = usable.withColumn("usable", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    narrow = usable.where(f"100 * usable >= {PERCENT} * n").select("digest", "n", "usable")
    able = open_members.join(narrow, "digest")
    least = able.groupBy("band").agg(F.min("n").alias("least"))
    fits = lambda shared, n: (100 + PERCENT) * shared >= PERCENT * n
    able = able.join(least, "band").where(fits(F.col("usable"), F.col("n") + F.col("least"))).drop("least")
    bitmaps = usable.select("digest", "cells", "filled")
    able = stored(_mixed(able).join(sketches, "digest").join(bitmaps, "digest"), "able")
    x, y = able.alias("x"), able.alias("y")
    across = (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root"))
    both = F.expr(" + ".join(f"bit_count(x.cells[{i}] & y.cells[{i}])" for i in range(CELLS // 64)))
    sizes = F.col("x.n") + F.col("y.n")
    enough = fits(F.least("x.usable", "y.usable"), sizes)
    overlap = F.least(F.col("x.n") - F.col("x.filled"), F.col("y.n") - F.col("y.filled")) + both
    pairs = x.join(y, across & enough & fits(overlap, sizes) & _like(F.col("x.sketch"), F.col("y.sketch")))
    pairs = stored(pairs.select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b")).distinct(), "across")
    discard(open_members, able)
    return pairs


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components."""
    several = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return rows.join(several.select("band"), "band", "left_semi")


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _hash, n_shingles, root`` of every row: its key and its component's class."""
    plain = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    signed = stored(plain.mapInArrow(_sign, _SIGNED), "signed")
    filled = signed.where("n_shingles > 0")
    classes = stored(filled.select("digest", "bands", "sketch").dropDuplicates(["digest"]), "classes")
    members = _members(classes)

    sketches = classes.select("digest", "sketch")
    first = (
        members.where("digest <> leader").select(F.col("leader").alias("a"), F.col("digest").alias("b")).distinct()
        .join(sketches.select(F.col("digest").alias("a"), F.col("sketch").alias("of_a")), "a")
        .join(sketches.select(F.col("digest").alias("b"), F.col("sketch").alias("of_b")), "b")
        .where(_like(F.col("of_a"), F.col("of_b"))).select("a", "b")
    )
    # Sets of all classes that share a bucket, from one row of each.
    wanted = stored(members.select("digest").distinct(), "wanted")
    key = F.xxhash64("_id", "_hash").alias("key")
    rows = filled.select("digest", key).join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("key").alias("key"))
    keys = stored(rows.select("key"), "keys")
    found = plain.select(key, "text").mapInArrow(_sets(sift_of(keys)), "digest binary, shingles array<bigint>, cells array<bigint>")
    sets = stored(found.join(wanted, "digest", "left_semi").dropDuplicates(["digest"]), "sets")
    discard(wanted, keys)

    links = stored(_confirmed(first, sets), "links")
    roots = components(links)
    second = _across(members, roots, sets, sketches)
    more = stored(_confirmed(second, sets), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    narrow = signed.select("_id", "_hash", "digest", "n_shingles")
    rooted = narrow.join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    rooted = stored(rooted.select("_id", "_hash", "n_shingles", F.coalesce("root", "digest").alias("root")), "rooted")
    discard(signed, classes, members, sets, links, second, more)
    return rooted


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, n_shingles, component_id, kept``; ``kept`` marks the least id of each component."""
    rooted = classes_of(docs, id_col, text_col)
    least = rooted.where("n_shingles > 0").groupBy("root").agg(F.min("_id").alias("least"))
    least = least.select(F.col("root").alias("_root"), "least")
    named = rooted.join(least, (F.col("root") == F.col("_root")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("_id"))
    return named.select(
        F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without near-duplicates: one of each component, and all without words.

    It is the row of the least id, a null id being the last; of equal ids the one whose text has the
    least hash. Of rows alike in id and text one stays.
    """
    rooted = classes_of(docs, id_col, text_col).where("n_shingles > 0")
    place = F.struct(F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    best = rooted.groupBy("root").agg(F.min(place).alias("best"))
    is_best = F.col("_id").eqNullSafe(F.col("best.id")) & (F.col("_hash") == F.col("best.hash"))
    judged = stored(
        rooted.join(best, "root").groupBy("_id", "_hash").agg(F.min(is_best.cast("int")).alias("best"), F.count("*").alias("n")), "judged"
    )
    dropped = judged.where("best = 0 or n > 1").select("_id", "_hash")
    repeated = stored(judged.where("best = 1 and n > 1").select("_id", "_hash"), "repeated")  # as a rule none
    kept = without_rows(docs, dropped, id_col, text_col)
    discard(rooted)
    return kept if repeated.isEmpty() else kept.unionByName(one_of_each(docs, repeated, id_col, text_col))
