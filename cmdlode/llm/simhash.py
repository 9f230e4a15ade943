"""SimHash near-duplicates: pivot distance tables find and discard pairs of fingerprints.

A document's fingerprint has a bit set if over half of its four-word shingles' hashes have it
set. Documents with equal fingerprints form a *class*; everything after works on classes.
Fingerprints that differ in at most four bits are linked.

Each fingerprint has a table of Hamming distances to *pivots*, fixed reference fingerprints.
By the triangle inequality two fingerprints are at least as far apart as their distances to
any pivot differ, over all 64 bits as well as over some of them.

- *Near pivots* see one block of bits each, eight a block. Of ``b`` blocks two linked
  fingerprints share at least ``b - 4`` in full, and so all distances to the pivots of those
  blocks. Every choice of ``b - 4`` blocks makes a key of these distances; pairs without a
  common key are never met. ``b`` grows with the number of classes, so buckets stay small.
- *Far pivots* see all bits. A pair of a bucket whose tables differ by more than four at any
  of them is discarded; the survivors are verified by their differing bits.

Buckets are not expanded into pairs. First every class is compared with the leader of its
buckets, the class of most documents. Verified links give components; where a bucket then
holds several, the classes outside its largest component are compared with those of other
components. So every pair of a bucket is compared or is in one component already.

Defined results: a null text or one without words has the fingerprint zero and is linked like
any other. Null ids are allowed; a component's id is its least id that is not null. Repeated
ids are separate rows. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlode.llm.components import components
from cmdlode.llm.words import mix64, row_slices
from cmdlode.session import stored

SHINGLE = 4
SEED = 42
BITS = 64
MOST = 4  # differing bits of linked fingerprints
NEAR_PIVOTS = 8  # for each block
FAR_PIVOTS = 16
_FEWEST_BLOCKS, _MOST_BLOCKS = 6, 10
_SPARE = 2  # a key has this many bits more than a number of classes, if blocks allow
_CHUNK = 8192  # shingles hashed at once: bounds a worker's memory on very long texts


def fingerprint(data: bytes) -> int:
    """Fingerprint of a text's UTF-8 bytes; zero without words."""
    words = data.lower().split()  # bytes: only A-Z, only the six ASCII blanks
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    ends = (ends - 1).tolist()
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for first in range(0, n, _CHUNK):
        last = min(first + _CHUNK, n)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[first:last], ends[first + size - 1 : last + size - 1])]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches, 1000):
        texts = part.column("text").cast(pa.binary())
        found = [0 if not (value := text.as_py()) else fingerprint(value) for text in texts]
        prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), prints], names=["doc_id", "print"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(first: int, n: int) -> list[int]:
    """Fixed fingerprints number ``first`` to ``first + n``, by rule."""
    return [int(x) for x in mix64(np.arange(first + 1, first + n + 1, dtype=np.uint64) << np.uint64(8))]


def block_masks(blocks: int) -> list[int]:
    """The 64 bits in ``blocks`` runs of about equal length."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def blocks_for(classes: int) -> int:
    """Fewest blocks whose keys have some bits more than the number of classes has."""
    fits = (b for b in range(_FEWEST_BLOCKS, _MOST_BLOCKS) if BITS * (b - MOST) // b >= classes.bit_length() + _SPARE)
    return next(fits, _MOST_BLOCKS)


def _distances(fingerprint: Column, references: list[int], mask: int = (1 << BITS) - 1) -> Column:
    """Distances to up to eight pivots, one in each byte of a long."""
    seen = [F.bit_count(fingerprint.bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask)))) for p in references]
    packed = [F.shiftleft(d.cast("bigint"), 8 * i) for i, d in enumerate(seen)]
    return sum(packed[1:], packed[0])


def near_keys(fingerprint: Column, blocks: int) -> Column:
    """Array of keys: for each choice of blocks the distances to these blocks' pivots."""
    tables = [
        _distances(fingerprint, pivots(NEAR_PIVOTS * j, NEAR_PIVOTS), mask) for j, mask in enumerate(block_masks(blocks))
    ]
    chosen = itertools.combinations(range(blocks), blocks - MOST)
    return F.array(*[F.xxhash64(F.lit(i), *[tables[j] for j in group]) for i, group in enumerate(chosen)])


def far_table(fingerprint: Column) -> list[Column]:
    """Distances to the far pivots as columns ``far0``, ``far1``, eight in each."""
    references = pivots(1 << 20, FAR_PIVOTS)
    return [_distances(fingerprint, references[i : i + 8]).alias(f"far{i // 8}") for i in range(0, FAR_PIVOTS, 8)]


def _linked(a: str, b: str) -> Column:
    """Pairs that no far pivot discards and that differ in few bits."""
    checks = []
    for i in range(FAR_PIVOTS):
        one, two = (F.expr(f"(shiftright({side}.far{i // 8}, {8 * (i % 8)}) & 127)") for side in (a, b))
        checks.append(F.abs(one - two) <= MOST)
    checks.append(F.expr(f"bit_count({a}.print ^ {b}.print)") <= MOST)
    out = checks[0]
    for check in checks[1:]:
        out = out & check
    return out


def _pairs(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Links ``a, b`` of members with the leaders of their buckets."""
    joined = members.alias("x").join(leaders.alias("y"), F.expr("x.key = y.key and x.print <> y.print") & _linked("x", "y"))
    return joined.select(F.col("y.print").alias("a"), F.col("x.print").alias("b")).distinct()


def _across(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Links ``a, b`` between components that share a bucket.

    Only classes outside a bucket's largest component look for others, so a component of very
    many variants is not compared with itself.
    """
    labelled = members.join(roots.withColumnRenamed("node", "print"), "print", "left")
    labelled = stored(labelled.withColumn("root", F.coalesce("root", "print")), "labelled")
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    main = main.where("roots > 1").select("key", F.col("main.root").alias("main"))
    mixed = stored(labelled.join(main, "key"), "mixed")
    strays = mixed.where("root <> main")
    apart = F.expr("x.key = y.key and x.root <> y.root and (y.root = y.main or x.root < y.root)")
    joined = strays.alias("x").join(mixed.alias("y"), apart & _linked("x", "y"))
    return joined.select(F.col("x.print").alias("a"), F.col("y.print").alias("b")).distinct()


def links(classes: DataFrame, blocks: int) -> DataFrame:
    """``node, root`` of the classes ``print, n`` linked with others; ``n`` chooses leaders."""
    keyed = classes.select("print", "n", F.explode(near_keys(F.col("print"), blocks)).alias("key"))
    best = keyed.groupBy("key").agg(F.max(F.struct("n", "print")).alias("best"), F.count("*").alias("c")).where("c > 1")
    leaders = best.select("key", F.col("best.print").alias("print"))
    leaders = stored(leaders.select("key", "print", *far_table(F.col("print"))), "leaders")
    members = keyed.join(leaders.select("key"), "key", "left_semi")
    members = stored(members.select("key", "print", *far_table(F.col("print"))), "members")
    first = stored(_pairs(members, leaders), "links")
    roots = components(first)
    more = stored(_across(members, roots), "links")
    return roots if more.isEmpty() else components(first.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id, fingerprint, component_id``; the fingerprint as 16 hex digits."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = stored(plain.mapInArrow(_sign, "doc_id bigint, print bigint"), "prints")
    classes = stored(signed.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "classes")
    roots = links(classes.select("print", "n"), blocks_for(classes.count()))

    rooted = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("print", "root").join(least, "root").select("print", "component_id")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return signed.join(named, "print").select(F.col("doc_id").alias(id_col), digits, "component_id")
