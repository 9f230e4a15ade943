"""Collocations: phrases that occur together far more often than their parts suggest.

1. Workers split texts into pieces and words and gather *shards* of about ``SHARD`` words of
   one language. A shard's words become numbers, pieces end with the number 0.
2. A shard has a bidirectional FM-index over these numbers: the Burrows-Wheeler transforms
   of its numbers and of their reverse, both ordered by as many symbols as phrases may have.
   An interval in one stands for a phrase, and its twin in the other is kept in step. The
   symbols in an interval are the phrase's extensions to one side, with their counts. Phrases
   grow from the middle: to the right, then to the left, and so on.
3. Spark sums each phrase's counts over all shards, for one length after the other. A bitmap
   of the phrases that reach the least count, of at most ``2**26`` bits, goes to the workers
   and keeps intervals from growing that hold no candidate: every part of a candidate is as
   frequent as it. The bitmap only sifts; sums are exact.
4. Joins with the parts' sums give scores, joins with the longer phrases' sums drop what
   occurs mainly inside of them.

Between tasks a word is its 64-bit hash. All words seen are checked for equal hashes; should
two share one, all starts again with other hashes, so equal hashes mean equal words.

Defined results: a null text has no words, a null language is ``und``. Nothing depends on ids,
so repeated rows count as often as they occur. An empty table gives no rows. Texts of any length
are read in sections, and a shard that ends inside a piece hands its last words on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlode.llm.words import mix64
from cmdlode.session import stored

MAX_WORDS = 3
MIN_COUNT = 10
INSIDE_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
UNKNOWN = "und"
SHARD = 1 << 21
_SECTION = 1 << 22
_MOST_BITS, _SPARE_BITS = 26, 4
_SEEDS = 8
_PARTS = 64  # of a language, for the first cut

_ENDS, _BLANKS = b".,;:!?\x0b\x0c\r", b"\t"
_TABLE = bytes.maketrans(_ENDS + _BLANKS, b"\n" * len(_ENDS) + b" " * len(_BLANKS))
_END = b"\n"  # between pieces; words hold neither this nor blanks


def sections(data: bytes, size: int = _SECTION) -> Iterator[bytes]:
    """``data`` in parts that end at blanks, of ``size`` bytes and the rest of a word."""
    start = 0
    while len(data) - start > size:
        cut = data.find(b" ", start + size)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:]


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words in order, with ``_END`` behind each piece; a list for each section."""
    data = text.lower().translate(_TABLE)
    for part in sections(data):
        yield [w for w in part.replace(_END, b" \n ").split(b" ") if w]
    yield [_END]


class Shard:
    """Words of one language as numbers, with the index over them."""

    def __init__(self, lang: str, depth: int):
        self.lang, self.depth = lang, depth
        self.numbers: dict[bytes, int] = {_END: 0}
        self._parts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        number = self.numbers
        self._parts.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64))

    def tail(self) -> list[bytes]:
        """Last words of an open piece that may still begin a phrase."""
        names = list(self.numbers)
        last = self.text[max(0, len(self.text) - self.depth) : -1]
        return [names[i] for i in last[np.flatnonzero(np.r_[0, last] == 0)[-1] :]]

    @cached_property
    def text(self) -> np.ndarray:
        """The numbers between two ends, so that each is preceded and followed by one of them."""
        frame = np.zeros(1, dtype=np.int64)
        return np.concatenate([frame, *self._parts, frame])

    @cached_property
    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.numbers))

    @cached_property
    def starts(self) -> np.ndarray:
        """First row of each symbol's interval, alike in both directions."""
        return np.cumsum(self.counts) - self.counts

    @cached_property
    def forward(self) -> Index:
        return Index(self.text, len(self.numbers), self.depth)

    @cached_property
    def backward(self) -> Index:
        return Index(self.text[::-1], len(self.numbers), self.depth)

    def hashes(self, seed: int) -> np.ndarray:
        before = self.lang.encode("utf-8", "surrogatepass") + _END
        return np.array([xxhash.xxh3_64_intdigest(before + w, seed) for w in self.numbers], dtype=np.uint64)

    def phrases(self, known: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of ``depth`` words as rows of numbers, and their counts.

        ``known`` tells for rows of numbers, of any length below ``depth``, which may be frequent.
        """
        words = (np.flatnonzero(self.counts[1:]) + 1)[:, None]
        if self.depth > 1:
            words = words[known(words)]
        n, low, back = self.counts[words[:, 0]], self.starts[words[:, 0]], self.starts[words[:, 0]]
        for size in range(2, self.depth + 1):
            to_right = size % 2 == 0
            index, own, other = (self.backward, back, low) if to_right else (self.forward, low, back)
            owner, symbol, n, own, before = index.extensions(own, n)
            other = other[owner] + before
            added = symbol[:, None]
            words = np.hstack([words[owner], added] if to_right else [added, words[owner]])
            keep = symbol > 0
            keep[keep] = known(words[keep, 1:] if to_right else words[keep, :-1])
            if size < self.depth:
                keep[keep] = known(words[keep])
            words, n = words[keep], n[keep]
            low, back = (other[keep], own[keep]) if to_right else (own[keep], other[keep])
        return words, n


class Index:
    """Burrows-Wheeler transform of numbers whose suffixes are ordered by ``depth`` symbols.

    Steps between intervals are exact for phrases of up to ``depth`` symbols.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.symbols, n = symbols, len(text)
        padded = np.r_[text, np.zeros(depth, dtype=np.int64)]
        columns = [padded[i : i + n] for i in range(depth)]
        if symbols**depth < 1 << 63:
            key = columns[0]
            for column in columns[1:]:
                key = key * symbols + column
            order = np.argsort(key, kind="stable")
        else:
            order = np.lexsort(columns[::-1])
        self.bwt = padded[order - 1]  # before the first end comes another one, like the last of the text
        self.step = np.empty(n, dtype=np.int64)
        self.step[np.argsort(self.bwt, kind="stable")] = np.arange(n)

    def extensions(self, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbols before the phrases of intervals: ``owner, symbol, count, low, smaller``.

        ``low`` is where the extended phrase's interval starts, ``smaller`` how many of the
        owner's occurrences have a smaller symbol there.
        """
        firsts = np.cumsum(n) - n
        rows = np.repeat(low - firsts, n) + np.arange(int(n.sum()))
        key = np.repeat(np.arange(len(n)), n) * self.symbols + self.bwt[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        owner, symbol = np.divmod(key[heads], self.symbols)
        counts = np.diff(np.r_[heads, len(key)])
        return owner, symbol, counts, self.step[rows[order[heads]]], heads - firsts[owner]


def _shards(batches: Iterator[pa.RecordBatch], depth: int, size: int) -> Iterator[Shard]:
    """Shards of the rows' texts, by language; together they hold at most about ``size`` words."""
    open_shards: dict[str, Shard] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.binary())):
            lang = lang.as_py()
            for words in tokens(text.as_py() or b""):
                open_shards.setdefault(lang, Shard(lang, depth)).add(words)
                held += len(words)
                if held >= size:
                    handed = {}
                    while open_shards:
                        name, shard = open_shards.popitem()
                        handed[name] = shard.tail()
                        yield shard
                    for name, rest in handed.items():
                        if rest:
                            open_shards.setdefault(name, Shard(name, depth)).add(rest)
                    held = 0
    yield from open_shards.values()


def _count_words(seed: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, 1, size):
            words = list(shard.numbers)[1:]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.hashes(seed)[1:].view(np.int64)),
                    pa.array([shard.lang] * len(words), pa.string()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array(shard.counts[1:]),
                ],
                names=["w0", "lang", "word", "n"],
            )

    return run


def phrase_hash(hashes: np.ndarray) -> np.ndarray:
    """Hash of each row of word hashes."""
    out = np.full(len(hashes), hashes.shape[1], dtype=np.uint64)
    for column in hashes.T:
        out = mix64(out ^ column)
    return out


def _places(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the bitmap for each print."""
    return prints >> np.uint64(64 - bits), prints & np.uint64((1 << bits) - 1)


def _marks(size: int, bits: int) -> Callable:
    """Words of 64 bits that a batch of phrases sets: ``at, v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(f"w{i}").to_numpy().view(np.uint64) for i in range(size)], axis=1)
            place = np.concatenate(_places(phrase_hash(rows), bits))
            marks = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(marks.view(np.int64))], names=["at", "v"]
            )

    return run


def _bitmap(frequent: DataFrame, size: int) -> tuple[int, Broadcast]:
    """Bits sized to the number of phrases, up to a fixed most."""
    bits = max(6, min(_MOST_BITS, frequent.count().bit_length() + _SPARE_BITS))
    marks = frequent.select(*_key(size)).mapInArrow(_marks(size, bits), "at bigint, v bigint")
    found = marks.groupBy("at").agg(F.bit_or("v").alias("v")).toPandas()  # at most 2**20 rows
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[found["at"].to_numpy(dtype=np.int64)] = found["v"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits, frequent.sparkSession.sparkContext.broadcast(table)


def _key(size: int) -> list[str]:
    return [f"w{i}" for i in range(size)]


def _count_phrases(depth: int, seed: int, size: int, bitmaps: dict[int, tuple[int, Broadcast]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: (bits, table.value) for k, (bits, table) in bitmaps.items()}
        for shard in _shards(batches, depth, size):
            hashes = shard.hashes(seed)

            def known(words: np.ndarray) -> np.ndarray:
                bits, table = tables[words.shape[1]]
                found = np.ones(len(words), dtype=bool)
                for place in _places(phrase_hash(hashes[words]), bits):
                    found &= (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
                return found

            words, n = shard.phrases(known)
            columns = [pa.array(hashes[words[:, i]].view(np.int64)) for i in range(depth)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=[*_key(depth), "n"])

    return run


def word_counts(plain: DataFrame, shard: int) -> tuple[DataFrame, int]:
    """``w0, lang, word, n`` of all words of ``lang, text``, with hashes that differ, and their seed."""
    for seed in range(_SEEDS):
        counted = plain.mapInArrow(_count_words(seed, shard), "w0 bigint, lang string, word string, n bigint")
        counted = stored(counted.groupBy("w0", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if counted.groupBy("w0").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return counted, seed
    raise RuntimeError(f"equal hashes of different words with each of {_SEEDS} seeds")


def frequent_phrases(
    plain: DataFrame, words: DataFrame, seed: int, max_words: int, min_count: int, shard: int
) -> dict[int, DataFrame]:
    """By length: the phrases ``w0, w1, ..., n`` that occur at least ``min_count`` times."""
    frequent = {1: stored(words.where(F.col("n") >= min_count).select("w0", "n"), "phrases")}
    bitmaps = {}
    for size in range(2, max_words + 1):
        bitmaps[size - 1] = _bitmap(frequent[size - 1], size - 1)
        schema = ", ".join(f"{c} bigint" for c in [*_key(size), "n"])
        counted = plain.mapInArrow(_count_phrases(size, seed, shard, dict(bitmaps)), schema)
        summed = counted.groupBy(*_key(size)).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        frequent[size] = stored(summed, "phrases")
    return frequent


def _part(frequent: dict[int, DataFrame], first: int, size: int, name: str) -> tuple[DataFrame, list[str]]:
    """Counts of the part of ``size`` words that starts at word ``first`` of a longer phrase."""
    names = [f"w{first + i}" for i in range(size)]
    return frequent[size].select(*[F.col(f"w{i}").alias(x) for i, x in enumerate(names)], F.col("n").alias(name)), names


def _score(a: str, left: str, right: str) -> Column:
    number = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"(cast({SCALE} as decimal(7, 0)) * {number(a)} * {number(a)}) div ({number(left)} * {number(right)})")


def scored(frequent: dict[int, DataFrame], size: int) -> DataFrame:
    """``w0, ..., a, l, r, score`` of the phrases of ``size`` words, by their lowest-scoring cut."""
    out = frequent[size].withColumnRenamed("n", "a")
    cuts = []
    for k in range(1, size):
        for part in (_part(frequent, 0, k, f"l{k}"), _part(frequent, k, size - k, f"r{k}")):
            out = out.join(*part)
        cuts.append(F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return out.withColumn("best", best).select(*_key(size), "a", "best.l", "best.r", "best.score")


def _longest(frequent: dict[int, DataFrame], size: int) -> DataFrame | None:
    """Per phrase of ``size`` words, the greatest count of a longer one around it: ``w0, ..., most``."""
    around = None
    for longer in range(size + 1, max(frequent) + 1):
        for first in range(longer - size + 1):
            inner = [F.col(f"w{first + i}").alias(f"w{i}") for i in range(size)]
            found = frequent[longer].select(*inner, F.col("n").alias("most"))
            around = found if around is None else around.unionByName(found)
    return None if around is None else around.groupBy(*_key(size)).agg(F.max("most").alias("most"))


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    inside_percent: int = INSIDE_PERCENT,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
    shard: int = SHARD,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the lowest-scoring cut,
    ``n`` the number of all words. Phrases that occur mainly inside a longer one are left out.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    plain = docs.select(lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, seed = word_counts(plain, shard)
    frequent = frequent_phrases(plain, words, seed, max_words, min_count, shard)
    names = words.where(F.col("n") >= min_count)

    found = None
    for size in range(2, max_words + 1):
        rows = scored(frequent, size)
        around = _longest(frequent, size)
        if around is not None:
            rows = rows.join(around, _key(size), "left")
            rows = rows.where(f"most is null or 100 * most < {inside_percent} * a")
        for i in range(size):
            named = names.select(F.col("w0").alias(f"w{i}"), F.col("word").alias(f"word{i}"), *(["lang"] if i == 0 else []))
            rows = rows.join(named, f"w{i}")
        phrase = F.concat_ws(" ", *[f"word{i}" for i in range(size)]).alias("phrase")
        rows = rows.select("lang", phrase, "a", "l", "r", "score")
        found = rows if found is None else found.unionByName(rows)
    # A language may hold most phrases: the best of each of its parts are found first.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)).alias("part")
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = found.select("*", part).withColumn("rank", place("lang", "part")).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", place("lang")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
