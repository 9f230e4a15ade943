"""Mixing sources to target weights by capped water-filling, without Python workers.

Every source's target is the smaller of its share of the whole and ``cap`` times its
own size; what capped sources leave goes to the others by weight. A source's target
is met by whole repetitions of all its documents and a fraction of one more: its
documents are ordered by a seeded digest of their id, and the first of them are
taken once more, up to the word. Every document decides on its own from a table
with one row per source, so no group of documents is ever brought together; the
digest's bucket that holds the cut is the only part ordered, and only its sizes.

The digest is of the id and the text, so only rows alike in both share one. If the cut is
at such rows, as many of them are taken once more as fit, and a part of one: every source's
words come to its target, rounded to whole words. They are told apart by a row number, in
blocks, so that they may be very many.

Defined results: a null text has no words; a null source is a source of its own,
ordered last; null and repeated ids are allowed. Of rows alike in id and text at a cut, ``mix``
returns the columns of one of them.
Sources without words take nothing, an empty table gives no rows, columns not named
are kept (``mix``) or ignored (``mix_counts``).
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlode.llm.words import BLANK, WORD_CHAR, count_words
from cmdlode.session import discard, stored

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
_BUCKET_DIGITS = 3  # hex digits of the digest: 4096 buckets a source
_BLOCK_BITS = 16  # of row numbers in a block
_COPIES = 4096  # of one document made by one row


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` (one row each) -> the same and ``target`` (double).

    A source is capped if its share, when all sources of smaller cap per weight are
    capped, reaches its cap. The windows run over the table of sources, not of documents.
    """
    unit = lcm(*weights)
    named = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sources.withColumn("place", F.row_number().over(named))
        .withColumn("weight", weight.cast("bigint"))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("level", F.col("most") * F.expr(f"{unit} div weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("below", F.coalesce(F.sum("most").over(before), F.lit(0).cast("bigint")))
        .withColumn("heavy", F.sum("weight").over(after))
    )
    capped = F.col("weight") * (F.col("total") - F.col("below")) >= F.col("most") * F.col("heavy")
    settled = (
        ranked.withColumn("capped", capped)
        .withColumn("kept_by_caps", F.sum(F.when(capped, F.col("most")).otherwise(0)).over(whole))
        .withColumn("open_weight", F.sum(F.when(capped, 0).otherwise(F.col("weight"))).over(whole))
    )
    share = F.expr("try_divide(cast(weight * (total - kept_by_caps) as double), cast(open_weight as double))")
    return settled.select(
        "source", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share).alias("target")
    )


def digest_of(id_col: Column, text: Column, seed: str) -> Column:
    parts = [F.coalesce(id_col.cast("string"), F.lit("null")), F.coalesce(F.md5(text.cast("binary")), F.lit("null"))]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: its target, whole repetitions, and where its fraction ends.

    ``sized`` has ``source, size, _digest``. Documents with a digest below ``cut`` are
    taken once more; those at it give ``rest`` words together.
    """
    bucket = F.substring("_digest", 1, _BUCKET_DIGITS)
    parts = stored(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "mix")
    targets = (
        water_fill(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
        .withColumn("goal", F.round("target").cast("bigint"))
        .withColumn("epochs", F.expr("goal div greatest(source_size, 1)"))
        .withColumn("fraction", F.col("goal") - F.col("epochs") * F.col("source_size"))
    )
    running = Window.partitionBy("source").orderBy("bucket")
    cut_bucket = (
        parts.withColumn("upto", F.sum("size").over(running))
        .join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")))
        .where((F.col("upto") >= F.col("fraction")) & (F.col("upto") - F.col("size") < F.col("fraction")))
        .select("_of", "bucket", (F.col("fraction") - F.col("upto") + F.col("size")).alias("wanted"))
    )
    here = Window.partitionBy("_of").orderBy("_digest")
    cut = (
        sized.join(cut_bucket, F.col("source").eqNullSafe(F.col("_of")) & (bucket == F.col("bucket")))
        .groupBy("_of", "wanted", "_digest")
        .agg(F.sum("size").alias("tied"))
        .withColumn("upto", F.sum("tied").over(here))
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("tied") < F.col("wanted")))
        .select("_of", F.col("_digest").alias("cut"), (F.col("wanted") - F.col("upto") + F.col("tied")).alias("rest"))
    )
    joined = targets.join(cut, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    return joined.select("source", "source_size", "target", "epochs", "cut", "rest")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(plan.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of")))


def _cut_rows(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``_cut_of, cut_row, rest_of_row`` of each source: the row at the cut, of which a part is taken.

    Rows at the cut have one size. They are counted by blocks of row numbers, and only the block
    that holds the cut's row is put in order.
    """
    tied = _with_plan(sized, plan.where("cut is not null")).where(F.col("_digest") == F.col("cut"))
    tied = tied.select("_of", "row", F.expr("rest div size").alias("whole"), F.expr("rest % size").alias("part"))
    tied = stored(tied.withColumn("block", F.shiftright("row", _BLOCK_BITS)), "tied")
    counts = tied.groupBy("_of", "whole", "part", "block").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_of").orderBy("block"))
    block = counts.withColumn("upto", upto).where((F.col("upto") > F.col("whole")) & (F.col("upto") - F.col("n") <= F.col("whole")))
    block = block.select(F.col("_of").alias("_in"), F.col("block").alias("_block"), (F.col("whole") - F.col("upto") + F.col("n")).alias("before"))
    inside = tied.join(block, F.col("_of").eqNullSafe(F.col("_in")) & (F.col("block") == F.col("_block")))
    place = F.row_number().over(Window.partitionBy("_of").orderBy("row"))
    found = inside.withColumn("place", place).where(F.col("place") == F.col("before") + 1)
    return found.select(F.col("_of").alias("_cut_of"), F.col("row").alias("cut_row"), F.col("part").alias("rest_of_row"))


def mix_counts(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document: ``id, size, source_size, target, taken``. Sizes are counted once and stored."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"),
        digest_of(F.col(id_col), F.col(text_col), seed).alias("_digest"),
    )
    sized = stored(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    plan = stored(plan_mix(sized, weights, cap), "plan")
    cuts = stored(_cut_rows(sized, plan), "cuts")
    joined = _with_plan(sized, plan).join(cuts, F.col("source").eqNullSafe(F.col("_cut_of")), "left")
    tied_below = F.coalesce(F.col("row") < F.col("cut_row"), F.lit(True))
    below = (F.col("_digest") < F.col("cut")) | ((F.col("_digest") == F.col("cut")) & tied_below)
    extra = F.when(below, F.col("size")).when(F.col("row") == F.col("cut_row"), F.col("rest_of_row")).otherwise(0)
    taken = (F.col("epochs") * F.col("size") + extra).cast("bigint").alias("taken")
    return joined.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", taken)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: every document as often as its source repeats, the last time perhaps
    cut to its first words. Columns of ``docs`` are kept; documents not taken go."""
    columns = docs.columns
    size, digest = count_words(F.col(text_col)).alias("size"), digest_of(F.col(id_col), F.col(text_col), seed).alias("_digest")
    sized = stored(docs.select(F.col(source_col).alias("source"), size, digest), "sizes")
    plan = stored(plan_mix(sized, weights, cap), "plan")
    discard(sized)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    planned = _with_plan(docs.select(row, F.col(source_col).alias("source"), size, digest), plan).where(F.col("size") > 0)
    at_cut = F.coalesce(F.col("_digest") == F.col("cut"), F.lit(False))
    once_more = F.when(F.col("_digest") < F.col("cut"), 1).otherwise(0)
    none = F.lit(0).cast("bigint")
    plain = planned.where(~at_cut).select("_row", "size", (F.col("epochs") + once_more).alias("whole"), none.alias("part"))
    # Rows at a cut become one row with their number; it makes its copies in pieces of bounded size.
    tied = planned.where(at_cut).groupBy("_of", "_digest", "size", "epochs", "rest").agg(F.first("_row").alias("_row"), F.count("*").alias("n"))
    whole = (F.col("epochs") * F.col("n") + F.expr("rest div size")).alias("whole")
    tied = tied.select("_row", "size", whole, F.expr("rest % size").alias("part"))
    numbers = F.sequence(none, F.floor(F.col("whole") / _COPIES))
    pieces = tied.select("*", F.explode(numbers).alias("_piece")).repartition("_piece")
    of_piece = F.least(F.lit(_COPIES), F.col("whole") - F.col("_piece") * _COPIES).cast("bigint").alias("whole")
    cut = pieces.select("_row", "size", of_piece, F.when(F.col("_piece") == 0, F.col("part")).otherwise(none).alias("part"))
    rows = plain.unionByName(cut)
    part = F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>"))
    takes = F.concat(F.array_repeat(F.col("size"), F.col("whole").cast("int")), part)
    taken = rows.select("_row", "size", F.explode(takes).alias("_take"))
    text = F.col("_row").getField(text_col)
    pieces = F.regexp_extract_all(text, F.lit(f"{BLANK}*{WORD_CHAR}+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("_take").cast("int")), "")
    shown = F.when(F.col("_take") < F.col("size"), head).otherwise(text)
    return taken.select(*[shown.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in columns])
