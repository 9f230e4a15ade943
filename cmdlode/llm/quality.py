"""Quality rules: a table of thresholds compiled into one projection.

A rule bounds one measure of a document; ``RULES`` is data, and ``verdict`` turns any
such table into columns. Measures are built from arrays of the document itself with
built-in functions, so a document's cost is its length (times its logarithm where
windows repeat) and nothing is shuffled.

Defined results: a null text is an empty one: all counts 0, ``base_failed`` true. Lines
without words count nowhere. Repeated rows are judged alike. Input columns are kept, but
those named like a result (or like an intermediate array, ``_INNER``) are replaced;
``keep_good`` keeps all of them. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlode.functions.text import compute_once
from cmdlode.llm.words import WORD_CHAR, text_or_empty, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this", "are",
    "der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    "le", "la", "de", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur",
    "el", "los", "las", "y", "del", "se", "una", "con", "no", "es", "al", "lo", "su", "para", "o",
)


@dataclass(frozen=True)
class Rule:
    """``measure`` (an SQL expression over the counts) must lie within the bounds, if it applies."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    applies: str = "true"


_RESULTS = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "broken", "kept")
_INNER = ("_text", "_words", "_lines", "_ids", "_win", "_next", "_own", "_runs")

# Measures are ratios of integers, so the same bounds hold for any length.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.5, 12.0),
    Rule("symbols", "n_symbols / n_words", high=0.2),
    Rule("stop_words", "n_stop_words / n_words", low=0.01, applies="n_words >= 50"),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.6, applies="n_lines >= 3"),
    Rule("repeated_words", "n_repeat_words / n_words", high=0.3),
)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts that rules may use; drops the text.

    Arrays pass through generators one after the other, so each is computed once and
    the functions over it read it by position.
    """
    text = text_or_empty(text_col)
    docs = docs.drop(*(c for c in (*_RESULTS, *_INNER) if c != text_col))
    once = compute_once(docs, _text=text, _words=words_of(text))
    t, w = F.col("_text"), F.col("_words")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD_CHAR))
    stop = sorted(set(STOP_WORDS))
    once = compute_once(
        once.drop(text_col),
        n_words=F.size(w).cast("bigint"),
        _lines=lines,
        _ids=F.transform(w, lambda x: F.xxhash64(x)),
        n_symbols=F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("bigint"),
        word_chars=F.length(F.regexp_replace(t, r"[ \x09-\x0D]+", "")).cast("bigint"),
        n_stop_words=F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("bigint"),
    ).drop("_text", "_words")
    counted = once.withColumns(
        {
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        }
    ).drop("_lines")
    return repeated_words(counted, "_ids").drop("_ids")


def repeated_words(docs: DataFrame, ids: str, window: int = WINDOW) -> DataFrame:
    """Adds ``n_repeat_words``: the words covered by windows (a power of two) that occur more than once.

    Only documents with a repeated window sort their windows; equal ones are then
    neighbours, and their positions, in order, are merged into covered stretches.
    """
    none = F.array().cast("array<bigint>")
    docs, last, width = docs.withColumn("_win", F.col(ids)), F.size(ids) - window + 1, 1
    while width < window:  # a window of 2w words is hashed from its two halves
        halves = F.zip_with("_win", F.slice("_win", width + 1, F.size("_win")), lambda a, b: F.xxhash64(a, b))
        docs, width = compute_once(docs, _next=halves).drop("_win").withColumnRenamed("_next", "_win"), 2 * width
    docs = compute_once(docs, _own=F.when(last > 0, F.slice("_win", F.lit(1), last)).otherwise(none))
    docs = docs.drop("_win").withColumnRenamed("_own", "_win")
    pairs = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    docs = compute_once(docs, _runs=F.when(repeats, pairs)).drop("_win")
    run = lambda k: F.get(F.col("_runs"), k.cast("int")).getField("h")
    twice = F.filter("_runs", lambda x, k: (x["h"] == run(k - 1)) | (x["h"] == run(k + 1)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    merged = F.aggregate(
        starts,
        zero,
        lambda acc, p: F.struct(
            (acc["covered"] + p + window - F.greatest(p, acc["end"])).alias("covered"), (p + window).alias("end")
        ),
        lambda acc: acc["covered"],
    )
    return docs.withColumn("n_repeat_words", F.coalesce(merged, F.lit(0)).cast("bigint")).drop("_runs")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules a document breaks, as one array expression."""
    broken = []
    for rule in rules:
        value = F.expr(f"try_divide(cast({rule.measure.split('/')[0]} as double), {rule.measure.split('/')[1]})")
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        broken.append(F.when(F.expr(rule.applies) & out, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns of ``docs`` without the text, the counts, ``base_failed``, ``broken`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = measures(docs, text_col).withColumn("base_failed", base).withColumn("broken", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that no rule rejects, with their own columns only."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = judge(docs.select(row, F.col(text_col).alias("_judged")), "_judged", rules)
    return judged.where("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
