"""Secret scans: fixed patterns, and two character Markov models compared by likelihood.

One model is trained on random strings, the other on ordinary identifiers. A run of
identifier characters whose log-likelihood ratio passes a threshold looks random. The
models are tables of character pairs, so a run's score is a sum over its pairs and
scanning needs no shuffle: the table of weights (80 x 80, whatever the training data)
goes into the plan as one constant array.

Offsets are code points, the end exclusive. A matcher anchored at its last match
returns the gap before each match; the running sum of gaps and matches gives offsets.

Defined results: a null text is an empty one, with no spans. Matches of a pattern too
short for it are dropped after matching. A random run that overlaps a pattern's span
is not reported again, nor is a universally unique id. Work grows with the length of runs and,
but for blocks of matches, with their number. Repeated rows are scanned alike, an empty table gives no rows.
Other input columns are kept; one named ``found`` is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlode.functions.text import compute_once
from cmdlode.llm.words import text_or_empty, words_of

# Patterns, the group that is measured, its least length, and a cheap sign.
# Runs of one class that are too short may be left out of the pattern itself.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 4, 6,
               r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": (r"AKIA[A-Z0-9]{16,}", 2, 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]{24,}", 2, 24, r"[0-9a-f]{24}"),
}
RANDOM = "random"
RUN = r"[A-Za-z0-9+/_=-]"
MIN_RUN = 20
MIN_SCORE = 12.0  # nats; an even chance for a prior of about 1 in 160,000
# Shapes that are random by design and name things: universally unique ids.
ORDINARY = r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
SAMPLE_DOCS = 400
SAMPLE_STRINGS = 8000

_FIRST, _WIDTH = ord("+"), ord("z") - ord("+") + 1
_BLOCK = 256


def random_strings(spark: SparkSession, n: int = SAMPLE_STRINGS) -> DataFrame:
    """``value, secret = true``: digests written as keys usually are (hex, base64, letters and digits)."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    letters = F.translate(b64, "+/=", "")
    forms = [F.left(digest, F.lit(40)), b64, F.translate(b64, "+/", "-_"), letters, F.upper(F.left(digest, F.lit(32))), F.upper(letters)]
    form = F.get(F.array(*forms), (F.col("id") % len(forms)).cast("int"))
    return spark.range(n).select(form.alias("value"), F.lit(True).alias("secret"))


def ordinary_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLE_DOCS) -> DataFrame:
    """``value, secret = false``: names built from neighbouring words of ``n`` documents, and drawn lines.

    The documents are those with the smallest digests of their id; those with a sign of
    a secret are left out. The sample's size is bounded by ``n``, whatever the table's.
    """
    chosen = docs.select(id_col).orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(n)
    clean = docs.join(F.broadcast(chosen.distinct()), id_col, "left_semi").where(~_any_sign(text_or_empty(text_col)))
    words = compute_once(clean, _w=words_of(text_or_empty(text_col)))
    pairs = F.transform("_w", lambda w, i: F.struct(w.alias("a"), F.get(F.col("_w"), i + 1).alias("b")))
    a, b = F.col("a"), F.col("b")
    forms = [
        a, F.concat(a, b), F.concat(a, F.lit("_"), b), F.concat(a, F.initcap(b)), F.concat(a, F.lit("-"), b),
        F.concat(a, F.lit("/"), b), F.upper(F.concat(a, F.lit("_"), b)), F.concat(b, F.lit("="), F.length(a).cast("string")),
        F.concat(b, F.lit("_"), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), F.pmod(F.xxhash64(a), F.lit(9000)).cast("int")), "yyyy-MM-dd")),
    ]
    form = F.get(F.array(*forms), F.pmod(F.xxhash64("a", "b"), F.lit(len(forms))).cast("int"))
    named = words.select(F.inline(pairs)).where("b is not null").select(form.alias("value"), F.lit(False).alias("secret"))
    rules = docs.sparkSession.range(_WIDTH).select(  # one character over and over, as in drawn lines
        F.repeat(F.char(F.col("id") + _FIRST), F.lit(2000)).alias("value"), F.lit(False).alias("secret")
    )
    return named.unionByName(rules).where(F.col("value").rlike(f"^{RUN}+$"))


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios of the second character given the first, row by row."""

    weights: tuple[float, ...]

    def score(self, run: Column) -> Column:
        """Sum of the ratios over the pairs of ``run``, which must consist of ``RUN`` characters."""
        table = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - _FIRST)  # split once: one step a character
        most = F.length(run) - 1
        pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), most), F.slice(c, F.lit(2), most), lambda a, b: a * _WIDTH + b + 1)
        places = F.element_at(F.transform(F.array(codes), pairs), 1)  # the codes are used twice and made once
        summed = F.aggregate(places, F.lit(0.0), lambda total, at: total + F.element_at(table, at))
        return F.when(F.length(run) < 2, F.lit(0.0)).otherwise(summed)


def train(samples: DataFrame, smoothing: float = 0.5) -> MarkovModel:
    """Fit both models from ``value, secret``; values with other characters than ``RUN`` are ignored.

    Pairs are counted by Spark; what comes to the driver is at most two counts for each
    of 80 x 80 pairs. Without samples all weights are 0.
    """
    usable = samples.where(F.col("value").rlike(f"^{RUN}+$") & F.col("secret").isNotNull())
    whole = usable.groupBy("value", "secret").count()
    steps = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = whole.where(F.length("value") > 1).select(
        "secret", "count", F.explode(F.transform(steps, lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair")
    )
    counts: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for row in pairs.groupBy("secret", "pair").agg(F.sum("count").alias("n")).collect():
        counts[row["secret"]][row["pair"]] = row["n"]
    rows = {label: [0] * _WIDTH for label in counts}
    for label, seen in counts.items():
        for pair, n in seen.items():
            rows[label][ord(pair[0]) - _FIRST] += n

    def log_p(label: bool, i: int, j: int) -> float:
        n = counts[label].get(chr(i + _FIRST) + chr(j + _FIRST), 0)
        return math.log((n + smoothing) / (rows[label][i] + smoothing * _WIDTH))

    both = all(counts.values())
    cells = ((i, j) for i in range(_WIDTH) for j in range(_WIDTH))
    return MarkovModel(tuple(round(log_p(True, i, j) - log_p(False, i, j), 6) if both else 0.0 for i, j in cells))


def _any_sign(text: Column) -> Column:
    found = F.lit(False)
    for *_, sign in KINDS.values():
        found = found | text.rlike(sign)
    return found


def _lengths(text: Column, pattern: str, group: int) -> Column:
    anchored = F.lit(rf"\G((?s:.*?))({pattern})")
    part = lambda g: F.transform(F.regexp_extract_all(text, anchored, F.lit(g)), F.length)
    return F.arrays_zip(part(1).alias("gap"), part(2).alias("len"), part(group).alias("measured"))


def _blocks(parts: Column) -> Column:
    """An array as an array of blocks of ``_BLOCK`` elements; an empty one has none."""
    last = F.floor((F.size(parts) - 1) / _BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(parts, i * _BLOCK + 1, F.lit(_BLOCK)))
    return F.filter(cut, lambda block: F.size(block) > 0)


def _running(sizes: Column, first: Column) -> Column:
    """Running sums of a short array, ``first`` in front of them."""
    return F.aggregate(sizes, F.array(first), lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n))


def _ends(parts: str) -> Column:
    """Where each part ends. Appending copies an array, so sums run within blocks and over blocks."""
    blocks = _blocks(F.transform(parts, lambda p: p["gap"] + p["len"]))

    def summed(cut: Column) -> Column:
        whole = F.transform(cut, lambda block: F.aggregate(block, F.lit(0), lambda total, n: total + n))
        heads = F.slice(_running(whole, F.lit(0)), F.lit(1), F.size(cut))
        inside = lambda block, head: F.slice(_running(block, head), F.lit(2), F.size(block))
        return F.flatten(F.zip_with(cut, heads, inside))

    return F.element_at(F.transform(F.array(blocks), summed), 1)


def scan(
    docs: DataFrame,
    model: MarkovModel,
    text_col: str = "text",
    min_run: int = MIN_RUN,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Replaces the text by ``found``: ``array<struct<start, end, kind>>`` in order of start and kind.

    Costs one matching pass a kind for documents with its sign, none for others.
    """
    none = F.array().cast("array<struct<gap:int,len:int,measured:int>>")
    text = F.col("_text")
    runs = f"{RUN}{{{min_run},}}"
    has_run = text.rlike(runs)
    kinds = [*KINDS, RANDOM]
    inner = [f"_{kind}{end}" for kind in kinds for end in ("", "_ends")] + ["_text", "_scores", "_base", "_runs", "_near", "_ordinary"]
    docs = docs.drop(*(c for c in (*inner, "found") if c != text_col))
    once = compute_once(docs, _text=text_or_empty(text_col)).drop(text_col)
    parts = {f"_{kind}": F.when(text.rlike(sign), _lengths(text, p, group)).otherwise(none)
             for kind, (p, group, _, sign) in KINDS.items()}
    scores = F.transform(F.regexp_extract_all(text, F.lit(runs), F.lit(0)), model.score)
    parts[f"_{RANDOM}"] = F.when(has_run, _lengths(text, runs, 2)).otherwise(none)
    parts["_scores"] = F.when(has_run, scores).otherwise(F.array().cast("array<double>"))
    ordinary = F.transform(F.regexp_extract_all(text, F.lit(runs), F.lit(0)), lambda run: run.rlike(f"^(?:{ORDINARY})$"))
    parts["_ordinary"] = F.when(has_run, ordinary).otherwise(F.array().cast("array<boolean>"))
    once = compute_once(once, **parts).drop("_text")
    once = compute_once(once, **{f"_{kind}_ends": _ends(f"_{kind}") for kind in kinds})

    def spans(kind: str) -> Column:
        end = lambda i: F.get(F.col(f"_{kind}_ends"), i)
        return F.transform(
            f"_{kind}",
            lambda p, i: F.struct((end(i) - p["len"]).alias("start"), F.lit(kinds.index(kind)).alias("rank"), end(i).alias("end")),
        )

    def long_enough(kind: str, least: int) -> Column:
        return F.filter(spans(kind), lambda s, i: F.get(F.col(f"_{kind}"), i)["measured"] >= least)

    base = [long_enough(kind, least) for kind, (_, _, least, _) in KINDS.items()]
    once = compute_once(once, _base=F.array_sort(F.concat(*base)), _runs=spans(RANDOM))
    reach = F.transform(
        _blocks(F.col("_base")),
        lambda block: F.struct(
            F.get(block, F.lit(0))["start"].alias("first"), F.array_max(F.transform(block, lambda b: b["end"])).alias("last"), block.alias("spans")
        ),
    )  # a run is compared with the spans of the blocks it reaches into
    once = compute_once(once, _near=reach)
    meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    inside = lambda s, n: (n["first"] < s["end"]) & (s["start"] < n["last"]) & F.exists(n["spans"], lambda b: meets(s, b))
    apart = lambda s: ~F.exists("_near", lambda n: inside(s, n))
    unlike = F.filter("_runs", lambda s, i: (F.get(F.col("_scores"), i) >= min_score) & ~F.get(F.col("_ordinary"), i) & apart(s))
    names = F.array(*map(F.lit, kinds))
    named = F.transform(
        F.array_sort(F.concat("_base", unlike)),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["rank"]).alias("kind")),
    )
    return once.withColumn("found", named).drop(*inner)


def as_text(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
