"""Do two commands look like attempts at the same thing?

The predicates are staged projections: token arrays first, then the first
differing position, then the two tokens there. A stage is only filled in for
rows that still need it, so token arrays are never built for settled rows.
Expressions are SQL text: one parse instead of hundreds of calls into the JVM.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlode.functions import distance
from cmdlode.params import DEFAULTS, Params

cloudpickle.register_pickle_by_value(distance)  # executors need not have the package


def edit_ratio_at_least(a: str, b: str, longest: str, floor: float) -> str:
    """SQL: ``1 - distance / longest >= floor`` with an early exit of the distance.

    The distance is bounded one above what the ratio allows; beyond the bound
    Spark returns -1 and the ratio is certainly lower.
    """
    bound = f"CAST(floor({longest} * {1.0 - floor}D) AS INT) + 1"
    edits = f"levenshtein({a}, {b}, {bound})"
    return (
        f"CASE WHEN {longest} = 0 THEN false ELSE {edits} >= 0 AND "
        f"1D - CAST({edits} AS DOUBLE) / CAST({longest} AS DOUBLE) >= {floor}D END"
    )


def token_similar(a: str, b: str, params: Params = DEFAULTS) -> str:
    """SQL: two tokens without outer quotes are a typo fix or an extension of each other."""
    len_a, len_b = f"octet_length({a})", f"octet_length({b})"
    longest = f"greatest({len_a}, {len_b})"
    extends = f"{len_a} >= 3 AND {len_b} >= 3 AND (startswith({a}, {b}) OR startswith({b}, {a}))"
    hopeless = f"abs(char_length({a}) - char_length({b})) > {longest} * {1.0 - params.token_sim}D"
    close = edit_ratio_at_least(a, b, longest, params.token_sim)
    return f"CASE WHEN {extends} THEN true WHEN {hopeless} THEN false ELSE {close} END"


def clipped(c: str, limit: int | None) -> str:
    """SQL: the first ``limit`` bytes, or all; a character cut in half becomes U+FFFD."""
    if limit is None:
        return c
    head = f"make_valid_utf8(CAST(substring(encode({c}, 'UTF-8'), 1, {limit}) AS STRING))"
    return f"CASE WHEN octet_length({c}) > {limit} THEN {head} ELSE {c} END"


def with_same_intent(
    df: DataFrame, a: str, b: str, out: str, when: str = "true", params: Params = DEFAULTS
) -> DataFrame:
    """Add boolean ``out``: normalised texts ``a`` and ``b`` (SQL) share an intent.

    Where ``when`` does not hold the result is false and nothing is computed.
    """
    pending = f"{when} AND {a} <> {b}"
    staged = df.withColumns(
        {"_ta": F.expr(f"IF({pending}, split({a}, ' '), NULL)"), "_tb": F.expr(f"IF({pending}, split({b}, ' '), NULL)")}
    )
    # 1-based place of the first differing token, 0 when one is a prefix.
    first = "CAST(array_position(zip_with(_ta, _tb, (x, y) -> x <> y), true) AS INT)"
    staged = staged.withColumn("_k", F.expr(first))
    staged = staged.withColumns(
        {
            "_xa": F.expr("""IF(_k > 0, btrim(get(_ta, _k - 1), '"\\''), NULL)"""),
            "_xb": F.expr("""IF(_k > 0, btrim(get(_tb, _k - 1), '"\\''), NULL)"""),
            "_near": F.expr(
                f"IF(_k > 0, array_contains(slice(_tb, _k + 1, {params.near_tokens}), get(_ta, _k - 1)) OR "
                f"array_contains(slice(_ta, _k + 1, {params.near_tokens}), get(_tb, _k - 1)), NULL)"
            ),
        }
    )
    verdict = (
        f"CASE WHEN NOT coalesce(({when}), false) THEN false WHEN {a} = {b} THEN true WHEN _k = 0 THEN true "
        f"WHEN _near THEN true ELSE {token_similar('_xa', '_xb', params)} END"
    )
    return staged.withColumn(out, F.expr(f"coalesce({verdict}, false)")).drop(
        "_ta", "_tb", "_k", "_xa", "_xb", "_near"
    )


def with_similar(
    df: DataFrame, a: str, b: str, out: str, when: str = "true", params: Params = DEFAULTS, long: bool = False
) -> DataFrame:
    """Add boolean ``out``: different text, same intent, close in edit distance.

    Spark's own distance takes milliseconds for a pair of many hundred characters. Set ``long`` where
    most texts are that long; then pairs that share an intent are compared side by side in numpy.
    """
    limit = params.sim_max_bytes
    staged = with_same_intent(df, a, b, "_intent", f"({when}) AND {a} <> {b}", params)
    size = lambda c: f"octet_length({c})" if limit is None else f"least(octet_length({c}), {limit})"
    longest = f"greatest({size(a)}, {size(b)})"
    if long:
        close = F.pandas_udf(distance.ratio_udf(params.sim_low), "boolean")
        asked = [F.expr(f"IF(_intent, {clipped(c, limit)}, NULL)") for c in (a, b)]
        return staged.withColumn(out, F.coalesce(close(*asked, F.expr(longest)), F.lit(False))).drop("_intent")
    close = edit_ratio_at_least(clipped(a, limit), clipped(b, limit), longest, params.sim_low)
    verdict = f"CASE WHEN _intent THEN {close} ELSE false END"
    return staged.withColumn(out, F.expr(f"coalesce({verdict}, false)")).drop("_intent")
