"""Streaming forms of the batch operators.

``lateness`` (such as ``"10 minutes"``) sets a watermark on the journal, before
any filter. (Catalyst may still move a filter below it; then only rows that pass
move time on, and results are the same but later.) Rows then count in event order, in two
chained steps: each key's time is cut into slices, which are held and summed up side by
side until the watermark has passed them, and a second step joins the sums of a key. State
is dropped by event time, and rows later than the watermark are discarded
(``sinks.split_late`` keeps them). Without it micro-batches count in arrival order and a key's
last state stays; that is for replays of ordered logs.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlode.operators.fights import journal_usage
from cmdlode.operators.suggest import failures, suggest
from cmdlode.operators.usage import classify_commands, command_counts
from cmdlode.params import DEFAULTS, Params
from cmdlode.sources.journal import accepted, rejected, resolve_capture
from cmdlode.streaming import state

cloudpickle.register_pickle_by_value(sys.modules[state.__name__])

COUNT_KEYS = ["scope", "tool", "cmd"]
FIGHTS_SCHEMA = (
    "scope string, tool string, shell string, seq bigint, command string, attempts bigint, "
    "cost_ms bigint, cwd string, ts_us bigint"
)
RUNS_SCHEMA = (
    "scope string, tool string, shell string, slice bigint, place int, whole boolean, head boolean, ends boolean, "
    "n bigint, first bigint, first_cmd string, micros bigint, cmd string, exit int, dur_ms bigint, cwd string, seq bigint"
)


def _late(journal: DataFrame, lateness: str | None) -> DataFrame:
    return journal if lateness is None else journal.withWatermark("ts", lateness)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def _in_arrival_order(rows: DataFrame, keys: list[str], make, out: str | None = None) -> DataFrame:
    """Run a processor over ``rows``, which have ``ts`` and ``seq``, one task a key and batch."""
    plain = rows.withColumn("micros", F.unix_micros("ts")).drop("ts")
    return plain.groupBy(*keys).transformWithState(make(plain.columns), out or _schema(plain), "append", "None")


def _in_event_order(rows: DataFrame, keys: list[str], params: Params, make_slices, sums: str, make_joiner, out: str | None = None) -> DataFrame:
    """Sum up slices of time of each key, then join the sums of a key.

    Slices are windows that Spark collects natively until the watermark has passed them: most hold few
    rows, and a Python state for each would cost far more than its rows.
    """
    plain = rows.withColumn("micros", F.unix_micros("ts")).drop("ts")
    held = ["micros", "seq", *[c for c in plain.columns if c not in (*keys, "micros", "seq")]]
    windows = rows.withColumn("micros", F.unix_micros("ts")).groupBy(F.window("ts", f"{params.slice_s} seconds"), *keys)
    sliced = windows.agg(F.sort_array(F.collect_list(F.struct(*held))).alias("rows")).select(*keys, "rows")
    summed = sliced.mapInPandas(make_slices(plain.columns, keys, params.slice_s * 1_000_000), sums)
    return summed.groupBy(*keys).transformWithStateInPandas(make_joiner(plain.columns), out or _schema(plain), "append", "EventTime")


def ingest(events: DataFrame, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Capture events to ``(journal rows, rejected events)``; stateless."""
    resolved = resolve_capture(events, params)
    return accepted(resolved, params), rejected(resolved)


def stream_fights(journal: DataFrame, lateness: str | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Fights of a journal stream, as in ``operators.fights`` (``ts`` as ``ts_us``)."""
    keys, limits = ["scope", "tool", "shell"], (params.max_fight_gap_s * 1_000_000, params.near_tokens, params.token_sim)
    used = journal_usage(_late(journal, lateness), params)
    if lateness is None:
        return _in_arrival_order(used, keys, lambda columns: state.FightProcessor(columns, *limits), FIGHTS_SCHEMA)
    make_slices = lambda *base: state.FightSlices(*base, *limits)
    return _in_event_order(used, keys, params, make_slices, RUNS_SCHEMA, lambda _: state.FightJoiner(*limits), FIGHTS_SCHEMA)


def stream_suggestions(
    journal: DataFrame,
    by_tool: DataFrame,
    roots: DataFrame | None = None,
    params: Params = DEFAULTS,
    lateness: str | None = None,
) -> DataFrame:
    """Suggestions for failures of a journal stream; ``by_tool`` is the static side."""
    used = journal_usage(_late(journal, lateness), params)
    return suggest(failures(used, roots, params), by_tool)


def stream_cooldown(
    suggestions: DataFrame, ordered: bool = False, params: Params = DEFAULTS
) -> DataFrame:
    """Rate limit per scope and tool. Only rows with a suggestion restart the clock.

    Set ``ordered`` when the suggestions were made with a ``lateness``.
    """
    rows = suggestions.withColumn("won_at_us", F.unix_micros("won_at")).drop("won_at")
    keys, cooldown = ["scope", "tool"], params.cooldown_s * 1_000_000
    if ordered:
        sums = "scope string, tool string, slice bigint, packed binary"
        make_joiner = lambda columns: state.CooldownJoiner(columns, cooldown)
        passed = _in_event_order(rows, keys, params, state.PackedSlices, sums, make_joiner)
    else:
        passed = _in_arrival_order(rows, keys, lambda columns: state.CooldownProcessor(columns, cooldown))
    return passed.withColumnRenamed("micros", "ts_us")


def running_counts(commands: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Command and help counts so far, a row for each of ``COUNT_KEYS``; write in update mode, keyed by them
    (``sinks.merge_by_key``)."""
    return command_counts(classify_commands(commands, params), params)
