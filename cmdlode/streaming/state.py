"""Keyed state of the streaming operators.

The only Python that runs on executors. The module imports nothing from the
package, so that it can be sent to workers by value.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _within(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits turn ``a`` into ``b``.

    Keeps, for each number of edits, the furthest place reached on each diagonal, so the
    cost follows the edits allowed and made, not the product of the lengths.
    """
    goal = len(a) - len(b)
    if abs(goal) > most:
        return False
    reach = {0: 0}
    for edits in range(most + 1):
        new: dict[int, int] = {}
        for d in range(max(-edits, -len(b)), min(edits, len(a)) + 1):
            if edits:
                steps = (reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -2))
                i = min(max(steps), len(a), len(b) + d)
            else:
                i = 0
            if i < max(0, d):
                continue
            while i < len(a) and i - d < len(b) and a[i] == b[i - d]:
                i += 1
            new[d] = i
        if new.get(goal) == len(a):
            return True
        reach = new
    return False


def same_intent(a: str, b: str, near: int = 3, floor: float = 0.5) -> bool:
    """The predicate of ``functions.similarity.with_same_intent`` for two strings."""
    left, right = a.split(" "), b.split(" ")
    at = next((i for i, (x, y) in enumerate(zip(left, right)) if x != y), None)
    if at is None:
        return True
    x, y = left[at], right[at]
    window = slice(at + 1, at + 1 + near)
    if x in right[window] or y in left[window]:
        return True
    x, y = x.strip("\"'"), y.strip("\"'")
    size_x, size_y = len(x.encode()), len(y.encode())
    if min(size_x, size_y) >= 3 and (x.startswith(y) or y.startswith(x)):
        return True
    longest = max(size_x, size_y)
    # 1 - edits / longest >= floor, in the floating-point steps of the batch form
    most = next((n for n in range(int(longest * (1 - floor)) + 1, -1, -1) if longest and 1 - n / longest >= floor), -1)
    return most >= 0 and _within(x, y, most)


_NAN = float("nan")  # a null number where steps reckon with it: compares false, and sorts last


def _towards_zero(a: int, b: int) -> int:
    return a // b if a >= 0 else -(-a // b)


def _by_time(row) -> tuple:
    """By ``micros``, then ``seq``; missing ones last."""
    timeless, unnumbered = row.micros != row.micros, row.seq is None
    return timeless, 0 if timeless else row.micros, unnumbered, 0 if unnumbered else row.seq


class ArrivalProcessor(StatefulProcessor):
    """Handle the rows of a key batch by batch, those of a batch in (ts, seq) order.

    For logs that arrive in order. Subclasses keep one state tuple. Rows come and go as plain rows:
    most keys have few, and a pandas frame for each key would take far longer than its rows.
    """

    state_schema = ""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema)

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple | None, dict | None]:
        """New state and output for one row (a named tuple with ``micros``)."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        make, names = namedtuple("Named", self.columns), {"micros", "dur_ms"} & set(self.columns)
        known = (make(*row) for row in rows)
        known = [row._replace(**{c: _NAN for c in names if getattr(row, c) is None}) for row in known]
        state = tuple(_NAN if v is None else v for v in self.state.get()) if self.state.exists() else None
        for row in sorted(known, key=_by_time):
            state, made = self.step(state, row)
            if made is not None:
                yield Row(**{c: None if v != v else v for c, v in made.items()})
        if state is None:
            self.state.clear()
        else:
            self.state.update(tuple(None if v != v else v for v in state))


class FightProcessor(ArrivalProcessor):
    """Failure runs closed by a success of the same intent."""

    state_schema = "first bigint, last bigint, cmd string, failures bigint"

    def __init__(self, columns, gap_micros: int, near: int, floor: float) -> None:
        super().__init__(columns)
        self.gap, self.near, self.floor = gap_micros, near, floor

    def step(self, state, row):
        if state is not None:
            recent = row.micros - state[1] <= self.gap
            if not recent or not same_intent(state[2], row.cmd, self.near, self.floor):
                state = None
        if row.exit != 0:
            first, failures = (state[0], state[3]) if state else (row.micros, 0)
            return (first, row.micros, row.cmd, failures + 1), None
        if state is None:
            return None, None
        return None, _fight(row, state[3] + 1, state[0], row.micros)


def _fight(row, attempts: int, first: int, last: int) -> dict:
    return {
        "scope": row.scope, "tool": row.tool, "shell": row.shell, "seq": row.seq, "command": row.cmd,
        "attempts": attempts, "cost_ms": max(0, _towards_zero(last - first, 1000) + row.dur_ms), "cwd": row.cwd, "ts_us": last,
    }


class CooldownProcessor(ArrivalProcessor):
    """Let a row through when none was within the cooldown; it restarts the clock."""

    state_schema = "spoken bigint"

    def __init__(self, columns, cooldown_micros: int) -> None:
        super().__init__(columns)
        self.cooldown = cooldown_micros

    def step(self, state, row):
        if state is not None and row.micros - state[0] < self.cooldown:
            return state, None
        return (row.micros,), row._asdict()


class Slices:
    """For ``mapInPandas``: whole slices of a key (its ``rows`` in order) to what the next step needs to know.

    Slices are handled by themselves, many in one batch, and those of a busy key by different tasks.
    """

    def __init__(self, columns: list[str], keys: list[str], slice_micros: int) -> None:
        self.columns, self.keys, self.slice = list(columns), list(keys), slice_micros

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = namedtuple("Row", self.columns)
        for frame in frames:
            made = []
            for *key, held in zip(*(frame[c] for c in (*self.keys, "rows"))):
                named = dict(zip(self.keys, key))
                rows = [make(**named, **row) for row in held]
                made += self.entries((*key, rows[0].micros // self.slice), rows)
            if made:
                yield pd.DataFrame(made)

    def summary(self, key, rows: list[tuple], told_at: pd.Timestamp | None = None) -> pd.DataFrame:
        """One slice; ``key`` ends in its number."""
        made = pd.DataFrame(self.entries(key, rows))
        return made if told_at is None else made.assign(told_at=told_at)

    def entries(self, key, rows: list[tuple]) -> list[dict]:
        raise NotImplementedError


class FightSlices(Slices):
    """A slice to its whole fights, and the runs at its ends that may go on outside.

    A run goes on from a failure to the next row if that is recent and has the same intent. ``head``
    marks the first run, which may belong to the one before the slice, ``ends`` a run that another
    one follows. A run that is neither first nor open at the end is a fight or nothing.
    """

    def __init__(self, columns, keys, slice_micros, gap_micros: int, near: int, floor: float) -> None:
        super().__init__(columns, keys, slice_micros)
        self.gap, self.near, self.floor = gap_micros, near, floor

    def entries(self, key, rows):
        runs: list[list] = []
        for row in rows:
            last = runs[-1][1] if runs else None
            near = last is not None and last.exit != 0 and row.micros - last.micros <= self.gap
            if near and same_intent(last.cmd, row.cmd, self.near, self.floor):
                runs[-1][1:] = [row, runs[-1][2] + 1]
            else:
                runs.append([row, row, 1])
        out = []
        for place, (first, last, n) in enumerate(runs):
            head, tail = place == 0, place == len(runs) - 1
            whole = not head and last.exit == 0
            if whole and n == 1 or not (whole or head or tail):
                continue
            out.append({
                "scope": last.scope, "tool": last.tool, "shell": last.shell, "slice": int(key[-1]), "place": place,
                "whole": whole, "head": head, "ends": not tail, "n": n, "first": first.micros, "first_cmd": first.cmd,
                "micros": last.micros, "cmd": last.cmd, "exit": last.exit, "dur_ms": last.dur_ms, "cwd": last.cwd,
                "seq": last.seq,
            })
        return out


class FightJoiner(StatefulProcessor):
    """Join the open runs of a key's slices, which come in order; whole fights pass.

    The state is the run of failures at the end of the last slice. A key has a few rows for each
    slice, however many rows the slice had.
    """

    def __init__(self, gap_micros: int, near: int, floor: float) -> None:
        self.gap, self.near, self.floor = gap_micros, near, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "first bigint, last bigint, cmd string, failures bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        edges, out = [], []
        for frame in rows:
            whole = frame[frame["whole"]]
            if len(whole):
                yield pd.DataFrame([_fight(row, row.n, row.first, row.micros) for row in whole.itertuples(index=False)])
            edges += list(frame[~frame["whole"]].itertuples(index=False))
        state = tuple(self.state.get()) if self.state.exists() else None
        for row in sorted(edges, key=lambda r: (r.slice, r.place)):
            goes_on = row.head and state is not None and row.first - state[1] <= self.gap
            goes_on = goes_on and same_intent(state[2], row.first_cmd, self.near, self.floor)
            first, n = (state[0], state[3] + row.n) if goes_on else (row.first, row.n)
            state = None
            if row.exit == 0:
                if n > 1:
                    out.append(_fight(row, n, first, row.micros))
            elif not row.ends:
                state = (first, row.micros, row.cmd, n)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            self.handle.registerTimer((state[1] + self.gap) // 1000 + 1)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1] + self.gap < timerValues.getCurrentWatermarkInMs() * 1000:
            self.state.clear()
        return iter(())


class PackedSlices(Slices):
    """A slice to one row that holds its rows in order."""

    def entries(self, key, rows):
        packed = pickle.dumps([tuple(r) for r in rows])
        return [dict(zip(self.keys, key)) | {"slice": int(key[-1]), "packed": packed}]


class CooldownJoiner(StatefulProcessor):
    """The cooldown over a key's packed slices; they wait in a map by slice and are opened one by one."""

    def __init__(self, columns: list[str], cooldown_micros: int) -> None:
        self.columns, self.cooldown = columns, cooldown_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spoken = handle.getValueState("spoken", "spoken bigint")
        self.slices = handle.getMapState("slices", "slice bigint", "packed binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for row in frame.itertuples(index=False):
                self.slices.updateValue((row.slice,), (row.packed,))
        spoken = self.spoken.get()[0] if self.spoken.exists() else None
        place = self.columns.index("micros")
        for number in sorted(k[0] for k in self.slices.keys()):
            out = []
            for row in pickle.loads(self.slices.getValue((number,))[0]):
                if spoken is None or row[place] - spoken >= self.cooldown:
                    spoken = row[place]
                    out.append(row)
            self.slices.removeKey((number,))
            if out:
                yield pd.DataFrame(out, columns=self.columns)
        self.spoken.update((spoken,))
        self.handle.registerTimer((spoken + self.cooldown) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.spoken.exists() and self.spoken.get()[0] + self.cooldown < timerValues.getCurrentWatermarkInMs() * 1000:
            self.spoken.clear()
        return iter(())
