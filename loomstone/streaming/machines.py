"""State machines over ordered events: as folds of one key's events, and, where the states are few, as compositions of transitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILURES, COOLDOWN_MS = 5, 30_000
MOST_RETRIES = 5


def breaker_step(state: str, failures: int, opened: int, at: int, outcome: str, most: int = FAILURES, cooldown: int = COOLDOWN_MS) -> tuple[str, int, int, bool]:
    """A circuit breaker's (state, failures, opened, allowed) after a call at a time in ms.

    outcome: success, transient or permanent (what the call would give). An open breaker blocks until the cooldown is over
    and then lets one call try; permanent failures don't count against the provider.
    """
    if state == "open":
        if at - opened < cooldown:
            return state, failures, opened, False
        state = "half_open"
    if outcome == "success":
        return "closed", 0, opened, True
    if outcome == "permanent":
        return ("closed", 0, opened, True) if state == "half_open" else (state, failures, opened, True)
    if state == "half_open":
        return "open", failures, at, True
    failures += 1
    return ("open", failures, at, True) if failures >= most else (state, failures, opened, True)


def _summary(key: object, state: tuple[str, int, int], blocked: int, calls: int) -> pd.DataFrame:
    return pd.DataFrame([(key, state[0], state[1], blocked, calls)], columns=["key", "state", "failures", "blocked", "calls"])


def _folded(events: DataFrame, order: list[str], start: Callable[[], tuple], step: Callable[[tuple, tuple], tuple], row: Callable[[object, tuple], tuple], schema: str) -> DataFrame:
    """A fold over each key's events in order: rows of a key come together and sorted, and only the current key's state is held.

    events: key, and the columns of order first. Sorting spills, so a key's history may be of any length.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in parts:
            out = []
            for key, *event in part.itertuples(index=False, name=None):
                if state is None or key != now:
                    if state is not None:
                        out.append(row(now, state))
                    now, state = key, start()
                state = step(state, event)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([row(now, state)], columns=names)

    return events.filter(F.col("key").isNotNull()).repartition("key").sortWithinPartitions("key", *order).mapInPandas(fold, schema)


def breaker_replay(events: DataFrame, key: str, at_ms: Column, order: Column, outcome: Column) -> DataFrame:
    """Final state of each key's breaker, with blocked and all calls. Null keys don't count."""

    def step(s: tuple, e: tuple) -> tuple:
        state, failures, opened, allowed = breaker_step(*s[:3], e[0], e[2])
        return state, failures, opened, s[3] + (not allowed), s[4] + 1

    ordered = events.select(F.col(key).alias("key"), at_ms.alias("at"), order.alias("o"), outcome.alias("outcome"))
    kind = dict(ordered.dtypes)["key"]
    return _folded(ordered, ["at", "o"], lambda: ("closed", 0, 0, 0, 0), step, lambda k, s: (k, s[0], s[1], s[3], s[4]), f"key {kind}, state string, failures int, blocked long, calls long")


def breaker_stream(events: DataFrame) -> DataFrame:
    """Breakers over a stream (key, at, outcome): the state after each batch's events of a key."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, failures, opened, blocked, calls = held.get if held.exists else ("closed", 0, 0, 0, 0)
        for e in pd.concat(list(parts)).sort_values("at", kind="stable").itertuples(index=False):
            state, failures, opened, allowed = breaker_step(state, failures, opened, e.at, e.outcome)
            blocked, calls = blocked + (not allowed), calls + 1
        held.update((state, failures, opened, blocked, calls))
        yield _summary(key[0], (state, failures, opened), blocked, calls)

    return events.groupBy("key").applyInPandasWithState(update, "key string, state string, failures long, blocked long, calls long", "state string, failures long, opened long, blocked long, calls long", "update", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class Machine:
    """A machine of few states: the states, the first being the start, and for each symbol the number of the state that follows each state."""

    states: tuple
    follows: dict[str, tuple[int, ...]]

    @classmethod
    def explored(cls, start: object, symbols: Sequence[str], step: Callable[[object, str], object], most: int = 200) -> Machine:
        """The states that the symbols reach from the start, by a step function; an error beyond ``most``."""
        states = [start]
        for state in states:
            for symbol in symbols:
                after = step(state, symbol)
                if after not in states:
                    states.append(after)
            if len(states) > most:
                raise ValueError(f"more than {most} states")
        number = {state: i for i, state in enumerate(states)}
        return cls(tuple(states), {x: tuple(number[step(state, x)] for state in states) for x in symbols})


def _compositions(functions: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """One function for each run of a segment: the functions in its rows, applied one after the other, composed in pairs."""
    while True:
        first = np.r_[True, segment[1:] != segment[:-1]]
        if first.all():
            return functions
        place = np.arange(len(segment)) - np.maximum.accumulate(np.where(first, np.arange(len(segment)), 0))
        even = np.flatnonzero(place % 2 == 0)
        paired = even[(even + 1 < len(segment)) & ~np.r_[first[1:], True][even]]
        functions = functions.copy()
        functions[paired] = np.take_along_axis(functions[paired + 1], functions[paired], axis=1)
        functions, segment = functions[even], segment[even]


def composed(events: DataFrame, key: str, order: Column, symbol: Column, machine: Machine) -> DataFrame:
    """(key, state): the number of the state in which each key's events, in their order, leave a machine. Null keys don't count; unknown symbols change nothing.

    An event is a function from states to states, and functions compose: so a key's events are cut anywhere. Ranges of
    (key, order) are dealt to tasks, however many events a key has; each batch of a task's sorted rows shrinks to one
    function for each key in it, by arrays; and these few functions, in order, are applied to the start.
    """
    letters = "".join(chr(0x4E00 + i) for i in range(len(machine.states)))
    symbols = list(machine.follows)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, symbols)), symbol), F.lit(0)).cast("int")
    told = events.select(F.col(key).alias("key"), order.alias("o"), code.alias("x")).filter(F.col("key").isNotNull())
    table = np.array([range(len(machine.states)), *machine.follows.values()], dtype=np.intp)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            new = np.r_[True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)] if len(keys) > 1 else np.array([True])
            functions = _compositions(table[batch.column("x").to_numpy()], np.cumsum(new))
            written = pa.array(["".join(letters[i] for i in f) for f in functions])
            n = len(functions)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.flatnonzero(new))), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), written], names=["key", "part", "at", "f"])
            at += n

    kind = told.schema["key"].dataType.simpleString()
    chunks = told.repartitionByRange("key", "o").sortWithinPartitions("key", "o").select("key", "x").mapInArrow(shrink, f"key {kind}, part int, at long, f string")
    ordered = F.array_sort(F.collect_list(F.struct("part", "at", "f")))
    last = F.aggregate(ordered, F.lit(letters[0]), lambda s, c: F.call_function("translate", s, F.lit(letters), c["f"]))
    return chunks.groupBy("key").agg(last.alias("s")).select("key", (F.instr(F.lit(letters), F.col("s")) - 1).alias("state"))


def crawl_step(state: str, retries: int, outcome: str) -> tuple[str, int]:
    """A page's (state, retries) after an outcome: ok, gone, error, ingested or requeue.

    The fifth error quarantines; a requeue frees from quarantine; what is expired or ingested stays so.
    """
    if outcome == "requeue":
        return ("unknown", 0) if state == "quarantined" else (state, retries)
    if outcome == "ingested":
        return ("ingested" if state == "collected" else state), retries
    if state in ("quarantined", "expired", "ingested"):
        return state, retries
    if outcome == "ok":
        return "collected", 0
    if outcome == "gone":
        return "expired", retries
    if outcome == "error":
        return ("quarantined" if retries + 1 >= MOST_RETRIES else "retryable"), retries + 1
    return state, retries


CRAWL = Machine.explored(("unknown", 0), ("ok", "gone", "error", "ingested", "requeue"), lambda state, outcome: crawl_step(*state, outcome))


def crawl_fold(events: DataFrame, key: str, order: Column, outcome: Column) -> DataFrame:
    """Final crawl state of each key: unknown, collected, expired, retryable (with retries) or quarantined, or ingested. Null keys don't count."""
    states = F.array(*(F.struct(F.lit(state).alias("state"), F.lit(retries).alias("retries")) for state, retries in CRAWL.states))
    final = composed(events, key, order, outcome, CRAWL)
    return final.select("key", F.element_at(states, F.col("state") + 1).alias("s")).select("key", "s.state", "s.retries")


def needs_fetch(state: Column) -> Column:
    """Keys whose page has to be loaded."""
    return F.coalesce(state, F.lit("unknown")).isin("unknown", "retryable")
