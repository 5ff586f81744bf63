"""Counters of a pass, taken in the pass itself: no second scan of what was read, and none of what was written.

A set of counters splits rows by dimensions whose values are declared (stages, outcomes, sources, providers); what isn't
declared is counted as ``other``, null too. On a batch plan they come from an ``Observation``, on a stream from the
progress that a listener hears, a batch once however often it is told.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

OTHER = "other"
#: Most counters of a pass: each is an aggregate over all rows.
MOST_CELLS = 2000


@dataclass(frozen=True)
class Counters:
    """What to count: a column and its declared values for each dimension, and columns to sum besides."""

    name: str
    dimensions: dict[str, tuple[Column, Sequence[str]]]
    sums: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self._cells()) * (1 + len(self.sums)) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} counters")

    def _cells(self) -> list[tuple[str, ...]]:
        return list(product(*([*values, OTHER] for _, values in self.dimensions.values())))

    def metrics(self) -> list[Column]:
        """An aggregate for each combination of values, named by its number."""
        slots = {d: F.when(c.isin(*values), c).otherwise(OTHER) for d, (c, values) in self.dimensions.items()}
        out = []
        for i, cell in enumerate(self._cells()):
            own = F.lit(True)
            for d, value in zip(self.dimensions, cell, strict=True):
                own = own & (slots[d] == value)
            out.append(F.count_if(own).alias(f"n{i}"))
            out += [F.coalesce(F.sum(F.when(own, c.cast("double"))), F.lit(0.0)).alias(f"s{i}_{j}") for j, c in enumerate(self.sums.values())]
        return out

    def rows(self, found: dict[str, float]) -> Iterator[tuple]:
        """Rows of values, number and sums, of combinations that occurred."""
        for i, cell in enumerate(self._cells()):
            if found.get(f"n{i}"):
                yield (*cell, int(found[f"n{i}"]), *(float(found[f"s{i}_{j}"]) for j in range(len(self.sums))))

    @property
    def schema(self) -> str:
        return ", ".join([*(f"`{d}` string" for d in self.dimensions), "n long", *(f"`{s}` double" for s in self.sums)])


class Observed:
    """Counters of a batch plan: ``on`` puts them into it, ``table`` has them after the plan's first action."""

    def __init__(self, counters: Counters) -> None:
        self.counters = counters
        self.observation = Observation(counters.name)

    def on(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *self.counters.metrics())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.counters.rows(self.observation.get)), self.counters.schema)


class StreamCounters(StreamingQueryListener):
    """Counters of streams: ``on`` puts them into a stream, ``table`` has what the batches so far have counted.

    Attach it (``spark.streams.addListener``) before the query starts, and ``wait`` after it ends: progress comes later
    than the batch. A batch that runs again after a failure replaces what it counted before.
    """

    def __init__(self, counters: Counters) -> None:
        self.counters = counters
        self.batches: dict[tuple[str, int], dict[str, float]] = {}
        self.ended: dict[str, threading.Event] = {}

    def on(self, stream: DataFrame) -> DataFrame:
        return stream.observe(self.counters.name, *self.counters.metrics())

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        found: Row | None = event.progress.observedMetrics.get(self.counters.name)
        if found is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = found.asDict()

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        self._end(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the query has ended and its progress has been heard."""
        query.awaitTermination()
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError("the query's end was not heard")

    def table(self, spark: SparkSession) -> DataFrame:
        totals: dict[str, float] = {}
        for found in self.batches.values():
            for name, value in found.items():
                totals[name] = totals.get(name, 0) + (value or 0)
        return spark.createDataFrame(list(self.counters.rows(totals)), self.counters.schema)


# --- the engine's own counters

# Outcomes of a collected row; outcomes and stages of a call to a model.
COLLECTED = ("new", "already_seen", "too_old", "unnormalizable")
CALLS = ("success", "timeout", "networkError", "rateLimited", "serverError", "providerError", "authError", "configError", "requestError", "invalidEnvelope", "invalidOutput", "httpError")
STAGES = ("stage-a", "stage-b")


def funnel(sources: Sequence[str], source: Column, outcome: Column, name: str = "funnel") -> Counters:
    """Rows of a collection by source and outcome."""
    return Counters(name, {"source": (source, sources), "outcome": (outcome, COLLECTED)})


def funnel_totals(counted: DataFrame) -> DataFrame:
    """By source: collected, normalized, new, already seen, too old and not normalisable rows, from a funnel's counters."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("outcome").isin(*names), F.col("n"))), F.lit(0))
    return counted.groupBy("source").agg(
        F.sum("n").alias("collected"), of("new", "already_seen").alias("normalized"), *(of(x).alias(x) for x in COLLECTED)
    )


def calls(stage: Column, outcome: Column, provider: Column, error_type: Column, providers: Sequence[str], error_types: Sequence[str], sums: dict[str, Column]) -> list[Counters]:
    """Calls to models by stage and outcome with their sums (tokens, cost; a call without a usage report adds none), by provider, and by type of error."""
    return [
        Counters("calls_by_outcome", {"stage": (stage, STAGES), "outcome": (outcome, CALLS)}, sums),
        Counters("calls_by_provider", {"provider": (provider, providers)}),
        Counters("calls_by_error", {"error_type": (error_type, error_types)}),
    ]
