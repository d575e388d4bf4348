"""W1-W4 on a stream: lags, rolling statistics and forward fill with state per series.

``stream_windows`` uses ``transformWithState``: a value state holds the last rows that
a window can reach, the last filled value and the last order key in its own types, so
ids beyond 2^53 and times compare exactly. A processing-time timer ends the state of a
series that has been idle; a row that comes after that begins the series anew.

What a batch window gives, a stream gives too, whatever the micro-batches are, as long
as rows come in order from batch to batch. A row that is older than one of an earlier
batch is ``late``: its features are null and the history stays as it is. Backward fill
needs rows that have not come yet, so leading gaps stay null. Rows of one series in one
micro-batch are sorted in a task's memory; bound them by the trigger
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). With timers Spark plans batches for
as long as the query runs, also when no rows come: such a query is stopped by its owner
and takes no ``availableNow`` trigger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from ..operators.windows import lag_name, roll_name

#: transformWithState keeps its state here; Spark's default store does not serve it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _mean(x: list[float]) -> float:
    return math.fsum(x) / len(x)


def _std(x: list[float]) -> float | None:
    if len(x) < 2:
        return None
    m = _mean(x)
    return math.sqrt(math.fsum((v - m) ** 2 for v in x) / (len(x) - 1))


_STATS = {"mean": _mean, "std": _std}


class _Windows(StatefulProcessor):
    """One series: its recent values, the value to carry on, its last order key."""

    def __init__(self, key: str, order: list[str], value: str, schema: StructType, state: StructType, lags: list[int],
                 windows: list[int], stats: list[str], idle_ms: int | None):
        self.key, self.order, self.value = key, order, value
        self.row, self.layout = Row(*schema.names), state
        self.lags, self.windows, self.stats, self.idle_ms = lags, windows, stats, idle_ms
        self.reach = max([*lags, *[w - 1 for w in windows], 0])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", self.layout)

    def _features(self, past: list, x: float | None, carried: float | None) -> list:
        out = [past[-k] if k <= len(past) else None for k in self.lags]
        for w in self.windows:
            held = [*past[len(past) - w + 1:], x] if len(past) >= w - 1 else [None]
            full = len(held) == w and None not in held
            out += [_STATS[s](held) if full else None for s in self.stats]
        return [*out, x if x is not None else carried]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0
        past, carried, last, until = [], None, None, None
        if self.state.exists():
            past, carried, last, until = self.state.get()
            past, last = list(past), tuple(last)
            if until is not None:
                self.handle.deleteTimer(until)
                if until <= now:                    # idle too long: the series begins anew
                    past, carried, last = [], None, None
        before = last
        for r in sorted(rows, key=lambda r: [r[c] for c in self.order]):
            at = tuple(r[c] for c in self.order)
            x = None if r[self.value] is None else float(r[self.value])
            given = [r[c] for c in (self.key, *self.order, self.value)]
            if before is not None and at < before:
                yield self.row(*given, *[None] * (len(self.row) - len(given) - 1), True)
                continue
            features = self._features(past, x, carried)
            yield self.row(*given, *features, False)
            carried, last = features[-1], at
            past = [*past, x][-self.reach:] if self.reach else []
        if last is not None:
            until = None if self.idle_ms is None else now + self.idle_ms
            self.state.update((past, carried, last, until))
            if until is not None:
                self.handle.registerTimer(until)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_windows(df: DataFrame, key: str, order: Sequence[str], value: str, lags: Sequence[int] = (),
                   windows: Sequence[int] = (), stats: Sequence[str] = ("mean",), idle_ms: int | None = None) -> DataFrame:
    """key, order..., value, ``{value}_lag_{k}``, ``{value}_roll_{stat}_{w}`` (complete
    windows without nulls), ``{value}_filled`` (forward fill) and ``late``, in append
    mode. ``idle_ms``: a series' state ends after so long without a row; None: never.
    Rows without a complete order key are left out; a null key is a series; other columns
    are left behind. The session's state store is set to RocksDB, which this needs."""
    unknown = set(stats) - set(_STATS)
    if unknown:
        raise ValueError(f"unknown rolling statistics {sorted(unknown)}")
    order = list(order)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    given = [df.schema[c] for c in (key, *order, value)]
    names = [*[lag_name(value, k) for k in lags], *[roll_name(value, s, w) for w in windows for s in stats], f"{value}_filled"]
    schema = StructType([*given, *[StructField(n, DoubleType()) for n in names], StructField("late", BooleanType())])
    state = StructType([StructField("past", ArrayType(DoubleType())), StructField("carried", DoubleType()),
                        StructField("last", StructType([StructField(c, df.schema[c].dataType) for c in order])), StructField("until", LongType())])
    rows = df.select(key, *order, value).where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in order)))
    return rows.groupBy(key).transformWithState(
        _Windows(key, order, value, schema, state, list(lags), list(windows), list(stats), idle_ms), outputStructType=schema,
        outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")
