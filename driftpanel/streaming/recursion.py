"""The exponentially weighted recursion of each series over a stream, as state of Spark's own keeping.

A series' state is what the batch fold of ``operators.crossproducts`` knows at its last value: the position,
the weighted mean and mean square, and the sum of squared weights. Values wait in the state until the
watermark has passed their time, when a timer takes them in order of position, so that values that come
late, or in another order, by less than the delay change nothing. Later ones are left out, as in any
stream with a watermark. State and timers are in the query's checkpoint: a restart goes on where it stopped.

The session needs a state store that can hold timers and lists:
``spark.sql.streaming.stateStore.providerClass`` = ``STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.crossproducts import rate

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "series string, time_idx bigint, mean double, variance double"


class Recursion(StatefulProcessor):
    """y -> (d y + a x) / (d + a) with d = (1 - a) ** gap, for the mean, the mean square and the weights."""

    def __init__(self, halflife: float):
        self.a = rate(halflife)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "last bigint, mean double, square double, w2 double")
        self.waiting = handle.getListState("waiting", "ms bigint, time_idx bigint, x double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.dropna(subset=["x", "ms", "time_idx"])
            if len(batch):
                self.waiting.appendList([(int(ms), int(i), float(x)) for ms, i, x in zip(batch["ms"], batch["time_idx"], batch["x"])])
                for ms in batch["ms"].unique():
                    self.handle.registerTimer(int(ms))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        rows = list(self.waiting.get())
        due, later = sorted((r for r in rows if r[0] <= until), key=lambda r: r[1]), [r for r in rows if r[0] > until]
        if not due:
            return
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        state, out = self.known.get(), []
        for _, at, x in due:
            if state is None:
                state = (at, x, x * x, 1.0)
            else:
                last, mean, square, w2 = state
                d = (1 - self.a) ** (at - last)
                p, q = d / (d + self.a), self.a / (d + self.a)
                state = (at, p * mean + q * x, p * square + q * x * x, p * p * w2 + q * q)
            _, mean, square, w2 = state
            out.append((key[0], at, mean, (square - mean * mean) / (1 - w2) if w2 < 1 - 1e-12 else None))
        self.known.update(state)
        yield pd.DataFrame(out, columns=["series", "time_idx", "mean", "variance"]).astype({"variance": "float64"})

    def close(self) -> None:
        pass


def weighted_stream(rows: DataFrame, halflife: float, late: str = "1 hour") -> DataFrame:
    """series, time_idx, mean, variance after each value of a stream of series, ts (timestamp), time_idx (position,
    in order of ts) and x; each value once the watermark, ``late`` behind the latest ts, has passed it."""
    ready = rows.select("series", "ts", F.unix_millis("ts").alias("ms"), F.col("time_idx").cast("bigint").alias("time_idx"), F.col("x").cast("double").alias("x"))
    return ready.withWatermark("ts", late).groupBy("series").transformWithStateInPandas(
        statefulProcessor=Recursion(halflife), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
    )
