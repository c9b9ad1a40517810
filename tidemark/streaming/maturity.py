"""The first candle after a signal's horizon, once per signal, with state that ends by itself.

Signals and candles are one stream, keyed by symbol and by the bucket of ``grace`` width in
which a signal falls due.  A signal lives in one bucket; a candle goes to its own bucket
and to the one before, whose last signals may still take it.  A bucket keeps its signals
and, per candle, its closing time and price, as lists that grow by whole batches: a call per candle would cost more than the candle.  An event-time timer at the end of the bucket plus the
grace period is the moment from which no candle can come any more (later ones are behind the watermark):
it emits one row per signal that met a candle and clears the state.  A symbol's stream is so
spread over as many keys as it has open buckets, and none of them lives longer than horizon,
two grace periods and the lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state needs; transformWithState keeps its state in RocksDB.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "symbol string, signal_id {id}, generated_at timestamp, due timestamp, close_time timestamp, close double"


def _us(span: str) -> int:
    return int(pd.Timedelta(span).value // 1000)


class _FirstCandle(StatefulProcessor):
    def __init__(self, grace: int, kind: str) -> None:
        self.grace, self.kind = grace, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signals = handle.getListState("signals", f"signal_id {self.kind}, generated long, due long")
        self.candles = handle.getListState("candles", "close_time long, close double")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            given = part[part["is_signal"]]
            if len(given):
                self.signals.appendList(list(zip(given["signal_id"].tolist(), given["generated"].tolist(), given["due"].tolist())))
            # Of candles that close together the least counts; what comes later with the same time is compared in the end.
            least = part[~part["is_signal"]].groupby("closed")["close"].min()
            if len(least):
                self.candles.appendList(list(zip(least.index.tolist(), least.tolist())))
        if not self.timer.exists():
            at = ((key[1] + 2) * self.grace) // 1000 + 1
            self.timer.update((at,))
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen: dict[int, float] = {}
        for at, close in self.candles.get():
            if at not in seen or close < seen[at]:
                seen[at] = close
        candles = sorted(seen.items())
        times = pd.Series([t for t, _ in candles], dtype="int64")
        found = []
        for signal_id, generated, due in self.signals.get():
            place = int(times.searchsorted(due))
            if place < len(candles) and candles[place][0] <= due + self.grace:
                found.append((key[0], signal_id, generated, due, *candles[place]))
        for state in (self.signals, self.candles, self.timer):
            state.clear()
        if found:
            out = pd.DataFrame(found, columns=["symbol", "signal_id", "generated_at", "due", "close_time", "close"])
            for c in ("generated_at", "due", "close_time"):
                out[c] = pd.to_datetime(out[c], unit="us", utc=True)
            yield out

    def close(self) -> None:
        pass


def matured_labels(signals: DataFrame, candles: DataFrame, horizon: str, grace: str, lateness: str) -> DataFrame:
    """symbol, signal_id (a number or text), generated_at, due, close_time, close: one row per signal with a candle in [due, due + grace].

    ``signals`` has signal_id, symbol, generated_at, ``candles`` symbol, close_time, close (zoned
    times).  Rows that come behind the watermark (``lateness`` behind the newest time) are too
    late.  A signal without a candle in its grace period gives no row.  The session
    needs ``STATE_STORE`` as its state store.
    """
    wide = _us(grace)
    kind = signals.schema["signal_id"].dataType.simpleString()
    micros = lambda c: F.unix_micros(c)
    due = micros("generated_at") + _us(horizon)
    s = signals.select(
        "symbol", F.floor(due / wide).cast("long").alias("bucket"), F.col("generated_at").alias("at"), F.lit(True).alias("is_signal"), "signal_id",
        micros("generated_at").alias("generated"), due.alias("due"), F.lit(0).cast("long").alias("closed"), F.lit(0.0).alias("close"),
    )
    # No nulls in either kind of row: pandas would turn whole numbers with gaps into doubles.
    own = F.floor(micros("close_time") / wide).cast("long")
    c = candles.select(
        "symbol", F.explode(F.array(own - 1, own)).alias("bucket"), F.col("close_time").alias("at"), F.lit(False).alias("is_signal"), F.lit("0").cast(kind).alias("signal_id"),
        F.lit(0).cast("long").alias("generated"), F.lit(0).cast("long").alias("due"), micros("close_time").alias("closed"), F.col("close").cast("double").alias("close"),
    )
    both = s.unionByName(c).withWatermark("at", lateness)
    return both.groupBy("symbol", "bucket").transformWithStateInPandas(
        statefulProcessor=_FirstCandle(wide, kind), outputStructType=_OUT.format(id=kind), outputMode="Append", timeMode="EventTime"
    )
