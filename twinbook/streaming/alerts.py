"""Streaming alert filters: re-alerts by key and cooldowns, with state that expires by timers.

State advances in the batch that hands an alert to its sink: a batch whose
delivery fails is repeated from the state before it, so that no alert is lost
and none counts as sent that was not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUTPUT = "key string, net double, ts timestamp, reason string"
STATE = "net double, sent_us long, seen_us long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_timers(spark: SparkSession) -> None:
    """State with timers needs this store; the setting holds for streams that begin later in the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Realerts(StatefulProcessor):
    """What was last sent of a key; a timer in event time forgets keys that stay away."""

    def __init__(self, again_us: int, improve: float, keep_ms: int):
        self.again_us, self.improve, self.keep_ms = again_us, improve, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sent = handle, handle.getValueState("sent", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        net, sent, seen = self.sent.get() if self.sent.exists() else (None, None, 0)
        out = []
        for r in pd.concat(rows).sort_values(["ts", "net"], kind="stable").itertuples():
            us = r.ts.value // 1000
            reason = "new" if net is None else "improved" if r.net >= net + self.improve - 1e-12 else "due" if us - sent >= self.again_us else None
            seen = max(seen, us)
            if reason:
                net, sent = float(r.net), us
                out.append((key[0], net, r.ts, reason))
        self.sent.update((net, sent, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(seen // 1000 + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["key", "net", "ts", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.sent.clear()
        yield pd.DataFrame(columns=["key", "net", "ts", "reason"])


def alert_stream(signals: DataFrame, hours: float = 24.0, improve: float = 0.005, keep_days: float = 7.0, late: str = "1 hour") -> DataFrame:
    """Signals (key, net, ts) worth sending: new, improved by ``improve``, or last sent ``hours`` or more ago.

    A key's state is the net and time last sent; a timer forgets it ``keep_days``
    after its last signal in event time. Signals of one key in one batch are taken
    in the order of their times. Nulls in key, net or ts are dropped.
    """
    _with_timers(signals.sparkSession)
    rows = signals.where("key is not null and net is not null and ts is not null").select(F.col("key").cast("string").alias("key"), F.col("net").cast("double").alias("net"), F.col("ts").cast("timestamp").alias("ts"))
    step = _Realerts(int(hours * 3_600_000_000), improve, int(keep_days * 86_400_000))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(step, OUTPUT, "append", "eventTime")


class _Cooldown(StatefulProcessor):
    """Lets one row of a key pass, then none for a while; a timer in event time ends it."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in pd.concat(rows).sort_values(["ts", "reason"], kind="stable").itertuples():
            us = r.ts.value // 1000
            if last is None or us - last >= self.wait_ms * 1000:
                last = us
                out.append((key[0], r.ts, r.reason))
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last // 1000 + self.wait_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame(columns=["key", "ts", "reason"])


def degradation_alerts(faults: DataFrame, wait: float = 1.0, late: str = "1 hour") -> DataFrame:
    """Faults (key, ts, reason) of a pipeline, at most one of a key in ``wait`` hours of event time; blanks in reasons become single spaces."""
    _with_timers(faults.sparkSession)
    rows = faults.where("key is not null and ts is not null").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.trim(F.regexp_replace(F.coalesce("reason", F.lit("")), r"\s+", " ")).alias("reason"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_Cooldown(int(wait * 3_600_000)), "key string, ts timestamp, reason string", "append", "eventTime")


def deliver(alerts: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of ``alerts`` to ``send`` (rows, batch number) until the input is read.

    A batch counts, and the state behind it advances, only when ``send`` returns;
    after a failure the same batch comes again under the same number.
    """
    return alerts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signals_to_send(signals: DataFrame, state: DataFrame, now: Column, hours: float, least: float = 0.0, top: int = 10, improve: float = 0.005) -> DataFrame:
    """What to send of a scan's ``signals`` (key, net, annualised): the ``top`` richest, with ``label``, or nothing if none of them is fresh.

    Rich are signals with a net above ``least``, by annualised return, then net and
    key. Fresh ones are new to the ``state`` (key, net, ts), improved, or sent more
    than ``hours`` ago; others have a null label. ``top`` 0 sends all.
    """
    rich = signals.where(F.col("net") > least)
    if top:
        rich = rich.orderBy(F.desc_nulls_last("annualised"), F.desc("net"), "key").limit(top)
    last = state.select("key", F.col("net").alias("_net"), F.col("ts").alias("_ts"))
    label = F.when(F.col("_ts").isNull(), "new").when(F.col("net") >= F.coalesce("_net", F.lit(-1.0)) + improve - 1e-12, "improved")
    label = label.when(F.unix_micros(now) - F.unix_micros("_ts") > int(hours * 3_600_000_000), "due")
    rows = rich.join(last, "key", "left").withColumn("label", label).drop("_net", "_ts")
    any_fresh = rows.agg(F.coalesce(F.bool_or(F.col("label").isNotNull()), F.lit(False)).alias("_any"))
    return rows.join(F.broadcast(any_fresh)).where("_any").drop("_any")


def windowed_best(signals: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Best net and number of signals in tumbling windows of event time (beyond the surveyed system)."""
    rows = signals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "key").agg(F.max("net").alias("best"), F.count("*").alias("signals"))
