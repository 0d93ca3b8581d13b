"""Keyed state with timers: conversations that are found or made, first-hit windows that close on time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tradewind.operators.scans import advance

#: State on disk, of which a batch saves what it has changed instead of a whole snapshot of every partition.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def on_disk_state(spark: SparkSession):
    """Streams started inside keep their state on disk, which processors need."""
    before = {key: spark.conf.get(key, None) for key in ON_DISK}
    for key, value in ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Conversations(StatefulProcessor):
    """One conversation for every key: the first event makes it, later ones join it and may give it the name it lacks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("conversation", "conversation_id long, customer_name string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["created_at", "id"], kind="stable")
        conversation, name = self.kept.get() if self.kept.exists() else (int(events["id"].iloc[0]), None)
        made = not self.kept.exists()
        names = events["customer_name"].where(events["customer_name"].notna() & (events["customer_name"] != ""), None)
        if not name and names.notna().any():
            at = int(np.flatnonzero(names.notna().to_numpy())[0])
            name = names.iloc[at]
            known = [None] * at + [name] * (len(names) - at)
        else:
            known = [name or None] * len(names)
        self.kept.update((conversation, name))
        created = np.zeros(len(events), bool)
        created[0] = made
        yield pd.DataFrame({"id": events["id"], "channel_id": events["channel_id"].astype("Int32"), "customer_ref": events["customer_ref"], "conversation_id": conversation, "customer_name": known, "created": created})

    def close(self) -> None:
        pass


def conversations(stream: DataFrame) -> DataFrame:
    """Every event (id, channel_id, customer_ref, customer_name, created_at) with the conversation that it belongs to,
    whether it made it, and the customer's name as known then. Null keys are one key; an empty name is none.

    State is one small row for each customer of a channel and is never given up.
    """
    key = F.to_json(F.struct("channel_id", "customer_ref")).alias("key")  # keys of processors must not be null
    rows = stream.select(key, "id", "channel_id", "customer_ref", "customer_name", "created_at")
    out = "id long, channel_id int, customer_ref string, conversation_id long, customer_name string, created boolean"
    return rows.groupBy("key").transformWithStateInPandas(Conversations(), out, "Append", "None")


class FirstHits(StatefulProcessor):
    """One open window for each key. A later hit closes it, or a timer when the watermark has passed its end."""

    def __init__(self, seconds: int, limit: int):
        self.length, self.limit = seconds * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("window", "start long, hits long")

    def _rows(self, users, starts, hits) -> pd.DataFrame:
        hits = np.asarray(hits, np.int64)
        return pd.DataFrame({"user_id": np.asarray(users, np.int64), "start": np.asarray(starts, np.int64), "hits": hits, "allowed": np.minimum(hits, self.limit)})

    def _ends_at(self, start: int) -> int:
        return (start + self.length) // 1000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(pd.concat(list(rows))["t"].to_numpy())
        before = self.open.get() if self.open.exists() else None
        users = np.full(len(times), key[0], np.int64)
        *closed, (_, start, hits) = advance(users, times, self.length, None if before is None else (key[0], *before))
        if before is None or before[0] != start:
            if before is not None:
                self.handle.deleteTimer(self._ends_at(before[0]))
            self.handle.registerTimer(self._ends_at(start))
        self.open.update((start, hits))
        yield self._rows(*closed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            start, hits = self.open.get()
            if self._ends_at(start) <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield self._rows([key[0]], [start], [hits])

    def close(self) -> None:
        pass


def first_hits(stream: DataFrame, limit: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """The streaming twin of scans.first_hit_windows (user_id, ts): a window comes out when a later hit closes it, or
    once the watermark (`late` behind the latest event) has passed its end. State is given up with the window.
    """
    rows = stream.where("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", late).withColumn("t", F.unix_micros("at"))
    found = rows.groupBy("user_id").transformWithStateInPandas(FirstHits(seconds, limit), "user_id long, start long, hits long, allowed long", "Append", "EventTime")
    return found.select("user_id", F.timestamp_micros("start").cast("timestamp_ntz").alias("window_start"), "hits", "allowed")
