"""Sessions as they are opened: a store keeps at most thirty for eight hours.

Opening a session first lets go of those older than the time they may live, then,
if the store is full, of the oldest.  The sessions alive are keyed state; a timer
clears what has outlived its time where nothing is opened any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Sessions of a store, and hours that one lives from its creation.
MOST, HOURS = 30, 8
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "store string, session_id string, created_at timestamp, event string, at timestamp"


class _Store(StatefulProcessor):
    """State: session_id -> microseconds of creation, and its place in line."""

    def __init__(self, most: int, hours: float):
        self.most, self.life = most, int(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alive = handle.getMapState("alive", "session_id string", "created long, place long")

    def close(self) -> None:
        pass

    def _rows(self, store: str, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if not out:
            return
        stamp = lambda k: pd.to_datetime([o[k] for o in out], unit="us")
        text = lambda values: pd.Series(values, dtype=object)
        yield pd.DataFrame({"store": text([store] * len(out)), "session_id": text([o[0] for o in out]), "created_at": stamp(1), "event": text([o[2] for o in out]), "at": stamp(3)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        alive = {k[0]: tuple(v) for k, v in self.alive.iterator()}
        before, out = dict(alive), []
        opened = pd.concat(list(rows)).sort_values(["created_at", "session_id"], kind="stable")
        moments = opened["created_at"].astype("datetime64[us]").astype("int64")
        place = max((p for _, p in alive.values()), default=0)
        for session, now in zip(opened["session_id"], moments.tolist(), strict=True):
            for old in [s for s, (created, _) in alive.items() if created < now - self.life]:
                out.append((old, alive.pop(old)[0], "expired", now))
            if len(alive) >= self.most:
                old = min(alive, key=alive.get)
                out.append((old, alive.pop(old)[0], "evicted", now))
            # Opened again, a session keeps its place in line.
            place += session not in alive
            alive[session] = now, alive.get(session, (0, place))[1]
            out.append((session, now, "opened", now))
        for session in before.keys() - alive.keys():
            self.alive.removeKey((session,))
        for session, value in alive.items():
            if before.get(session) != value:
                self.alive.updateValue((session,), value)
                self.handle.registerTimer((value[0] + self.life) // 1000 + 1)
        yield from self._rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        gone = [(k[0], v[0], "expired", now) for k, v in self.alive.iterator() if v[0] < now - self.life]
        for session, *_ in gone:
            self.alive.removeKey((session,))
        yield from self._rows(key[0], gone)


def session_events(opened: DataFrame, most: int = MOST, hours: float = HOURS, late: str = "1 hour") -> DataFrame:
    """The stream of what happens to sessions, from the stream (or table) of
    their creations (store, session_id, created_at)."""
    opened.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = opened.select(F.col("store").cast("string").alias("store"), F.col("session_id").cast("string").alias("session_id"), F.col("created_at").cast("timestamp").alias("created_at"))
    return (
        rows.withWatermark("created_at", late)
        .groupBy("store")
        .transformWithStateInPandas(_Store(most, hours), OUT, "Append", "EventTime")
    )


def states(events: DataFrame, now: Column) -> DataFrame:
    """(store, session_id, created_at, state) of every session that was opened:
    alive at ``now``, expired or evicted."""
    last = events.groupBy("store", "session_id").agg(F.max_by(F.struct("event", "created_at"), F.struct("at", F.col("event") != "opened")).alias("e"))
    lives = F.col("e.created_at") >= now - F.expr(f"INTERVAL {HOURS} HOURS")
    state = F.when(F.col("e.event") == "evicted", "evicted").when((F.col("e.event") == "opened") & lives, "alive").otherwise("expired")
    return last.select("store", "session_id", "e.created_at", state.alias("state"))


def survivors(events: DataFrame) -> DataFrame:
    """(store, session_id, created_at) of the sessions still alive."""
    last = events.groupBy("store", "session_id").agg(F.max_by(F.struct("event", "created_at"), F.struct("at", F.col("event") == "opened")).alias("e"))
    return last.filter("e.event = 'opened'").select("store", "session_id", "e.created_at")
