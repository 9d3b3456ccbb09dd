"""Live alerts that expire.

An alert holds until the TTL has passed since the client was last flagged. `alert_handler` stores
alerts with the micro-batch that flags the client, so they are seen from then on; expiry is
applied on read (`sources.profiles.read_active_alerts`). `alert_periods` is their history: in
event time an alert is a session window with the TTL as its gap. Each further flag prolongs it,
and its state is dropped with the watermark. Flags of one client merge inside each task before
the shuffle.

`alert_transitions` reports every change of an alert as it happens: raised, extended, expired. A keyed
state holds one alert per client, and an event-time timer ends it. (The state's own TTL counts
processing time, so a replay would keep alerts that have long expired.) Flags are counted per client
and minute before they reach that state, so it takes one row per client and minute, whatever the
number of requests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.profiles import ALERT_TTL_SECONDS, alerts, newest_alerts
from ..sources.profiles import write_alerts
from .run import WATERMARK


def alert_handler(path: str, profiles: DataFrame) -> Callable[[DataFrame, int], None]:
    """Handler for `run.to_batches` over flagged requests (`ip`, `flagged_at`, `reason`, optional
    `request_count`): stores each client's newest alert of the micro-batch at once."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_alerts(newest_alerts(alerts(batch, profiles)), path, batch_id)

    return handle


def alert_periods(events: DataFrame, ttl_seconds: int = ALERT_TTL_SECONDS,
                  delay: str = WATERMARK) -> DataFrame:
    """Expired alerts: first and last flag, number of flags, end of the alert."""
    return (events.filter("is_bot = 1").withWatermark("ts", delay)
            .groupBy("ip", F.session_window("ts", f"{ttl_seconds} seconds").alias("s"))
            .agg(F.max("ts").alias("flagged_at"), F.count(F.lit(1)).alias("hits"))
            .select("ip", F.col("s.start").alias("first_flagged_at"), "flagged_at", "hits",
                    F.col("s.end").alias("expires_at")))


MINUTE = 60
_MICROS = 1_000_000


class AlertState(StatefulProcessor):
    """One alert per client in microseconds of event time: first flag, last flag, number of flags.

    Minutes reach the state in order, since each is passed on when the watermark has closed it. A timer
    is set to the end of the minute in which the alert expires: by then all flags that could still have
    prolonged it have been seen, and rows are handled before timers.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * _MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "first long, last long, hits long")

    def _timer(self, last: int) -> int:
        minute = MINUTE * _MICROS
        return ((last + self.ttl) // minute + 1) * MINUTE * 1000

    def _row(self, ip: str, transition: str, at: int, hits: int, last: int) -> Row:
        # instants as whole microseconds; the query turns them into timestamps
        return Row(ip=ip, transition=transition, at=at, hits=hits, expires_at=last + self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ip, held = key[0], self.alert.get() if self.alert.exists() else None
        before = held[1] if held else None
        for minute in sorted(rows, key=lambda r: r["first"]):
            if held and minute["first"] > held[1] + self.ttl:
                yield self._row(ip, "expired", held[1] + self.ttl, held[2], held[1])
                held = None
            if held:
                held = (held[0], minute["last"], held[2] + minute["hits"])
                yield self._row(ip, "extended", held[1], held[2], held[1])
            else:
                held = (minute["first"], minute["last"], minute["hits"])
                yield self._row(ip, "raised", held[0], held[2], held[1])
        if before is not None and self._timer(before) != self._timer(held[1]):
            self.handle.deleteTimer(self._timer(before))
        self.handle.registerTimer(self._timer(held[1]))
        self.alert.update(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.alert.exists():
            _, last, hits = self.alert.get()
            self.alert.clear()
            yield self._row(key[0], "expired", last + self.ttl, hits, last)

    def close(self) -> None:
        pass


def alert_transitions(events: DataFrame, ttl_seconds: int = ALERT_TTL_SECONDS,
                      delay: str = WATERMARK) -> DataFrame:
    """Every change of every client's alert, final once the watermark has passed it: `raised` at the
    first flag, `extended` at the last flag of each further minute, `expired` when the TTL (a minute at
    least) has passed since the last flag. `hits` counts the alert's flags so far. Append mode, RocksDB."""
    minutes = (events.filter("is_bot = 1 AND ip IS NOT NULL").withWatermark("ts", delay)
               .groupBy("ip", F.window("ts", f"{MINUTE} seconds").alias("w"))
               .agg(F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last"),
                    F.count(F.lit(1)).alias("hits"))
               .select("ip", F.window_time("w").alias("closed_at"), "first", "last", "hits"))
    changes = minutes.groupBy("ip").transformWithState(
        AlertState(ttl_seconds), "ip string, transition string, at long, hits long, expires_at long",
        "append", "eventTime")
    return changes.select("ip", "transition", F.timestamp_micros("at").alias("at"), "hits",
                          F.timestamp_micros("expires_at").alias("expires_at"))
