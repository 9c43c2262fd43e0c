"""Continuous forms of the operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusguard.operators import scan


def scan_arrivals(files: DataFrame) -> DataFrame:
    """Rule findings of files as they arrive; the batch scan has no shuffle and runs on a stream as it is."""
    return scan.rule_scan(files)


def check_arrivals(files: DataFrame) -> DataFrame:
    """``path, rule_id``: the rules that files meet as they arrive, comments included, and the checks that settings files fail; a file is read once."""
    return scan.rule_hits(files, also=scan.config_check(F.col("path"), F.col("content"))).select("path", "rule_id")


def first_seen(findings: DataFrame, time: str = "ts", key: str = "fingerprint", delay: str = "1 hour") -> DataFrame:
    """The first finding of each fingerprint within the delay; older state is dropped."""
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def request_windows(requests: DataFrame, internal: str, width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Requests, posts, external requests and errors by window; rows later than the delay are dropped."""
    from corpusguard.operators.web import request_summary

    late = requests.withWatermark("ts", delay)
    return request_summary(late, internal, F.window("ts", width, slide) if slide else F.window("ts", width))


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """``user_id``, session bounds and events of sessions that a gap ends."""
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))


class _Snapshots(StatefulProcessor):
    """The last hash and time of a path, and a timer for when it should have been seen again.

    A path costs few calls to the store: a timer that a later row has overtaken stays and finds nothing to do.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "hash string, seen long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, digest = max((row.seen, row.hash) for row in rows)
        old_hash, old_seen = self.last.get() or (None, None)
        if old_seen is not None:
            if (seen, digest) <= (old_seen, old_hash):
                return
            if seen - old_seen > self.gap:  # it was gone, whether or not the watermark had told
                yield Row(path=key[0], event="removed", hash=old_hash, at=old_seen + self.gap)
                old_hash = old_seen = None
        self.last.update((digest, seen))
        if seen != old_seen:
            self.handle.registerTimer(seen + self.gap)
        if digest != old_hash:
            yield Row(path=key[0], event="added" if old_seen is None else "changed", hash=digest, at=seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        digest, seen = self.last.get() or (None, None)
        if seen is not None and seen + self.gap <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            yield Row(path=key[0], event="removed", hash=digest, at=seen + self.gap)

    def close(self) -> None:
        pass


def file_snapshots(rows: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """``path, event, hash, ts`` of a stream of snapshots ``(path, hash, ts)``: what was added, changed or removed.

    A path that no row shows for ``gap`` after its last one (more than the time between
    two snapshots) is removed once the watermark, ``delay`` behind the latest row, has passed that time; it
    is then forgotten, so that the state is that of the paths that exist. Of the rows
    that a batch has of a path, the latest counts against the state. Rows with nulls are left out. The state needs the
    RocksDB store: see :func:`use_rocksdb`.
    """
    known = rows.where("path IS NOT NULL AND hash IS NOT NULL AND ts IS NOT NULL").select("path", "hash", "ts").withWatermark("ts", delay)
    processor = _Snapshots(int(pd.Timedelta(gap).total_seconds() * 1000))
    found = known.withColumn("seen", F.unix_millis("ts")).groupBy("path").transformWithState(processor, "path string, event string, hash string, at long", "append", "eventTime")
    return found.select("path", "event", "hash", F.timestamp_millis("at").alias("ts"))


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that the session starts from now on keep their state in RocksDB, which processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def file_events(rows: DataFrame, keep: str | None = None, delay: str = "1 hour") -> DataFrame:
    """``path, event, hash, ts``: what a stream of ``(path, hash, ts)`` shows for the first time or changed.

    The state of a path is its last hash and time, kept by the state store, so that a
    batch touches the paths that it has and no others. A batch gives at most one event
    for a path: its latest row against the state; older rows than the state's are
    ignored. Rows of a hot path are reduced as they arrive. With ``keep`` (a duration as
    ``7 days``) a path is forgotten once the watermark, ``delay`` behind the latest row,
    is so far past its last row; rows behind the watermark are then dropped.
    """
    ttl = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None

    def update(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        latest = max((t, h) for chunk in chunks for t, h in [max(zip(chunk["ts"], chunk["hash"]))])
        old_hash, old_ts = state.get if state.exists else (None, None)
        if old_ts is not None and latest <= (pd.Timestamp(old_ts), old_hash):
            return
        state.update((latest[1], latest[0].to_pydatetime()))
        if ttl:
            state.setTimeoutTimestamp(max(int(latest[0].timestamp() * 1000) + ttl, state.getCurrentWatermarkMs() + 1))
        if latest[1] != old_hash:
            yield pd.DataFrame({"path": [key[0]], "event": ["first_seen" if old_ts is None else "changed"], "hash": [latest[1]], "ts": [latest[0]]})

    timeout = GroupStateTimeout.EventTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    rows = rows.withWatermark("ts", delay) if ttl else rows
    known = rows.where("path IS NOT NULL AND hash IS NOT NULL AND ts IS NOT NULL").select("path", "hash", "ts")
    return known.groupBy("path").applyInPandasWithState(update, "path string, event string, hash string, ts timestamp", "hash string, ts timestamp", "append", timeout)
