"""Task episodes as a stateful stream: rows wait for the watermark, so they count in the order of their times, however they arrive."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ["session_id", "episode", "events", "opened_by", "closed_by"]


class OpenEpisodes(StatefulProcessor):
    """Per bucket of sessions: the rows that the watermark has not passed, and each session's open episode.

    Rows wait as they came, a packed stretch an entry of a list; a timer at the
    earliest of them takes all that the watermark has passed, in order of time
    and id within each session. So a row that comes late, but not later than the
    watermark allows, re-opens or extends the episode it belongs to before that
    is emitted. What waits is bounded by the rows of a bucket within the delay;
    of an open episode only four values are kept, for as long as it takes to be
    closed. State is met once a bucket and batch, not once a row or session.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getValueState("open", "sessions binary")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest, new = None, []
        for b in rows:
            names = np.array([None if pd.isna(s) else s for s in b.session_id], object)
            new.append((_pack(names, *(b[c].to_numpy(np.int64) for c in ("at", "event_id", "mark"))),))
            low = int(b["at"].min())
            earliest = low if earliest is None else min(earliest, low)
        if earliest is not None:
            self.waiting.appendList(new)
            self._wake(earliest)
        yield pd.DataFrame(columns=FIELDS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        names, at, ident, mark = (np.concatenate(c) for c in zip(*(pickle.loads(r[0]) for r in self.waiting.get())))
        ripe, left = np.flatnonzero(at < passed), np.flatnonzero(at >= passed)
        ripe = ripe[np.lexsort((mark[ripe], ident[ripe], at[ripe]))]
        sessions = pickle.loads(self.open.get()[0]) if self.open.exists() else {}
        done = []
        for session, i, m in zip(names[ripe].tolist(), ident[ripe].tolist(), mark[ripe].tolist()):
            inside, number, count, first = sessions.get(session, (False, 0, 0, 0))
            if not inside:
                if m != 1:
                    continue
                inside, number, count, first = True, number + 1, 0, i
            count += 1
            if m == 0:
                inside = False
                done.append((session, number, count, first, i))
            sessions[session] = (inside, number, count, first)
        self.open.update((pickle.dumps(sessions),))
        self.due.clear()
        if len(left):
            self.waiting.put([(_pack(names[left], at[left], ident[left], mark[left]),)])
            self._wake(int(at[left].min()))
        else:
            self.waiting.clear()
        yield pd.DataFrame(done, columns=FIELDS)

    def _wake(self, at: int) -> None:
        """One timer, a millisecond after the earliest waiting row."""
        when = at // 1000 + 1
        if self.due.exists():
            known = self.due.get()[0]
            if known <= when:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(when)
        self.due.update((when,))

    def close(self) -> None:
        pass


def _pack(*columns: np.ndarray) -> bytes:
    return pickle.dumps(columns)


def timed_episodes(events: DataFrame, opens: Column, closes: Column, delay: str, buckets: int = 64) -> DataFrame:
    """Completed episodes of a stream of (session_id, ts, event_id, ...), by the rules of sequence.episodes, once the watermark has passed their closing event.

    Rows later than the delay are dropped by the watermark; tables kept by
    incremental.Maintained take them in. Rows without a time never ripen and
    are left out, as are those without an id. Sessions are dealt over so many
    buckets, each of which is held whole for a moment; a checkpoint keeps the
    number it was started with.
    """
    mark = F.when(opens, 1).when(closes, 0).otherwise(-1)
    rows = events.where("ts is not null and event_id is not null").withWatermark("ts", delay)
    rows = rows.select(F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int").alias("bucket"), "session_id", "ts", F.unix_micros("ts").alias("at"), "event_id", mark.alias("mark"))
    return rows.groupBy("bucket").transformWithStateInPandas(OpenEpisodes(), "session_id string, episode long, events long, opened_by long, closed_by long", "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that list state and timers need, for streams started inside."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


def resume(flow: DataFrame, out: str, mark: str) -> DataFrame:
    """Take all that is there into the table out, going on where the checkpoint mark stopped."""
    with rocksdb(flow.sparkSession):
        flow.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return flow.sparkSession.read.schema(flow.schema).parquet(out)
