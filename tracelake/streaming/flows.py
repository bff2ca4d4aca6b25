"""Structured Streaming over event files: tails, replays, quiet windows, watermarks, stateful episodes.

Each flow takes a streaming DataFrame of (session_id, line, ts, ...) with ts a
timestamp, and returns a streaming DataFrame; run() drives one over the files
that are there and hands back what it appended, as a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import new_path


def stream_events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """files: how many files a micro-batch takes at most. A file stream of the event log as typed rows with a usable event time. path: a folder of Parquet files, or one file, whose folder is then watched for that name."""
    known = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(known.schema)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    single = all(f.rstrip("/").endswith(f"/{name}") for f in known.inputFiles())
    logs = source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)
    return logs.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def run(flow: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input once; the result as a table. Exactly once: the sink and the checkpoint are in the shared folder.

    In complete mode each batch brings the whole result, so the last one counts.
    """
    spark = flow.sparkSession
    out, mark = new_path(spark, name), new_path(spark, f"{name}-checkpoint")

    epochs: list[int] = []

    def put(batch: DataFrame, epoch: int) -> None:
        epochs.append(epoch)
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    flow.writeStream.outputMode(mode).option("checkpointLocation", mark).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    if not epochs:
        return spark.createDataFrame([], flow.schema)
    which = epochs[-1] if mode == "complete" else "*"
    return spark.read.schema(flow.schema).parquet(f"{out}/epoch={which}")


def replay_safe(events: DataFrame, delay: str, *key: str) -> DataFrame:
    """Repeated deliveries of the same key within the delay add nothing."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key))


def _digest() -> list:
    """A digest of a session's events that doesn't depend on their order or batches: their number and the sum of their checksums."""
    return [F.count("*").alias("n"), F.sum(F.crc32(F.col("event_id").cast("string"))).alias("checksum")]


def index_state(events: DataFrame) -> DataFrame:
    """(session_id, indexed, indexed_to) of the events an index was built from."""
    return events.groupBy("session_id").agg(F.struct(*_digest()).alias("indexed"), F.max("ts").cast("timestamp").alias("indexed_to"))


def capture_ahead(events: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per session of the stream: whether what is captured differs from what the table indexed holds, and how many rows are rejected as newer than it. For complete mode."""
    j = events.join(indexed, "session_id", "left")
    newer = F.col("indexed_to").isNull() | (F.col("ts") > F.col("indexed_to"))
    g = j.groupBy("session_id").agg(F.struct(*_digest()).alias("captured"), F.first("indexed", True).alias("indexed"), F.count_if(newer).alias("rejected"))
    return g.select("session_id", (~F.col("captured").eqNullSafe(F.col("indexed"))).alias("ahead"), "rejected")


def quiet_sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """A session's stretch is emitted once nothing has come for gap."""
    w = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count("*").alias("events"))
    return w.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def rolling_health(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Count, failures and mean value per time window and type."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("avg_value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "errors", "avg_value")


def progress(events: DataFrame) -> DataFrame:
    """Processed watermark per session: last event and time. For update or complete mode."""
    return events.groupBy("session_id").agg(F.max("event_id").alias("to_line"), F.max("ts").alias("to_timestamp"))


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    open_, number, count = state.get if state.exists else (False, 0, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    done = []
    for kind, ident in zip(rows.event_type, rows.event_id):
        if not open_ and kind == "signup":
            open_, number, count = True, number + 1, 0
        if open_:
            count += 1
            if kind == "purchase":
                open_ = False
                done.append((key[0], number, count, ident))
    state.update((open_, number, count))
    yield pd.DataFrame(done, columns=["session_id", "episode", "events", "closed_by"])


def stateful_episodes(events: DataFrame) -> DataFrame:
    """Completed task episodes, kept open over micro-batches until their closing event; input in time order per session over batches."""
    return events.groupBy("session_id").applyInPandasWithState(_step, "session_id string, episode long, events long, closed_by long", "open boolean, number long, count long", "append", GroupStateTimeout.NoTimeout)


def changed_sessions(events: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch or stream whose session's stored digest differs or is missing: those to recompute."""
    return events.join(known, "session_id", "left").where(F.coalesce(F.col("indexed_sha") != F.col("sha"), F.lit(True)))


def interval_counts(events: DataFrame, opens: str) -> DataFrame:
    """Per session: events and opening events so far. For complete or update mode, so late rows re-open what they belong to."""
    return events.groupBy("session_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == opens).alias("intervals"))
