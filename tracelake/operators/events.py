"""The central table: typed session events, from operational logs and from dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What each raw type becomes (event type, family, phase, actor, outcome).
TYPING = {
    "signup": ("USER_INTENT", "communication", "request", "user", "requested"),
    "click": ("TOOL_CALL", "tool_interaction", "act", "assistant", "planned"),
    "view": ("TOOL_OUTPUT", "tool_interaction", "observe", "tool", "observed"),
    "purchase": ("VERIFICATION", "verification", "verify", "assistant", "verified"),
    "error": ("ERROR", "failure_signal", "diagnose", "tool", "failed"),
}
ROLE_TYPING = {"user": "USER_INTENT", "assistant": "ASSISTANT_MESSAGE", "system": "CONTEXT_STATE"}
FACETS = ("event_type", "family", "phase", "actor", "outcome")


def _typed(raw: Column, place: int) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in TYPING.items():
        out = out.when(raw == k, v[place])
    return out.otherwise("RAW_EVENT" if place == 0 else "unknown")


def classify(logs: DataFrame, raw_col: str) -> DataFrame:
    """Adds event type, family, phase, actor and outcome by the raw type; unlisted types become RAW_EVENT."""
    return logs.withColumns({name: _typed(F.col(raw_col), i) for i, name in enumerate(FACETS)})


def numbered(rows: DataFrame, session: str, day: str, *order: str) -> DataFrame:
    """Adds line, from 1, within each session in an order that days respect.

    Rows are numbered within a session's day, and each day starts where the
    days before it end: a session with a large share of all rows is spread over
    its days, and only its daily counts meet in one place.
    """
    n = rows.withColumn("__n", F.row_number().over(Window.partitionBy(session, day).orderBy(*order)))
    counts = rows.groupBy(F.col(session).alias("__s"), F.col(day).alias("__d")).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__s").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__s", "__d", F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col(session).eqNullSafe(F.col("__s")) & F.col(day).eqNullSafe(F.col("__d"))
    return n.join(starts, same).withColumn("line", F.col("__n") + F.col("__before")).drop("__n", "__s", "__d", "__before")


def user_session() -> Column:
    """The session of a row of an operational log."""
    return F.concat(F.lit("u"), F.col("user_id").cast("string"))


def operational_events(logs: DataFrame, lines: bool = True) -> DataFrame:
    """session_events from an operational log: a session per user, lines by time and id, the property k as key and correlation id. lines=False leaves line out for what doesn't need it."""
    return _events(logs.withColumn("session_id", user_session()), lines)


def whole_sessions(logs: DataFrame) -> DataFrame:
    """The same of logs that have their session_id, for sessions that are few enough rows for one task each."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    return _events(logs, False).withColumn("line", F.row_number().over(w).cast("long"))


def _events(logs: DataFrame, lines: bool) -> DataFrame:
    s = logs.select(
        "event_id", "session_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("session_date"),
        F.col("event_type").alias("raw_type"), "value", F.get_json_object("props", "$.k").alias("k"),
    )
    s = numbered(s, "session_id", "session_date", "ts", "event_id") if lines else s
    return classify(s, "raw_type").withColumn("correlation_id", F.when(F.col("event_type").isin("TOOL_CALL", "TOOL_OUTPUT", "ERROR"), F.col("k")))


def dialogue_events(turns: DataFrame) -> DataFrame:
    """session_events from dialogues: a session per conversation, lines by turn."""
    kind = F.when(F.lit(False), F.lit(""))
    for k, v in ROLE_TYPING.items():
        kind = kind.when(F.col("role") == k, v)
    return turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), (F.col("turn") + 1).alias("line"), F.col("role").alias("actor"), kind.otherwise("RAW_EVENT").alias("event_type"), "text")


def signals(events: DataFrame) -> DataFrame:
    """Adds the route signals of each event: type, key, family and, for failures, an error signal."""
    s = F.array(
        F.concat(F.lit("event_type:"), F.lower("event_type")), F.concat(F.lit("k:"), F.col("k")), F.concat(F.lit("family:"), F.col("family")),
        F.when(F.col("outcome") == "failed", F.concat(F.lit("error:"), F.col("k"))),
    )
    return events.withColumn("route_signals", F.array_compact(s))


def postings(events: DataFrame) -> DataFrame:
    """One row per event and signal, split into layer and key."""
    p = signals(events).withColumn("route_signal", F.explode("route_signals")).drop("route_signals")
    return p.withColumns({"layer": F.substring_index("route_signal", ":", 1), "key": F.substring_index("route_signal", ":", -1)})


def facet_rows(posted: DataFrame) -> DataFrame:
    """One row per axis, route key and session: signals and the first event as evidence."""
    return posted.groupBy(F.col("layer").alias("axis"), F.col("key").alias("route_key"), "session_id").agg(F.count("*").alias("signal_count"), F.min("event_id").alias("evidence"))


def sessions(events: DataFrame, gap_minutes: int | None = None) -> DataFrame:
    """One row per session: first and last time, counts, label by day and ordinal."""
    s = events.groupBy("session_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("event_count"), F.count_if(F.col("event_type") == "USER_INTENT").alias("intent_count"), F.count_if(F.col("outcome") == "failed").alias("failure_count"))
    return s.withColumn("session_date", F.date_format("start", "yyyy-MM-dd"))
