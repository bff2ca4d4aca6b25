"""Registration of queries, table reads, and the event model as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import lexical
from ..sources.store import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of a session that are dealt together, so that a large session is written by many tasks.
DEALT_LINES = 65_536


def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored session events: typed, with their line and signals, a folder a month, clustered by session."""
    raw = f"{sf_dir}/events.parquet"

    def build() -> DataFrame:
        e = ev.signals(ev.operational_events(spark.read.parquet(raw)))
        return e.withColumn("month", F.substring("session_date", 1, 7))

    return stored(spark, "events", [raw], build, ("month", "session_id", F.floor(F.col("line") / DEALT_LINES)), ("session_id", "line"), ("month",))


def posting_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored postings: one row per event and signal, a folder a layer, sorted by key."""
    build = lambda: ev.postings(event_store(spark, sf_dir)).select("event_id", "session_id", "session_date", "month", "layer", "key", "route_signal")
    return stored(spark, "postings", [f"{sf_dir}/events.parquet"], build, ("layer", "key", F.pmod(F.xxhash64("event_id"), F.lit(64))), ("key", "session_date"), ("layer",))


def facet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored facets: one row per axis, route key and session, a folder an axis."""
    build = lambda: ev.facet_rows(posting_store(spark, sf_dir))
    return stored(spark, "facets", [f"{sf_dir}/events.parquet"], build, ("axis", "route_key", "session_id"), ("route_key", "session_id"), ("axis",))


def kept_lexical(spark: SparkSession, sf_dir: str) -> lexical.Put:
    """How tables of the lexical index of documents are stored."""
    return lambda name, build, cluster, order: stored(spark, name, [f"{sf_dir}/documents.parquet"], build, cluster, order, version="2")


def lexical_index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored index of documents."""
    return lexical.build_index(table(spark, sf_dir, "documents"), put=kept_lexical(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store(spark, sf_dir).drop("month", "route_signals")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without line numbers, for what doesn't look at order."""
    return events(spark, sf_dir).drop("line")


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.dialogue_events(table(spark, sf_dir, "conversations"))


def _case(place: int, other: str) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[place]}'" for k, v in ev.TYPING.items()) + f" ELSE '{other}' END"


#: ev: the operational events; po: their postings. To follow WITH.
EV = f"""ev0 AS (SELECT event_id, 'u' || user_id AS session_id, ts, strftime(ts, '%Y-%m-%d') AS session_date, event_type AS raw_type, value,
  regexp_extract(props, '"k": ?([0-9]+)', 1) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line,
  {_case(0, "RAW_EVENT")} AS event_type, {_case(1, "unknown")} AS family, {_case(2, "unknown")} AS phase, {_case(3, "unknown")} AS actor, {_case(4, "unknown")} AS outcome FROM events),
ev AS (SELECT *, CASE WHEN event_type IN ('TOOL_CALL', 'TOOL_OUTPUT', 'ERROR') THEN k END AS correlation_id FROM ev0)"""
PO = (
    EV
    + """,
po AS (SELECT *, split_part(route_signal, ':', 1) AS layer, split_part(route_signal, ':', 2) AS key FROM (
  SELECT *, 'event_type:' || lower(event_type) AS route_signal FROM ev UNION ALL SELECT *, 'k:' || k FROM ev UNION ALL
  SELECT *, 'family:' || family FROM ev UNION ALL SELECT *, 'error:' || k FROM ev WHERE outcome = 'failed'))"""
)
