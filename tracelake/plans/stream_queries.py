"""Sources and sinks (S), streams (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import sequence as Q
from ..sources import readers as RD
from ..sources import storage as ST
from ..streaming import episodes as EP
from ..streaming import flows as FL
from ..streaming import incremental as IN
from .base import EV, PO, events, facts, posting_store, query, table
from .search_queries import RC, receipts
from .sequence_queries import _EP, _SEG

C = F.col


def stream(spark, d):
    return FL.stream_events(spark, f"{d}/events.parquet")


@query("s1_transcript_scan", "SELECT conv_id, turn + 1 AS line, 'parsed' AS status, role, text FROM conversations")
def s1(spark, d):
    """Conversations written as JSONL transcripts, one file each partition's share, and read back with their lines."""
    t = table(spark, d, "conversations")
    path = ST.new_path(spark, "transcripts")
    row = F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("response_item").alias("type"), F.struct(F.concat_ws(":", C("conv_id").cast("string"), C("turn").cast("string")).alias("id"), F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("input_text").alias("type"), C("text").alias("text"))).alias("content")).alias("payload")))
    t.select(row.alias("value")).write.option("maxRecordsPerFile", 5000).text(path)
    got = RD.read_transcripts(spark, path)
    ident = F.split(C("event.payload.id"), ":")
    return got.select(ident[0].cast("long").alias("conv_id"), (ident[1].cast("long") + 1).alias("line"), "status", C("event.payload.role").alias("role"), C("event.payload.content")[0]["text"].alias("text"))


@query("s2_receipt_scan", f"WITH {RC} SELECT hook_event_name, count(*) AS receipts, count(*) FILTER (NOT ok) AS hard_failures FROM rc GROUP BY 1 UNION ALL SELECT '(unreadable)', count(*) FILTER (event_id % 1000 = 0), 0 FROM rc")
def s2(spark, d):
    """Receipts written as JSON lines, some of them broken, and read back; the unreadable are counted, not lost."""
    path = ST.new_path(spark, "receipts")
    r = receipts(spark, d)
    good = r.select(F.to_json(F.struct("timestamp", "hook_event_name", "ok", "session_id", "errors")).alias("value"))
    bad = r.where("event_id % 1000 = 0").select(F.lit("{broken").alias("value"))
    good.unionByName(bad).write.text(path)
    got = RD.read_receipts(spark, path)
    return got.groupBy(F.coalesce("hook_event_name", F.lit("(unreadable)")).alias("hook_event_name")).agg(F.count("*").alias("receipts"), F.count_if(C("ok") == F.lit(False)).alias("hard_failures"))


@query("s3_posting_scan", f"WITH {PO} SELECT event_id, layer FROM po WHERE layer = 'family'")
def s3(spark, d):
    return posting_store(spark, d).where("layer = 'family'").select("event_id", "layer")


def _by_month(spark, d):
    return table(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))


@query("s4_month_shards", "WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders), m AS (SELECT DISTINCT month FROM o ORDER BY month DESC LIMIT 12) SELECT month, count(*) AS n FROM o WHERE month IN (SELECT month FROM m) GROUP BY 1")
def s4(spark, d):
    o = ST.write_projection(_by_month(spark, d), ST.new_path(spark, "orders"), "month")
    return ST.prune_months(o, "month", 12).groupBy(C("month").cast("string").alias("month")).agg(F.count("*").alias("n"))


@query("s8_projection_sink", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def s8(spark, d):
    o = ST.write_projection(_by_month(spark, d), ST.new_path(spark, "orders"), "month")
    return o.groupBy(C("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s9_partition_replace", "SELECT o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F' GROUP BY ALL")
def s9(spark, d):
    o = table(spark, d, "orders")
    path = ST.new_path(spark, "orders")
    ST.write_projection(o.withColumn("version", F.lit("old")), path, "o_orderpriority")
    dirty = o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").withColumn("version", F.lit("new"))
    return ST.replace_partitions(dirty, path, "o_orderpriority").groupBy("o_orderpriority", "version").agg(F.count("*").alias("n"))


@query("s10_idempotent_capture", "SELECT sha256(text) AS raw_sha256, count(*) AS captured FROM documents GROUP BY 1")
def s10(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("raw_sha256")).agg(F.count("*").alias("captured"))


@query("s11_import_selection", r"WITH v AS (SELECT doc_id, sha256(text) AS raw_sha256 FROM documents WHERE n_chars >= 500), a AS (SELECT doc_id, sha256(regexp_replace(text, '\s+$', '')) AS raw_sha256 FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT v.doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' ELSE 'stale' END AS state FROM v LEFT JOIN a USING (doc_id) WHERE a.raw_sha256 IS DISTINCT FROM v.raw_sha256")
def s11(spark, d):
    """Labelled good documents stand in for the archive, stored without their last white space; the window is documents of 500 characters or more."""
    docs = table(spark, d, "documents")
    archive = docs.join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id").select("doc_id", F.sha2(F.regexp_replace("text", r"\s+$", ""), 256).alias("raw_sha256"))
    return RD.missing_or_stale(docs.where("n_chars >= 500").select("doc_id", F.sha2("text", 256).alias("raw_sha256")), archive, "doc_id").select("doc_id", "state")


@query("r1_tail", "SELECT event_id, 'u' || user_id AS session_id, event_type FROM events")
def r1(spark, d):
    return FL.run(stream(spark, d).select("event_id", "session_id", "event_type"), "tail")


@query("r2_replay", "SELECT DISTINCT event_id FROM events")
def r2(spark, d):
    s = stream(spark, d)
    return FL.run(FL.replay_safe(s.unionByName(s), "40 days", "event_id").select("event_id"), "replay")


@query("r3_quiet_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g), w AS (SELECT user_id, n, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY ALL)
SELECT 'u' || user_id AS session_id, CAST(strftime(start, '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS start, events FROM w WHERE "end" <= (SELECT max(ts) FROM events)""")
def r3(spark, d):
    """Stretches that the end of the input has closed; still open ones are not emitted."""
    q = FL.run(FL.quiet_sessions(stream(spark, d), "30 minutes", "0 seconds"), "quiet")
    return q.select("session_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@query("r4_progress", "SELECT 'u' || user_id AS session_id, max(event_id) AS to_line, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS to_timestamp FROM events GROUP BY 1")
def r4(spark, d):
    return FL.run(FL.progress(stream(spark, d)), "progress", "complete").withColumn("to_timestamp", F.date_format("to_timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("r6_dirty_sessions", f"WITH {EV}, t AS (SELECT session_id, count(*) AS n FROM ev GROUP BY 1) SELECT session_id, n FROM t WHERE n % 2 = 1")
def r6(spark, d):
    """Sessions of an odd count stand in for those whose stored digest is old: only they are recomputed."""
    now = facts(spark, d).groupBy("session_id").agg(F.count("*").alias("n"))
    known = now.select("session_id", (C("n") - C("n") % 2).cast("string").alias("indexed_sha"))
    return FL.changed_sessions(now.withColumn("sha", C("n").cast("string")), known).select("session_id", "n")


@query("r7_stateful_episodes", f"""WITH {EV}, m AS (SELECT *, CASE event_type WHEN 'USER_INTENT' THEN 1 WHEN 'VERIFICATION' THEN 0 END AS m FROM ev),
p AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM m),
q AS (SELECT *, CAST(sum(CASE WHEN m = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) AS BIGINT) AS episode, coalesce(m = 1, false) OR was = 1 AS inside FROM p)
SELECT session_id, episode, count(*) AS events, max(event_id) FILTER (event_type = 'VERIFICATION') AS closed_by FROM q WHERE inside AND episode > 0 GROUP BY ALL HAVING max(event_id) FILTER (event_type = 'VERIFICATION') IS NOT NULL""")
def r7(spark, d):
    return FL.run(FL.stateful_episodes(stream(spark, d)), "episodes")


@query("r8_rolling_health", "WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 4) AS avg_value FROM events GROUP BY ALL) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, errors, avg_value FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def r8(spark, d):
    return FL.run(FL.rolling_health(stream(spark, d), "1 hour", "0 seconds"), "health").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("r9_capture_ahead", f"WITH {EV}, n AS (SELECT session_id, count(*) AS captured, count(*) FILTER (session_date < '2024-01-29') AS indexed FROM ev GROUP BY 1) SELECT session_id, captured <> indexed AS ahead, captured - indexed AS rejected FROM n")
def r9(spark, d):
    """The stream of captured events against the index as it stood before the last days."""
    old = facts(spark, d).where("session_date < '2024-01-29'")
    return FL.run(FL.capture_ahead(stream(spark, d), FL.index_state(old)), "ahead", "complete")


@query("r5_late_evidence", "SELECT 'u' || user_id AS session_id, count(*) AS events, count(*) FILTER (event_type = 'signup') AS intervals FROM events GROUP BY 1")
def r5(spark, d):
    return FL.run(FL.interval_counts(stream(spark, d), "signup"), "intervals", "complete")


#: Rows of a bucket of sessions, over all deliveries, about.
BUCKET_ROWS = 65_536


def _deliver(rows, part, take):
    """Write the rows of part 0, 1 and so on, and take each part in before the next one is there."""
    path = ST.new_path(rows.sparkSession, "deliveries")
    for k in range(3):
        rows.where(part == k).write.mode("append").parquet(path)
        take(rows.sparkSession.readStream.schema(rows.schema).parquet(path))


_CLOSED = f"""{_EP}, c AS (SELECT session_id, episode, count(*) AS events, min_by(event_id, line) AS opened_by, max(event_id) FILTER (event_type = 'VERIFICATION') AS closed_by, max(ts) FILTER (event_type = 'VERIFICATION') AS closed FROM q WHERE inside AND episode > 0 GROUP BY ALL)"""


@query("r7_timed_episodes", f"WITH {EV}, {_CLOSED} SELECT session_id, episode, events, opened_by, closed_by FROM c WHERE closed < (SELECT max(ts) FROM events) - INTERVAL 7 HOUR")
def r7_timed(spark, d):
    """Events arrive up to six hours late, in three deliveries with a restart between them; what the last watermark has not passed is still open."""
    rows = table(spark, d, "events")
    arrival = F.unix_micros(C("ts").cast("timestamp")) + (C("event_id") * 7919) % 21600 * 1_000_000
    low, high, n = rows.agg(F.min(arrival), F.max(arrival), F.count("*")).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    part = F.coalesce(F.floor((arrival - F.lit(low or 0)) / third).cast("int"), F.lit(0))
    out, mark = ST.new_path(spark, "episodes"), ST.new_path(spark, "episodes-checkpoint")
    got = []

    def take(stream):
        s = stream.select("event_id", F.concat(F.lit("u"), C("user_id").cast("string")).alias("session_id"), C("ts").cast("timestamp").alias("ts"), "event_type")
        got.append(EP.resume(EP.timed_episodes(s, C("event_type") == "signup", C("event_type") == "purchase", "7 hours", buckets=max(64, n // BUCKET_ROWS)), out, mark))

    _deliver(rows, part, take)
    return got[-1]


def _marked(e, lines):
    """Events with their segments and episodes, which projections add up."""
    opens, closes = C("event_type") == "USER_INTENT", C("event_type") == "VERIFICATION"
    marked = Q.episodes(Q.segments(e, opens, lines), opens, closes, lines)
    return marked.select("session_id", "line", "ts", "k", "event_type", "family", "outcome", "segment", "role", "episode", "in_episode")


def _segment_rows(s):
    return s.groupBy("session_id", "segment", "role").agg(F.count("*").alias("events"), F.min("line").alias("from_line"))


def _mention_rows(e):
    return E.postings(e).groupBy("session_id", "route_signal").agg(F.count("*").alias("n"))


def _maintained(spark, d):
    """Segments, episodes, postings and routes kept up to date over three deliveries: first most events, then late ones of a quarter of the users, then the other late ones."""
    kept = IN.Maintained(
        ST.new_path(spark, "maintained"), E.user_session(), lambda raw: _marked(E.whole_sessions(raw), None),
        [IN.Projection("segments", _segment_rows), IN.Projection("episodes", lambda e: Q.episode_rows(e).drop("start", "end")), IN.Projection("mentions", _mention_rows)],
        [IN.Total("routes", "mentions", "route_signal")], [IN.Revision("revisions", "episodes", "episode")], buckets=16, spread=lambda raw: _marked(E.operational_events(raw), Q.STRETCH), large=Q.STRETCH,
    )
    late = C("event_id") % 10 == 9
    _deliver(table(spark, d, "events"), F.when(~late, 0).when(C("user_id") % 4 == 0, 1).otherwise(2), kept.run)
    return kept


@query("r6_dirty_propagation", f"""WITH {PO}, {_SEG}, {_EP},
sr AS (SELECT session_id, segment, count(*) AS n, min(line) AS place FROM sg GROUP BY ALL), sl AS (SELECT *, CASE WHEN segment = 0 THEN 'initial' ELSE 'compaction' END || CASE WHEN segment = max(segment) OVER (PARTITION BY session_id) THEN '-to-latest' ELSE '-to-compaction' END AS role FROM sr)
SELECT 'segment' AS kind, session_id || '#' || segment AS item, n, place, role AS state FROM sl
UNION ALL SELECT 'episode', session_id || '#' || episode, events, from_line, status || '/' || failure_state FROM es
UNION ALL SELECT 'mention', session_id || '#' || route_signal, count(*), NULL, NULL FROM po GROUP BY session_id, route_signal
UNION ALL SELECT 'route', route_signal, count(*), count(DISTINCT session_id), NULL FROM po GROUP BY route_signal""")
def r6_propagation(spark, d):
    """All maintained tables after the last delivery, as a rebuild of all events would make them."""
    kept, none, named = _maintained(spark, d), F.lit(None), lambda c: F.concat_ws("#", "session_id", C(c).cast("string"))
    as_one = lambda name, kind, item, n, place, state: kept.table(spark, name).select(F.lit(kind).alias("kind"), item.alias("item"), C(n).cast("long").alias("n"), place.cast("long").alias("place"), state.cast("string").alias("state"))
    out = as_one("segments", "segment", named("segment"), "events", C("from_line"), C("role"))
    out = out.unionByName(as_one("episodes", "episode", named("episode"), "events", C("from_line"), F.concat_ws("/", "status", "failure_state")))
    return out.unionByName(as_one("mentions", "mention", named("route_signal"), "n", none, none)).unionByName(as_one("routes", "route", C("route_signal"), "n", C("sessions"), none))


def _episodes_of(where):
    return f"(WITH {EV.replace('FROM events)', f'FROM events WHERE {where})')}, {_EP} SELECT session_id, episode, events, from_line, to_line, status, failures, verification_state, failure_state FROM es)"


_STATES = ["event_id % 10 <> 9", "(event_id % 10 <> 9 OR user_id % 4 = 0)", "true"]


@query("r5_reopened_intervals", " UNION ALL ".join(f"""SELECT {k} AS delivery, coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.episode, b.episode) AS episode, a.status AS was, b.status AS status, a.events AS events_before, b.events AS events
FROM {_episodes_of(_STATES[k - 1])} a FULL JOIN {_episodes_of(_STATES[k])} b ON a.session_id = b.session_id AND a.episode = b.episode
WHERE ROW(a.events, a.from_line, a.to_line, a.status, a.failures, a.failure_state) IS DISTINCT FROM ROW(b.events, b.from_line, b.to_line, b.status, b.failures, b.failure_state)""" for k in (1, 2)))
def r5_reopened(spark, d):
    """What late deliveries made of intervals that were there: extended, re-opened, newly found or gone."""
    r = _maintained(spark, d).table(spark, "revisions").where("epoch > 0")
    return r.select(C("epoch").alias("delivery"), "session_id", "episode", C("old.status").alias("was"), C("new.status").alias("status"), C("old.events").alias("events_before"), C("new.events").alias("events"))
