"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import rollups as R
from ..operators import sequence as Q
from ..operators import typing as Y
from .base import EV, PO, dialogue, event_store, events, facet_store, facts, posting_store, query, table
from .search_queries import RC, receipts

C = F.col


@query("a1_entity_inventory", f"WITH {PO} SELECT layer, key, count(*) AS signal_count, count(DISTINCT session_id) AS session_count, max(session_date) AS last_date FROM po GROUP BY layer, key")
def a1(spark, d):
    return R.entity_inventory(posting_store(spark, d), "layer", "key")


@query("k2_inventory_top", f"WITH {PO} SELECT layer, key, count(*) AS signal_count, count(DISTINCT session_id) AS session_count FROM po GROUP BY layer, key ORDER BY 3 DESC, 4 DESC, key, layer LIMIT 30")
def k2(spark, d):
    i = R.entity_inventory(posting_store(spark, d), "layer", "key")
    return i.orderBy(F.desc("signal_count"), F.desc("session_count"), "key", "layer").limit(30).select("layer", "key", "signal_count", "session_count")


@query("a2_facet_inventory", f"WITH {EV}, f AS (SELECT family, k, session_id, count(*) - 1 AS signal_count, max(session_date) AS session_date FROM ev GROUP BY ALL) SELECT family, k, CAST(sum(greatest(signal_count, 1)) AS BIGINT) AS signal_total, count(DISTINCT session_id) AS sessions, max(session_date) AS last_date FROM f GROUP BY family, k")
def a2(spark, d):
    f = facts(spark, d).groupBy("family", "k", "session_id").agg((F.count("*") - 1).alias("signal_count"), F.max("session_date").alias("session_date"))
    return R.facet_inventory(f.withColumn("session_label", F.lit(None).cast("string")), "family", "k")


@query("a3_pattern_scan", f"""WITH {EV}, f AS (SELECT 'event_type' AS facet, event_type AS value FROM ev UNION ALL SELECT 'family', family FROM ev UNION ALL SELECT 'outcome', outcome FROM ev UNION ALL SELECT 'k', k FROM ev UNION ALL SELECT 'session_id', session_id FROM ev
  UNION ALL SELECT 'actions', raw_type FROM ev UNION ALL SELECT 'actions', actor FROM ev), c AS (SELECT facet, value, count(*) AS n FROM f GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS place FROM c) WHERE place <= 12""")
def a3(spark, d):
    return R.top_values(facts(spark, d).withColumn("actions", F.array("raw_type", "actor")), 12, "event_type", "family", "outcome", "k", "session_id", "actions")


@query("a4_top_counts", "SELECT o_orderpriority AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1 ORDER BY place LIMIT 3")
def a4(spark, d):
    return R.top_values(table(spark, d, "orders"), 3, "o_orderpriority").select("value", "n", "place")


_SUMMARY = "count(*) AS receipts, count(*) FILTER (NOT ok OR NOT bridge_ok OR listed) AS error_like, count(*) FILTER (NOT ok) AS hard_failures, count(*) FILTER (NOT bridge_ok) AS bridge_failures, count(duration_ms) AS timed, round(min(duration_ms), 2) AS min_ms, round(avg(duration_ms), 2) AS avg_ms, round(max(duration_ms), 2) AS max_ms"


@query("a5_receipt_summary", f"WITH {RC} SELECT 'event' AS axis, hook_event_name AS value, {_SUMMARY} FROM rc GROUP BY 2 UNION ALL SELECT 'session', session_id, {_SUMMARY} FROM rc GROUP BY 2")
def a5(spark, d):
    r = receipts(spark, d)
    return R.receipt_summary(r.withColumns({"axis": F.lit("event"), "value": C("hook_event_name")}), "axis", "value").unionByName(R.receipt_summary(r.withColumns({"axis": F.lit("session"), "value": C("session_id")}), "axis", "value"))


@query("a5_receipt_actions", f"WITH {RC} SELECT action, count(*) AS n FROM (SELECT raw_type AS action FROM rc UNION ALL SELECT family FROM rc) GROUP BY 1")
def a5_actions(spark, d):
    return receipts(spark, d).select(F.explode("actions").alias("action")).groupBy("action").agg(F.count("*").alias("n"))


@query("a6_durations", f"WITH {RC} SELECT count(duration_ms) AS timed, round(min(duration_ms), 2) AS min_ms, round(avg(duration_ms), 2) AS avg_ms, round(max(duration_ms), 2) AS max_ms FROM rc")
def a6(spark, d):
    return R.receipt_summary(receipts(spark, d)).select("timed", "min_ms", "avg_ms", "max_ms")


_FRESH = "CASE outcome WHEN 'failed' THEN 'Stale since' WHEN 'observed' THEN 'dirty' WHEN 'verified' THEN ' FRESH' END"


def _freshness(rows):
    return rows.withColumn("freshness_status", F.when(C("outcome") == "failed", "Stale since").when(C("outcome") == "observed", "dirty").when(C("outcome") == "verified", " FRESH"))


@query("a7_quality_summary", f"WITH {EV} SELECT event_type, count(*) AS n, count(*) FILTER (outcome = 'verified') AS fresh, count(*) FILTER (outcome IN ('failed', 'observed')) AS stale, count(*) FILTER (outcome NOT IN ('verified', 'failed', 'observed')) AS unverifiable, count(correlation_id) AS with_ref, arg_max(event_id, event_id + epoch_us(ts) * 1000) AS latest_event FROM ev GROUP BY 1")
def a7(spark, d):
    return R.quality_summary(_freshness(facts(spark, d)), "event_type")


@query("a8_freshness", f"WITH {EV} SELECT event_id, CASE outcome WHEN 'verified' THEN 'fresh' WHEN 'failed' THEN 'stale' WHEN 'observed' THEN 'stale' ELSE 'unverifiable' END AS bucket FROM ev")
def a8(spark, d):
    return _freshness(facts(spark, d)).select("event_id", R.freshness_bucket(C("freshness_status")).alias("bucket"))


_ROLL = "count(*) AS posting_count, count(DISTINCT session_id) AS session_count, array_to_string(list_slice(list_sort(list(DISTINCT session_id)), 1, 3), ',') AS session_sample"


@query("a9_route_rollup", f"WITH {PO} SELECT layer, key, route_signal, {_ROLL} FROM po GROUP BY layer, key, route_signal")
def a9(spark, d):
    return R.route_rollup(posting_store(spark, d), ["layer", "key", "route_signal"])


@query("a10_direct_event_rollup", f"WITH {EV} SELECT actor, event_type, outcome, {_ROLL} FROM ev GROUP BY actor, event_type, outcome")
def a10(spark, d):
    return R.route_rollup(facts(spark, d), ["actor", "event_type", "outcome"])


#: What each event adds to the twelve facets of its segment, as SQL arrays. Tags and acts chosen here.
_ACT = "CASE actor WHEN 'user' THEN 'ask' WHEN 'assistant' THEN 'act' ELSE 'report' END"
_STEP = "CASE phase WHEN 'request' THEN 'open' WHEN 'verify' THEN 'close' ELSE 'work' END"
FACETS = {"by_type": "event_type", "by_tag": "raw_type, actor", "by_family": "family", "by_phase": "phase", "by_actor": "actor", "by_action": "raw_type", "by_outcome": "outcome", "by_correlation": "correlation_id", "by_conversation_act": _ACT, "by_session_act": _STEP}
_SIGNALS = {"by_route_layer": "'event_type', 'k', 'family', CASE WHEN outcome = 'failed' THEN 'error' END", "by_route_signal": "'event_type:' || lower(event_type), 'k:' || k, 'family:' || family, CASE WHEN outcome = 'failed' THEN 'error:' || k END"}
_UNPIVOT = " UNION ALL ".join(f"SELECT session_id, segment, line, '{n}' AS facet, unnest([{x}]) AS value FROM sg" for n, x in (FACETS | _SIGNALS).items())


@query("a11_segment_facets", f"""WITH {EV}, sg AS (SELECT *, CAST(sum(CASE WHEN event_type = 'USER_INTENT' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) AS BIGINT) AS segment FROM ev), f AS ({_UNPIVOT})
SELECT session_id, segment, facet, value, count(*) AS n, array_to_string(list_slice(list_sort(list(line)), 1, 5), ',') AS first_lines FROM f WHERE value IS NOT NULL GROUP BY ALL""")
def a11(spark, d):
    s = E.signals(Q.segments(events(spark, d), C("event_type") == "USER_INTENT"))
    signals = {"by_route_layer": F.array_distinct(F.transform("route_signals", lambda x: F.substring_index(x, ":", 1))), "by_route_signal": C("route_signals")}
    return R.segment_facets(s, {n: F.expr(f"array({x})") for n, x in FACETS.items()} | signals)


@query("a12_totals_by_basis", "WITH p AS (SELECT l_suppkey, l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ALL) SELECT * FROM p UNION ALL SELECT NULL, l_returnflag, CAST(sum(n) AS BIGINT), CAST(sum(qty) AS BIGINT), CAST(sum(lines) AS BIGINT) FROM p GROUP BY 2")
def a12(spark, d):
    l = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", C("l_quantity").cast("long").alias("qty"), C("l_linenumber").cast("long").alias("lines"))
    return R.totals_by_basis(l, "l_suppkey", "l_returnflag", "qty", "lines")


@query("a15_session_counters", f"WITH {EV} SELECT session_id, count(*) AS event_count, count(*) FILTER (event_type = 'USER_INTENT') AS segment_count, arg_max(event_id, line) AS latest FROM ev GROUP BY 1")
def a15(spark, d):
    return events(spark, d).groupBy("session_id").agg(F.count("*").alias("event_count"), F.count_if(C("event_type") == "USER_INTENT").alias("segment_count"), F.max_by("event_id", "line").alias("latest"))


#: Review weights by event type.
WEIGHTS = {"SECURITY_OR_SECRET_RISK": 12, "ERROR": 2, "DEAD_BRANCH": 8, "PROCESS_LESSON": 6, "ASSUMPTION": 4, "DECISION": 3, "OPEN_THREAD": 2, "FINAL_STATE": 1}


@query("a16_review_score", f"""WITH {EV}, s AS (SELECT session_id, CAST(sum(CASE event_type WHEN 'ERROR' THEN 2 ELSE 0 END) AS BIGINT) AS weight, count(*) AS size FROM ev GROUP BY 1),
t AS (SELECT *, weight + CASE WHEN size >= 100 THEN 100 WHEN size >= 24 THEN 30 ELSE 0 END AS score FROM s)
SELECT *, CASE WHEN score >= 100 THEN 'deep' WHEN score >= 20 THEN 'standard' WHEN score >= 1 THEN 'sample' ELSE 'none' END AS band FROM t""")
def a16(spark, d):
    return R.weighted_review(facts(spark, d), WEIGHTS)


@query("a19_census_ratio", "SELECT count(*) FILTER (quality = 1) AS numerator, count(*) AS denominator, round(count(*) FILTER (quality = 1) / count(*), 4) AS ratio FROM labels")
def a19(spark, d):
    return R.census_ratio(table(spark, d, "labels"), C("quality") == 1)


@query("a20_registry_counts", "SELECT 'kind' AS axis, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'size', p_size::VARCHAR, count(*) FROM part GROUP BY 2")
def a20(spark, d):
    g = table(spark, d, "part").select(C("p_brand").alias("kind"), C("p_size").cast("string").alias("size"))
    return R.facet_values(g, "kind", "size").groupBy(C("facet").alias("axis"), "value").agg(F.count("*").alias("n"))


@query("a21_fingerprint", """WITH r AS (SELECT event_type AS grp, sha256(event_id || '|' || user_id) AS d FROM events), c AS (SELECT grp, d, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT grp, left(d, 2) AS b, sha256(string_agg(d || ':' || n, ',' ORDER BY d || ':' || n)) AS h FROM c GROUP BY ALL)
SELECT grp, sha256(string_agg(b || ':' || h, ',' ORDER BY b || ':' || h)) AS fingerprint FROM b GROUP BY grp""")
def a21(spark, d):
    return R.table_fingerprint(table(spark, d, "events"), C("event_type"), "event_id", "user_id")


@query("a22_flag_counts", "SELECT flag, count(*) AS n FROM (SELECT 'short_text' AS flag FROM documents WHERE length(text) < 60 UNION ALL SELECT 'shouting' FROM documents WHERE contains(text, '!!') UNION ALL SELECT 'table_like' FROM documents WHERE contains(text, ' | ')) GROUP BY 1")
def a22(spark, d):
    return R.flag_counts(table(spark, d, "documents"), {"short_text": F.char_length("text") < 60, "shouting": F.contains("text", F.lit("!!")), "table_like": F.contains("text", F.lit(" | "))})


@query("a23_sizes", f"WITH {PO} SELECT 'events' AS name, count(*) AS n FROM ev UNION ALL SELECT 'postings', count(*) FROM po UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM ev")
def a23(spark, d):
    e = facts(spark, d)
    return R.sizes(events=e, postings=E.postings(e), sessions=E.sessions(e))


@query("a24_promotion", f"WITH {PO} SELECT layer, key, count(DISTINCT session_id) AS session_count FROM po GROUP BY ALL HAVING count(DISTINCT session_id) >= 60")
def a24(spark, d):
    return R.promotion_candidates(posting_store(spark, d), 60, "layer", "key")


@query("c12_facets", f"WITH {PO} SELECT layer AS axis, key AS route_key, session_id, count(*) AS signal_count, min(event_id) AS evidence FROM po GROUP BY ALL")
def c12(spark, d):
    return facet_store(spark, d)


@query("s6_facet_scan", f"WITH {PO} SELECT key AS route_key, session_id, count(*) AS signal_count FROM po WHERE layer = 'error' GROUP BY ALL")
def s6(spark, d):
    return facet_store(spark, d).where("axis = 'error'").select("route_key", "session_id", "signal_count")


@query("c1_classified_dialogue", "SELECT 'c' || conv_id AS session_id, turn + 1 AS line, CASE role WHEN 'user' THEN 'USER_INTENT' WHEN 'assistant' THEN 'ASSISTANT_MESSAGE' WHEN 'system' THEN 'CONTEXT_STATE' ELSE 'RAW_EVENT' END AS event_type FROM conversations")
def c1(spark, d):
    return dialogue(spark, d).select("session_id", "line", "event_type")


def transcript_lines(spark, d):
    """Lines in the shape of transcripts: turns as messages, log events as calls, their outputs and what is said of them. What each says is chosen here."""
    none = F.lit(None).cast("string")
    said = table(spark, d, "conversations").select(F.concat(F.lit("c"), C("conv_id").cast("string")).alias("session_id"), (C("turn") + 1).alias("line"), F.lit("2024-01-01").alias("day"), F.lit("response_item").alias("kind"), F.lit("message").alias("payload"), "role", none.alias("tool"), none.alias("arguments"), "text")
    logs = events(spark, d).select("session_id", "line", C("session_date").alias("day"), *[F.expr(x).alias(n) for n, x in LOGGED.items()])
    return said.unionByName(logs)


_KN = "(CAST(k AS INT) % {})"
#: The transcript line that a log event stands for, as SQL.
LOGGED = {
    "kind": f"CASE WHEN {_KN.format(50)} = 49 THEN 'hook_stop' WHEN {_KN.format(50)} = 48 THEN 'compacted' WHEN {_KN.format(50)} = 47 THEN 'session_meta' ELSE 'response_item' END",
    "payload": "CASE raw_type WHEN 'click' THEN 'function_call' WHEN 'view' THEN 'function_call_output' WHEN 'error' THEN 'function_call_output' ELSE 'message' END",
    "role": "CASE raw_type WHEN 'signup' THEN 'user' WHEN 'purchase' THEN 'assistant' END",
    "tool": f"CASE WHEN raw_type = 'click' THEN CASE {_KN.format(9)} WHEN 0 THEN 'shell' WHEN 1 THEN 'read_file' WHEN 2 THEN 'write_file' WHEN 3 THEN 'apply_patch' WHEN 4 THEN 'update_plan' WHEN 5 THEN 'spawn_agent' WHEN 6 THEN 'send_agent' WHEN 7 THEN 'mcp__catalog__find' ELSE 'exec' END END",
    "arguments": f"CASE WHEN raw_type = 'click' THEN CASE {_KN.format(4)} WHEN 0 THEN 'git show ' || k WHEN 1 THEN 'sudo run' || k || '.sh' WHEN 2 THEN 'pytest' ELSE k END END",
    "text": f"CASE raw_type WHEN 'view' THEN 'exited with code 0 after ' || k || ' ms' WHEN 'error' THEN '{{\"ok\": false, \"error\": \"E' || k || '\"}}' WHEN 'signup' THEN 'look for ITEM-' || k || ' in /srv/data/' || k WHEN 'purchase' THEN CASE {_KN.format(8)} WHEN 0 THEN 'Done: ' || k WHEN 1 THEN 'tests passed, stale ' || k WHEN 2 THEN 'decided on ' || k WHEN 3 THEN 'todo ' || k WHEN 4 THEN 'a lesson' WHEN 5 THEN 'assuming ' || k WHEN 6 THEN 'a checkpoint' ELSE 'item ' || k END END",
}
_LINES = f"""{EV}, ln AS (SELECT 'c' || conv_id AS session_id, turn + 1 AS line, '2024-01-01' AS day, 'response_item' AS kind, 'message' AS payload, role, NULL AS tool, NULL AS arguments, text FROM conversations
  UNION ALL SELECT session_id, line, session_date, {', '.join(LOGGED.values())} FROM ev)"""
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_RULES = ", ".join(f"({k}, {_quoted(r.gives)}, {', '.join(_quoted(r.when.get(f, '')) for f in Y.FIELDS)})" for k, r in enumerate(Y.RULES))
_TYPED = f"""{_LINES}, ru(rule, gives, {', '.join('p_' + f for f in Y.FIELDS)}) AS (VALUES {_RULES}), kinds(event_type, family, phase, actor, outcome) AS (VALUES {', '.join(str((k, *v)) for k, v in Y.TYPES.items())}),
ty AS (SELECT session_id, line, min(rule) AS rule FROM ln JOIN ru ON {' AND '.join(f"regexp_matches(coalesce({f}, ''), p_{f})" for f in Y.FIELDS)} GROUP BY ALL)"""


@query("c1_rule_typing", f"WITH {_TYPED} SELECT ty.session_id, ty.line, ty.rule, gives AS event_type, family, phase, actor, outcome FROM ty JOIN ru USING (rule) JOIN kinds ON event_type = gives")
def c1_rules(spark, d):
    """Every line typed by the rule table; the SQL tries all rules on all lines and takes the first."""
    return Y.classify_lines(transcript_lines(spark, d)).select("session_id", "line", "rule", "event_type", *Y.FACETS)


_LAYERS = " UNION ALL ".join(f"SELECT session_id, line, '{x.name}' AS layer, unnest(regexp_extract_all(coalesce({x.field}, ''), {_quoted(x.finds)}, 1)) AS key FROM ln" for x in Y.LAYERS)


@query("c3_layers", f"WITH {_LINES}, sg AS ({_LAYERS}) SELECT layer, lower(key) AS key, count(DISTINCT session_id || ':' || line) AS lines FROM sg WHERE key <> '' GROUP BY 1, 2")
def c3_layers(spark, d):
    s = Y.route_signals(transcript_lines(spark, d)).select("session_id", "line", F.explode("route_signals").alias("s"))
    return s.groupBy("s.layer", "s.key").agg(F.count("*").alias("lines"))


@query("c12_axes", f"""WITH {_TYPED}, sg AS (SELECT DISTINCT session_id, line, layer, lower(key) AS key FROM ({_LAYERS}) WHERE key <> ''), tl AS (SELECT ty.session_id, ty.line, ln.day, k.* FROM ty JOIN ln USING (session_id, line) JOIN ru USING (rule) JOIN kinds k ON k.event_type = gives),
ax AS ({' UNION ALL '.join(f"SELECT '{a}' AS axis, key AS route_key, session_id, line FROM sg WHERE layer = '{v[6:]}'" if v.startswith('layer:') else f"SELECT '{a}', lower(event_type), session_id, line FROM tl WHERE event_type IN ({', '.join(_quoted(x) for x in v[5:].split())})" if v.startswith('type:') else f"SELECT '{a}', {v}, session_id, line FROM tl" for a, v in Y.AXES.items())})
SELECT axis, route_key, session_id, count(*) AS signal_count, min(line) AS first_line, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM ax GROUP BY 1, 2, 3""")
def c12_axes(spark, d):
    return Y.axis_rows(Y.route_signals(Y.classify_lines(transcript_lines(spark, d))))


@query("c3_route_signals", f"WITH {PO} SELECT event_id, route_signal FROM po")
def c3(spark, d):
    return event_store(spark, d).select("event_id", F.explode("route_signals").alias("route_signal"))
