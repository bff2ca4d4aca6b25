"""Filters and projections (P), sorts and limits (K), set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import events as E
from ..operators import search as P
from ..operators.sequence import running_sum
from .base import EV, PO, dialogue, event_store, events, facts, query, table

C = F.col


@query("p1_multi_filter_search", f"WITH {EV} SELECT event_id, session_id, event_type, session_date FROM ev WHERE event_type = 'ERROR' AND family = 'failure_signal' AND outcome = 'failed' AND k = '7' AND session_date >= '2024-01-05' AND session_date <= '2024-01-25'")
def p1(spark, d):
    rows = P.search(event_store(spark, d), event_type="ERROR", family="failure_signal", outcome="failed", route_signal="k:7", date_from="2024-01-05", date_to="2024-01-25")
    return rows.select("event_id", "session_id", "event_type", "session_date")


@query("p2_in_list", "SELECT conv_id, turn, role FROM conversations WHERE role IN ('assistant', 'system')")
def p2(spark, d):
    return table(spark, d, "conversations").where(P.one_of(C("role"), [], {"agent": "assistant"}, ["agent", "system"])).select("conv_id", "turn", "role")


@query("p3_present", f"WITH {EV} SELECT event_id FROM ev WHERE correlation_id IS NOT NULL AND correlation_id <> ''")
def p3(spark, d):
    return facts(spark, d).where(P.present(C("correlation_id"))).select("event_id")


@query("p4_title_or_body", "SELECT doc_id FROM documents WHERE contains(lower(coalesce(source, '')), 'the and') OR contains(lower(coalesce(text, '')), 'the and')")
def p4(spark, d):
    return table(spark, d, "documents").where(P.mentions("The And", C("source"), C("text"))).select("doc_id")


@query("p5_term_contains", f"WITH {PO} SELECT route_signal, count(*) AS n FROM po WHERE contains(key, 'tool') OR contains(route_signal, 'tool') GROUP BY route_signal")
def p5(spark, d):
    p = E.postings(facts(spark, d))
    return p.where(P.term_contains("Tool!", C("key"), C("route_signal"))).groupBy("route_signal").agg(F.count("*").alias("n"))


@query("p6_session_selector", f"WITH {EV} SELECT session_id, count(*) AS n FROM ev WHERE session_id = 'u12' OR contains(session_id, 'u14') GROUP BY session_id")
def p6(spark, d):
    e = facts(spark, d)
    return e.where(P.session_matches("u14", C("session_id"), C("session_id")) | (C("session_id") == "u12")).groupBy("session_id").agg(F.count("*").alias("n"))


def receipts(spark, d):
    """Receipts derived from the event log: one per event, failures by type, the value as duration."""
    e = facts(spark, d)
    return e.select(
        "event_id", "session_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), C("raw_type").alias("hook_event_name"), (C("event_type") != "ERROR").alias("ok"),
        F.when(C("value") > 50, F.array(F.lit("slow"))).otherwise(F.array().cast("array<string>")).alias("errors"), F.array("raw_type", "family").alias("actions"),
        F.struct((C("k") != "13").alias("ok")).alias("typing_bridge"), F.when(C("k") != "20", C("value")).alias("duration_ms"),
    )


RC = f"""{EV}, rc AS (SELECT event_id, session_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, raw_type AS hook_event_name, event_type <> 'ERROR' AS ok, value > 50 AS listed, k <> '13' AS bridge_ok, CASE WHEN k <> '20' THEN value END AS duration_ms, raw_type, family FROM ev)"""


@query("p7_receipt_filter", f"WITH {RC} SELECT event_id FROM rc WHERE hook_event_name = 'click' AND timestamp >= '2024-01-10' AND (NOT ok OR NOT bridge_ok OR listed)")
def p7(spark, d):
    return receipts(spark, d).where(P.receipt_filter("CLICK", "2024-01-10", True)).select("event_id")


@query("p8_error_like", f"WITH {RC} SELECT event_id, (NOT ok OR NOT bridge_ok OR listed) AS error_like FROM rc")
def p8(spark, d):
    return receipts(spark, d).select("event_id", P.error_like().alias("error_like"))


@query("p9_exact_or_substring", "SELECT 'exact' AS lane, o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'substring', o_orderkey FROM orders WHERE contains(o_orderpriority, 'NOT')")
def p9(spark, d):
    o = table(spark, d, "orders")
    pick = lambda needle, lane: P.exact_or_substring(o, "o_orderpriority", needle).select(F.lit(lane).alias("lane"), "o_orderkey")
    return pick("5-LOW", "exact").unionByName(pick("NOT", "substring"))


@query("p10_grain_date", """WITH s AS (SELECT user_id, min(ts)::DATE AS d FROM events GROUP BY user_id), t AS (SELECT event_id, user_id, CASE WHEN event_type <> 'view' THEN ts::DATE END AS own FROM events)
SELECT event_id, coalesce(own, d) AS grain FROM t JOIN s USING (user_id) WHERE coalesce(own, d) BETWEEN '2024-01-03' AND '2024-01-12'""")
def p10(spark, d):
    e = table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    j = e.join(first, "user_id").withColumn("grain", P.grain_date(F.when(C("event_type") != "view", C("ts")), C("first")))
    return j.where(C("grain").between("2024-01-03", "2024-01-12")).select("event_id", "grain")


@query("p11_kind_family", "SELECT CASE event_type WHEN 'view' THEN 'mcp_tool_x' WHEN 'error' THEN 'mcp' ELSE event_type END AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")
def p11(spark, d):
    k = table(spark, d, "events").select(F.when(C("event_type") == "view", "mcp_tool_x").when(C("event_type") == "error", "mcp").otherwise(C("event_type")).alias("kind"))
    return k.where(P.kind_matches(C("kind"), "mcp")).groupBy("kind").agg(F.count("*").alias("n"))


def registry(spark, d):
    """Entities from parts: the key as id, the name as canonical key, brand and type as aliases."""
    return table(spark, d, "part").select(C("p_partkey").cast("string").alias("entity_id"), C("p_brand").alias("kind"), C("p_name").alias("canonical_key"), F.array("p_type", F.concat(C("p_brand"), F.lit("/"), C("p_partkey").cast("string"))).alias("aliases"), C("p_size").alias("size"))


@query("p12_registry_query", "SELECT p_partkey::VARCHAR AS entity_id FROM part WHERE contains(lower(p_name), 'ste') OR contains(lower(p_type), 'ste') OR contains(lower(p_brand || '/' || p_partkey), 'ste')")
def p12(spark, d):
    return registry(spark, d).where(P.registry_query("STE", C("aliases"), C("entity_id"), C("canonical_key"))).select("entity_id")


@query("p12_registry_matches", "SELECT p_partkey::VARCHAR AS entity_id FROM part WHERE contains(lower(p_partkey::VARCHAR), 'ring') OR contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand || '/' || p_partkey), 'ring')")
def p12_matches(spark, d):
    """Entries that hold the needle in their id, key or an alias."""
    return registry(spark, d).where(P.registry_query("Ring", C("aliases"), C("entity_id"), C("canonical_key"))).select("entity_id")


@query("p13_guarded_search", f"WITH {EV} SELECT event_id FROM ev WHERE outcome = 'verified' AND session_date >= '2024-01-20'")
def p13(spark, d):
    try:
        P.check_filters({"task_episode_id": 1, "route_signal": "x"})
    except ValueError:
        return P.search(facts(spark, d), outcome="verified", date_from="2024-01-20").select("event_id")


@query("p14_hit_projection", f"WITH {EV} SELECT 'event:' || session_id || ':' || event_id AS doc_id, upper(left(raw_type, 1)) || substr(raw_type, 2) || ' ' || k AS title, 'raw:line:' || line AS raw_ref, CASE WHEN outcome = 'failed' THEN 'stale' ELSE 'fresh' END AS freshness FROM ev")
def p14(spark, d):
    hit = events(spark, d).select(F.concat_ws(":", F.lit("event"), "session_id", C("event_id").cast("string")).alias("doc_id"), F.concat_ws(" ", F.initcap("raw_type"), "k").alias("title"), F.struct(F.concat(F.lit("raw:line:"), C("line").cast("string")).alias("raw")).alias("refs"), F.when(C("outcome") == "failed", "stale").otherwise("fresh").alias("freshness"))
    return hit.select("doc_id", "title", C("refs.raw").alias("raw_ref"), "freshness")


@query("p15_compact_json", """SELECT o_orderkey, '{"o_orderstatus":"' || o_orderstatus || '"' || CASE WHEN o_orderstatus = 'F' THEN ',"note":"late"' ELSE '' END || '}' AS doc FROM orders""")
def p15(spark, d):
    o = table(spark, d, "orders").withColumn("note", F.when(C("o_orderstatus") == "F", "late").when(C("o_orderstatus") == "O", ""))
    return o.select("o_orderkey", P.compact_json(o, "o_orderstatus", "note").alias("doc"))


@query("p16_generation_gate", f"WITH {EV} SELECT count(*) FILTER (outcome = 'failed') AS abstained, count(*) FILTER (outcome <> 'failed') AS admitted FROM ev")
def p16(spark, d):
    kept, out = P.current_generation(facts(spark, d).withColumn("gen", F.when(C("outcome") == "failed", 1).otherwise(2)), gen=2)
    return out.withColumn("admitted", kept.agg(F.count("*")).scalar())


@query("p17_agent_routes", """WITH c AS (SELECT conv_id, turn, role, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS fin, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT conv_id, turn, CASE WHEN turn = fin THEN 'closeout' ELSE 'progress_update' END AS route, CASE WHEN nxt = 'user' THEN 'answered' WHEN nxt IS NULL THEN 'final' ELSE 'continued' END AS state FROM c WHERE role = 'assistant'""")
def p17(spark, d):
    """Every answer: the last of its conversation is the closeout, the others are progress updates; and what follows it."""
    return P.agent_routes(dialogue(spark, d), C("session_id").isNotNull()).select(F.substring("session_id", 2, 40).cast("long").alias("conv_id"), (C("line") - 1).alias("turn"), "route", "state")


@query("p19_session_row", f"WITH {EV} SELECT session_id, min(session_date) AS session_date, count(*) AS event_count, 'session:' || session_id AS ref FROM ev WHERE contains(session_id, 'u7') GROUP BY session_id")
def p19(spark, d):
    s = E.sessions(facts(spark, d)).where(P.session_matches("u7", C("session_id"), C("session_id")))
    return s.select("session_id", "session_date", "event_count", F.concat(F.lit("session:"), "session_id").alias("ref"))


# Sorts, limits, top-k


@query("k1_recent", f"WITH {EV} SELECT event_id, session_date FROM ev ORDER BY session_date DESC, event_id DESC LIMIT 50")
def k1(spark, d):
    return P.ranked(facts(spark, d).select("event_id", "session_date"), 50, F.desc("session_date"), F.desc("event_id"))


@query("k3_term_preference", f"WITH {PO} SELECT layer, key FROM (SELECT DISTINCT layer, key FROM po) ORDER BY CASE layer WHEN 'k' THEN 0 WHEN 'event_type' THEN 1 ELSE 2 END, key <> '7', length(key), key LIMIT 20")
def k3(spark, d):
    t = E.postings(facts(spark, d)).select("layer", "key").distinct()
    return P.ranked(t, 20, F.when(C("layer") == "k", 0).when(C("layer") == "event_type", 1).otherwise(2), C("key") != "7", F.length("key"), C("key"))


@query("k4_edge_budget", "SELECT source, target, n, cnt > 5 AS truncated FROM (SELECT user_id AS source, event_type AS target, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r, count(*) OVER (PARTITION BY event_type) AS cnt FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r <= 5")
def k4(spark, d):
    """The first budget edges of each target by count; one more is fetched to tell whether some were cut."""
    e = table(spark, d, "events").groupBy(C("user_id").alias("source"), C("event_type").alias("target")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("target").orderBy(F.desc("n"), "source")
    six = e.withColumn("r", F.row_number().over(w)).where("r <= 6")
    return six.withColumn("truncated", F.max("r").over(Window.partitionBy("target")) > 5).where("r <= 5").select("source", "target", "n", "truncated")


@query("k5_timeline_order", f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), ''), session_id, line, event_id) AS place FROM ev")
def k5(spark, d):
    """Lines follow the time of events, so the place is the count of lines so far."""
    return running_sum(events(spark, d), F.lit(1), "place").select("event_id", "place")


@query("k6_receipts_newest", f"WITH {RC} SELECT event_id FROM rc ORDER BY timestamp DESC NULLS LAST, session_id DESC, event_id LIMIT 40")
def k6(spark, d):
    return P.ranked(receipts(spark, d), 40, F.desc_nulls_last("timestamp"), F.desc("session_id"), C("event_id")).select("event_id")


@query("k7_fair_samples", f"WITH {EV}, r AS (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS round FROM ev) SELECT k, event_id, round FROM r ORDER BY round, CAST(k AS INT) LIMIT 120")
def k7(spark, d):
    """One per key first, then a second of each, up to a total."""
    w = Window.partitionBy("k").orderBy(F.desc("ts"), F.desc("event_id"))
    r = facts(spark, d).select("k", "event_id", F.row_number().over(w).alias("round")).where("round <= 120")
    return P.ranked(r, 120, C("round"), C("k").cast("int"))


@query("k8_fair_evidence", f"WITH {EV}, v AS (SELECT family, event_id, row_number() OVER (PARTITION BY family ORDER BY event_id) AS r FROM ev) SELECT family, event_id FROM v WHERE r <= 4 ORDER BY r, family LIMIT 10")
def k8(spark, d):
    w = Window.partitionBy("family").orderBy("event_id")
    v = facts(spark, d).select("family", "event_id", F.row_number().over(w).alias("r")).where("r <= 4")
    return P.ranked(v, 10, C("r"), C("family")).select("family", "event_id")


@query("k9_action_order", "SELECT event_type AS action, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 4 ELSE 3 END, event_type) AS place, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def k9(spark, d):
    """Strong actions in their order, then unlisted ones by name, then weak ones; twelve at most."""
    counts = table(spark, d, "events").groupBy(C("event_type").alias("action")).agg(F.count("*").alias("n"))
    strong, weak = ["purchase", "click"], ["view"]
    rank = F.when(C("action").isin(*weak), S.priority(C("action"), weak) + 100).otherwise(S.priority(C("action"), strong))
    # A handful of distinct actions: one window over them all is small.
    return counts.withColumn("place", F.row_number().over(Window.orderBy(rank, "action"))).where("place <= 12").select("action", "place", "n")


@query("k10_clamped_limit", "SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def k10(spark, d):
    return P.ranked(table(spark, d, "events").select("event_id"), P.clamp(5000, 1, 20, 100), C("event_id"))


@query("k11_seeded_sample", f"WITH {PO}, c AS (SELECT layer, key, count(*) AS n FROM po GROUP BY ALL HAVING count(*) >= 20) SELECT layer, key FROM (SELECT layer, key, row_number() OVER (PARTITION BY layer ORDER BY sha256('seed' || key), key) AS r FROM c) WHERE r <= 5")
def k11(spark, d):
    c = E.postings(facts(spark, d)).groupBy("layer", "key").agg(F.count("*").alias("n")).where("n >= 20")
    return P.ranked(c, 5, F.sha2(F.concat(F.lit("seed"), "key"), 256), C("key"), by=["layer"]).select("layer", "key")


@query("k12_goal_order", f"WITH {EV}, g AS (SELECT k, min(event_id) AS first_id, max(event_id) AS last_id FROM ev GROUP BY k) (SELECT 'old' AS lane, k FROM g ORDER BY first_id LIMIT 10) UNION ALL (SELECT 'new', k FROM g ORDER BY last_id DESC LIMIT 10)")
def k12(spark, d):
    g = facts(spark, d).groupBy("k").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return P.ranked(g, 10, F.asc("a")).select(F.lit("old").alias("lane"), "k").unionByName(P.ranked(g, 10, F.desc("b")).select(F.lit("new").alias("lane"), "k"))


@query("k13_segment_preview", "SELECT session_id, line, src FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY src, line) AS r FROM (SELECT 'c' || conv_id AS session_id, turn + 1 AS line, 0 AS src FROM conversations WHERE role = 'user' UNION ALL SELECT 'c' || conv_id, turn + 1, 1 FROM conversations WHERE role = 'assistant')) WHERE r <= 3")
def k13(spark, d):
    t = dialogue(spark, d)
    lanes = t.where("actor = 'user'").select("session_id", "line", F.lit(0).alias("src")).unionByName(t.where("actor = 'assistant'").select("session_id", "line", F.lit(1).alias("src")))
    return P.ranked(lanes, 3, C("src"), C("line"), by=["session_id"])


# Set operations


@query("u1_ordered_distinct", f"WITH {EV} SELECT session_id, k, min(line) AS position FROM ev GROUP BY session_id, k")
def u1(spark, d):
    return events(spark, d).groupBy("session_id", "k").agg(F.min("line").alias("position"))


@query("u2_union_lanes", "SELECT DISTINCT id FROM (SELECT user_id AS id FROM events WHERE event_type = 'error' UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def u2(spark, d):
    a = table(spark, d, "events").where("event_type = 'error'").select(C("user_id").alias("id"))
    return a.unionByName(table(spark, d, "customer").where("c_acctbal < 0").select(C("c_custkey").alias("id"))).distinct()


@query("u3_intersection", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def u3(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(C("o_custkey").alias("id")).intersect(table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey"))


@query("u4_difference", "SELECT l_partkey AS id FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 25")
def u4(spark, d):
    small = table(spark, d, "part").where("p_size < 25")
    return table(spark, d, "lineitem").join(small, C("l_partkey") == C("p_partkey"), "left_anti").select(C("l_partkey").alias("id")).distinct()


@query("u5_ref_dedupe", "SELECT l_orderkey || '|' || l_suppkey AS ref, min(l_linenumber) AS first_line, count(*) - 1 AS duplicates FROM lineitem GROUP BY 1")
def u5(spark, d):
    key = F.concat_ws("|", C("l_orderkey").cast("string"), C("l_suppkey").cast("string"))
    return table(spark, d, "lineitem").groupBy(key.alias("ref")).agg(F.min("l_linenumber").alias("first_line"), (F.count("*") - 1).alias("duplicates"))


@query("u6_first_hit_lane", f"WITH {EV}, h AS (SELECT session_id, event_id, CASE event_type WHEN 'VERIFICATION' THEN 1 WHEN 'ERROR' THEN 2 ELSE 3 END AS lane FROM ev), m AS (SELECT session_id, min(lane) AS lane FROM h GROUP BY 1) SELECT h.session_id, h.event_id, h.lane FROM h JOIN m ON h.session_id = m.session_id AND h.lane = m.lane")
def u6(spark, d):
    """Candidate signals in order; a session's hits are those of the first lane with any."""
    h = facts(spark, d).select("session_id", "event_id", F.when(C("event_type") == "VERIFICATION", 1).when(C("event_type") == "ERROR", 2).otherwise(3).alias("lane"))
    return h.join(h.groupBy("session_id").agg(F.min("lane").alias("lane")), ["session_id", "lane"])
