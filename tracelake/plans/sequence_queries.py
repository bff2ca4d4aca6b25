"""Joins (J), windows and sequences (W), evidence (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import events as E
from ..operators import search as P
from ..operators import history as H
from ..operators import review as V
from ..operators import sequence as Q
from ..sources.storage import materialize
from .base import EV, PO, events, query, table
from .search_queries import RC, receipts, registry

C = F.col
CALL, RESULT = "event_type = 'TOOL_CALL'", "event_type IN ('TOOL_OUTPUT', 'ERROR')"


@query("j1_route_join", f"WITH {PO}, t AS (SELECT DISTINCT route_signal, layer FROM po) SELECT t.layer, ev.event_type, count(*) AS n FROM ev JOIN po USING (event_id) JOIN t ON po.route_signal = t.route_signal GROUP BY ALL")
def j1(spark, d):
    e = events(spark, d)
    bridge = E.postings(e).select("event_id", "route_signal")
    terms = E.postings(e).select("route_signal", "layer").distinct()
    return e.select("event_id", "event_type").join(bridge, "event_id").join(terms, "route_signal").groupBy("layer", "event_type").agg(F.count("*").alias("n"))


@query("j2_receipt_sessions", f"WITH {RC}, s AS (SELECT session_id, count(*) AS size FROM ev GROUP BY 1 HAVING count(*) > 60) SELECT rc.event_id, s.size FROM rc LEFT JOIN s USING (session_id)")
def j2(spark, d):
    s = E.sessions(events(spark, d)).where("event_count > 60").select("session_id", C("event_count").alias("size"))
    return receipts(spark, d).join(s, "session_id", "left").select("event_id", "size")


_PAIRS = f"pr AS (SELECT c.session_id, c.event_id AS call_id, c.line AS call_line, r.event_id AS result_id, r.line AS result_line, r.event_type AS result_type, c.correlation_id FROM ev c JOIN ev r ON c.session_id = r.session_id AND c.correlation_id = r.correlation_id AND r.line > c.line WHERE c.{CALL} AND r.{RESULT})"


def pairs(spark, d, how="inner"):
    e = events(spark, d)
    return Q.correlate(e.where(CALL), e.where(RESULT), how=how)


@query("j3_correlation", f"WITH {EV}, {_PAIRS} SELECT call_id, result_id FROM pr")
def j3(spark, d):
    return pairs(spark, d).select("call_id", "result_id")


@query("j4_foreign_results", f"WITH {EV} SELECT c.session_id, c.event_id AS call_id, r.event_id AS result_id FROM ev c JOIN ev r ON c.session_id = r.session_id AND r.line BETWEEN c.line + 1 AND c.line + 4 AND r.correlation_id <> c.correlation_id WHERE c.{CALL} AND r.{RESULT}")
def j4(spark, d):
    return Q.nearby_foreign(events(spark, d), F.expr(CALL), F.expr(RESULT), 4).select("session_id", "call_id", "result_id")


@query("j5_status_edges", f"WITH {EV} SELECT c.event_id AS source, r.event_id AS target, 'has_correlated_status' AS edge_type FROM ev c JOIN ev r ON c.session_id = r.session_id AND c.correlation_id = r.correlation_id AND r.line > c.line WHERE c.{CALL} AND r.event_type = 'ERROR'")
def j5(spark, d):
    e = events(spark, d)
    return Q.correlate(e.where(CALL), e.where("event_type = 'ERROR'")).select(C("call_id").alias("source"), C("result_id").alias("target"), F.lit("has_correlated_status").alias("edge_type"))


_SPANS = "sp AS (SELECT session_id, event_id AS span_id, line AS lo, lead(line) OVER (PARTITION BY session_id ORDER BY line) AS hi FROM ev WHERE event_type = 'USER_INTENT')"


OPENS = "event_type = 'USER_INTENT'"


@query("j6_interval_join", f"WITH {EV}, {_SPANS} SELECT span_id, event_id FROM ev JOIN sp USING (session_id) WHERE line > lo AND line < hi")
def j6(spark, d):
    return Q.interior(events(spark, d), F.expr(OPENS)).select("span_id", "event_id")


@query("j7_span_overlap", f"WITH {EV}, {_SPANS}, s AS (SELECT a.span_id, strftime(x.ts, '%Y-%m-%d') AS d1, strftime(y.ts, '%Y-%m-%d') AS d2 FROM sp a JOIN ev x ON x.session_id = a.session_id AND x.line = a.lo JOIN ev y ON y.session_id = a.session_id AND y.line = a.hi) SELECT span_id FROM s WHERE d1 <= '2024-01-15' AND d2 >= '2024-01-12'")
def j7(spark, d):
    s = Q.first_after(events(spark, d).where(OPENS), C("session_date"), "b").select(C("event_id").alias("span_id"), C("session_date").alias("a"), "b")
    return s.where(P.spans_overlap(C("a"), C("b"), "2024-01-12", "2024-01-15")).select("span_id")


@query("j8_fork_consolidation", "WITH t AS (SELECT conv_id, turn, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS h FROM conversations), p AS (SELECT c.conv_id AS child, c.turn, min(p.conv_id) AS parent, count(DISTINCT p.conv_id) AS n FROM t c JOIN t p ON c.h = p.h AND p.conv_id < c.conv_id AND p.turn = c.turn GROUP BY ALL) SELECT child, turn, parent FROM p WHERE n = 1")
def j8(spark, d):
    """Turns that repeat, normalised, a turn of exactly one earlier conversation at the same place."""
    h = F.sha2(F.btrim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), 256)
    t = table(spark, d, "conversations").select("conv_id", "turn", h.alias("h"))
    # For each text and place: the two smallest conversations tell who has exactly one earlier one.
    first = t.groupBy("h", "turn").agg(F.min("conv_id").alias("parent"))
    later = t.join(first, ["h", "turn"]).where("conv_id > parent").select("h", "turn", C("conv_id").alias("child"), "parent").distinct()
    only = later.groupBy("h", "turn").agg(F.min("child").alias("child"), F.first("parent").alias("parent"))
    return only.select("child", "turn", "parent")


def forked(spark, d):
    """Conversations and forks of them: every third was forked half-way, with other white space and a turn of its own; every sixth was copied whole besides."""
    t = table(spark, d, "conversations").select(C("conv_id").alias("session_id"), (C("turn") + 1).alias("line"), "role", "text")
    half = F.greatest(F.lit(1), F.floor(C("n") / 2)).cast("long")
    n = t.groupBy("session_id").agg(F.max("line").alias("n")).withColumn("half", half)
    own = t.join(n, "session_id").where("session_id % 3 = 0 and line <= half + 1")
    child = own.select((C("session_id") + 10_000_000).alias("session_id"), "line", "role", F.when(C("line") <= C("half"), F.concat(F.lit(" "), F.regexp_replace("text", " ", "  "))).otherwise(F.lit("turn of its own")).alias("text"))
    copy = t.where("session_id % 6 = 0").select((C("session_id") + 20_000_000).alias("session_id"), "line", "role", "text")
    boundaries = n.where("session_id % 3 = 0").select((C("session_id") + 10_000_000).alias("child"), C("half").alias("boundary"))
    return t.unionByName(child).unionByName(copy), boundaries


_FORKS = r"""t AS (SELECT conv_id AS s, turn + 1 AS line, role, text FROM conversations), n AS (SELECT s, greatest(1, max(line) // 2) AS half FROM t GROUP BY 1),
a AS (SELECT * FROM t UNION ALL SELECT s + 10000000, line, role, CASE WHEN line <= half THEN ' ' || replace(text, ' ', '  ') ELSE 'turn of its own' END FROM t JOIN n USING (s) WHERE s % 3 = 0 AND line <= half + 1 UNION ALL SELECT s + 20000000, line, role, text FROM t WHERE s % 6 = 0),
c AS (SELECT s, line, string_agg(role || '>' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')), chr(10)) OVER (PARTITION BY s ORDER BY line) AS history FROM a),
b AS (SELECT s + 10000000 AS child, half AS boundary FROM n WHERE s % 3 = 0),
f AS (SELECT child, boundary, count(o.s) AS candidates, min(o.s) AS least FROM b JOIN c ON c.s = child AND c.line = boundary LEFT JOIN c o ON o.line = c.line AND o.history = c.history AND o.s <> child GROUP BY ALL)"""


def _fork_table(spark, d):
    turns, boundaries = forked(spark, d)
    # The role is evidence too.
    chained = H.chain(turns, "session_id", "line", F.concat_ws(">", "role", H.normalised(C("text"))))
    return turns, H.fork_parents(materialize(chained, "chains"), boundaries)


@query("j8_fork_history", f"WITH {_FORKS} SELECT child, boundary, candidates, CASE WHEN candidates = 1 THEN least END AS parent, CASE WHEN candidates = 1 THEN 'admitted' WHEN candidates > 1 THEN 'ambiguous' ELSE 'unmatched' END AS verdict FROM f")
def j8_history(spark, d):
    """Forks and their parents by the whole history before the fork; one of several like parents is not taken for the right one."""
    return _fork_table(spark, d)[1]


@query("t9_fork_groups", f"WITH {_FORKS}, g AS (SELECT coalesce(CASE WHEN candidates = 1 THEN least END, x.s) AS shown FROM (SELECT DISTINCT s FROM a) x LEFT JOIN f ON f.child = x.s) SELECT shown, count(*) AS members FROM g GROUP BY 1")
def t9_groups(spark, d):
    turns, forks = _fork_table(spark, d)
    return H.fork_groups(turns.select("session_id"), forks)


@query("j9_alias_lookup", "WITH n AS (SELECT DISTINCT p_partkey, trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM (SELECT p_partkey, p_name AS x FROM part UNION ALL SELECT p_partkey, p_type FROM part UNION ALL SELECT p_partkey, p_brand || '/' || p_partkey FROM part UNION ALL SELECT p_partkey, p_partkey::VARCHAR FROM part)), a AS (SELECT DISTINCT p_type AS anchor FROM part) SELECT anchor, p_partkey::VARCHAR AS entity_id FROM a JOIN n ON n.key = trim(regexp_replace(lower(anchor), '[^a-z0-9]+', '_', 'g'), '_')")
def j9(spark, d):
    anchors = table(spark, d, "part").select(C("p_type").alias("anchor")).distinct()
    return P.registry_lookup(anchors, registry(spark, d)).select("anchor", "entity_id")


@query("j15_reference_check", f"WITH {EV}, r AS (SELECT event_id, session_id, CASE WHEN event_id % 5 = 0 THEN line + 1000000 WHEN event_id % 7 = 0 THEN NULL ELSE line END AS ref FROM ev), n AS (SELECT session_id, max(line) AS lines FROM ev GROUP BY 1) SELECT event_id, CASE WHEN ref IS NULL THEN 'malformed' WHEN ref > lines THEN 'missing' ELSE 'resolved' END AS status FROM r JOIN n USING (session_id)")
def j15(spark, d):
    e = events(spark, d)
    text = F.concat(F.lit("raw:line:"), F.when(C("event_id") % 5 == 0, C("line") + 1000000).when(C("event_id") % 7 == 0, F.lit(-1)).otherwise(C("line")).cast("string"))
    refs = e.select("event_id", "session_id", S.raw_line(text).alias("ref"))
    known = e.groupBy("session_id").agg(F.max("line").alias("lines"))
    status = F.when(C("ref").isNull(), "malformed").when(C("lines").isNull() | (C("ref") > C("lines")), "missing").otherwise("resolved")
    return refs.join(known, "session_id", "left").select("event_id", status.alias("status"))


@query("j14_freshness_sets", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'stale' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'deferred' ELSE 'current' END AS status FROM customer")
def j14(spark, d):
    o = table(spark, d, "orders")
    mark = lambda s, name: o.where(C("o_orderstatus") == s).select(C("o_custkey").alias("c_custkey"), F.lit(True).alias(name)).distinct()
    j = table(spark, d, "customer").select("c_custkey").join(mark("P", "dirty"), "c_custkey", "left").join(mark("O", "waits"), "c_custkey", "left")
    return j.select("c_custkey", F.when(C("dirty"), "stale").when(C("waits"), "deferred").otherwise("current").alias("status"))


@query("j16_source_states", "WITH a AS (SELECT c_custkey AS source_key, c_mktsegment AS fp FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey AS source_key, CASE WHEN c_custkey % 7 = 0 THEN 'old' ELSE c_mktsegment END AS fp FROM customer WHERE c_custkey % 9 <> 0) SELECT coalesce(a.source_key, b.source_key) AS source_key, CASE WHEN b.source_key IS NULL THEN 'missing' WHEN a.source_key IS NULL THEN 'orphan' WHEN a.fp <> b.fp THEN 'stale' ELSE 'current' END AS state FROM a FULL JOIN b ON a.source_key = b.source_key")
def j16(spark, d):
    c = table(spark, d, "customer")
    now = c.where("c_custkey % 10 <> 0").select(C("c_custkey").alias("source_key"), C("c_mktsegment").alias("fp"))
    stored = c.where("c_custkey % 9 <> 0").select(C("c_custkey").alias("source_key"), F.when(C("c_custkey") % 7 == 0, "old").otherwise(C("c_mktsegment")).alias("stored_fp"))
    state = F.when(C("stored_fp").isNull(), "missing").when(C("fp").isNull(), "orphan").when(C("fp") != C("stored_fp"), "stale").otherwise("current")
    return now.join(stored, "source_key", "full_outer").select("source_key", state.alias("state"))


@query("j17_candidates", "WITH g AS (SELECT p_brand, p_type, count(*) AS members, min(p_partkey) AS candidate FROM part GROUP BY ALL) SELECT *, CASE WHEN count(*) OVER (PARTITION BY p_brand) > 1 THEN 'competing' ELSE 'resolved' END AS verdict FROM g")
def j17(spark, d):
    """Definitions sharing a digest collapse; different digests of one key stay competing."""
    g = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("members"), F.min("p_partkey").alias("candidate"))
    n = g.groupBy("p_brand").agg(F.count("*").alias("digests"))
    return g.join(n, "p_brand").withColumn("verdict", F.when(C("digests") > 1, "competing").otherwise("resolved")).drop("digests")


@query("j17_digests", """WITH g AS (SELECT p_brand || ':' || p_name AS key, sha256('=' || p_type || '|=' || p_size) AS digest, count(*) AS members, bool_or(p_retailprice < 1500) AS active FROM part GROUP BY 1, 2), n AS (SELECT key, count(*) FILTER (active) AS n FROM g GROUP BY 1)
SELECT key, digest, members, active, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'competing' ELSE 'dormant' END AS verdict FROM g JOIN n USING (key)""")
def j17_digests(spark, d):
    """Definitions of a brand's part name by the digest of type and size; cheap ones are active."""
    parts = table(spark, d, "part").withColumn("key", F.concat_ws(":", "p_brand", "p_name"))
    return V.canonical_candidates(parts, "key", "p_type", "p_size", active=C("p_retailprice") < 1500)


# Windows


@query("w1_latest_samples", f"WITH {EV} SELECT k, event_id, place FROM (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY session_date DESC, event_id DESC) AS place FROM ev) WHERE place <= 3")
def w1(spark, d):
    return Q.latest_samples(events(spark, d).select("k", "event_id", "session_date"), 3, "k").select("k", "event_id", "place")


@query("w2_event_window", f"WITH {EV} SELECT event_id, seen FROM (SELECT event_id, event_type, string_agg(raw_type, ',') OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN 3 PRECEDING AND 6 FOLLOWING) AS seen FROM ev) WHERE event_type = 'VERIFICATION'")
def w2(spark, d):
    w = Q.event_windows(events(spark, d), C("event_type") == "VERIFICATION", 3, 6, "raw_type")
    return w.select("event_id", F.array_join("window.raw_type", ",").alias("seen"))


@query("w3_usage_neighbourhood", f"WITH {EV} SELECT c.event_id AS centre, e.event_id, e.line - c.line AS line_offset, CASE WHEN e.line = c.line THEN 'selected_usage' WHEN e.correlation_id = c.correlation_id THEN 'same_correlation_id' WHEN e.line > c.line THEN 'consequence_candidate' ELSE 'context' END AS relation FROM ev c JOIN ev e ON c.session_id = e.session_id AND e.line BETWEEN c.line - 2 AND c.line + 3 WHERE c.event_type = 'TOOL_CALL'")
def w3(spark, d):
    w = Q.event_windows(events(spark, d), C("event_type") == "TOOL_CALL", 2, 3, "event_id", "correlation_id")
    x = w.select(C("event_id").alias("centre"), C("line").alias("at"), C("correlation_id").alias("own"), F.explode("window").alias("e"))
    off = C("e.line") - C("at")
    rel = F.when(off == 0, "selected_usage").when(C("e.correlation_id") == C("own"), "same_correlation_id").when(off > 0, "consequence_candidate").otherwise("context")
    return x.select("centre", C("e.event_id").alias("event_id"), off.alias("line_offset"), rel.alias("relation"))


@query("w4_consequences", f"WITH {EV} SELECT event_id, coalesce(nxt, '') AS nxt FROM (SELECT event_id, event_type, string_agg(raw_type, ',') OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS nxt FROM ev) WHERE event_type = 'TOOL_CALL'")
def w4(spark, d):
    return Q.following(events(spark, d), 4, "raw_type", "nxt").where(CALL).select("event_id", F.array_join("nxt", ",").alias("nxt"))


_SEG = "sg AS (SELECT *, CAST(sum(CASE WHEN event_type = 'USER_INTENT' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) AS BIGINT) AS segment FROM ev)"


@query("w5_segments", f"WITH {EV}, {_SEG} SELECT event_id, segment, CASE WHEN segment = 0 THEN 'initial' ELSE 'compaction' END || CASE WHEN segment = max(segment) OVER (PARTITION BY session_id) THEN '-to-latest' ELSE '-to-compaction' END AS role FROM sg")
def w5(spark, d):
    """signup stands in for the compaction marker, which the tables don't have."""
    return Q.segments(events(spark, d), C("event_type") == "USER_INTENT").select("event_id", "segment", "role")


_EP = """m AS (SELECT *, CASE event_type WHEN 'USER_INTENT' THEN 1 WHEN 'VERIFICATION' THEN 0 END AS m FROM ev),
p AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM m),
q AS (SELECT *, CAST(sum(CASE WHEN m = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) AS BIGINT) AS episode, coalesce(m = 1, false) OR was = 1 AS inside FROM p),
ep AS (SELECT session_id, episode, min(line) AS from_line, max(line) AS to_line, min(ts) AS start, max(ts) AS "end", count(*) AS events, arg_max(event_type, line) AS last_type, count(*) FILTER (outcome = 'failed') AS failures,
  max(line) FILTER (outcome = 'failed') AS lf, max(line) FILTER (outcome = 'observed') AS ls FROM q WHERE inside AND episode > 0 GROUP BY ALL),
es AS (SELECT session_id, episode, from_line, to_line, start, "end", events, failures, CASE WHEN last_type = 'VERIFICATION' THEN 'completed' ELSE 'open' END AS status, CASE WHEN last_type = 'VERIFICATION' THEN 'success_observed' ELSE 'unverified' END AS verification_state,
  CASE WHEN failures = 0 THEN 'none' WHEN coalesce(ls > lf, false) THEN 'recovered' ELSE 'unresolved' END AS failure_state FROM ep)"""


def episode_marks(spark, d):
    return Q.episodes(events(spark, d), C("event_type") == "USER_INTENT", C("event_type") == "VERIFICATION")


@query("w6_episodes", f"WITH {EV}, {_EP} SELECT * FROM es")
def w6(spark, d):
    """signup opens a task and purchase completes it, for want of task markers in the tables."""
    return Q.episode_rows(episode_marks(spark, d))


@query("p18_episode_filter", f"WITH {EV}, {_EP} SELECT session_id, episode FROM es WHERE status = 'completed' AND failure_state = 'unresolved'")
def p18(spark, d):
    return w6(spark, d).where((C("status") == "completed") & (C("failure_state") == "unresolved")).select("session_id", "episode")


@query("w7_lifecycles", "SELECT o_custkey, arg_max(o_orderstatus, epoch_us(o_orderdate) + o_orderkey) AS status, count(*) AS events, min(o_orderkey) FILTER (o_orderstatus = 'O') AS first_created, min(o_orderkey) FILTER (o_orderstatus = 'F') AS first_completed, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS kinds FROM orders GROUP BY 1")
def w7(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", C("o_orderdate").alias("ts"), C("o_orderkey").alias("event_id"))
    return Q.lifecycles(o, "o_custkey", "o_orderstatus", "O", "F")


@query("w8_latest_session", f"WITH {EV} SELECT session_id, max(ts) AS updated FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1")
def w8(spark, d):
    return events(spark, d).groupBy("session_id").agg(F.max("ts").alias("updated")).orderBy(F.desc("updated"), F.desc("session_id")).limit(1)


@query("w9_ordered_relation", f"WITH {EV}, {_PAIRS}, v AS (SELECT session_id, line FROM ev WHERE event_type = 'VERIFICATION'), n AS (SELECT call_id, result_id, min(v.line) AS verified FROM pr LEFT JOIN v ON v.session_id = pr.session_id AND v.line > pr.result_line GROUP BY ALL) SELECT call_id, result_id, CASE WHEN verified IS NULL THEN 'rejected' ELSE 'ordered' END AS relation FROM n")
def w9(spark, d):
    """Action before result before verification: a result's session must verify after it."""
    last = events(spark, d).where("event_type = 'VERIFICATION'").groupBy("session_id").agg(F.max("line").alias("verified"))
    j = pairs(spark, d).join(last, "session_id", "left")
    return j.select("call_id", "result_id", F.when(C("verified") > C("result_line"), "ordered").otherwise("rejected").alias("relation"))


@query("w10_recovery", f"WITH {EV} SELECT f.event_id, (SELECT arg_min(g.event_id, g.line) FROM ev g WHERE g.session_id = f.session_id AND g.k = f.k AND g.outcome = 'observed' AND g.line > f.line) AS recovered_by FROM ev f WHERE f.outcome = 'failed'")
def w10(spark, d):
    return Q.recovery(events(spark, d), C("outcome") == "failed", C("outcome") == "observed").select("event_id", "recovered_by")


@query("w11_supersession", "SELECT o_orderkey, superseded_by, superseded_by IS NULL AS valid FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS superseded_by FROM orders)")
def w11(spark, d):
    return Q.superseded(table(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderpriority", order="o_orderdate", part=F.date_trunc("month", "o_orderdate")).select("o_orderkey", "superseded_by", "valid")


@query("w12_phases", f"WITH {EV}, {_SEG} SELECT session_id, segment, min(line) AS from_line, max(line) AS to_line, count(*) AS events, count(DISTINCT event_type) AS kinds, arg_min(k, line) AS intent, array_to_string(list_filter([CASE WHEN count(*) FILTER (outcome = 'failed') > count(*) / 2 THEN 'failing' END, CASE WHEN count(*) FILTER (event_type = 'VERIFICATION') = 0 THEN 'unverified' END, CASE WHEN count(*) < 3 THEN 'short' END, CASE WHEN segment = 0 THEN 'no_intent' END], lambda x: x IS NOT NULL), ',') AS quality_flags FROM sg GROUP BY session_id, segment")
def w12(spark, d):
    """Phase candidates; the flags tell what speaks against each."""
    s = Q.segments(events(spark, d), C("event_type") == "USER_INTENT")
    flags = F.array(
        F.when(F.count_if(C("outcome") == "failed") > F.count("*") / 2, "failing"), F.when(F.count_if(C("event_type") == "VERIFICATION") == 0, "unverified"),
        F.when(F.count("*") < 3, "short"), F.when(C("segment") == 0, "no_intent"),
    )
    return s.groupBy("session_id", "segment").agg(F.min("line").alias("from_line"), F.max("line").alias("to_line"), F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"), F.min_by("k", "line").alias("intent"), F.array_join(flags, ",").alias("quality_flags"))


@query("w13_labels", f"WITH {EV}, s AS (SELECT session_id, min(ts) AS start, strftime(min(ts), '%Y-%m-%d') AS d FROM ev GROUP BY 1) SELECT session_id, d || '__' || printf('%03d', row_number() OVER (PARTITION BY d ORDER BY start, session_id)) || '__' || session_id AS label FROM s")
def w13(spark, d):
    return Q.sequence_labels(E.sessions(events(spark, d))).select("session_id", "label")


# Evidence


_LATER = f"c AS (SELECT session_id, k, min(line) AS first_start, count(*) AS starts FROM ev WHERE {CALL} GROUP BY ALL), j AS (SELECT ev.*, first_start, starts, coalesce(first_start < line, false) AS later FROM ev LEFT JOIN c ON c.session_id = ev.session_id AND c.k = ev.k)"
# The thirteen states, in their order; what counts as evidence for each is chosen here.
STATES = {
    "registered": "true", "mentioned": "event_type = 'USER_INTENT'", "prompt_visible": "line <= 5", "selected": f"{CALL} AND NOT later", "loaded": "event_type = 'TOOL_OUTPUT'",
    "read": "event_type = 'TOOL_OUTPUT' AND later", "procedure_observed": f"{CALL} AND later", "invoked": CALL, "completed": f"{RESULT} AND later",
    "verified": "event_type = 'VERIFICATION'", "consequence_producing": "event_type = 'VERIFICATION' AND later", "failed": "event_type = 'ERROR'", "deflected": "event_type = 'ERROR' AND NOT later",
}


@query("e1_usage_states", f"WITH {EV}, {_LATER} SELECT k, " + ", ".join(f"count(*) FILTER ({x}) AS {n}" for n, x in STATES.items()) + " FROM j GROUP BY k")
def e1(spark, d):
    """Evidence of each state apart; no state stands for another."""
    return Q.since_first(events(spark, d), F.expr(CALL), "session_id", "k").groupBy("k").agg(*[F.count_if(F.expr(x)).alias(n) for n, x in STATES.items()])


_CHAINS = f"ch AS (SELECT c.session_id, c.correlation_id, c.event_id AS call_id, c.line AS call_line, count(r.event_id) AS results, list(r.event_id ORDER BY r.line) FILTER (r.event_id IS NOT NULL) AS ids, list(r.line ORDER BY r.line) FILTER (r.event_id IS NOT NULL) AS lines FROM ev c LEFT JOIN ev r ON c.session_id = r.session_id AND c.correlation_id = r.correlation_id AND r.line > c.line AND r.{RESULT} WHERE c.{CALL} GROUP BY ALL)"


def chains(spark, d):
    return Q.usage_chains(events(spark, d), F.expr(CALL), F.expr(RESULT))


@query("e2_usage_chains", f"WITH {EV}, {_CHAINS} SELECT call_id, results, results > 0 AS answered, coalesce(array_to_string(ids[1:5], ','), '') AS members FROM ch")
def e2(spark, d):
    """Every call with all its results counted and the first five named."""
    return chains(spark, d).select("call_id", "results", (C("results") > 0).alias("answered"), F.coalesce(F.array_join(C("members.event_id").cast("array<string>"), ","), F.lit("")).alias("members"))


ACTIONS = ["invoked", "verified", "failed", "called", "observed"]


@query("e3_action_semantics", f"WITH {EV} SELECT event_id, CASE event_type WHEN 'TOOL_CALL' THEN 'invoked' WHEN 'VERIFICATION' THEN 'verified' WHEN 'ERROR' THEN 'failed' WHEN 'TOOL_OUTPUT' THEN 'observed' ELSE 'mentioned' END AS primary_action FROM ev")
def e3(spark, d):
    e = events(spark, d)
    rules = {"invoked": C("event_type") == "TOOL_CALL", "called": C("event_type") == "TOOL_CALL", "verified": C("outcome") == "verified", "failed": C("outcome") == "failed", "observed": C("outcome").isin("observed", "failed"), "mentioned": C("k").isNotNull()}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return e.select("event_id", F.array_min(F.transform(found, lambda a: F.struct(S.priority(a, ACTIONS).alias("p"), a.alias("a"))))["a"].alias("primary_action"))


@query("e4_causal_admission", f"WITH {EV}, {_CHAINS}, one AS (SELECT session_id, correlation_id, CAST(sum(results) AS BIGINT) AS chains, arg_max(call_line, results) AS call_line, arg_max(lines[1], results) AS result_line FROM ch WHERE correlation_id <> '' GROUP BY ALL) SELECT session_id, correlation_id, CASE WHEN chains = 1 THEN 'admitted' ELSE 'unresolved' END AS verdict, CASE WHEN chains = 1 THEN 'raw:line:' || call_line END AS call_ref, CASE WHEN chains = 1 THEN 'raw:line:' || result_line END AS result_ref FROM one")
def e4(spark, d):
    """One ordered chain and no other under a correlation id is admitted, with the raw lines of both its ends."""
    one = chains(spark, d).where("correlation_id <> ''").groupBy("session_id", "correlation_id").agg(
        F.sum("results").alias("chains"), F.max_by("call_line", "results").alias("call_line"), F.max_by(C("members")[0]["line"], "results").alias("result_line")
    )
    ref = lambda line: F.when(C("chains") == 1, F.concat(F.lit("raw:line:"), C(line).cast("string")))
    return one.select("session_id", "correlation_id", F.when(C("chains") == 1, "admitted").otherwise("unresolved").alias("verdict"), ref("call_line").alias("call_ref"), ref("result_line").alias("result_ref"))


@query("e5_quantitative_admission", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) >= 2 AS admitted FROM documents")
def e5(spark, d):
    """Texts with at least two numbers, the rows a counting claim needs."""
    return table(spark, d, "documents").select("doc_id", (F.size(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)) >= 2).alias("admitted"))


@query("e6_interval_admission", f"WITH {EV}, {_SPANS} SELECT span_id, count(*) AS interior, bool_and(k <> '') AS all_readable FROM ev JOIN sp USING (session_id) WHERE line > lo AND line < hi GROUP BY span_id HAVING count(*) FILTER (event_type <> 'ERROR') >= 1")
def e6(spark, d):
    g = Q.interior(events(spark, d), F.expr(OPENS)).groupBy("span_id").agg(F.count("*").alias("interior"), F.bool_and(C("k") != "").alias("all_readable"), F.count_if(C("event_type") != "ERROR").alias("kept"))
    return g.where("kept >= 1").drop("kept")


@query("e7_identity_admission", "WITH n AS (SELECT p_name AS anchor, count(*) AS n, min(p_size) AS size FROM part GROUP BY 1) SELECT anchor, CASE WHEN n > 1 THEN 'ambiguous' WHEN size < 5 THEN 'incompatible' ELSE 'resolved' END AS verdict FROM n")
def e7(spark, d):
    n = registry(spark, d).groupBy(C("canonical_key").alias("anchor")).agg(F.count("*").alias("n"), F.min("size").alias("size"))
    return n.select("anchor", F.when(C("n") > 1, "ambiguous").when(C("size") < 5, "incompatible").when(C("n") == 1, "resolved").otherwise("unproven").alias("verdict"))


@query("e8_initial_context", "SELECT conv_id, count(*) FILTER (contains(text, ' the ')) > 0 AS visible FROM conversations WHERE turn < 2 GROUP BY conv_id")
def e8(spark, d):
    """A probe of the first two turns only: visible there is context, not use."""
    return table(spark, d, "conversations").where("turn < 2").groupBy("conv_id").agg((F.count_if(F.contains("text", F.lit(" the "))) > 0).alias("visible"))


@query("e9_generation_compatibility", "SELECT p_partkey, CASE WHEN p_brand <> 'Brand#1' AND p_size < 10 THEN 'incompatible' WHEN p_size < 25 THEN 'stale_readable' ELSE 'current' END AS state FROM part")
def e9(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.struct((C("p_brand") == "Brand#1").alias("schema_ok"), (C("p_size") >= 10).alias("digest_ok"), (C("p_size") >= 25).alias("source_ok")).alias("g"))
    return p.select("p_partkey", F.when(~C("g.schema_ok") & ~C("g.digest_ok"), "incompatible").when(~C("g.source_ok"), "stale_readable").otherwise("current").alias("state"))


@query("e10_target_freshness", f"WITH {EV}, s AS (SELECT session_id, max(ts) AS last, count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-30') AS indexed FROM ev GROUP BY 1), g AS (SELECT max(last) AS newest, count(*) FILTER (indexed < n) AS dirty FROM s) SELECT session_id, CASE WHEN indexed = 0 THEN 'unknown' WHEN last > newest - INTERVAL 1 HOUR THEN 'deferred_live' WHEN indexed < n THEN 'stale' WHEN dirty > 0 THEN 'global_stale' ELSE 'current' END AS freshness FROM s, g")
def e10(spark, d):
    """What is indexed up to the last day against what there is: a target's own state first, then that of the others."""
    e = events(spark, d)
    s = e.groupBy("session_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.count_if(C("ts") < F.lit("2024-01-30").cast("timestamp_ntz")).alias("indexed"))
    s = s.withColumns({"newest": e.agg(F.max("ts")).scalar(), "dirty": s.agg(F.count_if(C("indexed") < C("n"))).scalar()})
    ladder = F.when(C("indexed") == 0, "unknown").when(F.expr("last > newest - interval 1 hour"), "deferred_live").when(C("indexed") < C("n"), "stale").when(C("dirty") > 0, "global_stale").otherwise("current")
    return s.select("session_id", ladder.alias("freshness"))


@query("e11_completeness", f"WITH {EV} SELECT family, bool_and(session_date >= '2024-01-01') AND NOT bool_or(outcome = 'failed') AS complete FROM ev GROUP BY 1")
def e11(spark, d):
    return events(spark, d).groupBy("family").agg((F.bool_and(C("session_date") >= "2024-01-01") & ~F.bool_or(C("outcome") == "failed")).alias("complete"))


@query("e12_reviewed_receipts", "SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN l.toxic = 1 THEN 'drifted' ELSE 'eligible' END AS promotion FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def e12(spark, d):
    l = table(spark, d, "labels").withColumn("seen", F.lit(True))
    j = table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left")
    return j.select("doc_id", "quality", F.when(C("seen").isNull(), "unreviewed").when(C("toxic") == 1, "drifted").otherwise("eligible").alias("promotion"))


@query("e13_task_answers", f"WITH {EV}, {_EP} SELECT i.event_id AS intent_id, a.event_id AS answer_id FROM es JOIN ev i ON i.session_id = es.session_id AND i.line = es.from_line JOIN q a ON a.session_id = es.session_id AND a.episode = es.episode AND a.inside AND a.event_type = 'VERIFICATION'")
def e13(spark, d):
    m = episode_marks(spark, d).where("in_episode")
    start = m.groupBy("session_id", "episode").agg(F.min_by("event_id", "line").alias("intent_id"))
    answers = m.where("event_type = 'VERIFICATION'").select("session_id", "episode", C("event_id").alias("answer_id"))
    return start.join(answers, ["session_id", "episode"]).select("intent_id", "answer_id")


@query("a17_evidence_states", f"WITH {EV}, s AS (SELECT k, session_id, min(CASE event_type WHEN 'VERIFICATION' THEN 1 WHEN 'TOOL_OUTPUT' THEN 2 WHEN 'TOOL_CALL' THEN 3 ELSE 4 END) AS state, count(*) AS associations FROM ev GROUP BY ALL), rj AS (SELECT c.session_id, c.k, count(*) AS n FROM ev c JOIN ev r ON c.session_id = r.session_id AND r.line BETWEEN c.line + 1 AND c.line + 4 AND r.correlation_id <> c.correlation_id WHERE c.{CALL} AND r.{RESULT} GROUP BY ALL) SELECT state, count(*) AS units, CAST(sum(associations) AS BIGINT) AS associations, CAST(sum(associations) - count(*) AS BIGINT) AS duplicates, CAST(coalesce(sum(rj.n), 0) AS BIGINT) AS rejection_edges FROM s LEFT JOIN rj ON rj.session_id = s.session_id AND rj.k = s.k GROUP BY state")
def a17(spark, d):
    """Results near a unit's calls that belong to other calls are its rejection edges."""
    e = events(spark, d)
    rank = S.priority(C("event_type"), ["VERIFICATION", "TOOL_OUTPUT", "TOOL_CALL"])
    s = e.groupBy("k", "session_id").agg(F.min(rank).alias("state"), F.count("*").alias("a"))
    rejected = Q.nearby_foreign(e, F.expr(CALL), F.expr(RESULT), 4).groupBy("session_id", C("correlation_id").alias("k")).agg(F.count("*").alias("n"))
    j = s.join(rejected, ["session_id", "k"], "left")
    return j.groupBy("state").agg(F.count("*").alias("units"), F.sum("a").alias("associations"), (F.sum("a") - F.count("*")).alias("duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("rejection_edges"))


ROLES = {
    "entrypoint": "event_type = 'USER_INTENT' AND NOT later", "usage": CALL, "result": f"{RESULT} AND later", "outcome": "event_type = 'VERIFICATION'",
    "context": "event_type = 'USER_INTENT' AND later", "consequence": "event_type = 'VERIFICATION' AND later", "false_correlation": f"{RESULT} AND NOT later",
}


@query("a18_usage_roles", f"WITH {EV}, {_LATER} SELECT k, " + ", ".join(f"count(*) FILTER ({x}) AS {n}" for n, x in ROLES.items()) + f", CAST(coalesce(sum(starts) FILTER ({ROLES['false_correlation']}), 0) AS BIGINT) AS false_correlation_edges, count(DISTINCT session_id) AS sessions FROM j GROUP BY k")
def a18(spark, d):
    """A result before any call of its key is a false correlation: one event, and an edge to each of the calls."""
    j = Q.since_first(events(spark, d), F.expr(CALL), "session_id", "k")
    edges = F.coalesce(F.sum(F.when(F.expr(ROLES["false_correlation"]), C("starts"))), F.lit(0))
    return j.groupBy("k").agg(*[F.count_if(F.expr(x)).alias(n) for n, x in ROLES.items()], edges.alias("false_correlation_edges"), F.count_distinct("session_id").alias("sessions"))


@query("e5_ranked_numbers", f"WITH {EV}, c AS (SELECT session_id, correlation_id, count(*) AS calls, min(line) AS call_line FROM ev WHERE {CALL} GROUP BY ALL), r AS (SELECT session_id, correlation_id, calls, value, lag(value) OVER (PARTITION BY session_id, correlation_id ORDER BY line) AS prev FROM ev JOIN c USING (session_id, correlation_id) WHERE event_type = 'TOOL_OUTPUT' AND line > call_line) SELECT session_id, correlation_id, count(*) AS numbers, max(calls) = 1 AND count(*) >= 2 AND count(*) FILTER (value > prev) = 0 AS admitted FROM r GROUP BY ALL")
def e5_ranked(spark, d):
    return Q.ranked_number_chains(events(spark, d), F.expr(CALL), C("event_type") == "TOOL_OUTPUT", "value").select("session_id", "correlation_id", "numbers", "admitted")
