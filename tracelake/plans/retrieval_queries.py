"""Retrieval (T), typing and review (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import history as H
from ..operators import retrieval as T
from ..operators import review as V
from ..operators import search as P
from ..sources.storage import materialize
from .base import EV, PO, events, facts, kept_lexical, lexical_index, query, table

C = F.col


def asked(spark, d):
    """Queries: the benchmark texts, whole."""
    return table(spark, d, "benchmark").select(C("item_id").alias("query_id"), C("text").alias("query"))


_Q = "qs AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM benchmark), qt AS (SELECT DISTINCT query_id, unnest(ts) AS term FROM qs)"
_D = "dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL), ln AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len FROM documents)"
_BM = f"""{_Q}, {_D}, st AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM ln), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN ln USING (doc_id), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10)"""
_EX2 = f"{_BM}, nd AS (SELECT query_id, count(*) AS need FROM qt GROUP BY 1), hv AS (SELECT query_id, doc_id, count(*) AS have FROM tf JOIN qt USING (term) GROUP BY ALL), ex AS (SELECT query_id, doc_id FROM hv JOIN nd USING (query_id) WHERE have = need)"


@query("t1_exact_hits", f"WITH {_EX2} SELECT query_id, doc_id FROM ex")
def t1(spark, d):
    return T.exact_hits(table(spark, d, "documents"), asked(spark, d), put=kept_lexical(spark, d))


@query("t2_bm25", f"WITH {_BM} SELECT query_id, doc_id, round(score, 3) AS score FROM bm")
def t2(spark, d):
    return T.bm25(lexical_index(spark, d), asked(spark, d)).select("query_id", "doc_id", F.round("score", 3).alias("score"))


@query("t3_exact_first", f"WITH {_EX2} SELECT query_id, doc_id, 'exact' AS lane FROM ex UNION ALL SELECT query_id, doc_id, 'lexical' FROM bm WHERE query_id NOT IN (SELECT query_id FROM ex)")
def t3(spark, d):
    exact = materialize(t1(spark, d), "exact")
    lexical = T.bm25(lexical_index(spark, d), asked(spark, d)).join(exact.select("query_id").distinct(), "query_id", "left_anti")
    return exact.withColumn("lane", F.lit("exact")).unionByName(lexical.select("query_id", "doc_id", F.lit("lexical").alias("lane")))


@query("t4_dense_search", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= 5""")
def t4(spark, d):
    """Queries are the vectors whose id 50 divides, against all others."""
    best = T.dense_top(table(spark, d, "embeddings"), C("vec_id") % 50 == 0, 5)
    return T.top(best, 5, "query_id", F.desc("score"), C("vec_id")).select("query_id", "vec_id", "rank")


@query("t5_fusion", f"""WITH {_EX2}, xr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM ex), l AS (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM xr WHERE rank <= 10),
two AS (SELECT query_id, arg_min(doc_id, rank) AS doc_id, max(score) FILTER (rank = 1) AS lead, max(score) FILTER (rank = 2) AS next FROM bm WHERE rank <= 2 GROUP BY 1), sure AS (SELECT query_id, doc_id FROM two JOIN ex USING (query_id, doc_id) WHERE next IS NULL OR lead >= 1.25::DOUBLE * next)
SELECT l.query_id, l.doc_id, round(round(sum(1 / (60 + rank)), 8) + CASE WHEN bool_or(sure.doc_id IS NOT NULL) THEN 1 / 61::DOUBLE ELSE 0 END, 8) AS fused, count(*) AS lanes, bool_or(sure.doc_id IS NOT NULL) AS bonus FROM l LEFT JOIN sure ON sure.query_id = l.query_id AND sure.doc_id = l.doc_id GROUP BY ALL""")
def t5(spark, d):
    """Both lanes fused; documents that hold every term of the query are its anchors."""
    lexical, hits = materialize(T.bm25(lexical_index(spark, d), asked(spark, d)), "best"), materialize(t1(spark, d), "exact")
    exact = T.top(hits, 10, "query_id", C("doc_id"))
    return T.anchored(T.fuse({"lexical": lexical, "exact": exact}, "doc_id"), lexical, hits, "doc_id")


_ASKED = "CASE event_type WHEN 'signup' THEN 'k:' || {k} WHEN 'click' THEN 'git show ' || {k} WHEN 'view' THEN '/log/' || {k} WHEN 'error' THEN 'Request failed with ' || {k} WHEN 'purchase' THEN 'Purchase' || {k} ELSE event_type END"
_SHAPE = r"CASE WHEN regexp_matches(query, '^[a-z_]+:[^ ]+$') THEN 'entity' WHEN regexp_matches(query, '^(git|python|pip|make|npm|cargo) ') THEN 'command' WHEN regexp_matches(query, '^/?([A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]*$') THEN 'path' WHEN regexp_matches(query, '(?i)(error|exception|failed)') THEN 'error' WHEN regexp_matches(query, '^[A-Z][A-Za-z0-9]*$') THEN 'class' ELSE 'phrase' END"
_K = "regexp_extract(props, '\"k\": ?([0-9]+)', 1)"


@query("t6_query_shapes", f"WITH q AS (SELECT 'e' || event_id AS query_id, {_ASKED.format(k=_K)} AS query FROM events UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT 'p' || page_id, url FROM pages) SELECT query_id, {_SHAPE} AS shape FROM q WHERE query <> ''")
def t6(spark, d):
    """Queries of every shape: phrased from events, the benchmark texts and the urls."""
    phrased = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).select(F.concat(F.lit("e"), C("event_id").cast("string")).alias("query_id"), F.expr(_ASKED.format(k="k")).alias("query"))
    texts = table(spark, d, "benchmark").select(F.concat(F.lit("b"), C("item_id").cast("string")).alias("query_id"), C("text").alias("query"))
    urls = table(spark, d, "pages").select(F.concat(F.lit("p"), C("page_id").cast("string")).alias("query_id"), C("url").alias("query"))
    return phrased.unionByName(texts).unionByName(urls).where("query <> ''").select("query_id", T.query_shape(C("query")).alias("shape"))


@query("t7_repeated_errors", f"WITH {EV} SELECT k, count(*) AS failures, count(DISTINCT session_id) AS sessions FROM ev WHERE outcome = 'failed' GROUP BY k HAVING count(DISTINCT session_id) >= 2")
def t7(spark, d):
    return facts(spark, d).where("outcome = 'failed'").groupBy("k").agg(F.count("*").alias("failures"), F.count_distinct("session_id").alias("sessions")).where("sessions >= 2")


_RECIPES = f"""{EV}, sf AS (SELECT session_id, count(*) FILTER (outcome = 'failed') AS session_failures, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS fin FROM ev GROUP BY 1), kf AS (SELECT k, count(DISTINCT session_id) AS failing_sessions FROM ev WHERE outcome = 'failed' GROUP BY 1),
ea AS (SELECT * FROM ev JOIN sf USING (session_id) LEFT JOIN kf USING (k)), rh AS ({" UNION ALL ".join(f"SELECT '{n}' AS recipe, session_id, event_id, ts, fin FROM ea WHERE {c}" for n, c in T.RECIPES.items())}),
rp AS (SELECT recipe, session_id, event_id, CAST(row_number() OVER (PARTITION BY recipe, session_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place, CASE WHEN fin = 'VERIFICATION' THEN 'closed' ELSE 'open' END AS continuation FROM rh)"""


@query("t7_recipes", f"WITH {_RECIPES} SELECT * FROM rp WHERE place <= 8")
def t7_recipes(spark, d):
    """Packets of all seven recipes: eight hits a session, and whether it goes on."""
    return T.recipe_hits(facts(spark, d), 8)


@query("t8_route_trace", f"WITH {PO} SELECT route_signal, event_id FROM (SELECT route_signal, event_id, row_number() OVER (PARTITION BY route_signal ORDER BY event_id DESC) AS r FROM po WHERE key IN ('7', '8') AND layer IN ('k', 'error')) WHERE r <= 5")
def t8(spark, d):
    anchors = spark.createDataFrame([("k:7",), ("k:8",), ("error:7",), ("error:8",)], "route_signal string")
    return P.ranked(E.postings(facts(spark, d)).join(F.broadcast(anchors), "route_signal").select("route_signal", "event_id"), 5, F.desc("event_id"), by=["route_signal"])


@query("t9_consolidated", "SELECT sha256(text) AS group_id, min(doc_id) AS shown, count(*) AS members FROM documents GROUP BY 1")
def t9(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("group_id")).agg(F.min("doc_id").alias("shown"), F.count("*").alias("members"))


@query("t10_echo_suppression", f"WITH {EV}, s AS (SELECT DISTINCT session_id, correlation_id FROM ev WHERE event_type = 'TOOL_CALL' AND value > 40) SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.session_id = ev.session_id AND s.correlation_id = ev.correlation_id)")
def t10(spark, d):
    """Dear calls stand in for the search calls: what carries their correlation id is an echo."""
    e = facts(spark, d)
    s = e.where("event_type = 'TOOL_CALL' and value > 40").select("session_id", "correlation_id").distinct()
    return e.join(s, ["session_id", "correlation_id"], "left_anti").select("event_id")


@query("t11_absence_proof", "SELECT source, count(*) AS scanned, NOT bool_or(contains(text, 'needle-never-there')) AND count(*) = count(DISTINCT doc_id) AS absent FROM documents GROUP BY source")
def t11(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy("source").agg(F.count("*").alias("scanned"), (~F.bool_or(F.contains("text", F.lit("needle-never-there"))) & (F.count("*") == F.count_distinct("doc_id"))).alias("absent"))


def numbered_documents(spark, d):
    """Documents as lines of one file a source, in the order of their ids."""
    t = table(spark, d, "documents").select(C("source").alias("file"), "doc_id", "text", F.floor(C("doc_id") / 10_000).alias("part"))
    return E.numbered(t, "file", "part", "doc_id").select("file", "doc_id", "line", C("text").alias("raw"))


@query("t11_scan_proof", """WITH l AS (SELECT source AS file, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line, text FROM documents),
s AS (SELECT file, CASE WHEN file = 'src1' AND line > 1 THEN line - 1 ELSE line END AS line, CASE WHEN file = 'src2' AND line = 2 THEN text || '.' ELSE text END AS text FROM l WHERE NOT (file = 'src1' AND line = 1)),
m AS (SELECT file, count(*) AS lines, string_agg(md5(text), '' ORDER BY line) AS whole FROM l GROUP BY 1),
g AS (SELECT file, count(*) AS scanned, string_agg(md5(text), '' ORDER BY line) AS whole, bool_or(contains(text, 'password')) AS hit FROM s GROUP BY 1)
SELECT file, coalesce(scanned, 0) AS scanned, coalesce(scanned = lines AND g.whole = m.whole, false) AS complete, coalesce(scanned = lines AND g.whole = m.whole AND NOT hit, false) AS absent FROM m LEFT JOIN g USING (file)""")
def t11_proof(spark, d):
    """What is absent from the files as a manifest knows them: one was scanned without its first line, one with a changed line."""
    whole = materialize(numbered_documents(spark, d), "lines")
    manifest = H.file_digests(whole)
    lost = whole.where("not (file = 'src1' and line = 1)").withColumn("line", F.when(C("file") == "src1", C("line") - 1).otherwise(C("line")))
    scanned = lost.withColumn("raw", F.when((C("file") == "src2") & (C("line") == 2), F.concat("raw", F.lit("."))).otherwise(C("raw")))
    return H.absence(scanned, manifest, F.contains("raw", F.lit("password")))


@query("t12_rehydrate", f"WITH {EV}, l AS (SELECT session_id FROM ev GROUP BY 1 ORDER BY max(ts) DESC, 1 DESC LIMIT 1) SELECT event_id, line FROM ev WHERE session_id IN (SELECT session_id FROM l) ORDER BY line DESC LIMIT 20")
def t12(spark, d):
    e = events(spark, d)
    latest = e.groupBy("session_id").agg(F.max("ts").alias("u")).orderBy(F.desc("u"), F.desc("session_id")).limit(1).select("session_id")
    return P.ranked(e.join(F.broadcast(latest), "session_id").select("event_id", "line"), 20, F.desc("line"))


@query("t13_evidence_packet", f"""WITH {_RECIPES}, ix AS (SELECT session_id, count(*) AS known FROM ev WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1),
a AS (SELECT event_id, 'trace' AS lane FROM ev WHERE k = '7' UNION ALL SELECT event_id, 'search' FROM ev WHERE outcome = 'failed' AND k = '7' UNION ALL SELECT event_id, 'retrieve' FROM rp JOIN ev USING (event_id) WHERE place <= 8 AND k = '7' AND recipe = 'repeated-errors')
SELECT event_id, string_agg(lane, ',' ORDER BY lane) AS lanes, CASE WHEN any_value(line) <= any_value(coalesce(known, 0)) THEN 'resolved' ELSE 'missing' END AS ref_status FROM a JOIN ev USING (event_id) LEFT JOIN ix USING (session_id) GROUP BY 1""")
def t13(spark, d):
    """One key's trace, search and retrieval, each line checked against what was captured up to the last day."""
    e = events(spark, d)
    lane = lambda rows, name: rows.select("event_id", F.lit(name).alias("lane"))
    own = e.where("k = '7'")
    lanes = lane(E.postings(e).where("route_signal = 'k:7'"), "trace").unionByName(lane(P.search(own, outcome="failed"), "search"))
    lanes = lanes.unionByName(lane(T.recipe_hits(facts(spark, d), 8).where("recipe = 'repeated-errors'").join(own.select("event_id"), "event_id", "left_semi"), "retrieve"))
    packet = lanes.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list("lane")), ",").alias("lanes"))
    known = e.where(C("ts") < F.lit("2024-01-30").cast("timestamp_ntz")).groupBy("session_id").agg(F.count("*").alias("known"))
    status = F.when(C("line") <= F.coalesce("known", F.lit(0)), "resolved").otherwise("missing")
    return packet.join(own.select("event_id", "session_id", "line"), "event_id").join(known, "session_id", "left").select("event_id", "lanes", status.alias("ref_status"))


@query("t14_retrieval_evaluation", f"WITH {_EX2}, g AS (SELECT query_id, ex.doc_id FROM ex JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = ex.query_id WHERE contains(d.text, b.text)), n AS (SELECT query_id, count(*) AS gold FROM g GROUP BY 1) SELECT bm.query_id, count(*) AS hits, coalesce(min(n.gold), 0) AS gold, count(g.doc_id) AS gold_hits FROM bm LEFT JOIN g ON g.query_id = bm.query_id AND g.doc_id = bm.doc_id LEFT JOIN n ON n.query_id = bm.query_id GROUP BY 1")
def t14(spark, d):
    """Gold is what holds the passage itself, whatever its rank."""
    docs, passages = table(spark, d, "documents"), table(spark, d, "benchmark").select(C("item_id").alias("query_id"), C("text").alias("passage"))
    hits = T.bm25(lexical_index(spark, d), asked(spark, d)).select("query_id", "doc_id")
    able = t1(spark, d).join(docs.select("doc_id", "text"), "doc_id").join(passages, "query_id")
    gold = able.where(F.contains("text", C("passage"))).select("query_id", "doc_id", F.lit(1).alias("g"))
    known = gold.groupBy("query_id").agg(F.count("*").alias("gold"))
    met = hits.join(gold, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("hits"), F.count("g").alias("gold_hits"))
    return met.join(known, "query_id", "left").select("query_id", "hits", F.coalesce("gold", F.lit(0)).alias("gold"), "gold_hits")


@query("t15_expectations", "SELECT doc_id, CASE WHEN contains(text, '!!') THEN 0 ELSE 1 END AS actual, quality AS expected, (CASE WHEN contains(text, '!!') THEN 0 ELSE 1 END) = quality AS met FROM documents JOIN labels USING (doc_id)")
def t15(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    actual = F.when(F.contains("text", F.lit("!!")), 0).otherwise(1)
    return j.select("doc_id", actual.alias("actual"), C("quality").alias("expected"), (actual == C("quality")).alias("met"))


# Typing and review

RULES = [("assistant_verification_report", r"(?i)(^| )(that|que)( |$)"), ("assistant_decision", r"(?i)(^| )(the|la|der)( |$)"), ("assistant_plan", r"\?$")]


@query("c2_agent_events", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(^| )(that|que)( |$)') THEN 'assistant_verification_report' WHEN regexp_matches(text, '(?i)(^| )(the|la|der)( |$)') THEN 'assistant_decision' WHEN regexp_matches(text, '\?$') THEN 'assistant_plan' ELSE 'assistant_answer' END AS agent_event FROM conversations WHERE role = 'assistant'")
def c2(spark, d):
    t = table(spark, d, "conversations").where("role = 'assistant'")
    return t.select("conv_id", "turn", V.classify_text(C("text"), RULES, "assistant_answer").alias("agent_event"))


_RT = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, vs in V.ROUTES.items() for v in vs) + ") AS rt(event_type, route)"


@query("c4_distillation_routes", f"WITH {EV} SELECT event_id, route FROM ev JOIN {_RT} USING (event_type)")
def c4(spark, d):
    return V.distillation_routes(facts(spark, d)).select("event_id", "route")


@query("c5_lanes", f"WITH {EV}, s AS (SELECT session_id, count(*) AS n, count(*) FILTER (event_type = 'ERROR') AS e FROM ev GROUP BY 1) SELECT session_id, 'auto_first_pass' || CASE WHEN e >= 10 THEN ',manual_review' ELSE '' END || CASE WHEN e > 0 THEN ',mechanics_candidate' ELSE '' END || CASE WHEN n > 80 THEN ',diagnostic' ELSE '' END AS lanes FROM s")
def c5(spark, d):
    s = facts(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(C("event_type") == "ERROR").alias("e"))
    lanes = F.array_compact(F.array(F.lit("auto_first_pass"), F.when(C("e") >= 10, "manual_review"), F.when(C("e") > 0, "mechanics_candidate"), F.when(C("n") > 80, "diagnostic")))
    return s.select("session_id", F.array_join(lanes, ",").alias("lanes"))


@query("c6_first_pass", f"WITH {EV} SELECT session_id, event_type, event_id FROM (SELECT session_id, event_type, event_id, row_number() OVER (PARTITION BY session_id, event_type ORDER BY value DESC, event_id) AS r FROM ev) WHERE r <= 2")
def c6(spark, d):
    return P.ranked(facts(spark, d).select("session_id", "event_type", "event_id", "value"), 2, F.desc("value"), C("event_id"), by=["session_id", "event_type"]).drop("value")


def _pat(name):
    return V.SENSITIVE[name][0].replace("'", "''")


_RED, _COUNTS = "text", []
for _n in V.SENSITIVE:
    _COUNTS.append(f"len(regexp_extract_all({_RED}, '{_pat(_n)}')) AS {_n}")
    _RED = f"regexp_replace({_RED}, '{_pat(_n)}', '<{_n}>', 'g')"


@query("c7_redaction", f"SELECT doc_id, sha256({_RED}) AS digest, {', '.join(_COUNTS)}, {V.POLICY_VERSION} AS policy_version FROM documents")
def c7(spark, d):
    """What was replaced is kept as a count by class and the version of the rules only."""
    text, hits = V.redact(C("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("digest"), *[n.cast("long").alias(name) for name, n in hits.items()], F.lit(V.POLICY_VERSION).alias("policy_version"))


# Where the rules look around, the SQL takes the candidates and tests what surrounds them.
_HOME = r"/(?:home|Users)/[A-Za-z0-9._-]+"
_CANDIDATES = {
    "personal_home_path": f"list_filter(regexp_extract_all(text, '{_HOME}'), lambda v: NOT regexp_matches(v, '^/(home|Users)/(example|test|user|runner|workspace)([^A-Za-z0-9_]|$)'))",
    "private_network_address": r"regexp_extract_all(regexp_replace(text, '([^0-9.])', '\1\1', 'g'), '(?:^|[^0-9])(10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})(?:[^0-9]|$)', 1)",
}


def _candidates(name, pattern):
    return _CANDIDATES.get(name) or f"regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')"


_FIND = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS class, '{s}' AS severity, 'sha256:' || left(sha256('{n}' || chr(0) || v), 16) AS fingerprint FROM (SELECT doc_id, unnest({_candidates(n, p)}) AS v FROM documents)" for n, (p, s) in V.content_rules().items())


@query("c8_sensitive_findings", _FIND)
def c8(spark, d):
    return V.findings(table(spark, d, "documents"), "doc_id", "text")


@query("c9_findings_rollup", f"SELECT class, severity, count(*) AS findings, count(DISTINCT fingerprint) AS distinct_findings FROM ({_FIND}) GROUP BY ALL")
def c9(spark, d):
    return c8(spark, d).groupBy("class", "severity").agg(F.count("*").alias("findings"), F.count_distinct("fingerprint").alias("distinct_findings"))


@query("c10_readiness", f"""WITH {EV}, s AS (SELECT session_id, count(*) AS n, count(*) FILTER (event_type = 'USER_INTENT') AS i, count(*) FILTER (outcome = 'failed') AS f, count(*) FILTER (ts < TIMESTAMP '2024-01-30') AS x, count(*) FILTER (event_type = 'VERIFICATION') AS v FROM ev GROUP BY 1)
SELECT session_id, CASE WHEN n = 0 THEN 'blocked' WHEN v > n / 4 THEN 'named' WHEN n - x > 5 THEN 'needs_reindex' WHEN f * 2 > n THEN 'diagnostic_only' WHEN n < 20 OR i = 0 THEN 'low_signal' WHEN i > 15 THEN 'phase_discovery_ready' WHEN n >= 100 THEN 'needs_phase_discovery' WHEN f * 4 <= n THEN 'ready_for_semantic_name' ELSE 'readable_label' END AS readiness FROM s""")
def c10(spark, d):
    """Views are taken as indexed up to the last day; many verifications stand in for a reviewed name."""
    s = facts(spark, d).groupBy("session_id").agg(
        F.count("*").alias("event_count"), F.count_if(C("event_type") == "USER_INTENT").alias("intent_count"), F.count_if(C("outcome") == "failed").alias("failure_count"),
        F.count_if(C("ts") < F.lit("2024-01-30").cast("timestamp_ntz")).alias("indexed_count"), (F.count_if(C("event_type") == "VERIFICATION") > F.count("*") / 4).alias("reviewed"),
    )
    return V.readiness(s, lag=5).select("session_id", "readiness")


@query("c11_naming_hints", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') THEN 'small' WHEN contains(lower(p_name), 'widget') THEN 'gadget' END AS hint FROM part")
def c11(spark, d):
    return table(spark, d, "part").select("p_partkey", V.first_marker(C("p_name"), [("small", ["Ring", "bolt"]), ("gadget", ["widget"])]).alias("hint"))


@query("c13_registry_build", "WITH d AS (SELECT p_brand AS kind, p_type AS key, count(DISTINCT p_name) AS digests FROM part WHERE p_size < 20 GROUP BY ALL), o AS (SELECT p_brand AS kind, p_type AS key, count(*) AS seen FROM part WHERE p_size >= 10 GROUP BY ALL) SELECT coalesce(d.kind, o.kind) AS kind, coalesce(d.key, o.key) AS key, CASE WHEN digests IS NULL THEN 'observed_only' WHEN seen IS NULL THEN 'declared_only' ELSE 'active' END AS status, CASE WHEN coalesce(digests, 0) > 1 THEN 'competing' WHEN digests = 1 THEN 'resolved' ELSE 'unresolved' END AS canonical FROM d FULL JOIN o ON d.kind = o.kind AND d.key = o.key")
def c13(spark, d):
    p = table(spark, d, "part")
    declared = p.where("p_size < 20").select(C("p_brand").alias("kind"), C("p_type").alias("key"), C("p_name").alias("digest"))
    observed = p.where("p_size >= 10").select(C("p_brand").alias("kind"), C("p_type").alias("key"), F.lit(1).alias("n"))
    return V.merge_registry(declared, observed)


@query("c14_source_weights", "SELECT conv_id, CAST(sum(CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM conversations GROUP BY 1")
def c14(spark, d):
    weights = spark.createDataFrame([("user", 3), ("assistant", 2), ("system", 1)], "role string, w int")
    return table(spark, d, "conversations").join(F.broadcast(weights), "role").groupBy("conv_id").agg(F.sum("w").alias("weight"))


@query("s7_registry_scan", "SELECT p_partkey::VARCHAR AS entity_id, p_brand AS kind FROM part WHERE p_brand = 'Brand#3' AND contains(lower(p_name), 'r')")
def s7(spark, d):
    from .search_queries import registry

    return registry(spark, d).where(P.kind_matches(C("kind"), "Brand#3") & P.registry_query("r", F.array().cast("array<string>"), C("canonical_key"))).select("entity_id", "kind")


@query("g10_context_packet", f"WITH {_BM}, h AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 3) SELECT h.query_id, 'search' AS lane, 'doc:' || h.doc_id AS ref FROM h UNION SELECT h.query_id, 'neighbour', 'source:' || d.source FROM h JOIN documents d USING (doc_id)")
def g10(spark, d):
    """Hits of each query with what they are linked to, here their sources."""
    docs = table(spark, d, "documents")
    h = T.bm25(lexical_index(spark, d), asked(spark, d), 3).select("query_id", "doc_id")
    hits = h.select("query_id", F.lit("search").alias("lane"), F.concat(F.lit("doc:"), C("doc_id").cast("string")).alias("ref"))
    near = h.join(docs.select("doc_id", "source"), "doc_id").select("query_id", F.lit("neighbour").alias("lane"), F.concat(F.lit("source:"), "source").alias("ref"))
    return hits.unionByName(near).distinct()
