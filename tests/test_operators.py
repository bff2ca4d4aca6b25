"""Operators on small inline tables: the cases the given tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions import scalars as S
from tracelake.operators import graph as G
from tracelake.operators import retrieval as T
from tracelake.operators import rollups as R
from tracelake.operators import search as P
from tracelake.operators import sequence as Q
from tracelake.sources import readers as RD
from tracelake.sources import storage as ST

C = F.col


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v


def test_scalars(spark):
    assert one(spark, S.route_key(C("x")), x="  Straße / Über-42! ") == "strasse_ber_42"
    assert one(spark, S.label_date(C("x")), x="a-2024-01-02__001") == "2024-01-02" and one(spark, S.label_date(C("x")), x="12024-01-02") == ""
    assert one(spark, S.raw_line(C("x")), x="raw:line:12") == 12 and one(spark, S.raw_line(C("x")), x="raw:line:0") is None and one(spark, S.raw_line(C("x")), x="raw:line:-1") is None
    assert one(spark, S.bounded(C("x"), 8), x="abcd   efgh") == "abcd..." and one(spark, S.bounded(C("x"), 8), x="abc") == "abc"
    assert one(spark, S.pipe_items(C("x")), x="|a||b|") == ["a", "b"] and one(spark, S.comma_items(C("x")), x=" a, ,b ") == ["a", "b"]
    assert one(spark, S.iso_time(C("x")), x="bad") is None
    assert list(one(spark, F.array(*S.doc_id_parts(C("x"))), x="event:s1:003:e-9")) == ["003", "e-9"]
    assert one(spark, S.exit_code(C("x")), x="Process exited with code 17\n") == 17
    assert one(spark, S.path_mentions(C("x")), x="see /a/b.py and c/d") == ["/a/b.py", "c/d"]
    assert one(spark, S.prefixed_keys(C("x"), ["mcp:", "tool:"]), x="tool:q") == ["tool:q", "q", "mcp:q"]


EVENTS = "session_id string, line long, event_id long, event_type string, correlation_id string, k string, outcome string, ts string"


def log(spark, *rows):
    return spark.createDataFrame([(s, n, i, t, c, c, "failed" if t == "ERROR" else "observed" if t == "OUT" else "x", f"2024-01-01 00:00:{n:02d}") for i, (s, n, t, c) in enumerate(rows)], EVENTS)


def test_episodes_open_close_and_repeat(spark):
    e = log(spark, ("a", 1, "X", None), ("a", 2, "IN", None), ("a", 3, "IN", None), ("a", 4, "END", None), ("a", 5, "X", None), ("a", 6, "IN", None), ("b", 1, "END", None))
    for lines in (1, 2, 100):
        got = {(r.session_id, r.line): (r.episode, r.in_episode) for r in Q.episodes(e, C("event_type") == "IN", C("event_type") == "END", lines).collect()}
        assert got == {("a", 1): (0, False), ("a", 2): (1, True), ("a", 3): (1, True), ("a", 4): (1, True), ("a", 5): (1, False), ("a", 6): (2, True), ("b", 1): (0, False)}


def test_segments_without_marker_are_one(spark):
    e = log(spark, ("a", 1, "X", None), ("a", 2, "CUT", None), ("b", 1, "X", None))
    for lines in (1, 100):
        got = {(r.session_id, r.line): (r.segment, r.role) for r in Q.segments(e, C("event_type") == "CUT", lines).collect()}
        assert got == {("a", 1): (0, "initial-to-compaction"), ("a", 2): (1, "compaction-to-latest"), ("b", 1): (0, "initial-to-latest")}


def test_lines_follow_time_over_days(spark):
    from tracelake.operators import events as E

    rows = [(3, "b", "2024-01-02"), (1, "b", "2024-01-01"), (2, "b", "2024-01-01"), (9, "b", None), (5, None, "2024-01-01")]
    got = E.numbered(spark.createDataFrame(rows, "id long, s string, day string"), "s", "day", "id").collect()
    assert {r.id: r.line for r in got} == {9: 1, 1: 2, 2: 3, 3: 4, 5: 1}


def test_correlation_of_swapped_results_and_foreign_ones(spark):
    e = log(spark, ("a", 1, "CALL", "x"), ("a", 2, "CALL", "y"), ("a", 3, "OUT", "y"), ("a", 4, "OUT", "x"), ("b", 5, "OUT", "x"), ("a", 6, "CALL", None), ("a", 7, "CALL", ""), ("a", 8, "OUT", ""))
    pairs = Q.correlate(e.where("event_type = 'CALL'"), e.where("event_type = 'OUT'"))
    assert sorted((r.call_line, r.result_line) for r in pairs.collect()) == [(1, 4), (2, 3)]
    foreign = Q.nearby_foreign(e, C("event_type") == "CALL", C("event_type") == "OUT", 3)
    assert sorted((r.call_id, r.result_id) for r in foreign.where("call_id < 2").collect()) == [(0, 2), (1, 3)]


def test_event_window_bounds(spark):
    e = log(spark, *[("a", i, "X", None) for i in range(1, 6)])
    for lines in (1, 2, 3, 100):
        got = {r.line: [w.line for w in r.window] for r in Q.event_windows(e, F.lit(True), 3, 1, "event_id", lines=lines).collect()}
        assert got == {i: [j for j in range(i - 3, i + 2) if 1 <= j <= 5] for i in range(1, 6)}
    with pytest.raises(ValueError):
        Q.event_windows(e, F.lit(True), 25, 0)


def test_recovery_and_supersession(spark):
    e = log(spark, ("a", 1, "ERROR", "k"), ("a", 2, "OUT", "other"), ("a", 3, "OUT", "k"), ("a", 4, "ERROR", "k"))
    assert {r.line: r.recovered_by for r in Q.recovery(e, C("outcome") == "failed", C("outcome") == "observed").collect()} == {1: 2, 4: None}
    s = Q.superseded(spark.createDataFrame([("d", 1, "t1"), ("d", 2, "t2"), ("e", 3, "t0")], "key string, id long, ts string"), "id", "key")
    assert {r.id: (r.superseded_by, r.valid) for r in s.collect()} == {1: (2, False), 2: (None, True), 3: (None, True)}


def test_values_carried_over_stretches(spark):
    rows = [("a", i, t, c) for i, (t, c) in enumerate([("IN", None), ("CALL", "x"), ("OUT", "x"), ("CALL", "x"), ("OUT", "y"), ("OUT", "x"), ("IN", None), ("CALL", None), ("OUT", "x"), ("CALL", "y"), ("IN", "x")], 1)] + [("b", 1, "OUT", "x"), ("b", 2, "CALL", "x")]
    e = log(spark, *rows)
    at = {i: r for i, r in enumerate(rows)}
    call, out = C("event_type") == "CALL", C("event_type") == "OUT"
    for lines in (1, 2, 3, 100):
        got = {r.call_id: (r.results, [m.line for m in r.members or []]) for r in Q.usage_chains(e, call, out, 2, lines).collect()}
        want = {}
        for i, (s, n, t, c) in at.items():
            if t == "CALL":
                after = [r[1] for r in rows if c and r[0] == s and r[2] == "OUT" and r[3] == c and r[1] > n]
                want[i] = (len(after), after[:2])
        assert got == want
        inside = sorted((r.span_id, r.line) for r in Q.interior(e, C("event_type") == "IN", lines).collect())
        assert inside == [(0, n) for n in range(2, 7)] + [(6, n) for n in range(8, 11)]
        first = {(r.session_id, r.line): r.x for r in Q.first_after(e, F.when(out, C("line")), "x", lines).collect()}
        assert first == {(s, n): min((r[1] for r in rows if r[0] == s and r[2] == "OUT" and r[1] > n), default=None) for s, n, *_ in rows}


def test_versions_and_labels_meet_across_parts(spark):
    rows = [("k", i, f"2024-0{1 + i // 3}-0{1 + i % 3}") for i in range(9)] + [(None, 20, "2024-01-01"), (None, 21, "2024-05-01")]
    v = spark.createDataFrame(rows, "key string, id long, ts string")
    got = {r.id: r.superseded_by for r in Q.superseded(v, "id", "key", part=F.substring("ts", 1, 7)).collect()}
    assert got == {i: i + 1 if i < 8 else None for i in range(9)} | {20: 21, 21: None}
    s = spark.createDataFrame([("c", "2024-01-01 01:00:00"), ("a", "2024-01-01 05:00:00"), ("b", "2024-01-01 05:00:00"), ("d", "2024-01-02 00:00:00")], "session_id string, start string").selectExpr("session_id", "cast(start as timestamp_ntz) as start", "substring(start, 1, 10) as session_date")
    assert {r.label for r in Q.sequence_labels(s).collect()} == {"2024-01-01__001__c", "2024-01-01__002__a", "2024-01-01__003__b", "2024-01-02__001__d"}


def test_agent_routes_need_a_scope(spark):
    d = spark.createDataFrame([("c1", i, a) for i, a in enumerate(["user", "assistant", "assistant", "user", "assistant", "system"], 1)] + [("c2", 1, "user")], "session_id string, line long, actor string")
    for lines in (1, 2, 100):
        assert {r.line: (r.route, r.state) for r in P.agent_routes(d, F.lit(True), lines).collect()} == {2: ("progress_update", "continued"), 3: ("progress_update", "answered"), 5: ("closeout", "continued")}
    with pytest.raises(ValueError):
        P.agent_routes(d, None)


def test_one_more_vote_only_for_a_decisive_anchor(spark):
    sparse = spark.createDataFrame([(1, 10, 1, 9.0), (1, 11, 2, 3.0), (2, 20, 1, 9.0), (2, 21, 2, 8.9), (3, 30, 1, 5.0), (4, 40, 1, 7.0), (4, 41, 2, 1.0)], "query_id long, doc_id long, rank int, score double")
    anchors = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 41)], "query_id long, doc_id long")
    got = {(r.query_id, r.doc_id): r.bonus for r in T.anchored(T.fuse({"s": sparse}, "doc_id"), sparse, anchors, "doc_id").collect()}
    assert {k for k, b in got.items() if b} == {(1, 10), (3, 30)} and len(got) == 7


def test_bridges_reject_a_path_with_a_weak_edge(spark):
    walked = spark.createDataFrame([("a", "c", 2, ["a", "b", "c"]), ("a", "b", 1, ["a", "b"]), ("a", "z", 1, ["a", "z"])], "seed string, target string, hops int, path array<string>")
    typed = spark.createDataFrame([("a", "b", "caused"), ("b", "c", "cooccurrence")], "node string, other string, edge_type string")
    assert {(r.target, r.verdict) for r in G.bridges(walked, typed).collect()} == {("b", "admitted"), ("c", "rejected"), ("z", "rejected")}


def test_mixed_filters_are_refused():
    with pytest.raises(ValueError):
        P.check_filters({"task_episode_id": "1", "agent_event": "x"})
    with pytest.raises(ValueError):
        P.check_filters({"nope": 1})
    assert P.clamp(None, 1, 20, 100) == 20 and P.clamp(0, 1, 20, 100) == 1


def test_error_like_of_missing_fields(spark):
    rows = [("1", None, None, None), ("2", False, None, None), ("3", True, (False,), None), ("4", True, (True,), ["x"]), ("5", True, (True,), [])]
    r = spark.createDataFrame(rows, "id string, ok boolean, typing_bridge struct<ok: boolean>, errors array<string>")
    assert [x.id for x in r.where(P.error_like()).orderBy("id").collect()] == ["2", "3", "4"]


def test_fingerprint_ignores_order_and_sees_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "a long, b string")
    of = lambda t: R.table_fingerprint(t, F.lit("g"), "a", "b").first().fingerprint
    assert of(a) == of(a.orderBy(F.desc("a"))) != of(a.union(a.limit(1)))


def test_walk_depth_budget_and_paths(spark):
    links = G.both_ways(spark.createDataFrame([("a", "b", 5), ("b", "c", 1), ("a", "d", 1), ("d", "c", 1), ("c", "e", 1)], "source string, target string, n long"))
    seeds = spark.createDataFrame([("a",)], "seed string")
    reached = G.distances(links, seeds, 8)
    assert {r.node: r.hops for r in reached.collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 3}
    p = {r.target: r.path for r in G.paths(reached, spark.createDataFrame([("a", "e"), ("a", "d")], "seed string, target string"), 4).collect()}
    assert p == {"e": ["a", "b", "c", "e"], "d": ["a", "d"]}
    assert {r.node for r in G.distances(links, seeds, 2, node_budget=1).collect()} == {"a", "b", "c"}
    gate = C("node") != "b"
    assert {r.node: r.hops for r in G.distances(links, seeds, 2, admit=gate).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}


def test_bm25_and_exact(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "one fish"), (3, "green ham"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Fish, red!"), (2, "nothing")], "query_id long, query string")
    assert [(r.query_id, r.doc_id) for r in T.exact_hits(docs, q).collect()] == [(1, 1)]
    assert [r.doc_id for r in T.bm25(docs, q).orderBy("query_id", "rank").collect()] == [1, 2]


def test_transcripts_keep_every_line(spark, tmp_path):
    lines = [
        {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "s"}},
        {"timestamp": "2026-01-01T00:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do\nit"}]}},
        {"timestamp": "bad", "type": "response_item", "payload": {"type": "function_call", "name": "exec", "call_id": "c1", "arguments": '{"cmd":"x"}'}},
        {"timestamp": "2026-01-01T00:00:03Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "Process exited with code 2\n"}},
        {"timestamp": "2026-01-01T00:00:04Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "Process exited with code 0\n"}},
    ]
    text = "\n".join(json.dumps(x) for x in lines) + "\nnot json\n[1]\n"
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text(text)
    got = RD.read_transcripts(spark, str(tmp_path))
    a = got.where(C("file").endswith("a.jsonl")).orderBy("line").collect()
    assert [r.line for r in a] == list(range(1, 8)) and [r.status for r in a] == ["parsed"] * 5 + ["unparsable", "not_object"]
    e = RD.transcript_events(got).where(C("session_id").endswith("a.jsonl")).orderBy("line").collect()
    assert [r.event_type for r in e[:5]] == ["SESSION_META", "USER_INTENT", "TOOL_CALL", "TOOL_OUTPUT", "TOOL_OUTPUT"]
    assert e[2].ts is None and [e[3].outcome, e[4].outcome] == ["failed", "observed"]
    c = RD.captures(spark, str(tmp_path)).collect()
    assert len(c) == 1 and c[0].captured == 2


def test_only_dirty_partitions_are_replaced(spark, tmp_path):
    p = str(tmp_path / "t")
    ST.write_projection(spark.createDataFrame([(1, "a"), (2, "b")], "v long, k string"), p, "k")
    got = ST.replace_partitions(spark.createDataFrame([(9, "b")], "v long, k string"), p, "k")
    assert sorted((r.v, r.k) for r in got.collect()) == [(1, "a"), (9, "b")]


def test_entry_points():
    import __spark_entry__ as e

    q = e.queries()
    assert "a1_entity_inventory" in q and set(e.oracle_sql()) <= set(q)


def test_complete_results_of_several_batches_count_once(spark, tmp_path):
    from tracelake.streaming import flows

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events.parquet")
    for i in range(3):  # the last batch brings late rows
        rows.where(f"event_id % 3 = {(i + 2) % 3}").coalesce(1).write.mode("append").parquet(path)
    want = {(f"u{r.user_id}", r.n, r.e) for r in rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "signup").alias("e")).collect()}
    got = flows.run(flows.interval_counts(flows.stream_events(spark, path, files=1), "signup"), "several", "complete").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert flows.run(flows.progress(flows.stream_events(spark, path, files=1)), "several", "complete").count() == len(want)


def test_captures_ahead_of_the_index_over_several_batches(spark, tmp_path):
    from tracelake.operators import events as E
    from tracelake.streaming import flows

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events.parquet")
    for i in range(3):
        rows.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(path)
    old = E.operational_events(rows, lines=False).where("session_id <> 'u1' and (session_id <> 'u2' or ts < '2024-01-10')")
    got = {r.session_id: (r.ahead, r.rejected) for r in flows.run(flows.capture_ahead(flows.stream_events(spark, path, files=1), flows.index_state(old)), "ahead", "complete").collect()}
    late = {r.user_id: r.n for r in rows.where("user_id = 1 or (user_id = 2 and ts >= '2024-01-10')").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert len(got) == rows.select("user_id").distinct().count()
    assert all(v == ((int(k[1:]) in late), late.get(int(k[1:]), 0)) for k, v in got.items())


def test_budget_report_counts_what_is_left_out(spark):
    links = G.both_ways(spark.createDataFrame([("a", "b", 5), ("a", "c", 4), ("a", "d", 1), ("b", "e", 1), ("b", "c", 1)], "source string, target string, n long"))
    reached = G.distances(links, spark.createDataFrame([("a",), ("z",)], "seed string"), 2, node_budget=2)
    got = {r.seed: r.asDict() for r in G.budget_report(links, reached, 2, 4).collect()}
    # a reaches b and c, then e; d stays out. Walked from a, b and c: 3 + 3 + 2 edges.
    assert got["a"] == {"seed": "a", "nodes": 4, "omitted_nodes": 1, "edges": 4, "omitted_edges": 4, "truncated": True}
    assert got["z"] == {"seed": "z", "nodes": 1, "omitted_nodes": 0, "edges": 0, "omitted_edges": 0, "truncated": False}


SECRETS = {
    "private_key": ["-----BEGIN EC " + "PRIVATE KEY-----", "-----BEGIN " + "PRIVATE KEY-----"],
    "openai_api_key": ["sk-" + "a1B2" * 6, "sk-proj-" + "x_-9" * 7],
    "github_token": ["ghp_" + "Ab1" * 12],
    "aws_access_key": ["AKIA" + "A1" * 8, "ASIA" + "Z9" * 8],
    "credential_assignment": ["API_KEY = 'abcdefghijklm'", 'password:"123456789012345"'],
    "bearer_credential": ["Authorization: Bearer abcdefghijklmnop.qr", "bearer_token = 'abcdefghijklmnop"],
    "personal_home_path": ["/home/anna", "/Users/bob.c", "/home/examples"],
    "private_network_address": ["10.0.0.1", "192.168.17.4", "172.31.0.255"],
    "host_profile_path": ["/srv/host"],
}


def test_every_content_rule_finds_its_case(spark):
    import hashlib
    import re

    from tracelake.operators import review

    plain = ["nothing here", "/home/example/x /Users/runner", "110.0.0.1 10.0.0.1234 172.32.0.1", "sk-short ghp_x AKIA1", "password: short", None, ""]
    rows = [(i, f"see {v}, then {v};") for i, v in enumerate(v for vs in SECRETS.values() for v in vs)] + [(100 + i, t) for i, t in enumerate(plain)]
    got = sorted((r.doc_id, r["class"], r.severity, r.fingerprint) for r in review.findings(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())
    want = []
    for i, t in rows:
        for name, (pattern, severity) in review.content_rules().items():
            want += [(i, name, severity, "sha256:" + hashlib.sha256(f"{name}\0{m[0]}".encode()).hexdigest()[:16]) for m in re.finditer(pattern, t or "")]
    assert got == sorted(want)
    found = {(i, c) for i, c, *_ in got}
    assert {(i, n) for i, n in enumerate(n for n, vs in SECRETS.items() for _ in vs)} <= found and not any(i >= 100 for i, _ in found)


def test_dense_search_over_shards_is_brute_force(spark):
    import numpy as np

    from tracelake.operators import retrieval

    r = np.random.default_rng(5)
    x = r.standard_normal((300, 6))
    x[50] = x[7]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>")
    got = retrieval.top(retrieval.dense_top(df, F.col("vec_id") % 50 == 0, 4, shard_rows=64, block=2), 4, "query_id", F.desc("score"), F.col("vec_id")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = np.round(u[q] @ u.T, 6)
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:4]
        assert [g.vec_id for g in sorted(got, key=lambda g: g["rank"]) if g.query_id == q] == want


def test_readiness_has_nine_states(spark):
    from tracelake.operators import review as V

    rows = [(0, 0, 0, 0, False), (30, 1, 0, 30, True), (30, 1, 0, 9, False), (30, 1, 20, 30, False), (9, 1, 0, 9, False), (90, 16, 0, 90, False), (100, 1, 0, 100, False), (30, 1, 7, 30, False), (30, 1, 8, 30, False)]
    s = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, event_count int, intent_count int, failure_count int, indexed_count int, reviewed boolean")
    got = [r.readiness for r in V.readiness(s).orderBy("i").collect()]
    assert got == ["blocked", "named", "needs_reindex", "diagnostic_only", "low_signal", "phase_discovery_ready", "needs_phase_discovery", "ready_for_semantic_name", "readable_label"]


def test_repair_is_a_rebuild(spark):
    schema = "source_key string, node string, count long"
    stored = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 4), ("b", "z", 8)], schema)
    dirty, fresh = spark.createDataFrame([("a",)], "source_key string"), spark.createDataFrame([("a", "x", 16), ("a", "w", 32)], schema)
    got = G.repair(G.aggregate_contributions(stored, "node"), stored, dirty, fresh, "node")
    assert {(r.node, r["count"]) for r in got.collect()} == {("x", 20), ("z", 8), ("w", 32)}


def test_events_since_the_first_start(spark):
    e = log(spark, ("a", 1, "OUT", "p"), ("a", 2, "CALL", "p"), ("a", 3, "OUT", "p"), ("a", 4, "CALL", "p"), ("b", 1, "OUT", "p"))
    got = {(r.session_id, r.line): (r.starts, r.later) for r in Q.since_first(e, C("event_type") == "CALL", "session_id", "k").collect()}
    assert got == {("a", 1): (2, False), ("a", 2): (2, False), ("a", 3): (2, True), ("a", 4): (2, True), ("b", 1): (None, False)}


def test_names_and_redaction_counts(spark):
    from tracelake.operators import review as V

    assert one(spark, S.agent_event_alias(C("x")), x=" Process_Lesson ") == "assistant_process_lesson" and one(spark, S.agent_event_alias(C("x")), x="other") == "other"
    assert one(spark, S.node_ids(["tool", "tool"], C("x")), x="q") == ["route:tool:tool:q", "route:tool:entity:entity_q"]
    text, hits = V.redact(C("x"))
    assert one(spark, text, x="a@b.co and c@d.co, +1 (555) 123-4567") == "<email> and <email>, <phone>"
    assert one(spark, hits["email"], x="a@b.co and c@d.co") == 2
