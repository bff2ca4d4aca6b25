"""The rule tables: every rule decides some line, every layer and axis is reached, names are whole."""

from pyspark.sql import functions as F

from tracelake.operators import typing as Y

#: kind, payload, role, tool, arguments, text and the rule that decides.
LINES = [
    ("session_meta", None, None, None, None, None, 0), ("compacted", None, None, None, None, None, 1), ("hook_stop", None, None, None, None, "hook failed", 2), ("turn_context", None, None, None, None, None, 3), ("response_item", "reasoning", None, None, None, None, 4),
    ("response_item", "function_call_output", None, None, None, "found password: x", 5), ("response_item", "function_call_output", None, None, None, 'x {"ok":false,"error":"projection_stale"}', 6), ("response_item", "function_call_output", None, None, None, "exited with code 0", 7), ("response_item", "function_call_output", None, None, None, "fine", 8),
    ("response_item", "function_call", None, "spawn_agent", '{"agent": "helper"}', None, 9), ("response_item", "function_call", None, "send_agent", "{}", None, 10), ("response_item", "function_call", None, "apply_patch", "*** Update File: a/b.py", None, 11), ("response_item", "function_call", None, "write_file", "{}", None, 12),
    ("response_item", "function_call", None, "read_file", "{}", None, 13), ("response_item", "function_call", None, "update_plan", "{}", None, 14), ("response_item", "function_call", None, "shell", "sudo x", None, 15), ("response_item", "function_call", None, "shell", "git status && pytest run.sh", None, 16),
    ("response_item", "function_call", None, "mcp__catalog__query", '{"objective": "Find it"}', None, 17), ("response_item", "message", "system", None, None, None, 18), ("response_item", "message", "user", None, None, "Look for DEMO-ANCHOR-42 in /srv/data/x, prefer speed", 19),
]
SAID = ["Done.", "It is verified now", "We decided so", "assuming it holds", "a dead end", "a lesson", "it could be faster", "todo later", "resume from line 9", "a checkpoint", "I will go on", "hello"]
MENTIONS = "scope: full authority: board skill: search plugin: x1 validator: v eval: e playbook: p technique: t mechanic: m graph: g memory: core owner: me correlation: c1 decision: d high confidence permission denied 16 GB linux stale https://api.example.org/a raw:line:7 unverified"


def rows():
    lines = [(*x[:6], x[6]) for x in LINES] + [("response_item", "message", "assistant", None, None, t, 20 + i) for i, t in enumerate(SAID)]
    return lines + [("other", None, None, None, None, None, 32)]


def test_each_rule_decides_a_line_and_all_types_come_up(spark):
    df = spark.createDataFrame(rows(), "kind string, payload string, role string, tool string, arguments string, text string, want int")
    got = Y.classify_lines(df).collect()
    assert [r.rule for r in got] == [r.want for r in got] == list(range(len(Y.RULES)))
    assert {r.event_type for r in got} == set(Y.TYPES) and len(Y.TYPES) == 31
    assert all((r.family, r.phase, r.actor, r.outcome) == Y.TYPES[r.event_type] for r in got)
    assert (len({v[0] for v in Y.TYPES.values()}), len({v[1] for v in Y.TYPES.values()}), len({v[2] for v in Y.TYPES.values()}), len({v[3] for v in Y.TYPES.values()})) == (18, 19, 6, 17)
    none = Y.classify_lines(df, Y.RULES[:1]).where("kind <> 'session_meta'").select("event_type", "rule").distinct().collect()
    assert [tuple(r) for r in none] == [("RAW_EVENT", None)]


def test_each_layer_and_axis_is_reached(spark):
    lines = [(i, *r[:6]) for i, r in enumerate(rows())] + [(90, "response_item", "message", "user", None, None, MENTIONS), (91, "response_item", "message", "user", None, None, MENTIONS)]
    df = spark.createDataFrame(lines, "line int, kind string, payload string, role string, tool string, arguments string, text string").selectExpr("*", "'s1' as session_id", "'2024-01-02' as day")
    typed = Y.route_signals(Y.classify_lines(df)).cache()
    seen = {(s.layer, s.key) for r in typed.collect() for s in r.route_signals}
    assert {x for x, _ in seen} == {x.name for x in Y.LAYERS} and len(Y.LAYERS) == 37
    assert {("entity", "demo-anchor-42"), ("path", "/srv/data/x"), ("mcp", "catalog"), ("goal", "find it"), ("failure_mode", "projection_stale"), ("git", "status"), ("mutation_surface", "a/b.py"), ("api", "api.example.org")} <= seen
    axes = {(r.axis, r.route_key): r for r in Y.axis_rows(typed).collect()}
    assert {a for a, _ in axes} == set(Y.AXES) and len(Y.AXES) == 52
    twice = axes["by-skill", "search"]
    assert (twice.signal_count, twice.first_line, twice.confidence) == (2, 90, "medium") and axes["by-time", "2024-01-02"].confidence == "high" and axes["by-open-thread", "open_thread"].confidence == "low"
    typed.unpersist()
