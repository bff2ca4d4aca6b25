"""Typing of transcript lines by rules that are data: event type, facets, route layers and axes.

A rule is a row: the fields it looks at with a pattern each, and what it gives.
All rules are tried in one pass over the lines, the first that fits decides. The
names of types, facets, layers and axes are fixed; the patterns are chosen here
(version PATTERNS), as none are published. Patterns use no look-around and no
back-references, so any engine reads them alike.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERNS = "1"
#: Fields of a line: its own and its payload's type, role, namespace and name of a tool, command or arguments, text or output.
FIELDS = ("kind", "payload", "role", "tool", "arguments", "text")


class Rule(NamedTuple):
    gives: str
    when: dict[str, str]


# The 31 event types with what they are in family, phase, actor and outcome (the pairing chosen here).
TYPES = {
    "SESSION_META": ("session_lifecycle", "start", "codex_runtime", "observed"),
    "CONTEXT_STATE": ("context_memory", "communicate", "codex_runtime", "observed"),
    "USER_INTENT": ("communication", "request", "user", "requested"),
    "INTER_AGENT_TASK": ("agent_communication", "request", "agent", "requested"),
    "INTER_AGENT_MESSAGE": ("agent_communication", "communicate", "agent", "observed"),
    "ASSISTANT_REASONING_BOUNDARY": ("agent_cognition", "plan", "assistant", "observed"),
    "ASSISTANT_PLAN": ("agent_cognition", "plan", "assistant", "planned"),
    "ASSISTANT_MESSAGE": ("communication", "communicate", "assistant", "observed"),
    "TOOL_CALL": ("tool_interaction", "act", "assistant", "requested"),
    "TOOL_OUTPUT": ("tool_interaction", "observe", "tool", "observed"),
    "FILE_READ": ("workspace_navigation", "inspect", "assistant", "requested"),
    "FILE_WRITE": ("workspace_mutation", "mutate", "assistant", "changed"),
    "DIFF": ("workspace_mutation", "mutate", "assistant", "changed"),
    "COMMAND": ("command_execution", "act", "assistant", "requested"),
    "COMMAND_OUTPUT": ("command_execution", "observe", "tool", "succeeded"),
    "ERROR": ("failure_signal", "diagnose", "tool", "failed"),
    "DECISION": ("decision_signal", "decide", "assistant", "decided"),
    "ASSUMPTION": ("decision_signal", "decide", "assistant", "provisional"),
    "CHECKPOINT": ("memory_state", "checkpoint", "assistant", "checkpointed"),
    "COMPACTION_EVENT": ("context_memory", "compact", "codex_runtime", "compacted"),
    "RESUME_HINT": ("memory_state", "rehydrate", "assistant", "resumable"),
    "OPEN_THREAD": ("progress_state", "checkpoint", "assistant", "unresolved"),
    "DEAD_BRANCH": ("progress_state", "decide", "assistant", "stopped"),
    "PROCESS_LESSON": ("distillation", "distill", "assistant", "candidate"),
    "OPTIMIZATION_CANDIDATE": ("optimization", "improve", "assistant", "candidate"),
    "SECURITY_TOUCHPOINT": ("risk_signal", "guard", "assistant", "observed"),
    "SECURITY_OR_SECRET_RISK": ("risk_signal", "guard", "tool", "risk"),
    "VERIFICATION": ("verification", "verify", "assistant", "verified"),
    "FINAL_STATE": ("session_lifecycle", "close", "assistant", "completed"),
    "HOOK_EVENT": ("session_lifecycle", "hook", "codex_runtime", "observed"),
    "RAW_EVENT": ("raw_evidence", "observe", "unknown", "observed"),
}
FACETS = ("family", "phase", "actor", "outcome")

_CALL, _OUT, _SAID = {"payload": "^function_call$"}, {"payload": "^function_call_output$"}, {"payload": "^message$", "role": "^assistant$"}
#: In order of priority.
RULES = [
    Rule("SESSION_META", {"kind": "^session_meta$"}),
    Rule("COMPACTION_EVENT", {"kind": "^compact(ed|ion)"}),
    Rule("HOOK_EVENT", {"kind": "^hook"}),
    Rule("CONTEXT_STATE", {"kind": "^(turn_context|context_state)$"}),
    Rule("ASSISTANT_REASONING_BOUNDARY", {"payload": "^reasoning$"}),
    Rule("SECURITY_OR_SECRET_RISK", {"payload": "^function_call_output$", "text": "(?i)(private key|api[_-]?key|password)[ :=]"}),
    Rule("ERROR", _OUT | {"text": "(?i)(\"ok\": ?false|exited with code [1-9]|traceback|exception)"}),
    Rule("COMMAND_OUTPUT", _OUT | {"text": "(?i)exited with code 0"}),
    Rule("TOOL_OUTPUT", _OUT),
    Rule("INTER_AGENT_TASK", _CALL | {"tool": "(?i)(spawn|delegate)_?agent"}),
    Rule("INTER_AGENT_MESSAGE", _CALL | {"tool": "(?i)(send|message|wait)_?agent"}),
    Rule("DIFF", _CALL | {"tool": "(?i)apply_patch"}),
    Rule("FILE_WRITE", _CALL | {"tool": "(?i)(write|create|edit)_?file"}),
    Rule("FILE_READ", _CALL | {"tool": "(?i)(read|open|view)_?file"}),
    Rule("ASSISTANT_PLAN", _CALL | {"tool": "(?i)update_?plan"}),
    Rule("SECURITY_TOUCHPOINT", _CALL | {"tool": "(?i)(shell|exec)", "arguments": "(?i)(sudo|chmod|ssh-|gpg)"}),
    Rule("COMMAND", _CALL | {"tool": "(?i)(shell|exec|bash)"}),
    Rule("TOOL_CALL", _CALL),
    Rule("CONTEXT_STATE", {"payload": "^message$", "role": "^(system|developer)$"}),
    Rule("USER_INTENT", {"payload": "^message$", "role": "^user$"}),
    Rule("FINAL_STATE", _SAID | {"text": "(?i)^(done|finished|all done|completed)\\b"}),
    Rule("VERIFICATION", _SAID | {"text": "(?i)\\b(verified|tests? pass(ed)?|confirmed)\\b"}),
    Rule("DECISION", _SAID | {"text": "(?i)\\b(decided|decision:|we will use)\\b"}),
    Rule("ASSUMPTION", _SAID | {"text": "(?i)\\b(assum(e|ing|ption)|presumably)\\b"}),
    Rule("DEAD_BRANCH", _SAID | {"text": "(?i)\\b(dead end|abandon(ed|ing)?|does not lead)\\b"}),
    Rule("PROCESS_LESSON", _SAID | {"text": "(?i)\\b(lesson|next time)\\b"}),
    Rule("OPTIMIZATION_CANDIDATE", _SAID | {"text": "(?i)\\b(optimi[sz]e|could be faster|speed up)\\b"}),
    Rule("OPEN_THREAD", _SAID | {"text": "(?i)\\b(todo|remaining|still open|unresolved)\\b"}),
    Rule("RESUME_HINT", _SAID | {"text": "(?i)\\b(resume|pick up) (here|from)\\b"}),
    Rule("CHECKPOINT", _SAID | {"text": "(?i)\\bcheckpoint\\b"}),
    Rule("ASSISTANT_PLAN", _SAID | {"text": "(?i)\\b(plan:|first, i|i will)\\b"}),
    Rule("ASSISTANT_MESSAGE", _SAID),
    Rule("RAW_EVENT", {}),
]


class Layer(NamedTuple):
    """Keys of a layer: what the pattern's first group finds in a field, wherever it does."""

    name: str
    field: str
    finds: str


_SHOWN = "(?i)\\b{}[ :/=_-]+([a-z0-9][a-z0-9_.-]*)"
# The names of the 37 layers.
LAYERS = [
    Layer("scope_contract", "text", _SHOWN.format("scope")),
    Layer("authority_surface", "text", _SHOWN.format("(?:authority|owner of record)")),
    Layer("entity", "text", "\\b([A-Z][A-Z0-9]+-[0-9A-Z][0-9A-Z-]*)"),
    Layer("path", "text", "((?:/[A-Za-z0-9_.-]+){2,})"),
    Layer("skill", "text", _SHOWN.format("skill")),
    Layer("tool", "tool", "^(.+)$"),
    Layer("mcp", "tool", "^mcp__([A-Za-z0-9_-]+?)__"),
    Layer("hook", "kind", "^hook[_:]?([a-z_]*)"),
    Layer("api", "text", "https?://([A-Za-z0-9.-]+)"),
    Layer("plugin", "text", _SHOWN.format("plugin")),
    Layer("agent", "arguments", "(?i)\"agent\": ?\"([^\"]+)\""),
    Layer("script", "arguments", "([A-Za-z0-9_-]+\\.(?:sh|py|js))\\b"),
    Layer("validator", "text", _SHOWN.format("validator")),
    Layer("test", "arguments", "(?i)\\b(pytest|unittest|jest|cargo test|go test)\\b"),
    Layer("eval", "text", _SHOWN.format("eval")),
    Layer("git", "arguments", "\\bgit ([a-z-]+)"),
    Layer("playbook", "text", _SHOWN.format("playbook")),
    Layer("technique", "text", _SHOWN.format("technique")),
    Layer("mechanic", "text", _SHOWN.format("mechanic")),
    Layer("graph", "text", _SHOWN.format("graph")),
    Layer("memory", "text", _SHOWN.format("memory")),
    Layer("hook_health", "text", "(?i)\\bhook (failed|ok|slow)\\b"),
    Layer("goal", "arguments", "(?i)\"objective\": ?\"([^\"]+)\""),
    Layer("verification_state", "text", "(?i)\\b(verified|unverified|tests? pass(?:ed)?)\\b"),
    Layer("decision_thread", "text", _SHOWN.format("decision")),
    Layer("failure_mode", "text", "(?i)\"error\": ?\"([^\"]+)\""),
    Layer("memory_provenance", "text", "\\b(raw:line:[0-9]+)\\b"),
    Layer("freshness_drift", "text", "(?i)\\b(stale|outdated|drift(?:ed)?)\\b"),
    Layer("owner_route", "text", _SHOWN.format("owner")),
    Layer("runtime_environment", "text", "(?i)\\b(linux|macos|windows|docker|python ?3[0-9.]*)\\b"),
    Layer("mutation_surface", "arguments", "\\*\\*\\* (?:Add|Update|Delete) File: ([^\\n\"]+)"),
    Layer("correlation", "text", _SHOWN.format("correlation")),
    Layer("confidence", "text", "(?i)\\b(high|low|medium) confidence\\b"),
    Layer("access_boundary", "text", "(?i)\\b(permission denied|read-only|forbidden)\\b"),
    Layer("resource_profile", "text", "(?i)\\b([0-9]+ ?(?:mb|gb|ms|cores))\\b"),
    Layer("operator_preference", "text", "(?i)\\b(prefer [a-z]+)\\b"),
    Layer("agent_event", "text", "(?i)^(done|plan|progress|blocked|answer)\\b"),
]

# The names of the 52 axes. What feeds each is chosen here: a layer, a facet, or the event types it gathers.
AXES = {
    "by-work-context": "layer:path", "by-repo-family": "layer:git", "by-memory-surface": "layer:memory", "by-authority-surface": "layer:authority_surface", "by-session-act": "phase", "by-conversation-act": "actor", "by-agent-event": "layer:agent_event",
    "by-scope-contract": "layer:scope_contract", "by-verification-state": "layer:verification_state", "by-open-thread": "type:OPEN_THREAD", "by-entity": "layer:entity", "by-path": "layer:path", "by-tool": "layer:tool", "by-mcp": "layer:mcp", "by-skill": "layer:skill",
    "by-hook": "layer:hook", "by-hook-health": "layer:hook_health", "by-api": "layer:api", "by-plugin": "layer:plugin", "by-agent": "layer:agent", "by-script": "layer:script", "by-validator": "layer:validator", "by-test": "layer:test", "by-eval": "layer:eval", "by-git": "layer:git",
    "by-playbook": "layer:playbook", "by-technique": "layer:technique", "by-mechanic": "layer:mechanic", "by-graph": "layer:graph", "by-memory-entity": "layer:memory", "by-goal": "layer:goal", "by-delivery-state": "outcome", "by-failure-mode": "layer:failure_mode",
    "by-risk": "type:SECURITY_TOUCHPOINT SECURITY_OR_SECRET_RISK", "by-phase-topic": "phase", "by-external-snapshot": "layer:api", "by-review-state": "type:VERIFICATION DECISION", "by-promotion-candidate": "type:PROCESS_LESSON OPTIMIZATION_CANDIDATE", "by-index-health": "layer:freshness_drift",
    "by-time": "day", "by-operator-request": "type:USER_INTENT", "by-route-next-action": "type:RESUME_HINT OPEN_THREAD", "by-evidence-provenance": "layer:memory_provenance", "by-owner-route": "layer:owner_route", "by-freshness": "layer:freshness_drift",
    "by-runtime-environment": "layer:runtime_environment", "by-mutation-surface": "layer:mutation_surface", "by-correlation": "layer:correlation", "by-confidence": "layer:confidence", "by-access-boundary": "layer:access_boundary", "by-resource-profile": "layer:resource_profile",
    "by-operator-preference": "layer:operator_preference",
}


def _field(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def first_rule(rules: list[Rule]) -> Column:
    """(rule, gives) of the first rule, numbered from 0, all of whose patterns are found in their fields; a null field is ''."""
    out = F.lit(None)
    for k, rule in reversed(list(enumerate(rules))):
        fits = F.lit(True)
        for name, pattern in rule.when.items():
            fits = fits & _field(name).rlike(pattern)
        out = F.when(fits, F.struct(F.lit(k).alias("rule"), F.lit(rule.gives).alias("gives"))).otherwise(out)
    return out


def classify_lines(lines: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """lines with FIELDS, plus rule, event_type and the type's facets; a line that no rule fits is RAW_EVENT with a null rule."""
    t = lines.withColumn("__r", first_rule(rules)).withColumn("event_type", F.coalesce("__r.gives", F.lit("RAW_EVENT"))).withColumn("rule", F.col("__r.rule")).drop("__r")
    facets = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return t.withColumns({f: F.try_element_at(facets, F.col("event_type"))[i] for i, f in enumerate(FACETS)})


def route_signals(lines: DataFrame, layers: list[Layer] = LAYERS) -> DataFrame:
    """lines with route_signals: array<struct<layer, key>>, distinct, of all layers; keys are lower-case, empty ones left out."""

    def of(x: Layer) -> Column:
        return F.transform(F.regexp_extract_all(_field(x.field), F.lit(x.finds), 1), lambda k: F.struct(F.lit(x.name).alias("layer"), F.lower(k).alias("key")))

    found = F.flatten(F.array(*map(of, layers)))
    return lines.withColumn("route_signals", F.array_distinct(F.filter(found, lambda s: s["key"] != "")))


def axis_rows(typed: DataFrame, session: str = "session_id", day: str = "day", line: str = "line") -> DataFrame:
    """(axis, route_key, session_id, signal_count, first_line, confidence) of typed lines with route_signals: one row per axis, key and session.

    confidence, chosen here: high from five signals on, medium from two, else low.
    """

    def of(axis: str, source: str) -> Column:
        if source.startswith("layer:"):
            keys = F.transform(F.filter("route_signals", lambda s: s["layer"] == source[6:]), lambda s: s["key"])
        elif source.startswith("type:"):
            keys = F.array_compact(F.array(F.when(F.col("event_type").isin(*source[5:].split()), F.lower("event_type"))))
        else:
            keys = F.array_compact(F.array(F.col(day if source == "day" else source).cast("string")))
        return F.transform(keys, lambda k: F.struct(F.lit(axis).alias("axis"), k.alias("route_key")))

    parts = [of(*x) for x in AXES.items()]
    rows = typed.select(F.col(session).alias("session_id"), F.col(line).alias("line"), F.explode(F.flatten(F.array(*parts))).alias("x")).select("session_id", "line", "x.*")
    n = rows.groupBy("axis", "route_key", "session_id").agg(F.count("*").alias("signal_count"), F.min("line").alias("first_line"))
    return n.withColumn("confidence", F.when(F.col("signal_count") >= 5, "high").when(F.col("signal_count") >= 2, "medium").otherwise("low"))
