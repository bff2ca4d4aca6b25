"""Scalar functions of the event model as Column builders: all JVM-side, all null-tolerant."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kind aliases, layer prefixes, agent-event classes.
KIND_ALIASES = {"mcp_service": "mcp", "mcp_services": "mcp", "mcp_tool": "tool", "mcp_tools": "tool", "failure_mode": "error", "hook_health": "receipt", "route": "owner_route"}
AGENT_EVENT_ALIASES = {
    "answer": "assistant_answer",
    "assistant_answer": "assistant_answer",
    "response": "assistant_answer",
    "assistant_response": "assistant_answer",
    "open_thread": "assistant_open_thread",
    "assistant_open_thread": "assistant_open_thread",
    "thread": "assistant_open_thread",
    "remaining_gap": "assistant_open_thread",
    "final": "assistant_final_closeout",
    "closeout": "assistant_final_closeout",
    "final_closeout": "assistant_final_closeout",
    "assistant_final_closeout": "assistant_final_closeout",
    "reasoning": "assistant_reasoning_boundary",
    "reasoning_boundary": "assistant_reasoning_boundary",
    "reasoning_window": "assistant_reasoning_boundary",
    "assistant_reasoning_boundary": "assistant_reasoning_boundary",
    "plan": "assistant_plan",
    "assistant_plan": "assistant_plan",
    "progress": "assistant_progress_update",
    "progress_update": "assistant_progress_update",
    "assistant_progress_update": "assistant_progress_update",
    "verification": "assistant_verification_report",
    "verification_report": "assistant_verification_report",
    "assistant_verification_report": "assistant_verification_report",
    "decision": "assistant_decision",
    "assistant_decision": "assistant_decision",
    "assumption": "assistant_assumption",
    "assistant_assumption": "assistant_assumption",
    "checkpoint": "assistant_checkpoint",
    "assistant_checkpoint": "assistant_checkpoint",
    "blocker": "assistant_blocker_report",
    "blocked": "assistant_blocker_report",
    "assistant_blocker_report": "assistant_blocker_report",
    "handoff": "assistant_handoff_or_resume",
    "resume": "assistant_handoff_or_resume",
    "assistant_handoff_or_resume": "assistant_handoff_or_resume",
    "correction": "assistant_correction_ack",
    "correction_ack": "assistant_correction_ack",
    "assistant_correction_ack": "assistant_correction_ack",
    "process_lesson": "assistant_process_lesson",
    "assistant_process_lesson": "assistant_process_lesson",
}


def lookup(x: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped value, or x itself where the mapping has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv]), x), x)


def route_key(x: Column) -> Column:
    """Folded to lower case, runs of anything but a-z and 0-9 become one underscore, none at the ends."""
    folded = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    return F.btrim(F.regexp_replace(folded, "[^a-z0-9]+", "_"), F.lit("_"))


def kind_alias(x: Column) -> Column:
    return lookup(x, KIND_ALIASES)


def agent_event_alias(x: Column) -> Column:
    return lookup(F.lower(F.btrim(x)), AGENT_EVENT_ALIASES)


def split_signal(x: Column, layers: Sequence[str]) -> tuple[Column, Column, Column]:
    """(layer, key, valid) of ``layer:key``; valid if the layer is known and the key not empty."""
    layer, key = F.substring_index(x, ":", 1), F.expr("''")
    key = F.when(F.instr(x, ":") > 0, F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).otherwise(key)
    return layer, key, layer.isin(*layers) & (key != "")


def label_date(x: Column) -> Column:
    """The first date 20dd-dd-dd that no digit touches, or ''."""
    return F.regexp_extract(x, "(?:^|[^0-9])(20[0-9]{2}-[0-9]{2}-[0-9]{2})(?:[^0-9]|$)", 1)


def leading_date(x: Column) -> Column:
    return F.regexp_extract(x, "^(20[0-9]{2}-[0-9]{2}-[0-9]{2})(?:[^0-9]|$)", 1)


def iso_time(x: Column) -> Column:
    """Timestamp of an ISO string; bare dates are midnight, what can't be read is null."""
    return F.try_to_timestamp(x)


def pipe_items(x: Column) -> Column:
    return F.filter(F.split(F.btrim(x, F.lit("|")), "[|]"), lambda v: v != "")


def comma_items(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), lambda v: F.btrim(v)), lambda v: v != "")


def bounded(x: Column, n: int) -> Column:
    """At most n characters, an ellipsis in the last three where something was cut."""
    return F.when(F.char_length(x) > n, F.concat(F.rtrim(F.left(x, F.lit(n - 3))), F.lit("..."))).otherwise(x)


def lenient_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(x)).isin("1", "true", "yes", "on"), F.lit(False))


def doc_id_parts(x: Column) -> tuple[Column, Column]:
    """Segment and event id: the last two parts of a colon-separated document id."""
    rx = "(?s):([^:]+):([^:]+)$"
    return F.regexp_extract(x, rx, 1), F.regexp_extract(x, rx, 2)


def raw_line(x: Column) -> Column:
    """N of ``raw:line:N``; null unless N is a positive integer."""
    n = F.regexp_extract(x, "^raw:line:([0-9]{1,18})$", 1).try_cast("long")
    return F.when(n > 0, n)


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns' text joined by the unit separator; nulls as the word null."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]), 256)


def payload_field(payload: Column, field: str, fallback: Column) -> Column:
    """A field of a JSON text; the row's own value where it is missing or the text can't be read."""
    return F.coalesce(F.get_json_object(payload, f"$.{field}"), fallback)


def node_id(layer: Column, key: Column) -> Column:
    return F.concat(F.lit("route:"), layer, F.lit(":"), layer, F.lit(":"), key)


def node_ids(kinds: Sequence[str], key: Column) -> Column:
    """Node ids a key may have: for each kind the route form and the entity form; distinct, in order."""
    return F.array_distinct(F.flatten(F.array(*[F.array(node_id(F.lit(k), key), F.concat(F.lit(f"route:{k}:entity:entity_"), key)) for k in kinds])))


def prefixed_keys(key: Column, prefixes: Sequence[str], cap: int = 48) -> Column:
    """The key and, with every prefix it starts with stripped, the bare key under each prefix; distinct, at most cap."""
    bare = key
    for p in prefixes:
        bare = F.when(bare.startswith(p), F.substr(bare, F.lit(len(p) + 1))).otherwise(bare)
    forms = F.array_distinct(F.concat(F.array(key, bare), F.array(*[F.concat(F.lit(p), bare) for p in prefixes])))
    return F.slice(forms, 1, cap)


def signal_candidates(anchor: Column, layers: Sequence[str]) -> Column:
    """Signals an anchor may stand for: itself if it is one, else its key under every layer."""
    layer, key, valid = split_signal(anchor, layers)
    own = F.concat(layer, F.lit(":"), route_key(key))
    return F.when(valid, F.array_distinct(F.array(anchor, own))).otherwise(F.array(*[F.concat(F.lit(f"{v}:"), route_key(anchor)) for v in layers]))


def exit_code(x: Column) -> Column:
    return F.regexp_extract(x, "exited with code ([0-9]{1,9})", 1).try_cast("int")


def path_mentions(x: Column) -> Column:
    """Distinct path-like words: at least one slash between names."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit("(/?(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]*)"), 1))


def priority(x: Column, order: Sequence[str]) -> Column:
    """Place of a value in an ordered list; unlisted values come after all."""
    at = F.array_position(F.array(*map(F.lit, order)), x)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(len(order) + 1).cast("int")


def identity_values(*columns: Column) -> Column:
    """Distinct values that are neither null nor ''."""
    return F.array_distinct(F.filter(F.array(*columns), lambda v: v.isNotNull() & (v != "")))
