"""Typing rules, distillation, redaction and naming over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The candidate routes of each event type.
ROUTES = {
    "USER_INTENT": ["intent_pattern", "prompt_template", "requirement_shape"],
    "INTER_AGENT_TASK": ["delegation_pattern", "task_contract", "handoff_quality"],
    "INTER_AGENT_MESSAGE": ["coordination_pattern", "agent_handoff", "communication_quality"],
    "ASSISTANT_REASONING_BOUNDARY": ["reasoning_boundary", "transition_context", "agent_process_gap"],
    "ASSISTANT_PLAN": ["planning_quality", "missed_step", "reusable_plan"],
    "TOOL_CALL": ["tool_usage_pattern", "tool_sequence", "automation_macro"],
    "TOOL_OUTPUT": ["evidence_extract", "signal_noise_ratio", "parser_candidate"],
    "FILE_READ": ["navigation_pattern", "repo_map_update", "dependency_discovery"],
    "FILE_WRITE": ["mutation_pattern", "safety_review", "rollback_need"],
    "DIFF": ["change_pattern", "review_checklist", "test_gap"],
    "COMMAND": ["command_recipe", "preflight_candidate", "safe_runner_rule"],
    "COMMAND_OUTPUT": ["verification_signal", "error_signature", "parser_candidate"],
    "ERROR": ["root_cause", "guardrail", "regression_test", "detector"],
    "DECISION": ["adr", "principle", "future_constraint"],
    "ASSUMPTION": ["assumption_risk", "verification_task", "anti_hallucination_rule"],
    "CHECKPOINT": ["resume_quality", "memory_gap", "checkpoint_schema_improvement"],
    "COMPACTION_EVENT": ["retention_failure", "context_budget_pattern", "archive_trigger_tuning"],
    "RESUME_HINT": ["rehydration_quality", "missing_refs", "resume_template_improvement"],
    "OPEN_THREAD": ["backlog_item", "route_fork", "quest_candidate"],
    "DEAD_BRANCH": ["wasted_work_pattern", "avoid_rule", "routing_improvement"],
    "PROCESS_LESSON": ["technique_update", "skill_amendment", "playbook_patch"],
    "OPTIMIZATION_CANDIDATE": ["automation_seed", "metric_candidate", "owner_route"],
    "SECURITY_TOUCHPOINT": ["sensitive_surface_map", "redaction_candidate", "security_review_hint"],
    "SECURITY_OR_SECRET_RISK": ["redaction_rule", "safety_gate", "sanitizer_test"],
    "VERIFICATION": ["proof_pattern", "test_recipe", "confidence_model"],
    "FINAL_STATE": ["closeout_quality", "handoff_template", "next_route"],
}
# The content rules of the public-tree audit, by class, with pattern and severity, in their order.
# The marker of a host's own profile folder is a parameter of content_rules().
CONTENT_RULES = {
    "private_key": (r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", "blocking"),
    "openai_api_key": (r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{20,}\b", "blocking"),
    "github_token": (r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", "blocking"),
    "aws_access_key": (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "blocking"),
    "credential_assignment": (r"(?i)\b(?:api[_-]?key|access[_-]?token|client[_-]?secret|password)\b\s*[:=]\s*['\"][^'\"\s]{12,}['\"]", "blocking"),
    "bearer_credential": (r"(?i)\b(?:authorization\s*:\s*bearer|bearer[_-]?token\s*[:=])\s*['\"]?[A-Za-z0-9._~+/-]{16,}", "blocking"),
    "personal_home_path": (r"/(?:home|Users)/(?!example(?:/|\b)|test(?:/|\b)|user(?:/|\b)|runner(?:/|\b)|workspace(?:/|\b))[A-Za-z0-9._-]+", "blocking"),
    "private_network_address": (r"(?<![0-9])(?:10(?:\.\d{1,3}){3}|192\.168(?:\.\d{1,3}){2}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2})(?![0-9])", "review"),
}
# Chosen here: credential-like and personal text, by class, with severity, and the version of these rules.
POLICY_VERSION = 1
SENSITIVE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "medium"),
    "secret_assignment": (r"token = \"[0-9a-f]{20,}\"", "high"),
    "phone": (r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "medium"),
    "long_number": (r"[0-9]{13,19}", "low"),
}


def classify_text(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The first rule whose pattern the text matches."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def distillation_routes(events: DataFrame, routes: Mapping[str, Sequence[str]] = ROUTES) -> DataFrame:
    """One row per event and candidate route of its type."""
    m = F.create_map(*[x for k, v in routes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return events.withColumn("route", F.explode(F.try_element_at(m, F.col("event_type"))))


def redact(text: Column, rules: Mapping[str, tuple[str, str]] = SENSITIVE) -> tuple[Column, dict[str, Column]]:
    """(text with typed placeholders, number of replacements by class), rule by rule in order."""
    hits, out = {}, text
    for name, (pattern, _) in rules.items():
        hits[name] = F.coalesce(F.regexp_count(out, F.lit(pattern)), F.lit(0))
        out = F.regexp_replace(out, pattern, f"<{name}>")
    return out, hits


def content_rules(host_profile: str = "/srv/host") -> dict[str, tuple[str, str]]:
    """All content rules: the fixed ones, the host's profile folder, and those chosen here."""
    marker = "".join("\\" + c if not c.isalnum() and c != "/" else c for c in host_profile)
    return CONTENT_RULES | {"host_profile_path": (marker + r"(?:/|\b)", "review")} | SENSITIVE


def findings(docs: DataFrame, ident: str, text: str, rules: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """(ident, class, severity, fingerprint): one row per finding; the fingerprint is a truncated digest of class, NUL and value, not the value."""
    rules = content_rules() if rules is None else rules
    found = F.flatten(F.array(*[_hits(F.col(text), n, p, s) for n, (p, s) in rules.items()]))
    f = docs.select(ident, F.explode(found).alias("f"))
    return f.select(ident, F.col("f.class").alias("class"), F.col("f.severity").alias("severity"), F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat("f.class", F.lit("\0"), "f.v"), 256), 1, 16)).alias("fingerprint"))


def _hits(text: Column, name: str, pattern: str, severity: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda v: F.struct(F.lit(name).alias("class"), F.lit(severity).alias("severity"), v.alias("v")))


def first_marker(text: Column, hints: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Name of the first hint with a marker in the text, whatever the case."""
    low, out = F.lower(text), F.when(F.lit(False), F.lit(""))
    for name, markers in hints:
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(low, F.lit(m.lower()))
        out = out.when(hit, name)
    return out


def readiness(sessions: DataFrame, lag: int = 0) -> DataFrame:
    """Naming readiness of sessions(event_count, intent_count, failure_count, indexed_count, reviewed): one of nine states, the first that holds.

    lag is the number of events that generated views may be behind. Thresholds chosen here.
    """
    n, intents, failures = F.col("event_count"), F.col("intent_count"), F.col("failure_count")
    state = (
        F.when(n == 0, "blocked").when(F.col("reviewed"), "named").when(n - F.col("indexed_count") > lag, "needs_reindex").when(failures * 2 > n, "diagnostic_only")
        .when((n < 20) | (intents == 0), "low_signal").when(intents > 15, "phase_discovery_ready").when(n >= 100, "needs_phase_discovery")
        .when(failures * 4 <= n, "ready_for_semantic_name").otherwise("readable_label")
    )
    return sessions.withColumn("readiness", state)


def merge_registry(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Entities by kind and key from declared(kind, key, digest) and observed(kind, key, n): status and canonicalisation verdict."""
    d = declared.groupBy("kind", "key").agg(F.count_distinct("digest").alias("digests"))
    o = observed.groupBy("kind", "key").agg(F.sum("n").alias("seen"))
    j = d.join(o, ["kind", "key"], "full_outer")
    status = F.when(F.col("digests").isNull(), "observed_only").when(F.col("seen").isNull(), "declared_only").otherwise("active")
    return j.select("kind", "key", status.alias("status"), F.when(F.coalesce("digests", F.lit(0)) > 1, "competing").when(F.col("digests") == 1, "resolved").otherwise("unresolved").alias("canonical"))


def canonical_candidates(definitions: DataFrame, key: str, *content: str, active: Column | None = None) -> DataFrame:
    """(key, digest, members, active, verdict) of definitions: those of a key with equal content, digested in order, are one candidate.

    A key whose active candidates number one is resolved, several are competing,
    none is dormant. Null content digests as such and equals only itself.
    """
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in content]), 256)
    on = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    g = definitions.select(F.col(key).alias("key"), digest.alias("digest"), on.alias("on")).groupBy("key", "digest").agg(F.count("*").alias("members"), F.bool_or("on").alias("active"))
    n = g.groupBy("key").agg(F.count_if("active").alias("n"))
    verdict = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "competing").otherwise("dormant")
    return g.join(n, "key").select("key", "digest", "members", "active", verdict.alias("verdict"))
