"""Scalar functions F1 to F24, each over a whole table: (id, value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from .base import QUERIES, SQL, table

LAYERS = ["event_type", "k", "family"]
C = F.col
def _sig():
    return F.concat(C("event_type"), F.lit(":"), C("user_id").cast("string"))


def _label():
    return F.concat(F.lit("x"), C("o_orderkey").cast("string"), F.lit("__"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("__n"))


# name: (table, id, Spark column, SQL expression)
ITEMS = {
    "f1_route_key": ("documents", "doc_id", lambda: S.route_key(C("text")), "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_')"),
    "f2_kind_alias": ("events", "event_id", lambda: S.kind_alias(F.when(C("event_type") == "error", "failure_mode").when(C("event_type") == "view", "mcp_tool").otherwise(C("event_type"))), "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'tool' ELSE event_type END"),
    "f3_split_signal": ("events", "event_id", lambda: F.concat_ws("|", S.split_signal(_sig(), ["view", "error"])[0], S.split_signal(_sig(), ["view", "error"])[1], S.split_signal(_sig(), ["view", "error"])[2].cast("string")), "event_type || '|' || user_id || '|' || (event_type IN ('view', 'error'))::VARCHAR"),
    "f4_agent_event_alias": ("conversations", "conv_id", lambda: S.agent_event_alias(F.when(C("role") == "user", " Response").when(C("role") == "assistant", "FINAL").when(C("role") == "system", "Remaining_Gap").otherwise(C("role"))), "CASE role WHEN 'user' THEN 'assistant_answer' WHEN 'assistant' THEN 'assistant_final_closeout' WHEN 'system' THEN 'assistant_open_thread' ELSE role END"),
    "f5_label_date": ("orders", "o_orderkey", lambda: F.concat_ws("|", S.label_date(_label()), S.leading_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH")), S.leading_date(_label())), "CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' ELSE '||' END"),
    "f6_iso_time": ("events", "event_id", lambda: F.date_format(S.iso_time(F.when(C("event_id") % 7 == 0, F.lit("not a time")).when(C("event_id") % 7 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))), "yyyy-MM-dd HH:mm:ss"), "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"),
    "f7_items": ("part", "p_partkey", lambda: F.concat_ws("/", F.array_union(S.pipe_items(F.concat(F.lit("||"), F.regexp_replace("p_type", " ", "|"), F.lit("|"))), S.comma_items(F.concat(C("p_brand"), F.lit(" , ,"), C("p_name"))))), "array_to_string(string_split(p_type, ' '), '/') || '/' || p_brand || '/' || trim(p_name)"),
    "f8_bounded": ("documents", "doc_id", lambda: S.bounded(C("text"), 80), "CASE WHEN length(text) > 80 THEN rtrim(left(text, 77), ' ') || '...' ELSE text END"),
    "f9_lenient_bool": ("orders", "o_orderkey", lambda: S.lenient_bool(F.when(C("o_orderstatus") == "F", " Yes").when(C("o_orderstatus") == "O", "on").when(C("o_orderkey") % 2 == 0, C("o_orderstatus"))), "o_orderstatus IN ('F', 'O')"),
    "f10_doc_id_parts": ("lineitem", "l_orderkey", lambda: F.concat_ws("|", *S.doc_id_parts(F.concat_ws(":", F.lit("doc"), C("l_orderkey").cast("string"), C("l_partkey").cast("string"), C("l_linenumber").cast("string")))), "l_partkey || '|' || l_linenumber"),
    "f11_raw_line": ("events", "event_id", lambda: S.raw_line(F.concat(F.when(C("event_type") == "view", "raw:line:").when(C("event_type") == "error", "raw:line:-").otherwise("raw:"), C("event_id").cast("string"))), "CASE WHEN event_type = 'view' AND event_id > 0 THEN event_id END"),
    "f12_digest": ("events", "event_id", lambda: S.digest(C("event_type"), C("user_id"), F.get_json_object("props", "$.none")), "sha256(event_type || chr(31) || user_id || chr(31) || 'null')"),
    "f13_payload_field": ("events", "event_id", lambda: F.concat_ws("|", S.payload_field(C("props"), "k", F.lit("-")), S.payload_field(C("props"), "type", C("event_type")), S.payload_field(C("event_type"), "k", F.lit("bad"))), "regexp_extract(props, '\"k\": ?([0-9]+)', 1) || '|' || event_type || '|bad'"),
    "f14_node_id": ("events", "event_id", lambda: F.array_join(S.node_ids(["event_type", "event_type", "tool"], C("event_type")), ","), "'route:event_type:event_type:' || event_type || ',route:event_type:entity:entity_' || event_type || ',route:tool:tool:' || event_type || ',route:tool:entity:entity_' || event_type"),
    "f15_prefixed_keys": ("nation", "n_nationkey", lambda: F.concat_ws(",", S.prefixed_keys(F.concat(F.when(C("n_nationkey") % 2 == 0, "tool:").otherwise(""), F.lower("n_name")), ["tool:", "mcp:"])), "CASE WHEN n_nationkey % 2 = 0 THEN 'tool:' || lower(n_name) || ',' || lower(n_name) || ',mcp:' || lower(n_name) ELSE lower(n_name) || ',tool:' || lower(n_name) || ',mcp:' || lower(n_name) END"),
    "f16_signal_candidates": ("customer", "c_custkey", lambda: F.concat_ws(",", S.signal_candidates(F.when(C("c_custkey") % 2 == 0, F.concat(F.lit("k:"), C("c_mktsegment"))).otherwise(C("c_mktsegment")), LAYERS)), "CASE WHEN c_custkey % 2 = 0 THEN 'k:' || c_mktsegment || ',k:' || lower(c_mktsegment) ELSE 'event_type:' || lower(c_mktsegment) || ',k:' || lower(c_mktsegment) || ',family:' || lower(c_mktsegment) END"),
    "f17_nested_arguments": ("events", "event_id", lambda: F.get_json_object(F.get_json_object(F.to_json(F.struct(C("props").alias("arguments"))), "$.arguments"), "$.k"), "regexp_extract(props, '\"k\": ?([0-9]+)', 1)"),
    "f18_exit_code": ("events", "event_id", lambda: S.exit_code(F.concat(F.lit("Process exited with code "), F.when(C("event_type") == "error", C("user_id").cast("string")).when(C("event_type") == "view", "0").otherwise("?"))), "CASE event_type WHEN 'error' THEN user_id WHEN 'view' THEN 0 END::INTEGER"),
    "f19_path_mentions": ("pages", "page_id", lambda: F.concat_ws(" ", S.path_mentions(F.regexp_replace("url", "[?#].*$", ""))), ""),
    "f20_first_known": ("orders", "o_orderkey", lambda: F.coalesce(F.when(C("o_orderstatus") == "X", F.lit("a")), F.when(C("o_orderstatus") == "F", C("o_orderpriority")), C("o_orderstatus")), "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END"),
    "f21_title_fallback": ("supplier", "s_suppkey", lambda: F.coalesce(F.nullif(F.when(C("s_suppkey") % 3 == 0, "").when(C("s_suppkey") % 3 == 1, C("s_name")), F.lit("")), F.concat(F.lit("session-"), C("s_suppkey").cast("string"))), "CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE 'session-' || s_suppkey END"),
    "f22_round": ("lineitem", "l_orderkey", lambda: F.round(C("l_extendedprice") / 7, 2).cast("decimal(18,2)").cast("string"), "CAST(round(l_extendedprice / 7, 2)::DECIMAL(18,2) AS VARCHAR)"),
    "f23_priority": ("orders", "o_orderkey", lambda: S.priority(C("o_orderstatus"), ["O", "P"]), "CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END"),
    "f24_identity_values": ("customer", "c_custkey", lambda: F.concat_ws(",", S.identity_values(C("c_name"), F.lit(""), C("c_mktsegment"), C("c_name"), F.lit(None).cast("string"))), "c_name || ',' || c_mktsegment"),
}


def _register(name: str, t: str, key: str, column, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, t).select(F.col(key).alias("id"), column().alias("value"))
    SQL[name] = f"SELECT {key} AS id, {sql} AS value FROM {t}"


def register() -> None:
    for name, item in ITEMS.items():
        _register(name, *item)
    # The url has one path mention, from its second slash on, unless it has no slash at all.
    SQL["f19_path_mentions"] = r"SELECT page_id AS id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '(/?(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]*)', 1) AS value FROM pages"
