"""Filters, predicates and projections of typed reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import kind_alias, lookup, route_key
from .sequence import STRETCH, first_after

FILTERS = ("session_id", "doc_type", "event_type", "family", "outcome", "conversation_act", "session_act", "agent_event", "task_episode_id", "route_layer", "route_signal", "archive_status", "freshness_status", "date_from", "date_to")
#: Filters that belong to one kind of row and can't be asked of another at once.
EXCLUSIVE = ({"task_episode_id"}, {"agent_event", "conversation_act"}, {"route_layer", "route_signal"})


def check_filters(filters: Mapping[str, object]) -> None:
    """ValueError for an unknown filter or for filters of different kinds of rows, rather than a wider answer."""
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    if sum(bool(kind & set(filters)) for kind in EXCLUSIVE) > 1:
        raise ValueError("filters of different kinds of rows")


def search(rows: DataFrame, date_col: str = "session_date", **filters: object) -> DataFrame:
    """Conjunction of the filters given; dates are ISO strings and bounds are inclusive; a null date fails them."""
    check_filters(filters)
    for name, want in filters.items():
        if name in ("date_from", "date_to"):
            bound = (lambda c, x: c >= F.lit(x)) if name == "date_from" else (lambda c, x: c <= F.lit(x))
            rows = rows.where(bound(F.col(date_col), want))
            if "month" in rows.columns:  # of stored rows: folders of other months are not read
                rows = rows.where(bound(F.col("month"), want[:7]))
        elif name in ("route_signal", "route_layer"):
            signals = F.col("route_signals")
            rows = rows.where(F.array_contains(signals, want) if name == "route_signal" else F.exists(signals, lambda s: s.startswith(f"{want}:")))
        else:
            rows = rows.where(F.col(name) == F.lit(want))
    return rows


def one_of(column: Column, wanted: Sequence[str], aliases: Mapping[str, str], default: Sequence[str]) -> Column:
    """IN-list after alias normalisation; an empty list means the default."""
    return lookup(column, aliases).isin(*(aliases.get(w, w) for w in (wanted or default)))


def present(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def mentions(needle: str, *columns: Column) -> Column:
    """Any column holds the needle, whatever the case; null counts as ''."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))
    return out


def term_contains(needle: str, key: Column, signal: Column) -> Column:
    k = route_key(F.lit(needle))
    return F.contains(key, k) | F.contains(signal, k)


def session_matches(selector: str, ident: Column, *names: Column) -> Column:
    """Id equal to the selector, or any name holding it."""
    return (ident == selector) | mentions(selector, *names)


def receipt_filter(event: str | None = None, date_from: str | None = None, only_errors: bool = False) -> Column:
    """Event name equal but for case; time at or after date_from, null failing; optionally only error-like receipts."""
    out = F.lit(True)
    if event is not None:
        out = out & (F.lower("hook_event_name") == event.lower())
    if date_from is not None:
        out = out & F.coalesce(F.col("timestamp") >= F.lit(date_from), F.lit(False))
    return out & error_like() if only_errors else out


def error_like() -> Column:
    """Not ok, or its bridge not ok, or errors listed; what is missing speaks for neither."""
    no = lambda c: F.coalesce(F.col(c) == F.lit(False), F.lit(False))
    return no("ok") | no("typing_bridge.ok") | (F.coalesce(F.size("errors"), F.lit(0)) > 0)


def exact_or_substring(rows: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows equal to the needle if there are any, else rows holding it. A scalar subquery decides."""
    exact = F.col(column) == needle
    near = rows.where(F.contains(F.col(column), F.lit(needle)))
    any_exact = near.agg(F.coalesce(F.bool_or(exact), F.lit(False))).scalar()
    return near.where(exact | ~any_exact)


def grain_date(event_time: Column, session_date: Column) -> Column:
    """The event's own date, falling back to its session's."""
    return F.coalesce(F.to_date(event_time), F.to_date(session_date))


def spans_overlap(start: Column, end: Column, date_from: str, date_to: str) -> Column:
    return (start <= F.lit(date_to)) & (end >= F.lit(date_from))


def kind_matches(kind: Column, wanted: str) -> Column:
    """all, any and entity match every kind; mcp matches every mcp* kind."""
    if wanted in ("all", "any", "entity"):
        return F.lit(True)
    return kind.startswith("mcp") if wanted == "mcp" else kind_alias(kind) == kind_alias(F.lit(wanted))


def registry_query(needle: str, aliases: Column, *columns: Column) -> Column:
    return mentions(needle, *columns) | F.exists(aliases, lambda a: F.contains(F.lower(a), F.lit(needle.lower())))


def registry_lookup(anchors: DataFrame, registry: DataFrame, anchor_col: str = "anchor") -> DataFrame:
    """Anchors joined to every entry whose id, key or alias has the same route key; collisions stay several rows."""
    names = registry.withColumn("__name", F.explode(F.array_distinct(F.concat(F.array("entity_id", "canonical_key"), "aliases")))).withColumn("__key", route_key(F.col("__name"))).dropDuplicates(["entity_id", "__key"])
    return anchors.withColumn("__key", route_key(F.col(anchor_col))).join(names.drop("__name"), "__key").drop("__key")


def current_generation(rows: DataFrame, **expected: object) -> tuple[DataFrame, DataFrame]:
    """(rows of the expected generation, count of the rows abstained from)."""
    same = F.lit(True)
    for name, want in expected.items():
        same = same & F.col(name).eqNullSafe(F.lit(want))
    return rows.where(same), rows.where(~same).agg(F.count("*").alias("abstained"))


def compact_json(rows: DataFrame, *columns: str) -> Column:
    """JSON of the columns without nulls and empty texts."""
    typed = dict(rows.dtypes)
    return F.to_json(F.struct(*[(F.nullif(F.col(c), F.lit("")) if typed[c] == "string" else F.col(c)).alias(c) for c in columns]))


def ranked(rows: DataFrame, k: int, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """The first k rows in an order, per group if by is given."""
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def clamp(limit: int | None, least: int, default: int, most: int) -> int:
    return default if limit is None else max(least, min(most, limit))


def agent_routes(dialogue: DataFrame, scope: Column | None, lines: int = STRETCH) -> DataFrame:
    """Answers within the scope, which must be given: route (closeout for a session's last one, else progress_update) and state (answered by the user, continued, or final)."""
    if scope is None:
        raise ValueError("agent routes need a session, an episode or a query as their scope")
    answer = F.col("actor") == "assistant"
    e = first_after(dialogue.where(scope), F.when(answer, F.col("line")), "__later", lines)
    e = first_after(e, F.coalesce("actor", F.lit("unknown")), "__next", lines).where(answer)
    state = F.when(F.col("__next") == "user", "answered").when(F.col("__next").isNull(), "final").otherwise("continued")
    return e.withColumn("route", F.when(F.col("__later").isNull(), "closeout").otherwise("progress_update")).withColumn("state", state).drop("__later", "__next")
