"""Windows over a session's ordered events and the joins between them.

All windows are partitioned by session; frames are bounded where rows are
collected, so no session is held whole. Where lines may be None, that says that
each key's rows are few enough for one task: windows then run over all of them,
without joins of stretches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .events import numbered

BY, LINE = "session_id", "line"


def in_order() -> Window:
    return Window.partitionBy(BY).orderBy(LINE)


#: Lines of a session that one task looks at together in running sums and carried values.
STRETCH = 65_536


def _stretch(events: DataFrame, lines: int) -> DataFrame:
    return events.withColumn("__b", F.floor(F.col(LINE) / lines))


def _meets(by: tuple[str, ...]) -> Column:
    """That the keys by are those named __k0, __k1 and so on; null meets null."""
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)))


def _keys(by: tuple[str, ...]) -> list[Column]:
    return [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]


def _with_before(e: DataFrame, per: DataFrame, value: Column, by: tuple[str, ...]) -> DataFrame:
    """e joined to value, taken over the earlier stretches of the same keys, as __p."""
    p = per.withColumn("__p", value.over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select(*_keys(by), F.col("__b").alias("__c"), "__p")
    return e.join(p, _meets(by) & (F.col("__b") == F.col("__c")), "left").drop("__c", *(f"__k{i}" for i in range(len(by))))


def running_sum(events: DataFrame, value: Column, name: str, lines: int | None = STRETCH, by: tuple[str, ...] = (BY,)) -> DataFrame:
    """Adds the sum of value up to and with each row of its session, or of other keys.

    Summed within stretches of lines, which start from the sums of the earlier
    ones: of a very long session no task holds more than a stretch, and one row
    a stretch meets in one place.
    """
    if lines is None:
        return events.withColumn(name, F.sum(value.cast("long")).over(Window.partitionBy(*by).orderBy(LINE).rowsBetween(Window.unboundedPreceding, 0)))
    e = _stretch(events.withColumn("__v", value.cast("long")), lines)
    per = e.groupBy(*by, "__b").agg(F.sum("__v").alias("__t"))
    w = Window.partitionBy(*by, "__b").orderBy(LINE).rowsBetween(Window.unboundedPreceding, 0)
    e = _with_before(e.withColumn("__w", F.sum("__v").over(w)), per, F.sum("__t"), by)
    return e.withColumn(name, F.col("__w") + F.coalesce("__p", F.lit(0))).drop("__v", "__b", "__w", "__p")


def over_all(events: DataFrame, by: tuple[str, ...], lines: int | None = STRETCH, **values: tuple[Callable[[Column], Column], Column]) -> DataFrame:
    """Adds, per name, an aggregate (F.min, F.max or F.sum, and of what) over all rows of the same keys; null keys meet null.

    Aggregated by stretch, then over the stretches of a key; rows are joined by
    key and stretch, so those of a hot key stay apart.
    """
    if lines is None:
        return events.withColumns({n: f(v).over(Window.partitionBy(*by)) for n, (f, v) in values.items()})
    e = _stretch(events, lines)
    per = e.groupBy(*by, "__b").agg(*(f(v).alias(f"__v_{n}") for n, (f, v) in values.items()))
    w = Window.partitionBy(*by)
    per = per.select(*_keys(by), F.col("__b").alias("__c"), *(f(F.col(f"__v_{n}")).over(w).alias(n) for n, (f, _) in values.items()))
    return e.join(per, _meets(by) & (F.col("__b") == F.col("__c"))).drop("__b", "__c", *(f"__k{k}" for k in range(len(by))))


def last_before(events: DataFrame, value: Column, name: str, lines: int | None = STRETCH, by: tuple[str, ...] = (BY,)) -> DataFrame:
    """Adds the last non-null value of the rows before each row of its session, or of other keys, by stretches as in running_sum."""
    if lines is None:
        return events.withColumn(name, F.last(value, True).over(Window.partitionBy(*by).orderBy(LINE).rowsBetween(Window.unboundedPreceding, -1)))
    e = _stretch(events.withColumn("__v", value), lines)
    per = e.groupBy(*by, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(LINE))).alias("__t"))
    w = Window.partitionBy(*by, "__b").orderBy(LINE).rowsBetween(Window.unboundedPreceding, -1)
    e = _with_before(e.withColumn("__w", F.last("__v", True).over(w)), per, F.last("__t", True), by)
    return e.withColumn(name, F.coalesce("__w", "__p")).drop("__v", "__b", "__w", "__p")


def _backwards(events: DataFrame) -> DataFrame:
    return events.withColumn(LINE, -F.col(LINE))


def first_after(events: DataFrame, value: Column, name: str, lines: int = STRETCH, by: tuple[str, ...] = (BY,)) -> DataFrame:
    """Adds the first non-null value of the rows after each row: last_before, read backwards."""
    back = _backwards(events.withColumn("__x", value))
    return _backwards(last_before(back, F.col("__x"), name, lines, by)).drop("__x")


def latest_samples(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The newest n rows of each key: date, then id, descending."""
    w = Window.partitionBy(*by).orderBy(F.desc("session_date"), F.desc("event_id"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def framed(events: DataFrame, frame: Column, name: str, before: int, after: int, lines: int = STRETCH, by: tuple[str, ...] = (BY,)) -> DataFrame:
    """Adds the list of a column (or struct) over the rows from before rows ahead to after rows behind each row of its session.

    Rows are counted along the session and dealt by stretches; those near the
    end of a stretch also go to the neighbour that needs them, and each row's
    list is taken in its own stretch.
    """
    e = running_sum(events, F.lit(1), "__o", lines, by)
    at = lambda shift: F.floor((F.col("__o") + shift) / lines)
    e = e.withColumn("__h", at(0)).withColumn("__g", F.explode(F.sequence(F.greatest(at(-max(after, 0)), F.lit(0)), at(max(-before, 0)))))
    w = Window.partitionBy(*by, "__g").orderBy("__o").rowsBetween(before, after)
    return e.withColumn(name, F.collect_list(frame).over(w)).where("__h = __g").drop("__o", "__h", "__g")


def event_windows(events: DataFrame, centre: Column, before: int, after: int, *columns: str, lines: int = STRETCH) -> DataFrame:
    """One row per centre with the events from before lines ahead of it to after lines behind it."""
    if not (0 <= before <= 24 and 0 <= after <= 48):
        raise ValueError("windows reach 24 back and 48 ahead at most")
    return framed(events, F.struct(LINE, *columns), "window", -before, after, lines).where(centre)


def following(events: DataFrame, k: int, value: str, name: str) -> DataFrame:
    """Adds the next k values after each event."""
    return framed(events, F.col(value), name, 1, k)


def segments(events: DataFrame, boundary: Column, lines: int | None = STRETCH) -> DataFrame:
    """Adds the running segment number, and the segment's role: how it began and whether it is still open."""
    e = running_sum(events, F.when(boundary, 1).otherwise(0), "segment", lines)
    e = over_all(e, (BY,), lines, __last=(F.max, F.col("segment")))
    start = F.when(F.col("segment") == 0, "initial").otherwise("compaction")
    return e.withColumn("role", F.concat(start, F.when(F.col("segment") == F.col("__last"), "-to-latest").otherwise("-to-compaction"))).drop("__last")


def episodes(events: DataFrame, opens: Column, closes: Column, lines: int | None = STRETCH) -> DataFrame:
    """Task episodes: an opening event starts one unless one is open; a closing event ends it.

    An event opens if the last opening or closing event before it is not an
    opening one: a repeated opening inside an open episode changes nothing.
    Events before the first opening have episode 0; those after a close belong
    to no episode until the next opening.
    """
    e = last_before(events.withColumn("__m", F.when(opens, 1).when(closes, 0)), F.col("__m"), "__was", lines)
    was = F.coalesce("__was", F.lit(0))
    e = running_sum(e, F.when((F.col("__m") == 1) & (was == 0), 1).otherwise(0), "episode", lines)
    inside = F.coalesce(F.col("__m") == 1, F.lit(False)) | (was == 1)
    return e.withColumn("in_episode", inside & (F.col("episode") > 0)).drop("__m", "__was")


def episode_rows(marked: DataFrame) -> DataFrame:
    """One row per episode: lines, counts, and states of completion, verification and failure."""
    inside = marked.where("in_episode").groupBy(BY, "episode")
    rows = inside.agg(
        F.min(LINE).alias("from_line"), F.max(LINE).alias("to_line"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events"),
        F.max_by("event_type", LINE).alias("last_type"), F.count_if(F.col("outcome") == "failed").alias("failures"), F.max(F.when(F.col("outcome") == "failed", F.col(LINE))).alias("last_failure"),
        F.max(F.when(F.col("outcome") == "observed", F.col(LINE))).alias("last_success"),
    )
    done = F.col("last_type") == "VERIFICATION"
    return rows.withColumns({
        "status": F.when(done, "completed").otherwise("open"),
        "verification_state": F.when(done, "success_observed").otherwise("unverified"),
        "failure_state": F.when(F.col("failures") == 0, "none").when(F.coalesce(F.col("last_success") > F.col("last_failure"), F.lit(False)), "recovered").otherwise("unresolved"),
    }).drop("last_type", "last_failure", "last_success")


def lifecycles(rows: DataFrame, key: str, status: str, first: str, last: str) -> DataFrame:
    """Per key: the status seen last, the number of events, the first event of the first and of the last status."""
    at = F.struct("ts", "event_id")
    return rows.groupBy(key).agg(
        F.max_by(status, at).alias("status"), F.count("*").alias("events"), F.min(F.when(F.col(status) == first, F.col("event_id"))).alias("first_created"),
        F.min(F.when(F.col(status) == last, F.col("event_id"))).alias("first_completed"), F.array_join(F.array_sort(F.collect_set(status)), ",").alias("kinds"),
    )


def correlate(calls: DataFrame, results: DataFrame, within: int | None = None, how: str = "inner") -> DataFrame:
    """Calls joined to later results of the same session and non-empty correlation id."""
    c = calls.where((F.col("correlation_id") != "")).select(BY, "correlation_id", F.col(LINE).alias("call_line"), F.col("event_id").alias("call_id"))
    r = results.where((F.col("correlation_id") != "")).select(F.col(BY).alias("s"), F.col("correlation_id").alias("c"), F.col(LINE).alias("result_line"), F.col("event_id").alias("result_id"), F.col("event_type").alias("result_type"))
    on = (F.col(BY) == F.col("s")) & (F.col("correlation_id") == F.col("c")) & (F.col("result_line") > F.col("call_line"))
    if within is not None:
        on = on & (F.col("result_line") <= F.col("call_line") + within)
    return c.join(r, on, how).drop("s", "c")


def nearby_foreign(events: DataFrame, call: Column, result: Column, reach: int, lines: int = STRETCH) -> DataFrame:
    """Results within reach rows of a call whose correlation id differs: the rejected ones, found by a bounded window, not a range join."""
    near = framed(events, F.when(result, F.struct(F.col("event_id").alias("result_id"), F.col("correlation_id").alias("other"))), "near", 1, reach, lines)
    return near.where(call).select(BY, F.col("event_id").alias("call_id"), "correlation_id", F.explode("near").alias("n")).where(F.col("n.other").isNotNull() & (F.col("n.other") != F.coalesce("correlation_id", F.lit("")))).select(BY, "call_id", "correlation_id", F.col("n.result_id").alias("result_id"))


def usage_chains(events: DataFrame, call: Column, result: Column, most: int = 5, lines: int = STRETCH) -> DataFrame:
    """Each call with the number of later results of its session and correlation id, and the first of them, at most most: (id, line).

    Counts and members are running values along the key, so a key of many calls
    and results makes no pairs. A call without a correlation id has no results.
    """
    key, held = (BY, "correlation_id"), F.col("correlation_id") != ""
    named = events.where(held)
    found = framed(named.where(result), F.struct("event_id", LINE), "__m", 0, most - 1, lines, key)
    e = named.where(call).withColumn("__m", F.lit(None).cast(found.schema["__m"].dataType)).unionByName(found)
    e = first_after(e, F.col("__m"), "members", lines, key)
    e = _backwards(running_sum(_backwards(e), F.when(F.col("__m").isNotNull(), 1).otherwise(0), "results", lines, key)).where(F.col("__m").isNull())
    alone = events.where(call & ~F.coalesce(held, F.lit(False))).withColumn("members", F.lit(None).cast(found.schema["__m"].dataType)).withColumn("results", F.lit(0).cast("long"))
    columns = [BY, "correlation_id", F.col("event_id").alias("call_id"), F.col(LINE).alias("call_line"), "results", "members"]
    return e.select(*columns).unionByName(alone.select(*columns))


def interior(events: DataFrame, opens: Column, lines: int = STRETCH) -> DataFrame:
    """Events strictly between two openings of their session, with the first one's id as span_id. Openings are carried along, not joined."""
    opens = F.coalesce(opens, F.lit(False))
    e = last_before(events, F.when(opens, F.col("event_id")), "span_id", lines)
    e = first_after(e, F.when(opens, F.col(LINE)), "__hi", lines)
    return e.where(~opens & F.col("span_id").isNotNull() & F.col("__hi").isNotNull()).drop("__hi")


def recovery(events: DataFrame, failed: Column, good: Column, lines: int = STRETCH) -> DataFrame:
    """Each failed event with the first later good event on the same key of its session."""
    return first_after(events, F.when(good, F.col("event_id")), "recovered_by", lines, (BY, "k")).where(failed)


def superseded(rows: DataFrame, ident: str, *by: str, order: str = "ts", part: Column | None = None) -> DataFrame:
    """Adds superseded_by, the next version of the same key, and valid for the last.

    part, which must rise with order, deals a key's rows over several tasks; one
    row a part tells the part before it who comes next.
    """
    r = rows.withColumn("__b", F.lit(0) if part is None else part)
    keys = (*by, "__b")
    r = r.withColumn("__l", F.lead(ident).over(Window.partitionBy(*keys).orderBy(order, ident)))
    first = r.groupBy(*keys).agg(F.min_by(ident, F.struct(order, ident)).alias("__f"))
    following_ = first.select(*_keys(keys), F.lead("__f").over(Window.partitionBy(*by).orderBy("__b")).alias("__n"))
    r = r.join(following_, _meets(keys), "left").withColumn("superseded_by", F.coalesce("__l", "__n"))
    return r.withColumn("valid", F.col("superseded_by").isNull()).drop("__b", "__l", "__n", *(f"__k{i}" for i in range(len(keys))))


def sequence_labels(sessions: DataFrame) -> DataFrame:
    """Adds the label date__ordinal__id, counting a day's sessions by start, then id; a day's hours are numbered apart."""
    s = numbered(sessions.withColumn("__h", F.hour("start")), "session_date", "__h", "start", BY)
    return s.withColumn("label", F.concat_ws("__", "session_date", F.format_string("%03d", F.col(LINE)), F.col(BY))).drop("__h", LINE)


def ranked_number_chains(events: DataFrame, call: Column, good: Column, value: str, lines: int = STRETCH) -> DataFrame:
    """Quantitative admission per (session, correlation id): exactly one call, at least two later good results, their numbers in falling order."""
    key = (BY, "correlation_id")
    e = over_all(events.where(F.col("correlation_id") != ""), key, lines, calls=(F.sum, F.when(call, 1).otherwise(0)), call_line=(F.min, F.when(call, F.col(LINE))))
    r = e.where(good).where(F.col(LINE) > F.col("call_line"))
    r = last_before(r, F.struct(F.col(value).alias("v")), "prev", lines, key)
    g = r.groupBy(*key).agg(F.first("calls").alias("calls"), F.count("*").alias("numbers"), F.count_if(F.col(value) > F.col("prev.v")).alias("rises"))
    return g.withColumn("admitted", (F.col("calls") == 1) & (F.col("numbers") >= 2) & (F.col("rises") == 0))


def since_first(events: DataFrame, start: Column, *keys: str, lines: int = STRETCH) -> DataFrame:
    """Adds, by keys, the first line of a start, the number of starts, and later: whether the event comes after the first."""
    e = over_all(events, keys, lines, first_start=(F.min, F.when(start, F.col(LINE))), starts=(F.sum, F.when(start, 1)))
    return e.withColumn("later", F.coalesce(F.col("first_start") < F.col(LINE), F.lit(False)))
