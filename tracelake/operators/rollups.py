"""Counts, rollups and fingerprints. Every one is a grouped aggregate that combines before it shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import materialize
from .search import present
from .sequence import STRETCH, over_all


def entity_inventory(postings: DataFrame, *by: str) -> DataFrame:
    """Postings, distinct sessions and last date per key."""
    return postings.groupBy(*by).agg(F.count("*").alias("signal_count"), F.count_distinct("session_id").alias("session_count"), F.max("session_date").alias("last_date"))


def facet_inventory(facets: DataFrame, *by: str) -> DataFrame:
    """Signals (an entry counts once at least), distinct session ids or labels, last date."""
    return facets.groupBy(*by).agg(F.sum(F.greatest(F.coalesce("signal_count", F.lit(0)), F.lit(1))).alias("signal_total"), F.count_distinct(F.coalesce("session_id", "session_label")).alias("sessions"), F.max("session_date").alias("last_date"))


def facet_values(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per row, facet and value that is neither null nor ''; arrays give one per item."""
    typed = dict(rows.dtypes)
    pair = lambda c: F.transform(F.col(c) if typed[c].startswith("array") else F.array(F.col(c).cast("string")), lambda v: F.struct(F.lit(c).alias("facet"), v.cast("string").alias("value")))
    return rows.withColumn("__f", F.explode(F.concat(*[F.coalesce(pair(c), F.expr("cast(array() as array<struct<facet: string, value: string>>)")) for c in columns]))).withColumns({"facet": F.col("__f.facet"), "value": F.col("__f.value")}).drop("__f").where(present(F.col("value")))


def top_values(rows: DataFrame, k: int, *columns: str) -> DataFrame:
    """The k commonest values of each facet, ties by value, from one grouping."""
    counts = facet_values(rows.select(*columns), *columns).groupBy("facet", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def receipt_summary(receipts: DataFrame, *by: str) -> DataFrame:
    """Errors, hard failures, bridge failures and durations."""
    hard = F.coalesce(F.col("ok") == F.lit(False), F.lit(False))
    bridge = F.coalesce(F.col("typing_bridge.ok") == F.lit(False), F.lit(False))
    listed = F.coalesce(F.size("errors"), F.lit(0)) > 0
    return receipts.groupBy(*by).agg(
        F.count("*").alias("receipts"), F.count_if(hard | bridge | listed).alias("error_like"), F.count_if(hard).alias("hard_failures"), F.count_if(bridge).alias("bridge_failures"),
        F.count("duration_ms").alias("timed"), F.round(F.min("duration_ms"), 2).alias("min_ms"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.round(F.max("duration_ms"), 2).alias("max_ms"),
    )


def freshness_bucket(status: Column) -> Column:
    s = F.lower(F.btrim(F.coalesce(status, F.lit(""))))
    return F.when(s == "fresh", "fresh").when(s.isin("stale", "not_current", "dirty", "missing") | s.startswith("stale"), "stale").otherwise("unverifiable")


def quality_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by freshness, rows with a correlation id, and the latest row."""
    f = freshness_bucket(F.col("freshness_status"))
    return rows.groupBy(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c) for c in by]).agg(
        F.count("*").alias("n"), F.count_if(f == "fresh").alias("fresh"), F.count_if(f == "stale").alias("stale"), F.count_if(f == "unverifiable").alias("unverifiable"),
        F.count_if(present(F.col("correlation_id"))).alias("with_ref"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_event"),
    )


def route_rollup(rows: DataFrame, keys: Sequence[str], samples: int = 3) -> DataFrame:
    """Posting and session counts with the first few session ids of each key.

    Samples come from the distinct (key, session) pairs through a bounded
    window, so no group is collected whole.
    """
    pairs = rows.groupBy(*keys, "session_id").agg(F.count("*").alias("n"))
    counts = pairs.groupBy(*keys).agg(F.sum("n").alias("posting_count"), F.count("*").alias("session_count"))
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("session_id"))).where(F.col("r") <= samples)
    return counts.join(first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("session_id")), ",").alias("session_sample")), list(keys), "left")


def segment_facets(events: DataFrame, facets: Mapping[str, Column], samples: int = 5, lines: int = STRETCH) -> DataFrame:
    """Inverted facets of each (session, segment): per facet and value the number of events and the first lines. A facet is an array of an event's values; nulls don't count.

    Events are dealt by segment before their facets are laid out, so these are
    sorted and counted where they are. Only of sessions longer than a stretch
    are segments dealt by stretches, whose counts and first lines meet after.
    """

    def named(facet: str, values: Column) -> Column:
        return F.transform(F.array_compact(values), lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    by, line, first = ["session_id", "segment", "facet", "value"], F.col("line"), lambda x: F.slice(F.sort_array(x), 1, samples)
    e = over_all(events, ("session_id",), lines, __most=(F.max, line))
    e = materialize(e.select("session_id", "segment", "line", (F.col("__most") >= lines).alias("long"), F.flatten(F.array(*(named(*x) for x in facets.items()))).alias("f")), "facets")

    def counted(rows: DataFrame, *part: str) -> DataFrame:
        dealt = rows.repartition("session_id", "segment", *part)
        f = dealt.select("session_id", "segment", *part, "line", F.explode("f").alias("f")).select("session_id", "segment", *part, "f.facet", "f.value", "line")
        ranked = f.withColumn("r", F.row_number().over(Window.partitionBy(*by, *part).orderBy("line")))
        return ranked.groupBy(*by, *part).agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("r") <= samples, line)).alias("at"))

    whole = counted(e.where("not long")).select(*by, "n", first(F.col("at")).alias("at"))
    apart = counted(e.where("long").withColumn("part", F.floor(line / lines)), "part").groupBy(*by).agg(F.sum("n").alias("n"), first(F.flatten(F.collect_list("at"))).alias("at"))
    return whole.unionByName(apart).select(*by, "n", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("first_lines"))


def totals_by_basis(rows: DataFrame, session: str, basis: str, *measures: str) -> DataFrame:
    """Counts and sums per (session, basis) and per basis; never across bases."""
    per = rows.groupBy(session, basis).agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in measures])
    whole = per.groupBy(basis).agg(F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures])
    return per.unionByName(whole, allowMissingColumns=True)


def weighted_review(events: DataFrame, weights: Mapping[str, int], session: str = "session_id", large: int = 24, huge: int = 100, large_bonus: int = 30, huge_bonus: int = 100, deep: int = 100, standard: int = 20) -> DataFrame:
    """Sum of weights of a session's event types plus a bonus for its size, and the review band that follows."""
    w = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("event_type")), F.lit(0))
    s = events.groupBy(session).agg(F.sum(w).alias("weight"), F.count("*").alias("size"))
    score = F.col("weight") + F.when(F.col("size") >= huge, huge_bonus).when(F.col("size") >= large, large_bonus).otherwise(0)
    s = s.withColumn("score", score)
    return s.withColumn("band", F.when(F.col("score") >= deep, "deep").when(F.col("score") >= standard, "standard").when(F.col("score") >= 1, "sample").otherwise("none"))


def census_ratio(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.agg(F.count_if(condition).alias("numerator"), F.count("*").alias("denominator"), F.round(F.count_if(condition) / F.count("*"), 4).alias("ratio"))


def table_fingerprint(rows: DataFrame, group: Column, *columns: str) -> DataFrame:
    """Order-independent SHA-256 of a group's rows: the 256 buckets of row digests are each sorted and hashed, then their hashes."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    d = rows.select(group.alias("grp"), F.sha2(F.concat_ws("|", *map(cell, columns)), 256).alias("d"))
    counted = d.groupBy("grp", "d").agg(F.count("*").alias("n"))
    bucket = counted.groupBy("grp", F.substring("d", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "d", F.col("n").cast("string")))), ","), 256).alias("h"))
    return bucket.groupBy("grp").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "b", "h"))), ","), 256).alias("fingerprint"))


def flag_counts(rows: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    return rows.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def sizes(**tables: DataFrame) -> DataFrame:
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def promotion_candidates(postings: DataFrame, at_least: int, *by: str) -> DataFrame:
    return postings.groupBy(*by).agg(F.count_distinct("session_id").alias("session_count")).where(F.col("session_count") >= at_least)
