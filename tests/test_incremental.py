"""Tables kept up to date by changed sessions: late rows, repeated and broken batches, untouched partitions."""

import os

import pytest
from pyspark.sql import functions as F

from tracelake.operators import events as E
from tracelake.plans.stream_queries import _marked
from tracelake.streaming.incremental import Maintained, Projection, Revision, Total

RAW = "event_id long, user string, n long"


def kept(root):
    rows = lambda e: e.groupBy("session_id", "key").agg(F.sum("n").alias("n"))
    state = lambda e: e.groupBy("session_id").agg(F.lit("all").alias("part"), F.count("*").alias("events"), F.max_by("key", "event_id").alias("last"))
    odd = lambda e: rows(e.where("n % 2 = 1 and event_id < 100"))
    typing = lambda raw: raw.select("event_id", F.col("user").alias("session_id"), F.concat(F.lit("k"), F.col("n") % 3).alias("key"), "n")
    return Maintained(str(root), F.col("user"), typing, [Projection("sums", rows), Projection("state", state), Projection("odd", odd)], [Total("totals", "sums", "key")], [Revision("revisions", "state", "part")], buckets=8)


FIRST = [(i, f"u{i % 5}", i) for i in range(20)] + [(50, None, 4)]
LATE = [(30, "u1", 7), (31, "u1", 8), (3, "u3", 3), (32, None, 9)]


def tables(k, spark):
    named = {"sums": ["session_id", "key", "n"], "state": ["session_id", "events", "last"], "odd": ["session_id", "key", "n"], "totals": ["key", "n", "sessions"]}
    return {t: sorted((tuple(r) for r in k.table(spark, t).select(c).collect()), key=repr) for t, c in named.items()}


def files(root, table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(os.path.join(root, table)) for f in names if f.endswith(".parquet")}


def test_two_batches_equal_a_rebuild_and_other_partitions_keep_their_files(spark, tmp_path):
    k, whole = kept(tmp_path / "a"), kept(tmp_path / "b")
    k.take(spark.createDataFrame(FIRST, RAW), 0)
    before = files(tmp_path / "a", "sums")
    k.take(spark.createDataFrame(LATE, RAW), 1)
    whole.take(spark.createDataFrame(list(dict.fromkeys(FIRST + LATE)), RAW), 0)
    assert tables(k, spark) == tables(whole, spark)
    touched = {r[0] for r in spark.createDataFrame(LATE, RAW).select(k._bucket("user")).collect()}
    after = files(tmp_path / "a", "sums")
    same = {p for p in before if after.get(p) == before[p]}
    assert same == {p for p in before if int(p.split("bucket=")[1].split("/")[0]) not in touched} and same
    got = {(r.session_id, r.old and r.old.events, r.new.events) for r in k.table(spark, "revisions").where("epoch = 1").collect()}
    assert got == {("u1", 4, 6), (None, 1, 2)}  # the row of u3 was there: it changes nothing


@pytest.mark.parametrize("broken", ["sums", "state", "totals"])
def test_a_batch_that_broke_while_it_was_published_counts_once(spark, tmp_path, broken):
    k, whole = kept(tmp_path / "a"), kept(tmp_path / "b")
    k.take(spark.createDataFrame(FIRST, RAW), 0)
    publish = k._publish

    def breaks(staged, name, full, touched):
        if name == broken:
            raise OSError("lost")
        publish(staged, name, full, touched)

    k._publish = breaks
    with pytest.raises(OSError):
        k.take(spark.createDataFrame(LATE, RAW), 1)
    k._publish = publish
    for _ in range(2):
        k.take(spark.createDataFrame(LATE, RAW), 1)
    whole.take(spark.createDataFrame(list(dict.fromkeys(FIRST + LATE)), RAW), 0)
    assert tables(k, spark) == tables(whole, spark)
    assert k.table(spark, "revisions").where("epoch = 1").count() == 2


def test_an_empty_delivery_changes_nothing(spark, tmp_path):
    k = kept(tmp_path / "a")
    k.take(spark.createDataFrame(FIRST, RAW), 0)
    was = tables(k, spark)
    k.take(spark.createDataFrame([], RAW), 1)
    assert tables(k, spark) == was


LOGS = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"


def logs(spark, n=240):
    """Events of five users, one of them with half of all, and of no user."""
    kinds = F.array(*(F.lit(k) for k in E.TYPING))
    user = F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 19 == 3, F.lit(None)).otherwise(F.col("id") % 5)
    return spark.range(n).select(
        F.col("id").alias("event_id"), user.cast("long").alias("user_id"), F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, id * 7919 % 100)").alias("ts"),
        kinds[(F.xxhash64("id") % 5 + 5) % 5].alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 3, F.lit("}")).alias("props"),
    ).to(spark.createDataFrame([], LOGS).schema)


def marks(root, large):
    rows = lambda s: s.groupBy("session_id", "line").agg(*(F.first(c).alias(c) for c in ("event_type", "segment", "role", "episode", "in_episode")))
    return Maintained(root, E.user_session(), lambda raw: _marked(E.whole_sessions(raw), None), [Projection("rows", rows)], buckets=4, spread=lambda raw: _marked(E.operational_events(raw), 7), large=large)


def test_sessions_that_are_spread_get_the_rows_of_whole_ones(spark, tmp_path):
    raw, got = logs(spark), []
    for name, large in (("whole", 10**6), ("both", 30), ("spread", 0)):
        k = marks(str(tmp_path / name), large)
        k.take(raw.where("event_id % 4 <> 1"), 0)
        k.take(raw.where("event_id % 4 = 1 or event_id < 40"), 1)
        got.append(sorted((tuple(r) for r in k.table(spark, "rows").drop("bucket").collect()), key=repr))
    assert got[0] == got[1] == got[2] and len(got[0]) == raw.count()


def test_whole_sessions_are_dealt_once_and_only_long_ones_are_spread(spark, tmp_path):
    seen = {}

    def keep(name):
        return lambda raw: seen.setdefault(name, raw).select("event_id", "session_id")

    rows = logs(spark).withColumn("session_id", E.user_session())
    Maintained(str(tmp_path), E.user_session(), keep("whole"), [], spread=keep("spread"), large=100)._typed(rows)
    assert {r[0] for r in seen["spread"].select("session_id").collect()} == {"u0"} and "u0" not in {r[0] for r in seen["whole"].select("session_id").collect()}
    plan = _marked(E.whole_sessions(rows.repartition("session_id").distinct()), None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_rows_of_changed_sessions_are_staged_apart(spark, tmp_path):
    k = kept(tmp_path)
    k.take(spark.createDataFrame(FIRST, RAW), 0)
    k.take(spark.createDataFrame(LATE, RAW), 1)
    staged = spark.read.parquet(f"{tmp_path}/stage/epoch=1/sums")
    sessions = {part: {r[0] for r in staged.where(F.col("staged") == part).select("session_id").collect()} for part in ("kept", "fresh", "gone")}
    assert sessions["fresh"] == sessions["gone"] == {"u1", "u3", None} and not sessions["kept"] & sessions["fresh"]
