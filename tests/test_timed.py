"""Timed episodes of many sessions in few buckets: state is kept by bucket, results by session."""

from pyspark.sql import functions as F

from tracelake.streaming.episodes import resume, timed_episodes


def plain(rows):
    """(session, episode, events, opened_by, closed_by) of rows in order of time and id."""
    out, state = [], {}
    for _, ident, session, kind in sorted(rows, key=lambda r: (r[0], r[1])):
        inside, number, count, first = state.get(session, (False, 0, 0, 0))
        if not inside and kind == "in":
            inside, number, count, first = True, number + 1, 0, ident
        if inside:
            count += 1
            if kind == "out":
                inside = False
                out.append((session, number, count, first, ident))
        state[session] = (inside, number, count, first)
    return out


def test_few_buckets_hold_many_sessions_and_late_rows_count_in_their_order(spark, tmp_path):
    name = lambda i: None if i % 40 == 7 else f"s{i % 40}"
    rows = [(1000 * 3600 + 30 * i, i, name(i * 17), ["in", "x", "out"][i * 7 % 11 % 3]) for i in range(2000)]
    last = [(rows[-1][0] + 40 * 3600, 9999, "end", "x")]
    late = [r for r in rows if r[1] % 6 == 5]
    path, got = str(tmp_path / "in"), None
    for part in ([r for r in rows if r[1] % 6 != 5 and r[1] < 1500], [r for r in rows if r not in late and r[1] >= 1500] + late, last):
        df = spark.createDataFrame(part, "t long, event_id long, session_id string, kind string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
        df.write.mode("append").parquet(path)
        flow = timed_episodes(spark.readStream.schema(df.schema).parquet(path), F.col("kind") == "in", F.col("kind") == "out", "24 hours", buckets=3)
        got = resume(flow, str(tmp_path / "out"), str(tmp_path / "mark"))
    want = plain(rows)
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key) and len(want) > 100
