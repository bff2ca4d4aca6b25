"""Forks by whole histories and proofs of complete scans, on small tables."""

import pytest

from tracelake.operators import history as H


@pytest.mark.parametrize("lines", [65_536, 2])
def test_forks_have_one_parent_by_their_whole_history(spark, lines):
    turns = {1: "abcd", 2: "abXd", 3: "bacd", 11: "ab!", 12: "abc!", 13: "abcd", 14: "zz", 15: "ba-", 16: "a"}
    rows = [(s, i + 1, (" A  b " if t == "b" else t)) for s, text in turns.items() for i, t in enumerate(text)] + [(15, 4, None), (3, 5, "")]
    df = spark.createDataFrame(rows, "s long, line long, text string")
    forks = spark.createDataFrame([(11, 2), (12, 3), (13, 4), (14, 1), (15, 2), (16, 1), (99, 1)], "child long, boundary long")
    from pyspark.sql import functions as F

    got = {r.child: (r.candidates, r.parent, r.verdict) for r in H.fork_parents(H.chain(df, "s", "line", F.col("text"), lines), forks).collect()}
    # 11 shares "ab" with 1, 2, 12 and 13; 12 "abc" with 1 and 13; 13 all with 1; 15 "ba" with 3; 16 "a" with four.
    assert got == {11: (4, None, "ambiguous"), 12: (2, None, "ambiguous"), 13: (1, 1, "admitted"), 14: (0, None, "unmatched"), 15: (1, 3, "admitted"), 16: (5, None, "ambiguous"), 99: (0, None, "unmatched")}
    groups = {r.shown: r.members for r in H.fork_groups(df.selectExpr("s as session_id"), H.fork_parents(H.chain(df, "s", "line", F.col("text")), forks)).collect()}
    assert groups == {1: 2, 2: 1, 3: 2, 11: 1, 12: 1, 14: 1, 16: 1}


def test_swapped_turns_are_another_history(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "a"), (3, 1, None), (4, 1, "")], "s long, line long, text string")
    got = {(r.session_id, r.line): r.chain for r in H.chain(df, "s", "line", F.col("text")).collect()}
    assert got[1, 2] != got[2, 2] and got[3, 1] != got[4, 1]


@pytest.mark.parametrize("fan", [3, 1000])
def test_any_changed_line_fails_the_proof(spark, fan):
    from pyspark.sql import functions as F

    rows = [("a", i + 1, f"line {i}") for i in range(40)] + [("b", 1, None), ("c", 1, "needle"), ("d", 1, "x")]
    df = spark.createDataFrame(rows, "file string, line long, raw string")
    manifest = H.file_digests(df, fan)
    look = lambda t: {r.file: (r.scanned, r.complete, r.absent) for r in H.absence(t, manifest, F.contains("raw", F.lit("needle")), fan).collect()}
    assert look(df.where("file <> 'd'")) == {"a": (40, True, True), "b": (1, True, True), "c": (1, True, False), "d": (0, False, False)}
    swapped = F.when(F.col("line") == 7, 8).when(F.col("line") == 8, 7).otherwise(F.col("line"))
    for other in (df.where("line <> 40"), df.where("line < 40"), df.withColumn("raw", F.when(F.col("line") == 23, "other").otherwise(F.col("raw"))), df.withColumn("line", swapped), df.unionByName(spark.createDataFrame([("a", 41, "")], df.schema))):
        assert look(other)["a"][1:] == (False, False)
