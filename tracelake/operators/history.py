"""Histories as chained values: forks found by one equi-join, files proven whole by a tree of digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .sequence import STRETCH, running_sum

#: Hexadecimal digits of a digest that a lane of a chain takes: 44 bits, so that two million turns add up to less than 64.
LANE = 11
LANES = 4


def normalised(text: Column) -> Column:
    """Lower-case, white space as single blanks, none at the ends: what counts as the same evidence."""
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def chain(turns: DataFrame, session: str, line: str, evidence: Column, lines: int = STRETCH) -> DataFrame:
    """(session_id, line, chain): for each turn a value of all turns of its session up to it, in their order.

    A turn's digest covers its place and its normalised evidence (null counts as
    a text of its own). The chain is the sums of four lanes of these digests, of
    176 bits in all: sums run by stretches, so no session, however long, meets
    in one task, and equal values mean equal histories but for a chance of one
    in 2^150 or less.
    """
    own = F.sha2(F.concat_ws(":", F.col(line).cast("string"), F.coalesce(F.concat(F.lit("="), normalised(evidence)), F.lit("-"))), 256)
    t = turns.select(F.col(session).alias("session_id"), F.col(line).cast("long").alias("line"), own.alias("own"))
    for k in range(LANES):
        t = running_sum(t, F.conv(F.substring("own", 1 + k * LANE, LANE), 16, 10).cast("long"), f"lane{k}", lines)
    return t.select("session_id", "line", F.concat_ws(":", *[F.col(f"lane{k}").cast("string") for k in range(LANES)]).alias("chain"))


def fork_parents(chained: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(child, boundary, candidates, parent, verdict) of boundaries(child, boundary), the last line each child took over.

    A candidate is another session with the child's chain at its boundary. The
    parent is admitted only if there is exactly one; several are ambiguous, none
    is unmatched. Sessions are counted per chain before they are joined, so a
    popular history makes one row, not pairs.
    """
    at = chained.groupBy("line", "chain").agg(F.count_distinct("session_id").alias("n"), F.min("session_id").alias("least"), F.max("session_id").alias("most"))
    own = boundaries.join(chained, (F.col("child") == F.col("session_id")) & (F.col("boundary") == F.col("line")), "left").select("child", "boundary", F.col("chain").alias("__chain"))
    j = own.join(at, (F.col("boundary") == F.col("line")) & (F.col("__chain") == F.col("chain")), "left")
    others = F.coalesce(F.col("n") - 1, F.lit(0))
    parent = F.when(others == 1, F.when(F.col("least") == F.col("child"), F.col("most")).otherwise(F.col("least")))
    return j.select("child", "boundary", others.alias("candidates"), parent.alias("parent"), F.when(others == 1, "admitted").when(others > 1, "ambiguous").otherwise("unmatched").alias("verdict"))


def fork_groups(sessions: DataFrame, forks: DataFrame) -> DataFrame:
    """(shown, members) of sessions(session_id): each admitted fork is shown under its parent; a parent that is a fork itself stays as it is shown."""
    admitted = forks.where("verdict = 'admitted'").select(F.col("child").alias("session_id"), "parent")
    shown = sessions.select("session_id").distinct().join(admitted, "session_id", "left").select(F.coalesce("parent", "session_id").alias("shown"))
    return shown.groupBy("shown").agg(F.count("*").alias("members"))


def file_digests(lines: DataFrame, fan: int = 1000) -> DataFrame:
    """(file, lines, digest) of lines(file, line from 1, raw): a tree of digests, fan of them under each.

    A leaf is the digest of a line; runs of fan neighbours become one digest of
    the next level until a file has a single one. No level collects more than
    fan digests in one place. A null line counts as an empty one; a file without
    lines is absent.
    """
    level = lines.select("file", (F.col("line") - 1).alias("at"), F.sha2(F.coalesce("raw", F.lit("")), 256).alias("digest"), F.lit(1).cast("long").alias("n"))
    while True:
        up = level.groupBy("file", F.floor(F.col("at") / fan).alias("at")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"), F.sum("n").alias("n"))
        level = materialize(up, "digests")
        if not level.where("at > 0").limit(1).count():
            return level.select("file", F.col("n").alias("lines"), "digest")


def absence(lines: DataFrame, manifest: DataFrame, found: Column, fan: int = 1000) -> DataFrame:
    """(file, scanned, complete, absent) of manifest(file, lines, digest): what is looked for is proven absent from a file only if every line was scanned.

    complete: as many lines as the manifest names, with its digest; one lost,
    added, changed or moved line fails it. A file of the manifest that was not
    scanned is incomplete.
    """
    hits = lines.groupBy("file").agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("hit"))
    seen = file_digests(lines, fan).join(hits, "file").select(F.col("file").alias("__f"), F.col("lines").alias("scanned"), F.col("digest").alias("__d"), "hit")
    j = manifest.join(seen, F.col("file") == F.col("__f"), "left")
    complete = F.coalesce((F.col("scanned") == F.col("lines")) & (F.col("__d") == F.col("digest")), F.lit(False))
    return j.select("file", F.coalesce("scanned", F.lit(0)).alias("scanned"), complete.alias("complete"), (complete & ~F.coalesce("hit", F.lit(True))).alias("absent"))
