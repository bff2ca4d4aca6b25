"""Projections that a stream keeps up to date: changed sessions are recomputed, their partitions replaced, totals follow.

A micro-batch names the sessions it changes. These are derived anew from the
log, whole, so rows that come late re-open what they belong to; other sessions
of the same partition are carried over, other partitions keep their files.
Totals over sessions change by the difference of old and new rows.

Each batch first stages everything it will publish, then replaces partitions
from the stage. A batch that is repeated after a failure finds its stage whole
and publishes it again, or stages anew from what was not yet replaced, so it
counts once. Stage, log and checkpoint lie under one folder, as batch numbers
mean something only together.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..sources.storage import materialize
from ..sources.store import _folder


class Projection(NamedTuple):
    """build: from the typed events of whole sessions to rows with a session_id."""

    name: str
    build: Callable[[DataFrame], DataFrame]


class Total(NamedTuple):
    """Rows (key, n, sessions): the sum of n, and the number of rows, of the projection of, by key. That projection has one row per session and key."""

    name: str
    of: str
    key: str


class Revision(NamedTuple):
    """Rows (session_id, key, old, new, epoch): what a batch made of the projection of; old and new are structs of its columns, null where there is none."""

    name: str
    of: str
    key: str


def _there(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def _buckets_in(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the bucket folders of a table, from its listing."""
    fs, p = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def _staged_in(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the buckets of a staged projection that will have rows."""
    parts = [f"{path}/staged={part}" for part in ("kept", "fresh")]
    return sorted({b for p in parts if _there(spark, p) for b in _buckets_in(spark, p)})


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*(f for f in schema if f.name != "bucket")]).add("bucket", IntegerType())


class Maintained:
    """Tables under root, kept up to date from deliveries of raw events.

    session makes a raw row's session_id, typing turns raw rows of whole
    sessions into the events that projections are built from. A row delivered
    again whole counts once. Null sessions are one session. buckets is the
    number of partitions of each table; the lists of those a batch touches are
    all that reaches the driver. Columns named bucket and staged are reserved.

    Where spread is given, typing gets only sessions of at most large rows,
    dealt by session_id, so its windows over whole sessions need no further
    shuffle; spread is the same for longer sessions, which no task should hold
    whole. Of these there are fewer than one in large rows.
    """

    def __init__(
        self, root: str, session: Column, typing: Callable[[DataFrame], DataFrame], projections: list[Projection], totals: list[Total] = (), revisions: list[Revision] = (), buckets: int = 64,
        spread: Callable[[DataFrame], DataFrame] | None = None, large: int = 65_536,
    ):
        self.root, self.session, self.typing, self.buckets = root, session, typing, buckets
        self.projections, self.totals, self.revisions = projections, totals, revisions
        self.spread, self.large = spread, large

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, path: str, schema: StructType) -> DataFrame:
        """The table, or no rows of its schema while it is not there."""
        fs, p = _folder(spark, path)
        fs.mkdirs(p)
        return spark.read.schema(schema).parquet(path)

    def _stage(self, rows: DataFrame, path: str, *parts: str) -> DataFrame:
        """rows as staged, a folder a part and bucket; what is staged whole already stays."""
        if not _there(rows.sparkSession, f"{path}/_SUCCESS"):
            rows.hint("rebalance", *parts, "bucket").write.mode("overwrite").partitionBy(*parts, "bucket").parquet(path)
        return rows.sparkSession.read.schema(_with_bucket(rows.schema)).parquet(path)

    def _typed(self, rows: DataFrame) -> DataFrame:
        """Typed events of raw rows with their session_id, each row once."""
        if not self.spread:
            return self.typing(rows.distinct())
        sizes = rows.groupBy("session_id").agg(F.count("*").alias("__n")).where(F.col("__n") > self.large)
        long = materialize(sizes.select(F.col("session_id").alias("__long")), "long")
        if long.isEmpty():
            return self.typing(rows.repartition("session_id").distinct())
        of = lambda how: rows.join(F.broadcast(long), rows["session_id"].eqNullSafe(long["__long"]), how)
        return self.typing(of("left_anti").repartition("session_id").distinct()).unionByName(self.spread(of("left_semi").distinct()))

    def _publish(self, staged: DataFrame, name: str, full: list[int], touched: list[int]) -> None:
        """Replace the touched partitions by the staged ones; those that have no rows any more go."""
        if full:
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")
        for b in set(touched) - set(full):
            _drop(staged.sparkSession, f"{self.root}/{name}/bucket={b}")

    def take(self, batch: DataFrame, epoch: int) -> None:
        """Carry one micro-batch through all tables."""
        spark, stage = batch.sparkSession, f"{self.root}/stage/epoch={epoch}"
        _drop(spark, f"{self.root}/stage/epoch={epoch - 1}")
        log = batch.withColumn("session_id", self.session).withColumn("bucket", self._bucket("session_id"))
        log.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/log/epoch={epoch}")
        new = spark.read.schema(_with_bucket(log.schema)).parquet(f"{self.root}/log/epoch={epoch}")
        touched = _buckets_in(spark, f"{self.root}/log/epoch={epoch}")
        if not touched:
            return
        rows, sessions = new.drop("bucket"), new.select(F.col("session_id").alias("__dirty")).distinct()
        there = [p for p in self.projections if _there(spark, f"{self.root}/{p.name}")]
        earlier = any(_there(spark, f"{self.root}/log/epoch={k}") for k in range(epoch))
        followed = {x.of for x in (*self.totals, *self.revisions)}
        dirty = materialize(sessions.withColumn("__changed", F.lit(True)), "dirty") if there or earlier else sessions
        among = lambda rows, how: rows.join(dirty, rows["session_id"].eqNullSafe(dirty["__dirty"]), how)
        if earlier:
            known = spark.read.schema(_with_bucket(log.schema).add("epoch", IntegerType())).parquet(f"{self.root}/log").where(F.col("bucket").isin(touched) & (F.col("epoch") < epoch))
            rows = rows.unionByName(among(known, "left_semi").drop("epoch", "bucket"))
        typed = materialize(self._typed(rows), "typed")

        ready: list[tuple[DataFrame, str, list[int]]] = []
        before, after = {}, {}
        for p in self.projections:
            # Staged apart: rows of other sessions as they were, rows of changed sessions as they are now, and, where something follows from them, as they were.
            fresh = p.build(typed).withColumn("bucket", self._bucket("session_id"))
            rows = fresh.withColumn("staged", F.lit("fresh"))
            if p in there:
                old = self._read(spark, f"{self.root}/{p.name}", _with_bucket(fresh.schema)).where(F.col("bucket").isin(touched))
                was = among(old, "left").withColumn("staged", F.when(F.col("__changed"), "gone").otherwise("kept")) if p.name in followed else among(old, "left_anti").withColumn("staged", F.lit("kept"))
                rows = rows.unionByName(was.select(rows.columns))
            staged = self._stage(rows, f"{stage}/{p.name}", "staged")
            before[p.name], after[p.name] = (staged.where(F.col("staged") == part).drop("staged") for part in ("gone", "fresh"))
            ready.append((staged.where("staged <> 'gone'").drop("staged"), p.name, touched))
        for t in self.totals:
            signed = lambda rows, sign: rows.select(t.key, (F.col("n") * sign).alias("n"), F.lit(sign).cast("long").alias("sessions"))  # noqa: B023, E731
            summed = lambda rows: rows.groupBy(t.key).agg(F.sum("n").alias("n"), F.sum("sessions").alias("sessions"))  # noqa: B023, E731
            change = summed(signed(after[t.of], 1).unionByName(signed(before[t.of], -1))).where("n <> 0 or sessions <> 0").withColumn("bucket", self._bucket(t.key))
            change = self._stage(change, f"{stage}/{t.name}-change")
            moved = _buckets_in(spark, f"{stage}/{t.name}-change")
            old = self._read(spark, f"{self.root}/{t.name}", change.schema).where(F.col("bucket").isin(moved))
            now = summed(old.drop("bucket").unionByName(change.drop("bucket"))).where("sessions <> 0").withColumn("bucket", self._bucket(t.key))
            ready.append((self._stage(now, f"{stage}/{t.name}"), t.name, moved))
        for r in self.revisions:
            path = f"{self.root}/{r.name}/epoch={epoch}"
            if not _there(spark, f"{path}/_SUCCESS"):
                had = before[r.of] if _there(spark, f"{stage}/{r.of}/staged=gone") else None
                self._revised(had, after[r.of], r.key).write.mode("overwrite").parquet(path)
        for staged, name, which in ready:
            self._publish(staged, name, (_staged_in if name in after else _buckets_in)(spark, f"{stage}/{name}"), which)

    @staticmethod
    def _revised(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
        """Rows that are not the same on both sides, which meet by session and key without a join of sides. Without an old side all are new."""
        values = [c for c in new.columns if c not in ("session_id", key, "bucket")]
        if old is None:
            row = F.struct(*values)
            return new.select("session_id", key, F.when(F.lit(False), row).alias("old"), row.alias("new"))
        side = lambda rows, name: rows.select("session_id", key, F.lit(name).alias("__side"), F.struct(*values).alias("__row"))
        both = side(old, "old").unionByName(side(new, "new")).groupBy("session_id", key)
        met = both.agg(*(F.max(F.when(F.col("__side") == s, F.col("__row"))).alias(s) for s in ("old", "new")))
        return met.where(~F.col("old").eqNullSafe(F.col("new")))

    def run(self, stream: DataFrame) -> None:
        """Take all that is there; run again, it goes on where it stopped."""
        stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(self.take).trigger(availableNow=True).start().awaitTermination()

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{name}")
