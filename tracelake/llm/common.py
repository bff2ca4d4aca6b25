"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import materialize, new_path

__all__ = ["discard", "join_spread", "materialize", "new_path", "table"]

#: A key with more than one in HOT of all rows is joined apart; there are fewer than HOT such keys, whatever the input.
HOT = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that was written to the shared folder and that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def join_spread(rows: DataFrame, named: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join of rows with named, which has one row per key and in n how many of the rows have it: any share of them.

    Keys with more than one in HOT of all rows number less than HOT: these are
    broadcast, and their rows stay where they are. The other rows are shuffled
    by key.
    """
    hot = F.col("n") * HOT > named.agg(F.sum("n")).scalar()
    few = named.where(hot).drop("n")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(named.where(~hot).drop("n"), key, how))
