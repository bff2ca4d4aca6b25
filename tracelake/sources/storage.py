"""Tables in the folder that all executors share: written once, read back, replaced by partition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary folder on one machine, and an error on a cluster, whose executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_projection(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """Rebuild a projection whole, partitioned for pruning; returns it as read back."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_partitions(df: DataFrame, path: str, *partition: str) -> DataFrame:
    """Replace only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
    return df.sparkSession.read.parquet(path)


def prune_months(df: DataFrame, column: str, last: int) -> DataFrame:
    """Rows of the newest months; the month list is read from the table's own distinct months (few), so the filter prunes partitions."""
    months = [r[0] for r in df.select(column).distinct().orderBy(F.desc(column)).limit(last).collect()]
    return df.where(F.col(column).isin(months)) if months else df.limit(0)
