"""Stored projections: tables derived once from their inputs, with a generation, and read by many queries.

A projection's generation is a digest of its name, its version and the state of
its inputs (path, bytes, files, time of change); it names the folder the rows
are in. A reader asks for the generation of the inputs as they are now: rows of
another generation are never an answer, and a folder whose write did not finish
is written anew. Rows are clustered and sorted as readers filter them, and
partition columns are folders, so scans prune by partition and by row group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .storage import shared_dir


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def input_state(spark: SparkSession, path: str) -> list:
    """Path, bytes, files and time of change of a table's folder or file."""
    fs, p = _folder(spark, path)
    inside = fs.getContentSummary(p)
    return [path, inside.getLength(), inside.getFileCount(), fs.getFileStatus(p).getModificationTime()]


def generation(spark: SparkSession, name: str, inputs: Sequence[str], version: str) -> str:
    said = json.dumps([name, version, [input_state(spark, i) for i in inputs]])
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def stored(
    spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame], cluster: Sequence = (), order: Sequence[str] = (), partition: Sequence[str] = (), version: str = "1", root: str | None = None
) -> DataFrame:
    """The projection's rows for the inputs as they are, written first if they are not there.

    cluster: what rows are dealt over tasks by; order: how they are sorted in
    each file; partition: columns that become folders. build gives the rows; it
    is also asked for its columns when they are only read.
    """
    path = f"{root or shared_dir(spark)}/projections/{name}/generation-{generation(spark, name, inputs, version)}"
    fs, done = _folder(spark, f"{path}/_SUCCESS")
    df = build()
    if not fs.exists(done):
        rows = df.repartition(*cluster) if cluster else df
        rows = rows.sortWithinPartitions(*partition, *order) if order else rows
        rows.write.mode("overwrite").partitionBy(*partition).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
