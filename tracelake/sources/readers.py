"""Transcripts, receipts and captures: lines kept whole, what can't be parsed counted and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize

TRANSCRIPT = "timestamp string, type string, payload struct<id: string, cwd: string, model: string, type: string, role: string, content: array<struct<type: string, text: string>>, name: string, namespace: string, call_id: string, arguments: string, output: string>"
RECEIPT = "timestamp string, hook_event_name string, ok boolean, session_id string, actions array<string>, errors array<string>, duration_ms double, typing_bridge struct<ok: boolean, adapter: string, returncode: int, stderr_head: string>, _corrupt string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line from 1, raw) of every line of the text files, exact however many tasks read a file.

    Spark splits large files into blocks at line ends. Lines are written once
    with their block and a number that grows within it; then only the lines of
    each block are counted, the counts are summed up along each file, and a
    line's number is its place in its block plus the lines of the blocks before.
    No file, and no whole block, is one value. Empty lines count; a line end at
    the end of a file starts no line; a carriage return before it is dropped.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("raw"))
    rows = materialize(rows, "lines")
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "raw")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of each JSONL file: file, line from 1, raw text, parse status, and the parsed struct."""
    return parse_transcript(read_lines(spark, path))


def parse_transcript(lines: DataFrame) -> DataFrame:
    parsed = F.from_json("raw", TRANSCRIPT)
    status = F.when(F.try_parse_json("raw").isNull(), "unparsable").when(~F.col("raw").startswith("{"), "not_object").otherwise("parsed")
    return lines.withColumns({"status": status, "event": parsed})


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipts as a struct table; lines that are no JSON object are kept in _corrupt."""
    return spark.read.schema(RECEIPT).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def transcript_events(lines: DataFrame) -> DataFrame:
    """Typed events of parsed transcript lines: messages by role, calls, and results by call id."""
    e = F.col("event")
    kind = (
        F.when(e["type"] == "session_meta", "SESSION_META").when(e["payload"]["type"] == "function_call", "TOOL_CALL").when(e["payload"]["type"] == "function_call_output", "TOOL_OUTPUT")
        .when(e["payload"]["role"] == "user", "USER_INTENT").when(e["payload"]["role"] == "assistant", "ASSISTANT_MESSAGE").otherwise("RAW_EVENT")
    )
    text = F.coalesce(F.array_join(e["payload"]["content"]["text"], "\n"), e["payload"]["output"], e["payload"]["arguments"])
    failed = F.contains(F.coalesce(e["payload"]["output"], F.lit("")), F.lit('"ok":false')) | (F.regexp_extract(F.coalesce(e["payload"]["output"], F.lit("")), "exited with code ([0-9]+)", 1).isin("", "0") == F.lit(False))
    return lines.select(
        F.col("file").alias("session_id"), "line", F.try_to_timestamp(e["timestamp"]).alias("ts"), kind.alias("event_type"), e["payload"]["call_id"].alias("correlation_id"), e["payload"]["name"].alias("tool"), text.alias("text"),
        F.when(kind == "TOOL_OUTPUT", F.when(failed, "failed").otherwise("observed")).when(kind == "TOOL_CALL", "requested").otherwise("observed").alias("outcome"),
    )


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per distinct content: the same bytes captured twice are one capture."""
    files = spark.read.format("binaryFile").load(path)
    c = files.withColumn("t", F.decode("content", "UTF-8")).select("path", F.sha2("content", 256).alias("raw_sha256"), F.col("length").alias("bytes"), F.expr("length(t) - length(replace(t, '\\n', '')) + 1").alias("lines"))
    return c.groupBy("raw_sha256").agg(F.min("path").alias("path"), F.max("bytes").alias("bytes"), F.max("lines").alias("lines"), F.count("*").alias("captured"))


def missing_or_stale(available: DataFrame, archive: DataFrame, *key: str, digest: str = "raw_sha256") -> DataFrame:
    """Rows of available that the archive lacks (state missing) or holds with another digest only (stale)."""
    known = archive.groupBy(*key).agg(F.collect_set(digest).alias("__known"))
    j = available.join(known, list(key), "left")
    same = F.coalesce(F.array_contains("__known", F.col(digest)), F.lit(False))
    return j.where(~same).withColumn("state", F.when(F.col("__known").isNull(), "missing").otherwise("stale")).drop("__known")
