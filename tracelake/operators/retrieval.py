"""Batch search over a table of queries: exact, lexical, dense, fused."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import lexical


def exact_hits(docs: DataFrame | lexical.Index, queries: DataFrame, ident: str = "doc_id", text: str = "text", put: lexical.Put | None = None) -> DataFrame:
    """(query_id, ident): documents holding every term of a query; docs may be an index of them. Otherwise only the forward table is made, and kept by put."""
    forward = docs.forward if isinstance(docs, lexical.Index) else lexical.build_forward(docs, ident, text, **({"put": put} if put else {}))
    return lexical.exact_hits(forward, queries).withColumnRenamed("doc", ident)


def bm25(docs: DataFrame | lexical.Index, queries: DataFrame, k: int = 10, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best documents of each query by BM25: (query_id, ident, score, rank); docs may be an index of them. Ties, at six digits, by id."""
    index = docs if isinstance(docs, lexical.Index) else lexical.build_index(docs, ident, text)
    return lexical.search(index, queries, k).withColumnRenamed("doc", ident)


def top(rows: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_top(vectors: DataFrame, asks: Column, k: int, ident: str = "vec_id", vec: str = "embedding", shard_rows: int = 16_384, block: int = 1024) -> DataFrame:
    """(query_id, ident, score): for each row that asks holds for, its k best by cosine (six digits, ties by id) in each shard of all other rows.

    Vectors are dealt by hash into shards of a bounded size; queries travel to
    every shard in packed blocks and are read from a stream. Null and empty
    vectors take no part; all others must be of one length.
    """
    v = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), asks.alias("asks")).where(F.size("v") > 0)
    shards = max(1, -(-v.count() // shard_rows))
    packed = "shard int, kind int, seq long, ids binary, data binary"

    def put(part: pd.DataFrame) -> tuple:
        return int(part.id.iloc[0]), part.id.to_numpy(np.int64).tobytes(), np.array(part.v.tolist(), float).tobytes()

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, part in b.groupby("shard"):
                yield pd.DataFrame([(s, 0, *put(part))], columns=["shard", "kind", "seq", "ids", "data"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), block):
                own = put(b.iloc[i : i + block])
                yield pd.DataFrame([(s, 1, *own) for s in range(shards)], columns=["shard", "kind", "seq", "ids", "data"])

    def unit(data: bytes, n: int) -> np.ndarray:
        x = np.frombuffer(data, float).reshape(n, -1)
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, names = None, [], []
        for b in batches:
            for s, kind, ids, data in zip(b.shard, b.kind, b.ids, b.data):
                if s != now:
                    now, held, names = s, [], []
                name = np.frombuffer(ids, np.int64)
                x = unit(data, len(name))
                if not kind:
                    held.append(x)
                    names.append(name)
                elif held:
                    if len(held) > 1 or not (np.diff(names[0]) >= 0).all():
                        order = np.argsort(np.concatenate(names), kind="stable")
                        held, names = [np.concatenate(held)[order]], [np.concatenate(names)[order]]
                    score = np.round(x @ held[0].T, 6)
                    score[name[:, None] == names[0][None]] = -np.inf
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    out = pd.DataFrame({"query_id": np.repeat(name, best.shape[1]), ident: names[0][best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})
                    yield out[np.isfinite(out.score)]

    stored = v.withColumn("shard", F.expr(f"cast(pmod(xxhash64(id), {shards}) as int)")).select("shard", "id", "v").mapInPandas(hold, packed)
    asked = v.where("asks").select("id", "v").mapInPandas(ask, packed)
    return stored.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "seq").mapInPandas(search, f"query_id long, {ident} long, score double")


def fuse(lanes: dict[str, DataFrame], ident: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lanes of (query_id, ident, rank). k chosen here: 60."""
    all_ = None
    for name, lane in lanes.items():
        one = lane.select("query_id", ident, "rank", F.lit(name).alias("lane"))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy("query_id", ident).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 8).alias("fused"), F.count("*").alias("lanes"))


def anchored(fused: DataFrame, sparse: DataFrame, anchors: DataFrame, ident: str, k: int = 60, margin: float = 1.25) -> DataFrame:
    """fused with one more vote of rank one, and bonus true, for a query's best hit of the sparse lane (query_id, ident, rank, score) if that is an anchor and leads the next by the margin (a factor chosen here)."""
    two = sparse.where("rank <= 2").groupBy("query_id").agg(F.min_by(ident, "rank").alias(ident), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("lead"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next"))
    sure = two.where(F.col("next").isNull() | (F.col("lead") >= margin * F.col("next"))).join(anchors.select("query_id", ident), ["query_id", ident], "left_semi")
    j = fused.join(sure.select("query_id", ident, F.lit(True).alias("bonus")), ["query_id", ident], "left").withColumn("bonus", F.coalesce("bonus", F.lit(False)))
    return j.withColumn("fused", F.round(F.col("fused") + F.when(F.col("bonus"), 1 / (k + 1)).otherwise(0), 8))


# The names of the recipes. Which events each calls for is chosen here.
RECIPES = {
    "continue-session": "true", "continue-techniques-session": "event_type IN ('TOOL_CALL', 'TOOL_OUTPUT')", "hook-failure": "outcome = 'failed' AND actor = 'tool'", "manual-review": "outcome = 'failed' AND session_failures >= 10",
    "naming-candidate": "event_type = 'USER_INTENT'", "process-lessons": "event_type = 'VERIFICATION'", "repeated-errors": "outcome = 'failed' AND failing_sessions >= 2",
}


def recipe_hits(events: DataFrame, limit: int) -> DataFrame:
    """(recipe, session_id, event_id, place, continuation): the newest hits of each recipe and session, and whether the session goes on.

    A session is closed if it ends in a verification. Its counts and those of
    its error keys are added by joins on the groups.
    """
    failed = F.col("outcome") == "failed"
    s = events.groupBy("session_id").agg(F.count_if(failed).alias("session_failures"), F.max_by("event_type", F.struct("ts", "event_id")).alias("__last"))
    k = events.where(failed).groupBy("k").agg(F.count_distinct("session_id").alias("failing_sessions"))
    e = events.join(s, "session_id").join(k, "k", "left")
    named = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in RECIPES.items()]))
    hits = e.select("session_id", "event_id", "ts", F.when(F.col("__last") == "VERIFICATION", "closed").otherwise("open").alias("continuation"), F.explode(named).alias("recipe"))
    w = Window.partitionBy("recipe", "session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("recipe", "session_id", "event_id", "place", "continuation")


def query_shape(q: Column) -> Column:
    """entity, command, path, error, class or phrase."""
    return (
        F.when(q.rlike("^[a-z_]+:[^ ]+$"), "entity").when(q.rlike("^(git|python|pip|make|npm|cargo) "), "command").when(q.rlike("^/?([A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]*$"), "path")
        .when(q.rlike("(?i)(error|exception|failed)"), "error").when(q.rlike("^[A-Z][A-Za-z0-9]*$"), "class").otherwise("phrase")
    )
