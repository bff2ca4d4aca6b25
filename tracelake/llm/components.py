"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the edges that are left; the
edges of each round go to a table in the shared folder, so a lost executor
costs one round at most. Nothing but three numbers a round reaches the driver.
A node with a large share of all edges is joined by broadcast, so its edges
stay dealt over all tasks; there are at most 2 * HOT such nodes. So is every
node while there are at most FEW edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, discard, new_path


#: Edges whose nodes are broadcast whole: a few megabytes.
FEW = 100_000


def _with_low(rows: DataFrame, low: DataFrame, edges: int) -> DataFrame:
    """rows(a, b) with m of low(a, m, n); hubs by broadcast."""
    if edges <= FEW:
        return rows.join(F.broadcast(low.select("a", "m")), "a")
    hub = F.col("n") * HOT > edges
    few = low.where(hub).select("a", "m")
    rest = rows.join(F.broadcast(few.select("a")), "a", "left_anti").join(low.where(~hub).select("a", "m"), "a")
    return rows.join(F.broadcast(few), "a").unionByName(rest)


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.union(e.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return _with_low(both.where("b > a"), low, edges).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return _with_low(down, low, edges).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a bigint, b bigint) -> (node bigint, root bigint): root is the smallest node reachable.

    Nodes on no edge, or only on edges to themselves, are absent. Null ends,
    repeated and reversed edges are allowed; an empty table gives an empty one.
    """

    def put(df: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = new_path(spark, "star")
        df.write.parquet(path)
        t = spark.read.schema("a bigint, b bigint").parquet(path)
        return path, t, tuple(t.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 7))")).first())

    first = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, e, seen = put(first)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        new_p, new_e, now = put(_small_star(_large_star(e, seen[0]), seen[0]))
        discard(spark, path)
        path, e = new_p, new_e
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
