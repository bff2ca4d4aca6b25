"""Approximate nearest neighbours by permutation index.

A vector is known by the order in which it sees a fixed set of pivots, nearest
first. It is posted under each pivot of the front of that order, with the
pivot's rank. A query reads the files of its own front pivots only, adds up the
footrule distance of the fronts, and measures exactly only the vectors ranked
best.

Vectors are dealt by hash into shards of a bounded size, each with its own
inverted files; queries travel to the shards in packed blocks and are read from
a stream, so a task holds one shard and one block. Equal vectors are indexed
once, with the few smallest ids a result can need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Pivots (rows with the smallest hash) and the length of a front: a vector is posted under a quarter of the pivots.
PIVOTS, FRONT = 512, 128


def usable(vec: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def smallest_hashes(rows: DataFrame, h: Column, n: int) -> DataFrame:
    """The n rows of smallest (signed) hash. Rows far above the expected cut are left out before sorting, so that little moves whatever the number of partitions."""
    total = rows.count()
    if total > 8 * n:
        rows = rows.where(h < F.lit(-(2**63) + int(2**64 * 4 * n / total)))
    return rows.orderBy(h).limit(n)


class PermutationShard:
    """Pivot inverted files over the rows of x."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, front: int):
        self.pivots, self.front = pivots, min(front, len(pivots))
        fronts = self.order(x)
        at = np.argsort(fronts.ravel(), kind="stable")
        self.rows = (at // self.front).astype(np.int32)
        self.ranks = (at % self.front).astype(np.int32)
        self.begin = np.searchsorted(fronts.ravel()[at], np.arange(len(pivots) + 1))
        self.n = len(x)

    def order(self, x: np.ndarray) -> np.ndarray:
        """The front of each row's pivot order."""
        d = (self.pivots**2).sum(1)[None] - 2 * x @ self.pivots.T
        return np.argsort(d, axis=1, kind="stable")[:, : self.front]

    def footrule(self, fronts: np.ndarray) -> np.ndarray:
        """Footrule distance of one query's front to that of every row of the shard, over the pivots of both: a pivot missing from a front counts as one past its end."""
        m = self.front
        total = np.full(self.n, m * (m + 1), np.int32)  # of fronts that share no pivot
        for i, p in enumerate(fronts):
            s, e = self.begin[p], self.begin[p + 1]
            total[self.rows[s:e]] -= 2 * np.minimum(m - i, m - self.ranks[s:e])
        return total


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, front: int = FRONT, rerank: float = 0.05, least: int = 128, shard_rows: int = 8192, block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that queries holds for, its k nearest found among the other ids, by Euclidean distance.

    The best rerank share of a shard by footrule (least rows at least) is
    measured. Rows whose vector is null, empty, zero or holds null or non-finite
    components, or whose id is null, take no part; a row repeated whole counts
    once. Vectors of several lengths are indexed apart, and only equal lengths
    compare; the lengths of a table are taken to be few. Fewer than k others: all
    of them. Other columns are not read. Empty input: empty result.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), queries.alias("asks")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    v = v.dropDuplicates(["id", "vec"])
    # The k + 1 smallest ids of equal vectors: one of them may be the query's own.
    first = v.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    own = materialize(first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("vec")), "vectors")
    found = None
    for r in own.groupBy(F.size("vec").alias("w")).count().orderBy("w").collect() or [None]:
        width = r.w if r else 1
        one = _search(own.where(F.size("vec") == width), v.where(F.col("asks") & (F.size("vec") == width)), width, r["count"] if r else 0, k, pivots, front, rerank, least, shard_rows, block)
        found = one if found is None else found.unionByName(one)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(own: DataFrame, asking: DataFrame, width: int, rows: int, k: int, pivots: int, front: int, rerank: float, least: int, shard_rows: int, block: int) -> DataFrame:
    """(query_id, vec_id, score) of each shard's k best among own(vec, ids, h) for asking(id, vec), all of one length."""
    chosen = np.array([r.vec for r in smallest_hashes(own, F.col("h"), pivots).collect()], float).reshape(-1, width)
    shards = max(1, -(-rows // shard_rows))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, part in b.groupby("shard"):
                yield pd.DataFrame({"shard": [s], "kind": [0], "seq": [int(part.ids.iloc[0][0])], "ids": [[list(i) for i in part.ids]], "data": [np.array(part.vec.tolist(), float).tobytes()]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), block):
                part = b.iloc[i : i + block]
                data = np.array(part.vec.tolist(), float).tobytes()
                ids = [[int(x)] for x in part.id]
                for s in range(shards):
                    yield pd.DataFrame({"shard": [s], "kind": [1], "seq": [ids[0][0]], "ids": [ids], "data": [data]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, xs, members, shard = None, [], [], None
        for b in batches:
            out = []
            for s, kind, ids, data in zip(b.shard, b.kind, b.ids, b.data):
                x = np.frombuffer(data, float).reshape(-1, width)
                if s != now:
                    now, xs, members, shard = s, [], [], None
                if kind == 0:
                    xs.append(x)
                    members += [np.asarray(i, np.int64) for i in ids]
                    continue
                if not xs:
                    continue
                if shard is None:
                    own_x = np.concatenate(xs)
                    shard = PermutationShard(own_x, chosen, front)
                budget = min(shard.n, max(least, int(np.ceil(rerank * shard.n))))
                for q, query, f in zip((int(i[0]) for i in ids), x, shard.order(x)):
                    rule = shard.footrule(f)
                    cand = np.argpartition(rule, budget - 1)[:budget]
                    dist = np.sqrt(((own_x[cand] - query) ** 2).sum(1))
                    near = dist <= (np.partition(dist, k)[k] if len(dist) > k else np.inf)
                    for i, d in sorted(((int(m), float(d)) for c, d in zip(cand[near], dist[near]) for m in members[c] if m != q), key=lambda t: (t[1], t[0]))[:k]:
                        out.append((q, i, d))
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    stored = own.withColumn("shard", F.expr(f"cast(pmod(h, {shards}) as int)")).select("shard", "ids", "vec").mapInPandas(pack, "shard int, kind int, seq long, ids array<array<long>>, data binary")
    asked = asking.select("id", "vec").mapInPandas(ask, "shard int, kind int, seq long, ids array<array<long>>, data binary")
    return stored.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "seq").mapInPandas(search, "query_id long, vec_id long, score double")
