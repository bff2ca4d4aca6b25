"""Embedding near-duplicates by epsilon grid order join.

On unit vectors a cosine of c or more is a Euclidean distance of at most
eps = sqrt(2 - 2c). Vectors are sorted by label and by their grid cells (side
eps) on leading principal dimensions, and the sorted sequence is cut into
blocks. Blocks of one label whose bounding boxes lie further apart than eps
never meet; the others are joined recursively: two intervals of the sequence are
dropped if their boxes are too far apart, halved if they are long, and compared
by one matrix product when short. Every meeting gives link counts and a spanning
forest, not the pairs. The principal axes come from a bounded sample and, being
a rotation, cannot change which pairs link, only how much is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import smallest_hashes, usable
from .common import join_spread, materialize
from .components import connected_components
from .simhash import forest

SAMPLE = 4096
LEAF = 128
SLACK = 1e-9
#: Keys that the boxes of a label are dealt over, and blocks that travel together.
SPREAD, GROUP = 16, 4


def principal_axes(rows: list, width: int) -> np.ndarray:
    """Orthonormal axes, by falling variance."""
    if len(rows) < 2:
        return np.eye(width)
    return np.linalg.eigh(np.cov(np.array(rows, float).T))[1][:, ::-1].copy()


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; large and small components are first brought near one, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Squared distance of the boxes of two point sets."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap)


def ego_pairs(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with x[i] . y[j] >= cosine; px, py hold leading principal coordinates. same: x is y, and i < j."""
    limit = 2 - 2 * cosine + SLACK
    work = [(0, len(x), 0, len(y))]
    while work:
        a, b, c, d = work.pop()
        if same and d <= a:
            continue
        if _apart(px[a:b], py[c:d]) > limit:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = (x[a:b] @ y[c:d].T >= cosine).nonzero()
            i, j = i + a, j + c
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j
        elif b - a >= d - c:
            m = (a + b) // 2
            work += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            work += [(a, b, c, m), (a, b, m, d)]


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", dims: int = 8, block: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link when their labels are equal and not null and their cosine is at
    least the threshold. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id, link with nothing. An id
    repeated with the same vector counts once and each of its rows is returned;
    rows with the same id and different vectors share a component. Labels may
    hold vectors of several lengths: only equal lengths compare.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    takes_part = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = v.where(takes_part)
    classes = materialize(good.groupBy("label", "vec").agg(F.min("id").alias("cid"), F.count_distinct("id").alias("n"), F.count("*").alias("rows")), "classes")
    sample = [unit(np.array([r.vec], float))[0] for r in smallest_hashes(classes, F.xxhash64("vec"), SAMPLE).select("vec").collect()]
    axes = {w: principal_axes([u for u in sample if len(u) == w], w) for w in {len(u) for u in sample}}
    eps = math.sqrt(2 - 2 * cosine)

    def lead(x: np.ndarray) -> np.ndarray:
        """Coordinates on the axes; of vectors of a length the sample doesn't hold, as they are."""
        a = axes.get(x.shape[1])
        return x if a is None else x @ a

    @F.pandas_udf("array<int>")
    def cell(vecs: pd.Series) -> pd.Series:
        return pd.Series([np.floor(lead(unit(np.asarray(v, float)[None]))[0, :dims] / eps).astype(np.int32) for v in vecs], dtype=object)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, key = TaskContext.get().partitionId(), 0, None
        rows: list = []

        def full() -> pd.DataFrame:
            x = unit(np.array([r[1] for r in rows], float))
            p = lead(x)[:, : 4 * dims]
            return pd.DataFrame({"bid": [(part << 32) + seq], "label": [key[0]], "width": [key[1]], "cids": [[r[0] for r in rows]], "ns": [[r[2] for r in rows]], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()], "data": [x.tobytes()]})

        for b in batches:
            for label, width, cid, n, u in zip(b.label, b.width, b.cid, b.n, b.vec):
                if rows and ((label, width) != key or len(rows) >= block):
                    yield full()
                    rows, seq = [], seq + 1
                key = (label, width)
                rows.append((cid, u, n))
        if rows:
            yield full()

    label_type = dict(classes.dtypes)["label"]
    ordered = classes.withColumns({"width": F.size("vec"), "cell": cell("vec")}).select("label", "width", "cid", "n", "vec", "cell")
    ordered = ordered.repartitionByRange("label", "width", "cell", "cid").sortWithinPartitions("label", "width", "cell", "cid")
    blocks = materialize(ordered.mapInPandas(cut, f"bid long, label {label_type}, width int, cids array<long>, ns array<long>, lo array<double>, hi array<double>, data binary"), "blocks")
    # A label may hold any share of the blocks: those of one side are dealt over SPREAD keys, and the boxes (not the vectors) of the other copied to each.
    box = blocks.select("bid", "label", "width", "lo", "hi").withColumn("deal", F.expr(f"cast(pmod(xxhash64(bid), {SPREAD}) as int)"))
    deals = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("deal")
    other = blocks.select(F.col("bid").alias("bid2"), "label", "width", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), deals)
    gap = F.expr("aggregate(zip_with(zip_with(lo, hi2, (a, b) -> a - b), zip_with(lo2, hi, (a, b) -> a - b), (a, b) -> greatest(a, b, 0D)), 0D, (s, g) -> s + g * g)")
    meets = box.join(other, ["label", "width", "deal"]).where((F.col("bid") <= F.col("bid2")) & (gap <= 2 - 2 * cosine + SLACK))
    # Neighbours in the sequence travel together: a group of GROUP blocks meets another such group in one task.
    near = meets.select(F.expr(f"bid div {GROUP}").alias("one"), F.expr(f"bid2 div {GROUP}").alias("two"), "label", "width", F.explode(F.array("bid", "bid2")).alias("bid")).distinct()
    both = near.join(blocks.select("bid", "cids", "ns", "data"), "bid")

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bid")
        xs = [np.frombuffer(d, float).reshape(-1, w) for d, w in zip(g.data, g.width)]
        ps = [lead(x)[:, : 4 * dims] for x in xs]
        ids = np.concatenate([np.asarray(c, np.int64) for c in g.cids])
        ns = np.concatenate([np.asarray(c, np.int64) for c in g.ns])
        begin = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
        group = (g.bid // GROUP).tolist()
        one, two = int(g.one.iloc[0]), int(g.two.iloc[0])
        links = np.zeros(len(ids), np.int64)

        def pairs():
            for a in range(len(xs)):
                for b in range(a, len(xs)):
                    if (group[a], group[b]) != (one, two):
                        continue
                    for i, j in ego_pairs(xs[a], xs[b], ps[a], ps[b], cosine, a == b):
                        i, j = i + begin[a], j + begin[b]
                        np.add.at(links, i, ns[j])
                        np.add.at(links, j, ns[i])
                        yield i, j

        low = forest(len(ids), pairs())
        some = links > 0
        return pd.DataFrame({"cid": ids[some], "links": links[some], "to": ids[low[some]]})

    met = materialize(both.groupBy("one", "two", "label", "width").applyInPandas(meet, "cid long, links long, to long"), "met")
    roots = connected_components(spark, met.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    counts = met.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = counts.join(roots, F.col("cid") == F.col("node"), "left").select(F.col("cid").alias("c"), "links", "root")
    key = F.struct("label", "vec").alias("key")
    named = classes.join(linked, F.col("cid") == F.col("c"), "left").select(key, F.col("rows").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    full = join_spread(good.select("id", key), materialize(named, "named"), "key").select("id", "n_links", "component_id")
    rest = v.where(~takes_part).select("id", F.lit(0).alias("n_links"), F.col("id").alias("component_id"))
    out = full.unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
