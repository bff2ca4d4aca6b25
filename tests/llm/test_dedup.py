import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import components, docs, simhash
from tracelake.llm import egojoin
from tracelake.llm import simhash as op
from tracelake.llm.components import connected_components


def test_fingerprint_is_the_plain_definition():
    r = random.Random(1)
    texts = [" ".join(r.choice(["Aa", "b", "ç", "D\tx", "e\n"]) for _ in range(r.randrange(0, 40))) for _ in range(60)]
    assert [op.fingerprint(t) for t in texts] == [simhash(t) for t in texts]
    assert op.fingerprint(None) == op.fingerprint(" \n") == 0
    long = "word%d " * 70_000 % tuple(range(70_000))
    assert op.fingerprint(long) == op.fingerprint(long.upper())


def test_tiles_find_every_link(spark):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(300)} | {0, 1, 2**64 - 1}
    for f in list(fps)[:150]:
        x = f
        for _ in range(r.randrange(1, 6)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    signed = sorted(int(np.array(f, np.uint64).view(np.int64)) for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components(len(signed), lambda i, j: ((signed[i] ^ signed[j]) & (2**64 - 1)).bit_count() <= 3)
    for tile in (8192, 1):
        got = {x.fp: x.root for x in op.link_fingerprints(spark, df, tile=tile).collect()}
        assert {f: got.get(f, f) for f in signed} == {f: signed[w] for f, w in zip(signed, want)}


def test_near_duplicates_rows_and_edge_cases(spark):
    base = " ".join(f"w{i % 37}x{i}" for i in range(400))
    rows = [(5, base, "a"), (3, base + " tail", "a"), (9, "other text here now", "b"), (7, None, "b"), (8, "", "c"), (9, "other text here now", "b"), (None, base, "c"), (11, "One", "c")]
    df = docs(spark, rows).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(-1))
    got = op.near_duplicates(df).collect()
    ids = [r[0] for r in rows]
    fps = [simhash(r[1]) for r in rows]
    root = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    want = sorted((str(ids[k]), min(ids[m] for m in range(len(rows)) if root[m] == root[k] and ids[m] is not None)) for k in range(len(rows)))
    assert sorted((str(g.doc_id), g.component_id) for g in got) == want
    kept = op.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "3", "7", "9", "None"]
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(600)]
    rows = [(100 + i, " ".join(words[:-1] + [f"z{i % 90}"]), "a") for i in range(400)] + [(i, " ".join(r.choice(words) for _ in range(80)), "b") for i in range(20)]
    got = {g.doc_id: g.component_id for g in op.near_duplicates(docs(spark, rows)).collect()}
    fps = [simhash(t) for _, t, _ in rows]
    root = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    low = {}
    for (i, _, _), c in zip(rows, root):
        low[c] = min(low.get(c, i), i)
    assert got == {rows[k][0]: low[root[k]] for k in range(len(rows))}


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (70, 69), (70, 69), (-4, 70)]
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1100)} | {69: -4, 70: -4}
    assert got == want
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_ego_join_is_brute_force(spark, block):
    r = np.random.default_rng(4)
    x = r.standard_normal((150, 12))
    x[60:120] = x[r.integers(0, 60, 60)] + 0.12 * r.standard_normal((60, 12))
    x[120:] = x[5]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 12, 0), (202, [float("nan")] + [1.0] * 11, 1), (203, [float("inf")] + [1.0] * 11, 1), (204, x[0].tolist(), None), (205, [], 0), (206, [1.0, None], 0), (7, x[7].tolist(), 1), (207, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("x"))
    got = egojoin.near_duplicate_vectors(df, block=block).collect()
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = lambda i, j: i != j and i % 2 == j % 2 and float(u[i] @ u[j]) >= 0.93
    root = components(150, linked)
    want = {i: (sum(linked(i, j) for j in range(150)), root[i]) for i in range(150)} | {i: (0, i) for i in range(200, 208)}
    assert {g.vec_id: (g.n_links, g.component_id) for g in got} == want
    assert all(g.kept == (g.vec_id == g.component_id) for g in got)
    assert egojoin.near_duplicate_vectors(df.limit(0)).count() == 0
