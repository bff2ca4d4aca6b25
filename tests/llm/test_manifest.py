import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracelake.llm import merkle as op

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def fold(level, fan):
    return [H("".join(level[i : i + fan])) for i in range(0, len(level), fan)]


def climb(levels, p, claim, fan):
    proof = ""
    for lv in levels[:-1]:
        run = lv[p // fan * fan : p // fan * fan + fan]
        before, after = run[: p % fan], run[p % fan + 1 :]
        proof, claim, p = proof + "".join(before + after), H("".join([*before, claim, *after])), p // fan
    return proof, claim


def brute(rows, fan=8):
    """rows: (id, group, leaf, claim) -> sorted results and root."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = [[r[2] for r in groups[g]]]
        while len(trees[g][-1]) > 1:
            trees[g].append(fold(trees[g][-1], fan))
    top = [[trees[g][-1][0] for g in order]]
    while len(top[-1]) > 1:
        top.append(fold(top[-1], fan))
    out = []
    for k, g in enumerate(order):
        for p, (i, _, leaf, claim) in enumerate(groups[g]):
            a, c = climb(trees[g], p, claim, fan)
            b, c = climb(top, k, c, fan)
            out.append((i, g, leaf, trees[g][-1][0], top[-1][0], a + b, c, c == top[-1][0]))
    return sorted(map(repr, out))


def fixture():
    r = random.Random(5)
    rows = [(i, g, H(f"{g}{i}"), H(f"{g}{i}") if r.random() < 0.6 else H("other")) for g, n in ((None, 9), ("a", 1), ("ab", 600), ("é", 64), ("Z", 65), ("z", 8)) for i in r.sample(range(10**6), n)]
    rows += [(i, f"g{i}", H(str(i)), H(str(i))) for i in range(70)]
    same = [(7, "ab", H("same"), H("same"))] * 20
    return rows + same + [(None, "ab", H("null id"), H("null id")), (-3, "z", H("x"), H("y"))]


@pytest.mark.parametrize("bits,few", [(3, 4096), (3, 20), (1, 100)])
def test_proofs_are_those_of_a_plain_tree(spark, monkeypatch, bits, few):
    """With all nodes broadcast, and with the fuller levels joined by shuffle; hash ties are rows that are alike."""
    monkeypatch.setattr(op, "FEW_NODES", few)
    rows = fixture()
    df = spark.createDataFrame(rows, "id long, g string, node string, claim string").withColumn("p", F.lit(1)).withColumn("parent", F.lit("x")).repartition(5)
    got = op.prove(op.build_manifest(df, "id", "g", F.col("node"), F.col("claim"), bits)).collect()
    assert sorted(repr((r.id, r.grp, r.leaf, r.subroot, r.root, r.proof.hex(), r.folded, r.verified)) for r in got) == brute(rows, 1 << bits)


def test_one_row_one_group_and_none(spark):
    for rows in ([(1, "a", H("1"), H("1"))], [(1, "a", H("1"), H("2"))], [(i, None, H(str(i)), H(str(i))) for i in range(10)], [(i, str(i), H(str(i)), H(str(i))) for i in range(9)]):
        df = spark.createDataFrame(rows, "id long, g string, leaf string, claim string")
        got = op.prove(op.build_manifest(df, "id", "g", F.col("leaf"), F.col("claim"))).collect()
        assert sorted(repr((r.id, r.grp, r.leaf, r.subroot, r.root, bytes(r.proof).hex(), r.folded, r.verified)) for r in got) == brute(rows)
    empty = op.build_manifest(df.limit(0), "id", "g", F.col("leaf"))
    assert empty.root is None and op.prove(empty).count() == 0


def test_fields_of_a_leaf(spark):
    df = spark.createDataFrame([(1, None, "", "é:1")], "a long, b string, c string, d string")
    assert df.select(op.leaf_hash(*map(F.col, "abcd"))).first()[0] == H("1:1-0:4:é:1")
    assert df.select(op.lowered(F.lit("ÀBCé"))).first()[0] == "Àbcé"
