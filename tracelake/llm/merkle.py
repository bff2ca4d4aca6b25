"""A Merkle manifest of a dataset, and inclusion proofs by a recursive query that climbs it.

Every row is a leaf. The leaves of a group ascend by id and are folded eight at
a time to the group's subroot; the subroots, in order of their groups, are
folded alike to the root. All levels are stored as rows of one table: node,
parent, slot in the parent, the hashes of the children. A recursive query starts
at the leaves and ascends parent by parent: each step appends the siblings of
its level and folds the claimed hash with them.

A node's id is the ordinal of its first leaf times 64 plus its level (32 is
added to levels above the subroots), so no numbering beyond the sort is needed.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_spread, materialize, new_path

#: Nodes of a level that are broadcast on the climb: about 3 MB. Nodes of fuller levels have a small share of all leaves each.
FEW_NODES = 4096
TOP = 32


def field(c: Column) -> Column:
    """A value as hashed: "-" if null, else its length in UTF-8 bytes, a colon, and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def lowered(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_ordinal(df: DataFrame, *keys: Column) -> DataFrame:
    """df, written once, with its place g in the order of keys, from 0; ties get places in no stated order.

    Rows are range-partitioned and sorted; only the row counts of the partitions
    are summed in one task.
    """
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33).alias("__part")
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    starts = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("g", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start")


def height(n: int, fan: int = 8) -> int:
    """Levels above n leaves: how often n must be divided by fan, rounded up, to be one."""
    h = 0
    while n > 1:
        n, h = -(-n // fan), h + 1
    return h


def _height(n: Column, most: int, fan: int) -> Column:
    """height() of a column whose largest value is most."""
    return sum(((n > fan**h).cast("int") for h in range(height(most, fan))), F.lit(0))


class Manifest(NamedTuple):
    """leaves: id, grp, g, o, leaf, claim, parent, slot. nodes: node, parent, slot, level, kids, hash. subroots: grp, o, n, subroot. root: one row, one column; levels: nodes by level."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None
    levels: dict[int, int]


def _node(first: Column, level: int) -> Column:
    return first * 64 + level


def _build(rows: DataFrame, tallest: int, base: int, path: str, bits: int, above: Column) -> None:
    """Write the levels above rows(s, h, o, p, hash): start, height and number of the tree, place in it. above: parent of a tree's top."""
    level = rows.where("h > 0")
    for lv in range(1, tallest + 1):
        span = bits * lv
        up = level.groupBy("s", "h", "o", F.shiftright("p", bits).alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "hash"))), lambda x: x["hash"]).alias("kids"))
        parent = F.when(F.col("h") > lv, _node(F.col("s") + F.shiftleft(F.shiftright("p", bits), span + bits), base + lv + 1)).otherwise(above)
        slot = F.when(F.col("h") > lv, F.col("p")).otherwise(F.col("o")).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        up = up.select("s", "h", "o", "p", _node(F.col("s") + F.shiftleft("p", span), base + lv).alias("node"), parent.cast("bigint").alias("parent"), slot.alias("slot"), "kids", F.sha2(F.array_join("kids", ""), 256).alias("hash"))
        up.write.parquet(f"{path}/level={base + lv}")
        level = rows.sparkSession.read.schema(up.schema).parquet(f"{path}/level={base + lv}").where(F.col("h") > lv).select("s", "h", "o", "p", "hash")


_NODES = "s bigint, h int, o bigint, p bigint, node bigint, parent bigint, slot int, kids array<string>, hash string, level int"


def build_manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, claim: Column | None = None, bits: int = 3) -> Manifest:
    """The tree over rows, one leaf each; bits 3 folds eight nodes at a time.

    leaf and claim are hashes made from the columns of rows; claim, by default
    the leaf, is what a proof is to be checked for. Leaves of a group ascend by
    id (null first), rows of one id by hash; groups ascend bytewise, null first.
    A lone leaf is its subroot, a lone subroot the root. No rows: no nodes, root
    null. Other columns of rows are not looked at; texts of any length only
    reach the hash.
    """
    spark, path, fan = rows.sparkSession, new_path(rows.sparkSession, "merkle"), 1 << bits
    small = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf.alias("leaf"), (leaf if claim is None else claim).alias("claim"))
    key = F.when(F.col("grp").isNull(), "").otherwise(F.concat(F.lit("="), F.col("grp").cast("string"))).alias("key")
    placed = with_ordinal(materialize(small, "hashes"), F.asc_nulls_first("grp"), F.asc_nulls_first("id"), F.asc("leaf")).withColumn("key", key)
    groups = with_ordinal(placed.groupBy("key", "grp").agg(F.min("g").alias("s"), F.count("*").alias("n")), F.asc_nulls_first("grp")).withColumnRenamed("g", "o")
    n_groups, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    groups = groups.withColumn("h", _height(F.col("n"), most, fan))
    top, last = height(n_groups, fan), F.lit(fan - 1)
    above = _node(F.shiftleft(F.shiftright("o", bits), bits), TOP + 1) if top else F.lit(None)
    leaves = join_spread(placed, groups.select("key", "n", "s", "h", "o"), "key").withColumn("p", F.col("g") - F.col("s"))
    parent = F.when(F.col("h") > 0, _node(F.col("s") + F.shiftleft(F.shiftright("p", bits), bits), 1)).otherwise(above).cast("bigint")
    slot = F.when(F.col("h") > 0, F.col("p")).otherwise(F.col("o")).bitwiseAND(last).cast("int")
    leaves = materialize(leaves.select("id", "grp", "g", "s", "h", "o", "p", "leaf", "claim", parent.alias("parent"), slot.alias("slot")), "leaves")
    _build(leaves.select("s", "h", "o", "p", F.col("leaf").alias("hash")), height(most, fan), 0, path, bits, above)
    # Parquet of no rows, so that the table is there without any level.
    spark.createDataFrame([], _NODES.rsplit(",", 1)[0]).write.parquet(f"{path}/level=-1")
    nodes = spark.read.schema(_NODES).parquet(path)
    tops = leaves.where("h = 0").select("o", F.col("leaf").alias("subroot")).unionByName(nodes.where("level = h").select("o", F.col("hash").alias("subroot")))
    subroots = materialize(groups.select("grp", "o", "n").join(tops, "o"), "subroots")
    _build(subroots.select(F.lit(0).cast("bigint").alias("s"), F.lit(top).alias("h"), F.lit(0).cast("bigint").alias("o"), F.col("o").alias("p"), F.col("subroot").alias("hash")), top, TOP, path, bits, F.lit(None))
    nodes = spark.read.schema(_NODES).parquet(path)
    root = nodes.where(F.col("level") == TOP + top).select("hash").first() if top else subroots.select("subroot").first()
    levels = {r[0]: r[1] for r in nodes.groupBy("level").count().collect()}
    return Manifest(leaves.select("id", "grp", "g", "o", "leaf", "claim", "parent", "slot"), nodes.select("node", "parent", "slot", "level", "kids", "hash"), subroots, root[0] if root else None, levels)


def _ascend(rows: DataFrame, nodes: DataFrame, levels: list[int], wide: bool) -> DataFrame:
    """rows(key, node, slot, hash, proof), each risen as long as its node is of these levels; wide: nodes come by shuffle, else by broadcast.

    A step folds the hash, where there is one, with the siblings at hand, and
    appends these to the proof, where there is one.
    """
    spark, tag = rows.sparkSession, uuid.uuid4().hex
    rows.createOrReplaceTempView(f"rows_{tag}")
    nodes.where(F.col("level").isin(levels)).createOrReplaceTempView(f"nodes_{tag}")
    out = spark.sql(f"""
        WITH RECURSIVE climb(key, node, slot, hash, proof) AS (
          SELECT key, node, slot, hash, proof FROM rows_{tag}
          UNION ALL
          SELECT key, parent, up, unhex(sha2(concat(before, lower(hex(hash)), after), 256)), concat(proof, unhex(concat(before, after)))
          FROM (SELECT {'' if wide else '/*+ BROADCAST(n) */'} c.key, c.hash, c.proof, n.parent, n.slot AS up,
                  array_join(slice(n.kids, 1, c.slot), '') AS before, array_join(slice(n.kids, c.slot + 2, size(n.kids)), '') AS after
                FROM climb c JOIN nodes_{tag} n ON n.node = c.node))
        SELECT * FROM climb WHERE NOT coalesce((node & 63) IN ({', '.join(map(str, levels))}), false)""")
    for name in ("rows", "nodes"):
        spark.catalog.dropTempView(f"{name}_{tag}")
    return out


def climb(m: Manifest, rows: DataFrame) -> DataFrame:
    """rows(key, node, slot, hash, proof) risen to the root by recursive queries.

    Nodes of levels with more than FEW_NODES of them come by shuffle; these have
    a small share of the leaves each and are the first to be met. The nodes
    above have many leaves each and are broadcast, so no hot node is a join key.
    Above more groups than that, the same happens once more. The session's limit
    on rows of a recursion is lifted: they number rows times levels.
    """
    m.leaves.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    of = lambda top, full: [k for k, n in m.levels.items() if (k >= TOP) == top and (n > FEW_NODES) == full]
    stages = [(of(False, True), True), (of(False, False), False), (of(True, True), True), (of(True, False), False)]
    if not stages[2][0]:
        stages = [stages[0], (stages[1][0] + stages[3][0], False)]
    stages = [x for x in stages if x[0]]
    for k, (levels, wide) in enumerate(stages):
        rows = _ascend(rows if k == 0 else materialize(rows, "risen"), m.nodes, levels, wide)
    return rows


def prove(m: Manifest) -> DataFrame:
    """Per leaf: id, grp, leaf, subroot, root, proof (its siblings' hashes up to the root, as bytes), folded (the root that its claim leads to), verified.

    Every leaf climbs with its claim, which is folded at each step. Leaves of
    one node share their proof but for its first part, so the siblings above are
    appended in climbs that start at these nodes, an eighth of the leaves.
    """
    none, empty = F.lit(None).cast("binary"), F.lit(b"")
    folded = climb(m, m.leaves.select(F.col("g").alias("key"), F.col("parent").alias("node"), "slot", F.unhex("claim").alias("hash"), none.alias("proof")))
    first = m.nodes.where(F.col("level").isin(1, TOP + 1))
    tails = climb(m, first.select(F.col("node").alias("key"), F.col("parent").alias("node"), "slot", none.alias("hash"), empty.alias("proof")))
    tails = first.select("node", "kids").join(tails.select(F.col("key").alias("node"), F.col("proof").alias("tail")), "node")
    named = join_spread(m.leaves.select("id", "grp", "g", "o", "leaf", F.col("parent").alias("node"), "slot"), m.subroots.select("o", "n", "subroot"), "o")
    beside = F.concat(F.slice("kids", F.lit(1), F.col("slot")), F.slice("kids", F.col("slot") + 2, F.greatest(F.size("kids"), F.lit(1))))
    both = named.join(folded.select(F.col("key").alias("g"), F.lower(F.hex("hash")).alias("folded")), "g").join(tails, "node", "left")
    proof = F.coalesce(F.concat(F.unhex(F.array_join(beside, "")), "tail"), empty)
    return both.select("id", "grp", "leaf", "subroot", F.lit(m.root).alias("root"), proof.alias("proof"), "folded", (F.col("folded") == F.lit(m.root)).alias("verified"))
