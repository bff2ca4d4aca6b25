"""SimHash near-duplicates: 64-bit fingerprints, linked by exact tiled comparison.

Fingerprints are laid out in tiles by population counts (of the four 16-bit
quarters, split further where a tile is full). Two fingerprints within the
radius have counts that differ by no more than the radius in sum, so a pair of
tiles beyond that is skipped unseen; the others are compared whole with numpy
exclusive-or and bit counts. A tile travels once to each later tile it must
meet, as one packed row, and each meeting yields a spanning forest of its links,
never the pairs. Components of the forests are the classes.

near_copies() finds texts by the Jaccard similarity of their word shingles with
the same comparison over wider fingerprints of the sets: pairs within a radius
are candidates, every link is checked on the whole texts, and only checked links
join classes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_spread, materialize
from .components import connected_components

CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a whole text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), 0
    while part := [digest(g, seed) for g in itertools.islice(grams, CHUNK)]:
        ones += bit_sums(np.array(part, "<u8").reshape(-1, 1))
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def bit_sums(words: np.ndarray) -> np.ndarray:
    """How often each bit is set over the rows of a matrix of unsigned 64-bit words; bytes suffice for 255 rows at a time."""
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    return bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)


def add_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 3, seed: int = 42) -> DataFrame:
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text_col)))


def forest(n: int, pairs) -> np.ndarray:
    """Smallest member of each of n items' components; pairs: an iterable of index-array pairs."""
    low = np.arange(n)
    for a, b in pairs:
        a, b = low[a], low[b]
        while True:
            keep = a != b
            a, b = a[keep], b[keep]
            if not len(a):
                break
            m = np.minimum(a, b)
            np.minimum.at(low, a, m)
            np.minimum.at(low, b, m)
            while not np.array_equal(nxt := low[low], low):
                low = nxt
            a, b = low[a], low[b]
    return low


def _close(x: np.ndarray, y: np.ndarray, radius: int, rows: int = 256):
    x, y = x.view(np.uint64), y.view(np.uint64)  # of signed numbers, numpy counts the bits of the absolute value
    for i in range(0, len(x), rows):
        near = np.bitwise_count(x[i : i + rows, None] ^ y[None, :]) <= radius
        a, b = near.nonzero()
        yield a + i, b


def _quarters(cell: int) -> tuple[int, ...]:
    return cell // 4913, cell // 289 % 17, cell // 17 % 17, cell % 17


def link_fingerprints(spark: SparkSession, fps: DataFrame, radius: int = 3, tile: int = 8192) -> DataFrame:
    """fps(fp bigint, distinct) -> (fp, root): fingerprints with a neighbour within radius and the smallest (signed) of their class."""
    quarter = [f"bit_count(shiftrightunsigned(fp, {16 * k}) & 65535L)" for k in range(4)]
    cells = fps.withColumn("cell", F.expr(f"cast((({quarter[3]} * 17 + {quarter[2]}) * 17 + {quarter[1]}) * 17 + {quarter[0]} as int)"))
    # At most 17^4 cells whatever the input: a bounded table.
    parts = {r.cell: -(-r.n // tile) for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    known = spark.createDataFrame(list(parts.items()) or [(0, 1)], "cell int, parts int")
    placed = cells.join(F.broadcast(known), "cell").withColumn("part", F.expr("cast(pmod(xxhash64(fp), parts) as int)"))
    tiles = placed.groupBy("cell", "part").agg(F.collect_list("fp").alias("fps"))

    shifts = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]

    def send(batches):
        for b in batches:
            out = []
            for cell, part, own in zip(b.cell, b.part, b.fps):
                own = np.sort(np.asarray(own, np.int64)).tobytes()
                here = (cell << 32) + part
                out.append((here, 0, here, own))
                q = _quarters(cell)
                for d in shifts:
                    c = [x + y for x, y in zip(q, d)]
                    if min(c) < 0 or max(c) > 16:
                        continue
                    other = ((c[0] * 17 + c[1]) * 17 + c[2]) * 17 + c[3]
                    for k in range(parts.get(other, 0)):
                        there = (other << 32) + k
                        if there > here:
                            out.append((there, 1, here, own))
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=["at", "guest", "origin", "fps"])
                    out = []
            yield pd.DataFrame(out, columns=["at", "guest", "origin", "fps"])

    def meet(batches):
        at, home = None, None
        for b in batches:
            found = []
            for where, guest, own in zip(b["at"], b.guest, b.fps):
                x = np.frombuffer(own, np.int64)
                if not guest:
                    at, home = where, x
                    low = forest(len(x), _close(x, x, radius))
                    own_ids = x
                elif where != at:
                    continue  # a part that drew no fingerprint has no host
                else:
                    n = len(home)
                    low = forest(n + len(x), ((p, q + n) for p, q in _close(home, x, radius)))
                    own_ids = np.concatenate([home, x])
                moved = low != np.arange(len(low))
                if moved.any():
                    found.append(pd.DataFrame({"a": own_ids[moved], "b": own_ids[low[moved]]}))
            yield pd.concat(found) if found else pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})

    sent = tiles.mapInPandas(send, "at long, guest int, origin long, fps binary")
    met = sent.repartition("at").sortWithinPartitions("at", "guest", "origin").mapInPandas(meet, "a long, b long")
    return connected_components(spark, met).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row: fingerprints of whole texts, classes of those linked at radius or fewer differing bits.

    Null text counts as empty: fingerprint 0, linked like any other. A null id
    keeps its fingerprint and its class's smallest id (null if the class has
    none). Repeated rows come back as often as they came. Empty input: empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = materialize(add_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "fp"), "fp")
    classes = slim.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    named = lowest_of_class(classes, link_fingerprints(spark, classes.select("fp"), radius), "fp")
    return join_spread(slim, named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def lowest_of_class(classes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, n, component_id) of classes(key, low, n): the smallest low of all that share a root; keys without one stand alone."""
    rooted = materialize(classes.select(key, "low", "n").join(roots.select(key, "root"), key, "left").withColumn("root", F.coalesce("root", key)), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    return materialize(join_spread(rooted, lowest, "root").select(key, "n", "component_id"), "classes")


# Near copies by Jaccard similarity


#: A fingerprint is WIDE words; tiles are compared by the first NARROW of them, what remains by all.
WIDE, NARROW = 4, 2
#: Differing bits of candidates, in the first words and in all. At a similarity of 0.8, 128 and 256 bits differ in 20 +- 4 and 40 +- 6 places, so by
#: the binomial law about two links in 10^5 at the very threshold are missed, and next to none above it.
NEAR, FAR = 42, 64
#: Sets of fewer than SMALL shingles scatter more (24 +- 4 and 48 +- 6 places for 4 against 5): their radius.
SMALL, SMALL_NEAR, SMALL_FAR = 32, 54, 90


def _turn(turn: int) -> int:
    return (2 * turn + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)


def _scramble(h: np.ndarray, turn: int | np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers to others, one to one, differently each turn."""
    h = h + (turn if isinstance(turn, np.ndarray) else np.uint64(_turn(turn)))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles (A-Z lower-cased); a shorter text is one shingle, a text without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    take = min(width, len(words))
    total = np.zeros(len(words) - take + 1, np.uint64)
    for i in range(take):
        total += h[i : len(h) - take + 1 + i] * np.uint64(_turn(i))
    total = np.sort(_scramble(total, take))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


_WORD_TURNS = np.array([_turn(200 + w) for w in range(WIDE)], np.uint64)


def wide_fingerprint(grams: np.ndarray) -> np.ndarray:
    """WIDE words of a set of shingle hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(grams), CHUNK):
        part = grams[i : i + CHUNK]
        ones += bit_sums(_scramble(part[:, None], _WORD_TURNS[None]))
    return np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")


def jaccard_at_least(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= (len(x) + len(y) - same) * similarity - 1e-9


def _may_link(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two different sets of these sizes can be as similar at all."""
    return np.minimum(n, m) - (n == m) >= (n + m) * (similarity / (1 + similarity)) - 1e-9


def spanning(labels: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], hold: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks (a, b, distance) of index pairs, those of a least spanning forest over the labels (numbers from 0 up). About hold pairs at most are kept at a time."""
    kept, waiting = [(np.zeros(0, np.int64),) * 3], 0

    def least() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, far = map(np.concatenate, zip(*kept))
        low, ends = np.arange(labels.max(initial=-1) + 1), [np.zeros(0, np.int64)]
        order = np.argsort(far, kind="stable")
        for band in np.split(order, np.flatnonzero(np.diff(far[order])) + 1):
            la, lb = low[labels[a[band]]], low[labels[b[band]]]
            while (differ := la != lb).any():
                band, la, lb = band[differ], la[differ], lb[differ]
                up, down = np.maximum(la, lb), np.minimum(la, lb)
                _, first = np.unique(up, return_index=True)  # each label hooks to one below it
                ends.append(band[first])
                low[up[first]] = down[first]
                while not np.array_equal(nxt := low[low], low):
                    low = nxt
                la, lb = low[la], low[lb]
        at = np.concatenate(ends)
        return a[at], b[at], far[at]

    for block in pairs:
        kept.append(block)
        waiting += len(block[0])
        if waiting > hold:
            kept, waiting = [least()], 0
    return least()[:2]


class Tile:
    """Sets that are compared together, by falling number of set bits: keys, present roots, sizes, fingerprints."""

    def __init__(self, keys: bytes, roots: bytes, sizes: bytes, fps: bytes, grams: bytes | None = None):
        self.keys, self.roots, self.sizes = np.frombuffer(keys, np.int64), np.frombuffer(roots, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.fps = np.frombuffer(fps, "<u8").reshape(-1, WIDE)
        self.words = [np.ascontiguousarray(self.fps[:, w]) for w in range(NARROW)]
        self.bits = np.bitwise_count(self.fps[:, :NARROW]).sum(1, dtype=np.int64)
        self.grams = np.split(np.frombuffer(grams, np.uint64), np.cumsum(self.sizes)[:-1]) if grams else []

    @staticmethod
    def packed(keys: list, roots: list, sizes: list, fps: list, grams: list | None = None) -> list[bytes | None]:
        f = np.array(list(fps), np.int64).reshape(-1, WIDE)
        order = np.argsort(-np.bitwise_count(f.view(np.uint64)[:, :NARROW]).sum(1, dtype=np.int64), kind="stable")
        return [np.asarray(v, t)[order].tobytes() for v, t in ((keys, np.int64), (roots, np.int64), (sizes, np.int32), (f, np.int64))] + [b"".join(np.asarray(grams[i], np.int64).tobytes() for i in order) if grams is not None else None]

    def candidates(self, other: Tile, similarity: float, rows: int = 32, cols: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks (a, b, distance) of pairs of different roots within the radius; of a tile with itself each pair once. Blocks whose counts of set bits differ beyond the radius are skipped."""
        radius = SMALL_NEAR if min(self.sizes.min(initial=SMALL), other.sizes.min(initial=SMALL)) < SMALL else NEAR
        for i in range(0, len(self.keys), rows):
            most, least = self.bits[i], self.bits[i : i + rows][-1]
            for j in range(i if self is other else 0, len(other.keys), cols):
                if least - other.bits[j] > radius or other.bits[j : j + cols][-1] - most > radius:
                    continue
                near = np.zeros((min(rows, len(self.keys) - i), min(cols, len(other.keys) - j)), np.uint8)
                for x, y in zip(self.words, other.words):
                    near += np.bitwise_count(x[i : i + rows, None] ^ y[None, j : j + cols])
                a, b = np.divmod(np.flatnonzero(near <= radius), near.shape[1])
                a, b = a + i, b + j
                keep = self.roots[a] != other.roots[b]
                if self is other:
                    keep &= a < b
                a, b = a[keep], b[keep]
                n, m = self.sizes[a], other.sizes[b]
                far = np.bitwise_count(self.fps[a] ^ other.fps[b]).sum(1, dtype=np.int64)
                keep = _may_link(n, m, similarity) & (far <= np.where(np.minimum(n, m) < SMALL, SMALL_FAR, FAR))
                if keep.any():
                    yield a[keep], b[keep], far[keep]


#: Bytes of whole sets that a tile carries at most, or one longer set.
CARRY = 16 << 20


def _meetings(sets: DataFrame, similarity: float, handle: Callable[[Tile, Tile, bool], Iterator[pd.DataFrame]], schema: str, tile: int = 16384) -> DataFrame:
    """What handle(home, guest, whether they are the same) yields for each meeting of tiles of sets(key, root, n, fp), with or without grams.

    Tiles hold sets of nearly one size; those whose sizes rule the similarity out never meet.
    """
    steps = sets.withColumn("step", F.floor(F.log2(F.greatest("n", F.lit(1))) * 8).cast("int"))
    whole = "grams" in sets.columns
    load = steps.groupBy("step").agg(F.count("*").alias("n"), F.sum("n").alias("grams")).collect()  # at most 8 * 32 rows
    parts = {r.step: max(-(-r.n // tile), -(-8 * r.grams // CARRY) if whole else 0) for r in load}
    known = sets.sparkSession.createDataFrame(list(parts.items()) or [(0, 1)], "step int, parts int")
    placed = steps.join(F.broadcast(known), "step").withColumn("part", F.expr("cast(pmod(xxhash64(key), parts) as int)"))
    fields = ["key", "root", "n", "fp"] + ["grams"] * whole
    tiles = placed.groupBy("step", "part").agg(*(F.collect_list(c).alias(c) for c in fields))
    reach = int(8 * math.log2(1 / similarity)) + 1
    columns = ["at", "guest", "origin", "keys", "roots", "sizes", "fps", "grams"]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for step, part, *lists in zip(b.step, b.part, *(b[c] for c in fields)):
                packed, here = Tile.packed(*lists), (step << 32) + part
                there = [(step << 32) + k for k in range(part, parts[step])] + [(s << 32) + k for s in range(step + 1, step + reach + 1) for k in range(parts.get(s, 0))]
                for t in there:
                    yield pd.DataFrame([(t, int(t != here), here, *packed)], columns=columns)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, home = None, None
        for b in batches:
            for where, guest, *packed in zip(b["at"], b.guest, b["keys"], b.roots, b.sizes, b.fps, b.grams):
                own = Tile(*packed)
                if not guest:
                    at, home = where, own
                if where == at:  # a part that drew no set has no host
                    yield from handle(home, own, not guest)

    sent = tiles.mapInPandas(send, "at long, guest int, origin long, keys binary, roots binary, sizes binary, fps binary, grams binary")
    return sent.repartition("at").sortWithinPartitions("at", "guest", "origin").mapInPandas(meet, schema)


def candidate_pairs(sets: DataFrame, similarity: float, turn: int, tile: int = 16384) -> DataFrame:
    """(a, b): pairs of different roots within the radius, per meeting of tiles those of a least spanning forest over the roots. Later turns shake the distances, so that other pairs of the same classes are tried."""

    def tie(home: Tile, own: Tile, same: bool) -> Iterator[pd.DataFrame]:
        _, label = np.unique(home.roots if same else np.concatenate([home.roots, own.roots]), return_inverse=True)
        shift = 0 if same else len(home.keys)

        def shaken(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
            mix = _scramble(own.keys[x].view(np.uint64) ^ _scramble(home.keys[y].view(np.uint64), turn), turn)
            return d + (mix % np.uint64(1 + 12 * turn)).astype(np.int64)

        i, j = spanning(label, ((x + shift, y, shaken(x, y, d)) for x, y, d in own.candidates(home, similarity)))
        yield pd.DataFrame({"a": own.keys[i - shift], "b": home.keys[j]})

    found = _meetings(sets, similarity, tie, "a long, b long", tile)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def undecided(sets: DataFrame, similarity: float) -> DataFrame:
    """(key): sets that have a candidate of another root."""

    def name(home: Tile, own: Tile, same: bool) -> Iterator[pd.DataFrame]:
        for i, j, _ in own.candidates(home, similarity):
            yield pd.DataFrame({"key": np.unique(np.concatenate([own.keys[i], home.keys[j]]))})

    return _meetings(sets, similarity, name, "key long").distinct()


def settle(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of sets with grams, links between different roots, enough of them to tie all that are linked. Every candidate pair of classes still apart is checked where its tiles meet; no pair but a link leaves."""

    def check(home: Tile, own: Tile, same: bool) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for i, j, _ in own.candidates(home, similarity):
            links = []
            for x, y, one, other in zip(i.tolist(), j.tolist(), own.roots[i].tolist(), home.roots[j].tolist()):
                one, other = root(one), root(other)
                if one != other and jaccard_at_least(own.grams[x], home.grams[y], similarity):
                    up[one] = other
                    links.append((own.keys[x], home.keys[y]))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return _meetings(sets, similarity, check, "a long, b long")


def _deal(pairs: DataFrame, texts: DataFrame, end: str, share: int = 256) -> DataFrame:
    """pairs(a, b, ...) with the text of one end; an end of more than share pairs is dealt over copies of its text."""
    n = pairs.groupBy(F.col(end).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > share)
    hubs = materialize(n.select("key", F.ceil(F.col("n") / share).cast("int").alias("deals")), "hubs")
    deals = F.coalesce("deals", F.lit(1))
    dealt = pairs.withColumn("key", F.col(end)).join(hubs, "key", "left").withColumn("deal", F.pmod(F.xxhash64("a", "b"), deals).cast("int")).drop("deals")
    copies = texts.join(hubs, "key", "left").select("key", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.col("text").alias(f"text_{end}"))
    return dealt.join(copies, ["key", "deal"]).drop("key", "deal")


def _check(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts' shingle sets are as similar as asked."""

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, y = None, None
        for t in batches:
            keep = []
            for b, one, other in zip(t.b, t.text_a, t.text_b):
                if b != last:
                    last, y = b, shingle_set(other, width)
                keep.append(jaccard_at_least(shingle_set(one, width), y, similarity))
            yield t.loc[keep, ["a", "b"]]

    return _deal(_deal(pairs, texts, "a"), texts, "b").mapInPandas(same, "a long, b long")


def link_sets(sets: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int, similarity: float, turns: int = 3) -> DataFrame:
    """(key, root) of the sets(key, n, fp) that have a similar other one; texts_of gives (key, text) for a table of keys.

    The first turns take spanning forests of candidates, near ones first, so a
    group of near copies is tied together by few checks. What is still apart and
    within the radius travels in tiles with whole sets, where every such pair is
    checked. All turns but the first only look at sets that have a candidate.
    """
    spark = sets.sparkSession
    able = sets.where("n > 0").withColumn("root", F.col("key"))
    pairs = materialize(candidate_pairs(able, similarity, 0), "pairs")
    met = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    texts = materialize(texts_of(met), "texts")
    some = materialize(able.drop("root").join(met, "key", "left_semi"), "met")
    links, tried = materialize(_check(pairs, texts, width, similarity), "links"), pairs

    def placed() -> tuple[DataFrame, DataFrame]:
        roots = materialize(connected_components(spark, links).select(F.col("node").alias("key"), "root"), "roots")
        return some.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), roots.select(F.col("key").alias("a"), F.col("root").alias("b"))

    for turn in range(1, turns):
        now, known = placed()
        pairs = materialize(candidate_pairs(now, similarity, turn).join(tried, ["a", "b"], "left_anti"), "pairs")
        links, tried = materialize(_check(pairs, texts, width, similarity), "links").union(known), tried.union(pairs)
    now, known = placed()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                yield pd.DataFrame({"key": part.key, "grams": [shingle_set(t, width).view(np.int64) for t in part.text]})

    left = materialize(undecided(now, similarity), "undecided")
    grams = texts.join(left, "key", "left_semi").select("key", "text").mapInPandas(whole, "key long, grams array<long>")
    more = materialize(settle(now.join(grams, "key"), similarity), "links")
    return connected_components(spark, more.union(known)).select(F.col("node").alias("key"), "root")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) for every row: the smallest id of the class, linked at this Jaccard similarity of word shingles or more.

    Equal sets are one class from the start, so copies never expand to pairs.
    Links are exact; candidates come by fingerprint, which misses about one link
    in a thousand at a similarity of just 0.8 and fewer above. Texts without
    words, null ones too, are a class of their own. A null id has its class's
    smallest id (null if the class has none). Repeated rows come back as often
    as they came. Very long texts are read whole. Other columns are not read.
    Empty input: empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))

    @F.pandas_udf("key long, n int, fp array<long>")
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            grams = shingle_set(t, width)
            out.append((xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63), len(grams), wide_fingerprint(grams).view(np.int64)))
        return pd.DataFrame(out, columns=["key", "n", "fp"])

    slim = materialize(rows.withColumn("d", describe("text")).select("id", "hash", "d.key", "d.n", "d.fp"), "slim")
    first = F.min(F.struct("id", "hash")).alias("first")
    sets = materialize(slim.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("fp").alias("fp"), first), "sets")

    def texts_of(keys: DataFrame) -> DataFrame:
        """One row stands for each set: that of the smallest id and hash. Rows repeated whole are taken together."""
        want = sets.join(keys, "key", "left_semi").select("key", F.col("first.id").alias("first_id"), F.col("first.hash").alias("hash"))
        return rows.join(want, (rows["hash"] == want["hash"]) & rows["id"].eqNullSafe(want["first_id"])).select("key", "text").groupBy("key").agg(F.first("text").alias("text"))

    roots = link_sets(sets.select("key", "n", "fp"), texts_of, width, similarity)
    named = lowest_of_class(sets.select("key", "low", F.col("rows").alias("n")), roots, "key")
    return join_spread(slim.select("id", "key"), named, "key").select(F.col("id").alias(id_col), "component_id")


def _smallest_of_class(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keep = classes.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    mine = docs.where(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi")
    kept = mine.withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col)))).where("__n = 1").drop("__n")
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each class the one with the smallest id, once (of different texts under one id, that of the smallest hash).

    Rows with a null id stay as they are. Repeated rows are one.
    """
    return _smallest_of_class(docs, near_copies(docs, id_col, text_col, width, similarity), id_col, text_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The same by the plain fingerprint and its radius."""
    return _smallest_of_class(docs, near_duplicates(docs, id_col, text_col, radius), id_col, text_col)
