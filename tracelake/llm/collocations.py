"""Phrase collocation mining over a weighted de Bruijn graph of word runs.

Texts are cut into pieces and pieces into words. Every position of a piece gives
one edge: the longest gram from there (4 words), from the node of its first
three words to that of its last three. Edges are aggregated; all shorter counts
are derived from them. A node's count is what flows out of it, plus what stops
there; a pair's is the flow of its nodes plus its stops; a word's that of its
pairs plus its stops. Stops are the corrections at piece ends. A word with fewer
occurrences than a candidate needs is in no candidate, so a walk stops before it
as at a piece end; this keeps every count of a candidate and of its parts exact.

Edges and nodes too light to be candidates are folded into the stops of their
node or pair. The heavy graph that is left is compacted: unary paths (one edge
in, one out, of one weight) become single rows by pointer doubling. Counts of
grams of four and three words are read off the paths.

Words become numbers: the most frequent ones, MOST_WORDS at most, get small ones
and are broadcast; if there are more words that a candidate may hold, the others
go by a 63-bit hash. Numbers are unique over all languages, so grams need no
language beside them, and small ones are packed, a node to a bigint. Words that share a hash (next to none) are broadcast too,
with numbers of their own, so no two words ever share one.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_spread, materialize

LONGEST = 4
MOST_WORDS = 1 << 19
CHUNK = 1 << 20
#: Word occurrences of one language that a task gathers before it aggregates, and of all languages.
GATHER, GATHER_ALL = 1 << 20, 1 << 21
KEEP_WORDS = 200_000
#: A-Z lowered, a tab to a blank, the ends of pieces to a newline.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 10)
IDS = [f"w{i}" for i in range(1, LONGEST + 1)]
#: Bits of a small number: three of them make a packed node.
BITS = 21


def _runs(text: str | None) -> Iterator[bytes]:
    """The folded text, a megabyte at a time, cut only where a word ends; what stands before a cut ends no piece by that."""
    data = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(data):
        cut = len(data) if at + CHUNK >= len(data) else data.find(b" ", at + CHUNK)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut]
        at = cut


def count_words(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> (lang, word, n) over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                seen = held.setdefault(lang, Counter())
                for part in _runs(text):
                    seen.update(part.split())
                    if len(seen) > KEEP_WORDS:
                        yield _counted({lang: seen})
                        seen.clear()
            if sum(map(len, held.values())) > KEEP_WORDS:
                yield _counted(held)
                held.clear()
        yield _counted(held)

    return docs.mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(held: dict[str, Counter]) -> pd.DataFrame:
    return pd.DataFrame([(lang, w.decode(), n) for lang, c in held.items() for w, n in c.items()], columns=["lang", "word", "n"])


def hash_id(lang: Column, word: Column) -> Column:
    """A negative number: XXH64 of the word, seeded by that of its language, with the top bit set."""
    return F.xxhash64(lang, word).bitwiseOR(F.lit(-(1 << 63)))


def number_words(words: DataFrame, least: int, most: int) -> tuple[DataFrame, dict[str, list[str]], bool]:
    """(numbered words with least occurrences: lang, word, n, id), the frequent ones by language in order of their ids from 1, whether these are all.

    Frequent: the highest classes of counts (eight to a doubling) that hold at
    most `most` words; the classes are less than 512.
    """
    known = words.where(F.col("n") >= least).withColumn("c", F.floor(F.log2("n") * 8).cast("int"))
    total, floor = 0, None
    classes = known.groupBy("c").count().orderBy(F.desc("c")).collect()
    for c, n in classes:
        if total + n > most:
            break
        total, floor = total + n, c
    complete = not classes or floor == classes[-1][0]
    frequent = known.where(F.col("c") >= (512 if floor is None else floor))
    if not complete:
        shared = words.groupBy(hash_id(F.col("lang"), F.col("word")).alias("id")).agg(F.count("*").alias("k"), F.collect_list(F.struct("lang", "word")).alias("of")).where("k > 1").select(F.explode("of").alias("x")).select("x.*")
        frequent = frequent.select("lang", "word").unionByName(shared).distinct()
    table = frequent.select("lang", "word").orderBy("lang", "word").toArrow()
    held: dict[str, list[str]] = {}
    for lang, word in zip(table["lang"].to_pylist(), table["word"].to_pylist()):
        held.setdefault(lang, []).append(word)
    ids = pa.table({"lang": table["lang"], "word": table["word"], "id": pa.array(np.arange(1, len(table) + 1, dtype=np.int64))})
    small = F.broadcast(words.sparkSession.createDataFrame(ids, "lang string, word string, id bigint"))
    numbered = known.drop("c").join(small, ["lang", "word"], "left").withColumn("id", F.coalesce("id", hash_id(F.col("lang"), F.col("word"))))
    return numbered, held, complete


class _Ids(dict):
    """Numbers of one language's words; a word without one gets its hash, which is not kept."""

    def __init__(self, words: list[str], first: int, lang: str, complete: bool):
        super().__init__(zip(map(str.encode, words), range(first, first + len(words))))
        self[b"\n"] = 0
        self.seed, self.complete = xxhash.xxh64_intdigest(lang.encode(), 42), complete

    def __missing__(self, word: bytes) -> int:
        return 0 if self.complete else xxhash.xxh64_intdigest(word, self.seed) | 1 << 63


_HERE: dict[str, dict[str, _Ids]] = {}


def _edges(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams (rows of LONGEST ids, 0 from a stop on) and their counts, of a run of ids with 0 at stops."""
    small, dense = np.unique(np.pad(ids.astype(np.uint64), (1, LONGEST - 1)), return_inverse=True)
    dense = dense[1:].astype(np.uint64)
    n = len(ids)
    live = dense[:n] > 0
    columns = [dense[:n][live]]
    for k in range(1, LONGEST):
        columns.append(np.where(columns[-1] > 0, dense[k : n + k][live], 0))
    bits = np.uint64(max(1, int(len(small) - 1).bit_length()))
    if int(bits) * LONGEST <= 64:
        code = columns[0]
        for c in columns[1:]:
            code = code << bits | c
        code, counts = np.unique(code, return_counts=True)
        columns = [code >> bits * np.uint64(LONGEST - 1 - k) & np.uint64((1 << int(bits)) - 1) for k in range(LONGEST)]
    else:
        pairs = np.concatenate([columns[0] << np.uint64(32) | columns[1], columns[2] << np.uint64(32) | columns[3]])
        pairs, at = np.unique(pairs, return_inverse=True)
        half = len(at) // 2
        code, counts = np.unique(at[:half].astype(np.uint64) << np.uint64(32) | at[half:].astype(np.uint64), return_counts=True)
        low = np.uint64((1 << 32) - 1)
        columns = [x for p in (pairs[code >> np.uint64(32)], pairs[code & low]) for x in (p >> np.uint64(32), p & low)]
    return small[np.array(columns, np.int64)], counts


def node_columns(complete: bool) -> list[str]:
    return ["node"] if complete else IDS[:3]


def edge_counts(docs: DataFrame, held: dict[str, list[str]], complete: bool) -> DataFrame:
    """docs(lang, text) -> (node, w4, n), or (w1, w2, w3, w4, n): edges of the graph as far as tasks have aggregated them; 0 from a stop on."""
    shared = docs.sparkSession.sparkContext.broadcast(held)
    key = uuid.uuid4().hex

    def ids_of(lang: str) -> _Ids:
        if key not in _HERE:
            _HERE.clear()
            first, out = 1, {}
            for k, words in shared.value.items():
                out[k] = _Ids(words, first, k, complete)
                first += len(words)
            _HERE[key] = out
        return _HERE[key].get(lang) or _Ids([], 0, lang, complete)

    def batch(parts: list[np.ndarray]) -> pa.RecordBatch:
        grams, counts = _edges(np.concatenate(parts))
        if complete:
            bits = np.uint64(BITS)
            grams = [(grams[0] << bits | grams[1]) << bits | grams[2], grams[3]]
        return pa.record_batch([*(pa.array(g.view(np.int64)) for g in grams), pa.array(counts.astype(np.int64))], [*node_columns(complete), "w4", "n"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[str, list[np.ndarray]] = {}
        sizes: Counter = Counter()
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                ids = ids_of(lang)
                parts = gathered.setdefault(lang, [])
                # The words of one text stay together, as pieces may cross what is read at once.
                for part in _runs(text.as_py()):
                    parts.append(np.array([ids[w] for w in part.replace(b"\n", b" \n ").split(b" ") if w], np.uint64))
                    sizes[lang] += len(parts[-1])
                parts.append(np.zeros(1, np.uint64))
                sizes[lang] += 1
                if sizes[lang] > GATHER:
                    yield batch(gathered.pop(lang))
                    del sizes[lang]
            if sizes.total() > GATHER_ALL:
                for v in gathered.values():
                    yield batch(v)
                gathered.clear()
                sizes.clear()
        for v in gathered.values():
            yield batch(v)

    return docs.mapInArrow(walk, ", ".join(f"{c} bigint" for c in [*node_columns(complete), "w4", "n"]))


def fold_light(edges: DataFrame, least: int) -> DataFrame:
    """Edges -> (k, w1..w4, n): k 4, edges of least or more; k 3, what flows out of a node of least or more by other ways; k 2 and 1, flow that stops at a pair or word or goes on to lighter nodes."""
    packed = "node" in edges.columns
    node = node_columns(packed)
    whole = edges.repartition(*node).groupBy(*node, "w4").agg(F.sum("n").alias("n"))
    # Of sums alone, so that no part of it moves below the exchange, which both branches share.
    heavy = F.when(F.col("w4") != 0, F.col("n")).otherwise(0) >= least
    nodes = whole.groupBy(*node).agg(F.sum("n").alias("flow"), F.sum(F.when(heavy, F.col("n")).otherwise(0)).alias("on"))
    mask, zero = F.lit((1 << BITS) - 1), F.lit(0).cast("bigint")
    ids = [F.shiftright("node", 2 * BITS), F.shiftright("node", BITS).bitwiseAND(mask), F.col("node").bitwiseAND(mask)] if packed else [F.col(c) for c in node]
    full = (ids[2] != 0) & (F.col("flow") >= least)
    k = F.when(full, 3).when(ids[1] != 0, 2).otherwise(1).alias("k")
    cut = [F.when(full, F.col("node")).otherwise(F.col("node").bitwiseAND(F.lit(-(1 << BITS)))).alias("node")] if packed else [F.col("w1"), F.col("w2"), F.when(full, F.col("w3")).otherwise(zero).alias("w3")]
    rest = nodes.select(k, *cut, (F.col("flow") - F.when(full, F.col("on")).otherwise(0)).alias("n")).groupBy("k", *node).agg(F.sum("n").alias("n"))
    spelled = [c.alias(w) for c, w in zip(ids, IDS)]
    return whole.where(heavy).select(F.lit(4).alias("k"), *spelled, "w4", "n").unionByName(rest.select("k", *spelled, zero.alias("w4"), "n"))


def compact_paths(edges: DataFrame) -> DataFrame:
    """edges(w1..w4, n), distinct -> (words array<bigint>, n): maximal unary paths; every other edge is a path of its own.

    A node with one edge in and one out, of one weight, lies inside a path.
    Edges find the first edge of their path by pointer doubling: a round joins
    what is not settled with itself and is written out. Edges of cycles without
    another way in never settle and stay single. A path is no longer than the
    longest piece.
    """
    edges = materialize(edges.withColumn("edge", F.monotonically_increasing_id()), "edges")
    into = edges.groupBy(F.col("w2").alias("a"), F.col("w3").alias("b"), F.col("w4").alias("c")).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.max("edge").alias("prev")).where("k = 1").drop("k")
    out = edges.groupBy(F.col("w1").alias("a"), F.col("w2").alias("b"), F.col("w3").alias("c")).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.max("edge").alias("edge")).where("k = 1").drop("k")
    links = materialize(into.join(out, ["a", "b", "c", "n"]).select("edge", F.col("prev").alias("to"), F.lit(1).cast("bigint").alias("far")), "links")
    settled, state, left = None, links.withColumn("done", F.lit(False)), links.count()
    while left:
        ahead = state.select(F.col("edge").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("done").alias("over"))
        # What an edge points at is a first edge if it has no link itself.
        step = materialize(state.where("not done").join(ahead, "to", "left").select("edge", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.coalesce("over", F.lit(True)).alias("done")), "doubling")
        now = step.where("done")
        settled = now if settled is None else settled.unionByName(now)
        state, before = settled.unionByName(step.where("not done")), left
        left = step.where("not done").count()
        if left == before:
            break
    if settled is None:
        return edges.select(F.array(*IDS).alias("words"), "n")
    tails = edges.join(settled, "edge").groupBy(F.col("to").alias("edge")).agg(F.transform(F.array_sort(F.collect_list(F.struct("far", "w4"))), lambda x: x["w4"]).alias("rest"))
    heads = edges.join(settled.select("edge"), "edge", "left_anti").join(tails, "edge", "left")
    return heads.select(F.concat(F.array(*IDS), F.coalesce("rest", F.expr("cast(array() as array<bigint>)"))).alias("words"), "n")


def _key(*ids) -> Column:
    return F.concat_ws(",", *[F.col(c) if isinstance(c, str) else c for c in ids])


def gram_counts(flows: DataFrame, paths: DataFrame) -> DataFrame:
    """(k, key, f): phrases as comma-joined numbers with their counts; all heavy ones, and lighter words and pairs too."""
    at = lambda i: F.try_element_at("words", F.col("i") + i)
    steps = paths.select("words", "n", F.explode(F.expr("sequence(1, size(words) - 3)")).alias("i")).select(*[at(i).alias(w) for i, w in enumerate(IDS)], "n")
    out = steps.select(F.lit(4).alias("k"), _key(*IDS).alias("key"), F.col("n").alias("f"))
    above = steps
    for k in (3, 2, 1):
        above = above.select(*IDS[:k], "n").unionByName(flows.where(F.col("k") == k).select(*IDS[:k], "n")).groupBy(*IDS[:k]).agg(F.sum("n").alias("n"))
        if k == 2:
            above = materialize(above, "pairs")
        out = out.unionByName(above.select(F.lit(k).alias("k"), _key(*IDS[:k]).alias("key"), F.col("n").alias("f")))
    return out


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def score_candidates(counts: DataFrame, least: int) -> DataFrame:
    """counts -> candidates (k, key, a, l, r, score) at their lowest-scoring cut."""
    cands = counts.where((F.col("k") > 1) & (F.col("f") >= least))
    head, tail = F.expr("substring_index(key, ',', cut)"), F.expr("substring_index(key, ',', cut - k)")
    cuts = cands.select("k", "key", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    parts = materialize(cuts.select("*", F.posexplode(F.array(head, tail)).alias("side", "part")), "parts")
    named = parts.groupBy("part").agg(F.count("*").alias("n")).join(counts.select(F.col("key").alias("part"), "f"), "part")
    both = join_spread(parts, named, "part").groupBy("k", "key", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    both = both.withColumn("score", F.expr("cast(cast(a as decimal(20,0)) * 2000000 as decimal(38,0)) div cast(cast(l as decimal(20,0)) + cast(r as decimal(20,0)) as decimal(38,0))"))
    best = both.groupBy("k", "key", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("k", "key", "a", "b.l", "b.r", "b.score")


def drop_inner(cands: DataFrame, share: int = 80) -> DataFrame:
    """Without candidates that lie inside a longer one, itself dropped or not, which has share hundredths of their count or more."""
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(0), F.col("k") - m), lambda i: F.array_join(F.slice(F.split("key", ","), i + 1, m), ","))))
    best = cands.where("k > 2").select(F.explode(F.array_distinct(inside)).alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    return cands.join(best, "key", "left").where(F.coalesce(_exact("longer") * 100 < _exact("a") * share, F.lit(True))).drop("longer")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000, share: int = 80, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 4 words.

    A phrase counts at every position inside pieces, overlaps included; a null
    language is `und`, a null or empty text has no words. Candidates have least
    occurrences; ranks go by score, then a (both descending), then the phrase's
    bytes. Rows are counted as often as they are there; ids are not looked at,
    nor other columns. No documents: no rows. Texts are read whole, a
    megabyte at a time.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = materialize(count_words(docs), "words")
    numbered, held, complete = number_words(words, least, most_words)
    flows = materialize(fold_light(edge_counts(docs, held, complete), least), "flows")
    paths = materialize(compact_paths(flows.where("k = 4").select(*IDS, "n")), "paths")
    counts = materialize(gram_counts(flows, paths).where((F.col("k") == 1) | (F.col("f") >= least)), "counts")
    kept = drop_inner(materialize(score_candidates(counts, least), "candidates"), share).withColumn("id", F.substring_index("key", ",", 1).cast("bigint"))
    langs = kept.groupBy("id").agg(F.count("*").alias("n")).join(numbered.select("id", "lang"), "id")
    kept = materialize(join_spread(kept, langs, "id").drop("id"), "kept")
    order = [F.desc("score"), F.desc("a")]
    # First the best of each of 64 parts, ties at the end included: a hot language does not meet in one task.
    some = kept.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("rank", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    some = materialize(some.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "part"), "best")
    spelled = some.select("key", F.posexplode(F.split("key", ",")).alias("at", "id")).withColumn("id", F.col("id").cast("bigint")).join(numbered.select("id", "word"), "id")
    phrases = spelled.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = some.join(phrases, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
