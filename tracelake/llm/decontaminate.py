"""Benchmark decontamination: one Aho-Corasick automaton over all windows of benchmark words, each text scanned once.

Benchmark items are normalised (A-Z lowered, everything but letters, digits and
non-ASCII characters parting words) and cut into windows of consecutive words.
Each different benchmark word becomes one symbol, so a window is a short symbol
string and a text, normalised alike, is a symbol string with one symbol a word.
The automaton reports every occurrence of every window in one scan; word
positions are mapped back to code points of the original text.

The windows are dealt into shards of at most PER_SHARD windows and SHARD_BYTES
bytes by hash, one automaton each: what a worker holds has a bound, whatever the
size of the benchmark. One shard, the usual case, needs a single pass over the
texts and no shuffle; more shards take a pass each, whose hits are joined by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PER_SHARD = 200_000
SHARD_BYTES = 64 << 20
CHUNK = 1 << 20
SPACE = 0x20
#: Lowered letters, digits and all bytes of non-ASCII characters stay; anything else parts words. No byte moves.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else SPACE for c in range(256))
RUN = "struct<word_from:bigint,word_to:bigint,start:bigint,end:bigint>"
FOUND = f"n_words bigint, runs array<{RUN}>, items array<string>"


def windows_of(words: list[bytes], size: int) -> Iterator[bytes]:
    """Every run of size words, joined by a space; fewer words are one window, none is none."""
    if words:
        yield from (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def benchmark_windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (window, item) of all items; item is the id as text. Rows of one id are one item; a null id gives windows without an item."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, text in zip(b["item"], b["text"]):
                found = windows_of((text or "").encode().translate(FOLD).split(), size)
                while part := list(islice(found, 50_000)):
                    yield pd.DataFrame({"window": [w.decode() for w in part], "item": item})

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(cut, "window string, item string").distinct()


class Scanner:
    """The automaton over (window, item) rows."""

    def __init__(self, rows: list[tuple[str, str | None]]):
        import ahocorasick

        by_window: dict[str, list[str]] = {}
        for window, item in rows:
            held = by_window.setdefault(window, [])
            if item is not None:
                held.append(item)
        #: Symbols from 1 on, past the surrogates; 0 is any other word.
        self.symbols: dict[bytes, str] = {}
        self.items = list(by_window.values())
        self.automaton = ahocorasick.Automaton() if rows else None
        for k, window in enumerate(by_window):
            words = window.encode().split(b" ")
            for w in words:
                if w not in self.symbols:
                    n = len(self.symbols) + 1
                    self.symbols[w] = chr(n if n < 0xD800 else n + 0x800)
            self.automaton.add_word("".join(map(self.symbols.__getitem__, words)), (len(words), k))
        if rows:
            self.automaton.make_automaton()

    def symbols_of(self, folded: bytes) -> str:
        """One symbol a word; the words of a megabyte at a time."""
        get, out, at = self.symbols.get, [], 0
        while at < len(folded):
            cut = len(folded) if at + CHUNK >= len(folded) else folded.find(b" ", at + CHUNK)
            cut = len(folded) if cut < 0 else cut
            out.append("".join([get(w, "\0") for w in folded[at:cut].split()]))
            at = cut
        return "".join(out)

    def find(self, text: str | None) -> tuple[int, list[dict], list[str]]:
        """Words of the text, runs of hit words with their code points, and the items with an occurring window."""
        data = (text or "").encode()
        folded = data.translate(FOLD)
        line = self.symbols_of(folded)
        if self.automaton is None or not line.strip("\0"):
            return len(line), [], []
        ends, sizes, seen = [], [], set()
        for end, (size, k) in self.automaton.iter(line):
            ends.append(end + 1)
            sizes.append(size)
            seen.add(k)
        if not ends:
            return len(line), [], []
        step = np.zeros(len(line) + 1, np.int64)
        stop = np.array(ends)
        np.add.at(step, stop - np.array(sizes), 1)
        np.add.at(step, stop, -1)
        first, last = _edges(step[:-1].cumsum() > 0)
        raw = np.frombuffer(data, np.uint8)
        word_start, word_end = _edges(np.frombuffer(folded, np.uint8) != SPACE)
        point = np.concatenate([[0], ((raw & 0xC0) != 0x80).cumsum()])
        runs = zip(first.tolist(), last.tolist(), point[word_start[first]].tolist(), point[word_end[last - 1]].tolist())
        return len(line), [{"word_from": a, "word_to": b, "start": c, "end": d} for a, b, c, d in runs], sorted({i for k in seen for i in self.items[k]})


def _edges(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs that are true."""
    change = np.diff(on.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


_HERE: dict[str, Scanner] = {}


def _scanner(token: str, rows) -> Scanner:
    """One per worker process: the newest."""
    if token not in _HERE:
        _HERE.clear()
        _HERE[token] = Scanner(rows.value)
    return _HERE[token]


def _scan(df: DataFrame, rows: list[tuple[str, str | None]], text_col: str) -> DataFrame:
    """df with found; rows: one shard, so what is broadcast has a bound."""
    held, token = df.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        find = _scanner(token, held).find
        return pd.DataFrame([find(t) for t in texts], columns=["n_words", "runs", "items"])

    return df.withColumn("found", scan(F.col(text_col)))


def _joined(runs):
    """Runs in order, those that overlap or touch made one."""
    empty = F.expr(f"cast(array() as array<{RUN}>)")

    def take(done, run):
        last = F.element_at(done, -1)
        wider = F.struct(last["word_from"].alias("word_from"), F.greatest(last["word_to"], run["word_to"]).alias("word_to"), last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        touches = (F.size(done) > 0) & F.coalesce(run["word_from"] <= F.try_element_at(done, F.lit(-1))["word_to"], F.lit(False))
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), empty, take)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", per_shard: int = PER_SHARD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with leak: struct<n_words, n_hit, spans array<struct<start, end>>, items array<string>>.

    A word of a text is hit where it lies in an occurrence of a window of the
    benchmark (window consecutive words of an item, or a whole shorter item).
    spans are the maximal runs of hit words in code points of the original text,
    end exclusive; items are the distinct ids, as text, of items with an
    occurring window. A null or empty text, or one without words, has no words
    and no hits, and so has every text if the benchmark is empty. Items without
    words match nothing; rows of one item id are one item; windows of a null id
    hit words but name no item. Rows of docs stay as they are, repeated ones
    too; a column leak of docs is replaced, other columns stay. Texts are
    processed whole, a megabyte of words at a time.
    """
    docs = docs.drop("leak")
    pairs = materialize(benchmark_windows(benchmark, window, item_col, item_text_col), "windows")
    n, size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    shards = max(1, -(-n // per_shard), -(-size // shard_bytes))
    hit = F.expr("aggregate(found.runs, 0L, (n, r) -> n + r.word_to - r.word_from)").alias("n_hit")
    spans = F.expr("transform(found.runs, r -> struct(r.start as start, r.end as end))").alias("spans")
    leak = F.struct("found.n_words", hit, spans, "found.items").alias("leak")
    if shards == 1:
        return _scan(docs, [tuple(r) for r in pairs.collect()], text_col).withColumn("leak", leak).drop("found")
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    dealt = pairs.withColumn("shard", F.pmod(F.xxhash64("window", "item"), F.lit(shards)))
    parts = None
    for k in range(shards):
        part = _scan(rows.select("__row", text_col), [tuple(r) for r in dealt.where(F.col("shard") == k).select("window", "item").collect()], text_col).drop(text_col)
        part = materialize(part if k == 0 else part.where(F.size("found.runs") > 0), "hits")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("__row").agg(F.max("found.n_words").alias("n_words"), F.flatten(F.collect_list("found.runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"))
    found = F.struct("n_words", _joined(F.col("runs")).alias("runs"), "items").alias("found")
    return rows.join(merged.select("__row", found), "__row").withColumn("leak", leak).drop("found", "__row")
