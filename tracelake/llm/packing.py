"""Packing documents into sequences of a fixed length.

Documents are tokenized where they lie. What is longer than a sequence is cut
into full pieces and a rest; pieces (numbers only, no ids) are dealt at random
into groups, and each group is packed on its own by first-fit decreasing: pieces
from longest to shortest, each into the first sequence with room, found by
descending a tournament tree whose nodes hold the most room below them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import word_tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class RoomTree:
    """Tournament tree over bins that start with the same room."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [room] * (2 * self.size)

    def put(self, need: int) -> tuple[int, int]:
        """Put need into the leftmost bin with room: (bin, room it had)."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < need:
                i += 1
        had = room[i]
        at = i - self.size
        room[i] = had - need
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at, had


def first_fit_decreasing(lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; lengths must not exceed room."""
    tree = RoomTree(max(1, len(lengths)), room)
    out: list = [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at, had = tree.put(lengths[i])
        out[i] = (at, room - had)
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = 4096, end_id: int = 2, group_pieces: int = 4096) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is the end id alone. Null ids and repeated rows are
    packed like any other row; other columns are not read. Empty input: empty
    result. group_pieces sets how many pieces share a group on average. Pieces
    are dealt row by row, not by content, and the number of groups follows
    theirs, so no task grows with the input.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, task = word_tokenizer(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                for doc, ids in zip(part.doc_id, words.pack([(t or "").encode() for t in part.text])):
                    ids += end
                    n = len(ids) // 4
                    doc = None if pd.isna(doc) else int(doc)
                    rows += [(doc, s, min(sequence, n - s), zlib.crc32(ids[4 * s : 4 * (s + sequence)]), n) for s in range(0, n, sequence)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})
            yield out.assign(nth=range(task, task + len(out)))
            task += len(out)

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "nth"], ascending=[False, True])
        at = first_fit_decreasing(group.length.tolist(), sequence)
        return group.assign(sequence_id=(int(group.grp.iloc[0]) << 32) + pd.Series([a for a, _ in at], index=group.index, dtype="int64"), offset=[o for _, o in at]).drop(columns=["grp", "nth"])

    pieces = materialize(source.mapInPandas(cut, PIECES + ", nth long"), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    return pieces.withColumn("grp", F.expr(f"pmod(xxhash64(nth, 20), {groups})")).groupBy("grp").applyInPandas(place, PIECES + ", sequence_id long, offset long")
