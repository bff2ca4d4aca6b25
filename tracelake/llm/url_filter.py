"""URL filtering with a bit-parallel wildcard automaton.

All glob rules are packed side by side into the bits of a few 64-bit words, one
bit for "the first i elements of rule r have matched". Reading a character moves
every rule of every URL of a batch at once:

    D = ((D << 1) & B[char]) | (D & L[char])

B holds the positions a character may advance to, L those a wildcard keeps
alive. A rule has matched when its last bit is set after the last character.

Rules are globs over the canonical form "." + host + path (host lower-cased,
path up to ? or #): ``*`` is any run within its part (before the first "/": no
"/"), ``**`` any run at all, ``?`` one character but "/".
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named glob with a verdict; of the rules that match, the one of the highest weight decides, then the first."""

    name: str
    glob: str
    verdict: str
    weight: int


def host_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host, its subdomains, and every path that starts with /path. Longer rules weigh more."""
    return Rule(text, f"*.{text}**", verdict, 1000 + len(text))


class ShiftAnd:
    """The automaton over bytes of the canonical form."""

    def __init__(self, globs: Sequence[str]):
        advance: list[set[int] | None] = []
        loops: dict[int, str] = {}
        tails: set[int] = set()  # after "?": the bytes that continue its character
        starts, finals = [], []
        for glob in globs:
            starts.append(len(advance))
            advance.append(set())
            g, i = glob.encode(), 0
            seen_slash = False
            while i < len(g):
                if g[i : i + 2] == b"**":
                    loops[len(advance) - 1] = "all"
                    i += 2
                elif g[i : i + 1] == b"*":
                    if loops.get(len(advance) - 1) != "all":
                        loops[len(advance) - 1] = "path" if seen_slash else "host"
                    i += 1
                else:
                    seen_slash |= g[i : i + 1] == b"/"
                    if g[i : i + 1] == b"?":
                        tails.add(len(advance))
                    advance.append(None if g[i : i + 1] == b"?" else {g[i]})
                    i += 1
            finals.append(len(advance) - 1)
        self.words = max(1, -(-len(advance) // 64))
        self.finals = finals
        self.start = self._mask(starts)
        self.B = np.zeros((256, self.words), np.uint64)
        self.L = np.zeros((256, self.words), np.uint64)
        for pos, chars in enumerate(advance):
            word, bit = divmod(pos, 64)
            for c in range(256):
                if (chars is None and c != 0x2F and not 0x80 <= c < 0xC0) or (chars and c in chars):
                    self.B[c, word] |= np.uint64(1 << bit)
                if (pos in tails and 0x80 <= c < 0xC0) or pos in loops and (loops[pos] == "all" or loops[pos] == "path" or c != 0x2F):
                    self.L[c, word] |= np.uint64(1 << bit)

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        m = np.zeros(self.words, np.uint64)
        for b in bits:
            m[b // 64] |= np.uint64(1 << (b % 64))
        return m

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """Final states, one row per text."""
        n = len(texts)
        state = np.tile(self.start, (n, 1))
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        lengths, at = lengths[order], at[order]
        live = state[order]
        for t in range(int(lengths[0]) if n else 0):
            k = int(np.searchsorted(-lengths, -t, "left"))  # those longer than t
            c = flat[at[:k] + t]
            d = live[:k]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            live[:k] = (moved & self.B[c]) | (d & self.L[c])
        state[order] = live
        return state

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: text by rule."""
        s = self.run(texts)
        return np.stack([(s[:, f // 64] >> np.uint64(f % 64)) & np.uint64(1) for f in self.finals], axis=1).astype(bool) if self.finals else np.zeros((len(texts), 0), bool)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (the deciding rule's name, else null) and verdict to every row.

    Null and malformed urls: empty host and path, judged like any other by the
    globs. Repeated rows are judged alike and stay; columns of pages named like
    an added one are replaced. Rules are a parameter list, compiled per task.
    """
    by_weight = sorted(rules, key=lambda r: -r.weight)
    automaton = ShiftAnd([r.glob for r in by_weight])
    names = np.array([r.name for r in by_weight] + [None], object)
    verdicts = np.array([r.verdict for r in by_weight] + [default], object)

    @F.pandas_udf("rule string, verdict string")
    def judge(canon: pd.Series) -> pd.DataFrame:
        hit = automaton.matches([c.encode() for c in canon])
        first = np.where(hit.any(1), hit.argmax(1), len(names) - 1) if hit.shape[1] else np.zeros(len(canon), int)
        return pd.DataFrame({"rule": names[first], "verdict": verdicts[first]})

    host, path = split_url(F.col("__url"))
    judged = pages.withColumn("__url", F.col(url_col)).withColumns({"host": host, "path": path}).drop("__url")
    return judged.withColumn("__j", judge(F.concat(F.lit("."), "host", "path"))).withColumns({"rule": F.col("__j.rule"), "verdict": F.col("__j.verdict")}).drop("__j")
