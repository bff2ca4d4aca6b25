"""Brute-force versions that the operators are held against."""

import re
import zlib

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grams(text):
    """Set of five-word shingles."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(n, linked):
    low = list(range(n))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def unigram(rows):
    """doc_id -> (n_tokens, n_known, N, base score)."""
    tokens = {i: [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None] for i, t in rows}
    counts = {}
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(w in counts for w in ws), n, sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}
