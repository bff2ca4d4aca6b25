"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (1024 bytes each). Every passage is described by
counts of byte kinds, hashed byte pairs and how much it repeats itself, encoded
by one learned layer, and weighed by gated attention; the weighted sum of the
encodings is scored. Weights are learned from document labels alone.

Fitted on a bounded, documented sample of labelled rows (per_label of each
label, those with the smallest hash of the id); only features reach the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 1024
PAIRS = 128

_KIND = np.full(256, 7, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'\"?-()", b"!", b"|#*$%&@+=_<>[]{}~^/\\`")):
    _KIND[list(_chars)] = _i
KINDS = 8
WIDTH = KINDS + PAIRS + 8
_MIX = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64)


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages per text); every text has at least one."""
    data = [(t or "").encode() for t in texts]
    counts = np.array([max(1, -(-len(d) // PASSAGE)) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(d) for d in data])
    begin = np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = begin + nth * PASSAGE
    length = np.minimum(PASSAGE, np.repeat(sizes, counts) - nth * PASSAGE)
    n = len(begin)
    who = np.repeat(np.arange(n), length)
    size = np.maximum(length, 1)[:, None]
    kinds = np.bincount(who * KINDS + _KIND[flat], minlength=n * KINDS).reshape(n, KINDS) / size
    pair = _MIX[(flat[:-1].astype(np.int64) << 8) | flat[1:]] if len(flat) > 1 else np.zeros(0, np.int64)
    inside = who[:-1] == who[1:] if len(flat) > 1 else np.zeros(0, bool)
    hist = np.bincount(who[:-1][inside] * PAIRS + pair[inside], minlength=n * PAIRS).reshape(n, PAIRS) / size
    own = np.zeros((n, 8))
    at = 0
    for d, c in zip(data, counts):
        lines = [x for x in d.split(b"\n") if x]
        kept = len(set(lines)) / len(lines) if lines else 1.0
        for k in range(c):
            w = d[k * PASSAGE : (k + 1) * PASSAGE].split()
            distinct = len(set(w))
            repeats = sum(a == b for a, b in zip(w, w[1:]))
            own[at] = (distinct / max(1, len(w)), np.log1p(len(w)) / 6, kept, np.log1p(len(d)) / 12, len(w) / 256, repeats / max(1, len(w)), 0, 0)
            at += 1
    own[:, 6] = (hist**2).sum(1) ** 0.5
    own[:, 7] = hist.max(1)
    return np.concatenate([kinds, np.sqrt(hist), own], axis=1).astype(np.float32), counts


class GatedAttention:
    """Encoder, gated attention and scorer; bags are consecutive rows."""

    def __init__(self, width: int, hidden: int = 24, attention: int = 12, seed: int = 1):
        r = np.random.default_rng(seed)
        scale = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": scale(width, hidden), "b": np.zeros(hidden, np.float32), "V": scale(hidden, attention), "U": scale(hidden, attention), "w": scale(attention, 1), "c": scale(hidden, 1), "d": np.zeros(1, np.float32)}
        self.mean, self.std = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.prior: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p = self.p
        at = np.cumsum(counts) - counts
        x = (x - self.mean) / self.std
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = ((t * g) @ p["w"])[:, 0]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, at), counts))
        a = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        y = 1 / (1 + np.exp(-np.clip((z @ p["c"])[:, 0] + p["d"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "at": at}

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, counts)
        do = ((f["y"] - y) * weight / weight.sum()).astype(np.float32)[:, None]
        dz = np.repeat(do @ p["c"].T, counts, axis=0)
        a, h = f["a"][:, None], f["h"]
        da = (dz * h).sum(1)
        ds = (f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["at"]), counts)))[:, None]
        dt, dg = ds @ p["w"].T * f["g"] * (1 - f["t"] ** 2), ds @ p["w"].T * f["t"] * f["g"] * (1 - f["g"])
        dh = (a * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ do, "d": do.sum(0)}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> GatedAttention:
        if len(y) == 0 or len(set(y)) < 2:
            self.prior = float(y[0]) if len(y) else 0.5
            return self
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        at, step = np.cumsum(counts) - counts, 0
        share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(order), batch):
                docs = order[i : i + batch]
                rows = np.concatenate([np.arange(at[d], at[d] + counts[d]) for d in docs])
                step += 1
                for k, g in self.gradient(x[rows], counts[docs], y[docs], share[docs]).items():
                    g = g + decay * self.p[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        out = []
        for i in range(0, len(texts), 256):
            x, counts = passages(texts[i : i + 256])
            out.append(self.forward(x, counts)["y"].astype(float))
        return np.concatenate(out) if out else np.zeros(0)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 1500) -> GatedAttention:
    """Fit on at most per_label labelled ids of each label among those not held out, on every passage of their texts.

    Null labels and ids are skipped; an id labelled twice counts with its larger
    label; every row of a chosen id is a bag. No labels: every score is 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    order = F.xxhash64(F.col(id_col), F.lit(5))
    chosen = known.where("__y = 0").orderBy(order).limit(per_label).unionByName(known.where("__y = 1").orderBy(order).limit(per_label))
    bags = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, counts = passages(list(b.text))
            rows = [part.tobytes() for part in np.split(x, np.cumsum(counts)[:-1])]
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": rows})

    got = bags.select(F.col(id_col).cast("long").alias("id"), F.col("__y").cast("int").alias("y"), "text").mapInPandas(describe, "id long, y int, x binary").toPandas().sort_values(["id", "x"])
    bags_x = [np.frombuffer(v, np.float32).reshape(-1, WIDTH) for v in got.x]
    model = GatedAttention(WIDTH)
    return model.fit(np.concatenate(bags_x) if bags_x else np.zeros((0, WIDTH), np.float32), np.array([len(v) for v in bags_x], int), got.y.to_numpy())


def add_score(docs: DataFrame, model: GatedAttention, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1 for each whole text, replacing a column of that name.

    Null counts as empty, and empty texts are scored too. Every row, repeated or
    not, is scored alone, whatever its id. Empty input: empty result.
    """
    packed = pickle.dumps(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(pickle.loads(packed).score(list(texts)))

    return docs.withColumn(out, score(F.col(text_col)))
