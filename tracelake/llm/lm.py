"""Language-model scores of whole documents.

Two scores: a smoothed unigram score over words, from counts of every training
document, and the log10 probability under a causal self-attention model over
subword ids.

The model predicts the next id's class from a window of ids by one masked
attention head beside the last id itself; an id's share within its class, given
the class of the id before it, comes from counts of the whole training corpus.
The commonest ids are classes of their own, the others are grouped by what
stands before and after them in that corpus. It is trained in numpy on every id of every training document, each
once: documents are dealt by hash into slices, one a round, and a slice into
shards of about SHARD ids; a shard trains from the parameters of the round
before, and the shards' results are averaged by their ids. Shards follow from
the rows alone, not from files or partitions. Scoring slides windows that
overlap over each document; every id is scored once, with at least the overlap
as context.
"""

from __future__ import annotations

import ctypes
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import forget, rank_tokenizer

VOCABULARY = 50_257
END_ID = 50_256
#: Classes: SINGLE common ids alone, the other ids grouped over the rest by their neighbours.
CLASSES, SINGLE = 64, 24
#: Groups that neighbours are counted by, and rounds of grouping.
GROUPS, GROUPING = 32, 12
#: Weight, in ids, of a share in the class that does not look at the id before.
PRIOR = 30
#: Rows of the input embedding: the start mark, common ids alone, others hashed.
INPUTS, COMMON = 2048, 1535
WINDOW, OVERLAP, DIM = 16, 4, 16
#: Ids that one shard trains on, and the eighths of the documents that each round takes.
SHARD, ROUNDS = 2_000_000, (1, 3, 4)
#: Words whose counts every task holds; the others are looked up by a join.
FREQUENT = 400_000


def keep_memory() -> None:
    """For tasks that tokenize nothing: forgets the tokenizers that earlier tasks of this worker left, and lets it keep freed arrays of up to 16 MB for the next ones, instead of fetching zeroed pages for every step; no change where the C library has no such setting."""
    forget()
    try:
        of = ctypes.CDLL(None).mallopt
        of(-3, 16 << 20), of(-1, 64 << 20)  # from what size on arrays are mapped, and how much is kept
    except (AttributeError, OSError):
        pass


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


class AttentionLM:
    """Causal model of id classes; windows are rows of a matrix, padding has target -1."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        d = DIM
        self.p = {"E": g(INPUTS, d), "P": g(WINDOW, d), "QKV": g(d, 3 * d), "O": g(d, d), "C": g(d, CLASSES), "c": np.zeros(CLASSES, np.float32)}

    def attend(self, t: np.ndarray) -> tuple:
        """q, k, v of rows (window, place, 3 * DIM + 1), whose last column is 1; weights s, not normalised, as their sum l comes with the values; outputs o."""
        q, k, v = t[..., :DIM], t[..., DIM : 2 * DIM], t[..., 2 * DIM :]
        s = q @ k.transpose(0, 2, 1)
        np.exp(np.minimum(s, 80, out=s), out=s)
        s *= np.tri(t.shape[1], dtype=s.dtype)
        o = (s @ v).reshape(-1, DIM + 1)
        return q, k, v[..., :DIM], s, o[:, DIM:].copy(), o[:, :DIM] / o[:, DIM:]

    def forward(self, ids: np.ndarray) -> dict:
        """Logits z, and what the gradient needs."""
        p, (n, length) = self.p, ids.shape
        x = p["E"].take(ids.ravel(), 0)
        x.reshape(n, length, DIM)[...] += p["P"]
        qkv = np.empty((n * length, 3 * DIM + 1), x.dtype)
        qkv[:, : 3 * DIM] = x @ p["QKV"]
        qkv[:, 3 * DIM] = 1
        q, k, v, s, l, o = self.attend(qkv.reshape(n, length, -1))
        f = x + o @ p["O"]
        z = f @ p["C"]
        z += p["c"]
        return {"x": x, "q": q, "k": k, "v": v, "s": s, "o": o, "l": l, "f": f, "z": z}

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each input and each place add to the projections and logits, and the projection of attention outputs to logits."""
        p, one = self.p, np.ones((1, 1), np.float32)
        wide = lambda m, last: np.concatenate([m @ p["QKV"], np.repeat(last * one, len(m), 0), m @ p["C"]], axis=1)
        place = wide(p["P"], 0)
        place[:, 3 * DIM + 1 :] += p["c"]
        return wide(p["E"], 1), place, p["O"] @ p["C"]

    def log_prob(self, ids: np.ndarray, targets: np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Natural log probability of each target class; 0 where the target is -1."""
        (of_id, of_place, project), (n, length), target = tables or self.tables(), ids.shape, targets.ravel()
        t = of_id.take(ids.ravel(), 0).reshape(n, length, -1)
        t += of_place
        *_, o = self.attend(t[..., : 3 * DIM + 1])
        z = o @ project
        z += t.reshape(n * length, -1)[:, 3 * DIM + 1 :]
        own = z[np.arange(len(z)), np.maximum(target, 0)]
        top = 0
        if z.max() > 80:  # too large for plain exponentials
            top = z.max(1)
            z -= top[:, None]
        np.exp(z, out=z)
        out = own - top - np.log(z @ np.ones(CLASSES, z.dtype))
        out[target < 0] = 0
        return out.reshape(targets.shape)

    def gradient(self, ids: np.ndarray, targets: np.ndarray) -> dict:
        """Of the mean negative log probability over targets."""
        p, m, t, (n, length) = self.p, self.forward(ids), targets.ravel(), ids.shape
        live = np.flatnonzero(t >= 0)
        share = np.zeros(len(t), m["z"].dtype)
        share[live] = 1 / max(1, len(live))
        dz = m["z"]
        np.exp(np.minimum(dz, 80, out=dz), out=dz)
        dz *= (share / (dz @ np.ones(CLASSES, dz.dtype)))[:, None]
        dz[live, t[live]] -= share[live]
        g = {"C": m["f"].T @ dz, "c": dz.sum(0)}
        dh = dz @ p["C"].T
        g["O"] = m["o"].T @ dh
        do = dh @ p["O"].T
        do /= m["l"]
        inner, do = np.einsum("ij,ij->i", do, m["o"]), do.reshape(n, length, DIM)
        ds = do @ m["v"].transpose(0, 2, 1)
        ds -= inner.reshape(n, length, 1)
        ds *= m["s"]
        d = np.empty((n, length, 3 * DIM), ds.dtype)
        np.matmul(ds, m["k"], out=d[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), m["q"], out=d[..., DIM : 2 * DIM])
        np.matmul(m["s"].transpose(0, 2, 1), do, out=d[..., 2 * DIM :])
        d = d.reshape(-1, 3 * DIM)
        g["QKV"] = m["x"].T @ d
        dh += d @ p["QKV"].T
        g["P"] = dh.reshape(n, length, DIM).sum(0)
        row = ids.ravel().astype(np.uint16)
        order = np.argsort(row, kind="stable")
        row = row[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        g["E"] = np.zeros_like(p["E"])
        g["E"][row[first]] = np.add.reduceat(dh[order], first, axis=0)
        return g

    def pack(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def unpack(self, values: np.ndarray) -> AttentionLM:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self


class Trainer:
    """Adam over a stream of documents' ids: every id is a target once, in windows that follow one another."""

    def __init__(self, model: AttentionLM, ids: Ids, rate: float, batch: int = 256):
        self.model, self.ids, self.rate, self.batch = model, ids, rate, batch
        self.first = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.steps, self.seen, self.waiting, self.held = 0, 0, [], 0

    def add(self, doc: np.ndarray) -> None:
        self.waiting.append(doc)
        self.held += len(doc)
        if self.held > 32 * self.batch * WINDOW:
            self.flush()

    def flush(self) -> None:
        lengths = np.array([len(d) for d in self.waiting], np.int64)
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int64)
        target, row, begin = self.ids.klass[flat], self.ids.row[flat], np.cumsum(lengths) - lengths
        n = -(-lengths // WINDOW)
        doc = np.repeat(np.arange(len(lengths)), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        for i in range(0, len(doc), self.batch):
            x, y, _ = slices(row, target, begin, lengths, doc[i : i + self.batch], start[i : i + self.batch])
            self.step(self.model.gradient(x, y))
        self.seen += len(flat)
        self.waiting, self.held = [], 0

    def step(self, gradient: dict) -> None:
        self.steps += 1
        a, b = np.float32(self.rate / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.99**self.steps))
        for k, g in gradient.items():
            m1, m2 = self.first[k], self.second[k]
            m1 *= np.float32(0.9)
            m1 += np.float32(0.1) * g
            m2 *= np.float32(0.99)
            m2 += np.float32(0.01) * g * g
            self.model.p[k] -= a * m1 / (np.sqrt(b * m2) + np.float32(1e-6))


class Ids:
    """From corpus counts of ids: each id's class, its log share within the class, and its input row.

    near, of shape (ids, 2 * GROUPS), counts each id by the group of the id
    before and of the id after it; without it classes are dealt by falling count.
    """

    def __init__(self, counts: np.ndarray, near: np.ndarray | None = None):
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.klass = np.where(place < SINGLE, place, SINGLE + (place - SINGLE) % (CLASSES - SINGLE)).astype(np.int64)
        if near is not None:
            met = order[SINGLE:][counts[order[SINGLE:]] > 0]
            self.klass[met] = SINGLE + grouped(near[met], counts[met], near.sum(0), CLASSES - SINGLE)
        self.mass = counts + 0.5
        self.log_share = np.log(self.mass / np.bincount(self.klass, self.mass, CLASSES)[self.klass])
        self.row = np.where(place < COMMON, 1 + place, 1 + COMMON + (np.arange(len(order)) * 2654435761 % 2**32) % (INPUTS - COMMON - 1)).astype(np.int64)
        self.given: np.ndarray | None = None

    def follow(self, pairs: np.ndarray) -> None:
        """Shares given the class before, from counts of shape (CLASSES, ids); few counts stay near the plain share."""
        self.given = np.empty(pairs.shape, np.float32)
        for c, n in enumerate(pairs):
            self.given[c] = np.log((n + PRIOR * np.exp(self.log_share)) / (np.bincount(self.klass, n, CLASSES) + PRIOR)[self.klass])

    def shares(self, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log share of each id of texts that follow one another, beginning at these places."""
        if self.given is None:
            return self.log_share[flat]
        return self.given[self.klass[before(flat, begin)], flat]


def before(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The id before each; the end id before the first of a text."""
    out = np.empty_like(flat)
    out[1:] = flat[:-1]
    out[begin] = END_ID
    return out


def grouped(near: np.ndarray, counts: np.ndarray, all_near: np.ndarray, groups: int) -> np.ndarray:
    """A group of each id: k-means, by counts, of the square roots of the shares of its neighbours' groups, from a cut along their main axis."""
    if not len(near):
        return np.zeros(0, np.int64)
    prior = 4 * all_near / max(1, all_near.sum())
    x = np.sqrt((near + prior) / (near.sum(1, keepdims=True) + prior.sum() + 1e-9))
    centred = x - np.average(x, axis=0, weights=counts)
    axis = np.linalg.eigh((centred * counts[:, None]).T @ centred)[1][:, -1]
    along = np.argsort(centred @ (axis * np.sign(axis[np.abs(axis).argmax()])), kind="stable")
    group = np.empty(len(x), np.int64)
    group[along] = np.minimum(np.cumsum(counts[along]) * groups / counts.sum(), groups - 1)
    for _ in range(GROUPING):
        weight = np.bincount(group, counts, groups)
        centre = np.stack([np.bincount(group, counts * c, groups) for c in x.T], 1) / np.maximum(weight, 1e-9)[:, None]
        far = (centre * centre).sum(1) - 2 * x @ centre.T
        far[:, weight == 0] = np.inf
        group = far.argmin(1)
    return group


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first position) of each window over documents of these many targets."""
    step = WINDOW - OVERLAP
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // step)), 0)
    doc = np.repeat(np.arange(len(lengths)), n)
    return doc, (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step


def slices(row: np.ndarray, target: np.ndarray, begin: np.ndarray, lengths: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, positions) of the windows that start there in these documents. The input is the id before the target, or the start mark."""
    pos = start[:, None] + np.arange(WINDOW)
    inside = pos < lengths[doc][:, None]
    at = np.minimum(begin[doc][:, None] + pos, len(row) - 1)
    return np.where(pos == 0, 0, row[np.maximum(at - 1, 0)]), np.where(inside, target[at], -1), pos


def score_ids(model: AttentionLM, ids: Ids, docs: list[np.ndarray], chunk: int = 256) -> np.ndarray:
    """log10 probability of each id sequence, every id scored once."""
    lengths = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    target, row, begin = ids.klass[flat], ids.row[flat], np.cumsum(lengths) - lengths
    total = np.bincount(np.repeat(np.arange(len(docs)), lengths), ids.shares(flat, begin[lengths > 0]), len(docs))
    (doc, start), tables = windows(lengths), model.tables()
    for i in range(0, len(doc), chunk):
        d, s = doc[i : i + chunk], start[i : i + chunk]
        x, y, _ = slices(row, target, begin, lengths, d, s)
        y[s > 0, :OVERLAP] = -1
        total += np.bincount(d, model.log_prob(x, y, tables).sum(1, dtype=float), len(docs))
    return total / np.log(10)


def read_corpus(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, flush: int = 200_000) -> DataFrame:
    """In one pass: (kind 0, key, n) counts of words by task, of the training rows; (kind 1, n, h, doc_id, train, text, ids) every row's number of ids, hash, lower-case text and ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted(c: Counter) -> pd.DataFrame:
            return pd.DataFrame({"kind": 0, "key": list(c.keys()), "n": list(c.values()), "h": 0, "doc_id": pd.array([None] * len(c), "Int64"), "train": True, "text": None, "ids": None})

        words = Counter()
        for b in batches:
            for i in range(0, len(b), 128):
                part = b.iloc[i : i + 128]
                texts = [(t or "").encode().lower() for t in part.text]
                for t, train in zip(texts, part.train):
                    if train:
                        words.update(t.split())
                packed = [np.append(np.frombuffer(p, "<u4"), END_ID).astype("<u2") for p in rank_tokenizer(tokenizer).pack(texts)]
                yield pd.DataFrame({"kind": 1, "key": None, "n": [len(p) for p in packed], "h": part.h.to_numpy(), "doc_id": part.doc_id.astype("Int64").to_numpy(), "train": part.train.to_numpy(), "text": texts, "ids": [p.tobytes() for p in packed]}).astype({"doc_id": "Int64"})
                if len(words) > flush:
                    yield counted(words)
                    words = Counter()
        yield counted(words)

    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), h.alias("h"), (~held_out(id_col)).alias("train"), F.col(text_col).alias("text"))
    return rows.mapInPandas(read, "kind int, key binary, n long, h long, doc_id long, train boolean, text binary, ids binary")


def tally(sequences: DataFrame, cells: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray], pieces: int = 32) -> np.ndarray:
    """Counts of the cells that of(ids, the ids before them) names, over all sequences; their sums by piece reach the driver, 8 bytes a cell."""
    size, chunk = -(-cells // pieces), 200_000

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, n = np.zeros(size * pieces, np.int64), [], 0

        def add() -> None:
            docs = [np.frombuffer(d, "<u2") for d in held]
            flat = np.concatenate(docs).astype(np.int64)
            lengths = np.array([len(d) for d in docs])
            np.add.at(total, of(flat, before(flat, np.cumsum(lengths) - lengths)), 1)
            held.clear()

        keep_memory()
        for b in batches:
            for data in b.ids:
                held.append(data)
                n += len(data) // 2
                if n > chunk:
                    add()
                    n = 0
        if held:
            add()
        yield pd.DataFrame({"piece": np.arange(pieces), "n": [p.tobytes() for p in total.reshape(pieces, size)]})

    def add_up(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [part.piece.iloc[0]], "n": [sum(np.frombuffer(p, np.int64) for p in part.n).tobytes()]})

    # Few tasks that read much each: every task makes one row a piece, whatever it reads.
    few = sequences.select("ids").coalesce(2 * sequences.sparkSession.sparkContext.defaultParallelism)
    got = few.mapInPandas(count, "piece int, n binary").groupBy("piece").applyInPandas(add_up, "piece int, n binary").collect()
    out = np.zeros((pieces, size), np.int64)
    for r in got:
        out[r.piece] = np.frombuffer(r.n, np.int64)
    return out.ravel()[:cells]


def fit_ids(sequences: DataFrame) -> Ids:
    """Ids with their classes and shares, from two counts over all training documents: of the groups next to each id, then of ids by the class before them."""
    near = tally(sequences, VOCABULARY * 2 * GROUPS, lambda id_, last: np.concatenate([id_ * (2 * GROUPS) + last % GROUPS, last * (2 * GROUPS) + GROUPS + id_ % GROUPS])).reshape(VOCABULARY, -1)
    ids = Ids(near[:, :GROUPS].sum(1).astype(float), near.astype(np.float32))
    klass = ids.klass
    del near
    forget()
    ids.follow(tally(sequences, CLASSES * VOCABULARY, lambda id_, last: klass[last] * VOCABULARY + id_).reshape(CLASSES, -1))
    return ids


def fit_model(sequences: DataFrame, ids: Ids, total: int, rate: float = 0.01) -> AttentionLM:
    """Rounds over slices of sequences(n, h, ids), shard by shard. Only one set of parameters a round reaches the driver."""
    model, known, eighth = AttentionLM(), pickle.dumps((ids.klass, ids.row)), F.pmod(F.shiftright("h", 8), F.lit(sum(ROUNDS)))
    begin = 0
    for k, eighths in enumerate(ROUNDS):
        now = model.pack()
        shards = max(1, round(total * eighths / sum(ROUNDS) / SHARD))

        def learn(batches: Iterator[pd.DataFrame], now: np.ndarray = now, k: int = k) -> Iterator[pd.DataFrame]:
            keep_memory()
            table, own, shard = Ids.__new__(Ids), None, None
            table.klass, table.row = pickle.loads(known)

            def done() -> pd.DataFrame:
                own.flush()
                return pd.DataFrame({"i": np.arange(len(now)), "v": own.model.pack().astype(float) * own.seen, "n": own.seen})

            for b in batches:
                for at, data in zip(b.shard, b.ids):
                    if at != shard:
                        if own:
                            yield done()
                        shard, own = at, Trainer(AttentionLM().unpack(now), table, rate / (1 + k))
                    own.add(np.frombuffer(data, "<u2").astype(np.int64))
            if own:
                yield done()

        part = sequences.where((eighth >= begin) & (eighth < begin + eighths)).withColumn("shard", F.pmod(F.shiftright("h", 16), F.lit(shards)).cast("int"))
        dealt = part.select("shard", "h", "ids").repartition("shard").sortWithinPartitions("shard", "h", "ids")
        got = dealt.mapInPandas(learn, "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
        if len(got):
            model.unpack(got.sort_values("i").v.to_numpy())
        begin += eighths
    return model


def frequent_from(words: DataFrame, most: int) -> int:
    """The least count that at most so many words reach, from a table of counts by size class (a few hundred rows whatever the corpus)."""
    size = F.floor(F.log2("n") * 8)
    classes = words.groupBy(size.alias("size")).agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.count("*").alias("words")).orderBy(F.desc("size")).collect()
    total, least = 0, (classes[0].largest + 1 if classes else 1)
    for c in classes:
        total += c.words
        if total > most:
            break
        least = c.least
    return int(least)


def word_scores(top: pa.Table, tokens: int) -> dict[bytes, float]:
    """log10 of the smoothed share of each word of top (key, n); words of one count share the number."""
    counts, of = np.unique(top["n"].to_numpy(), return_inverse=True)
    logs = np.log10((counts + 1) / (tokens + 1)).tolist()
    return dict(zip(top["key"].to_pylist(), map(logs.__getitem__, of.tolist())))


def score_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row, learned from the rows that are not held out.

    A null or empty text is its end token alone. A null id is scored and learned
    from like any other; repeated rows come back as often as they came. Very long
    texts are read whole; other columns are not read. Nothing to learn from: zero
    counts, and the model as it starts. Empty input: empty result.
    """
    spark = docs.sparkSession
    read = materialize(read_corpus(docs, id_col, text_col, tokenizer), "corpus")
    words = materialize(read.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")), "words")
    sequences = read.where("kind = 1 and train").select("n", "h", "ids")
    seen, met = words.agg(F.sum("n"), F.count("*")).first(), sequences.agg(F.sum("n"), F.count("*")).first()
    n_docs = met[1]
    total, distinct = (seen[0] or 0) + n_docs, seen[1] + (n_docs > 0)
    ids = fit_ids(sequences)
    model = fit_model(sequences, ids, met[0] or 0)
    # The driver holds these as Arrow buffers of some 10 MB, not as objects; tasks make the dictionary.
    top = words.where(F.col("n") >= frequent_from(words, frequent)).select("key", "n").toArrow()
    shared = spark.sparkContext.broadcast(pickle.dumps((ids, model, top)))
    del top, ids, model
    forget()
    end_score = float(np.log10((n_docs + 1) / (total + distinct + 1)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_memory()
        ids_, model_, top_ = pickle.loads(shared.value)
        known = word_scores(top_, total + distinct)
        get, columns = known.get, ["doc_id", "hash", "word", "n", "copies", "tokens", "known", "base", "lm"]
        task, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, len(b), 128):
                part = b.iloc[i : i + 128]
                lm = score_ids(model_, ids_, [np.frombuffer(p, "<u2").astype(np.int64) for p in part.ids])
                rows = []
                for doc, h, text, v in zip(part.doc_id, part.h, part.text, lm):
                    doc, nth = None if pd.isna(doc) else int(doc), nth + 1
                    ws = text.split()
                    got = list(map(get, ws))
                    rare: dict = {}
                    if None in got:
                        rare = Counter(w for w, s in zip(ws, got) if s is None)
                        got = [s for s in got if s is not None]
                    # A word holds no space, so this row's key meets no word in the join; it differs row by row, so copies don't meet either.
                    rows.append((doc, h, b" %d %d" % (task, nth), 0, 1, len(ws) + 1, len(got) + (n_docs > 0), sum(got) + end_score, v))
                    rows += [(doc, h, w, n, 0, 0, 0, 0.0, 0.0) for w, n in rare.items()]
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    parts = read.where("kind = 1").select("doc_id", "h", "text", "ids").mapInPandas(score, "doc_id long, hash long, word binary, n long, copies long, tokens long, known long, base double, lm double")
    c = F.coalesce(F.col("c"), F.lit(0))
    joined = parts.join(words.select(F.col("key").alias("word"), F.col("n").alias("c")), "word", "left").select(
        "doc_id", "hash", "copies", "tokens", "lm",
        (F.col("known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
        (F.col("base") + F.col("n") * F.log10((c + 1) / F.lit(float(total + distinct + 1)))).alias("base"),
    )
    sums_ = joined.groupBy("doc_id", "hash").agg(*(F.sum(x).alias(x) for x in ("copies", "tokens", "known", "base", "lm")))
    # Rows repeated whole were added up together: share the sums out again.
    each = sums_.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        F.col("doc_id").alias(id_col), held_out(id_col).alias("held_out"),
        F.expr("tokens div copies").alias("n_tokens"), F.expr("known div copies").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"), (F.col("lm") / F.col("copies")).alias("score"),
    )
