import random
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.util import docs, unigram
from tracelake.llm import lm, packing, pii, quality, registry, tokens, url_filter
from tracelake.llm.tokens import RankTokenizer, tokenizer_path, word_tokenizer


def fits(rule, host, path):
    rhost, _, rpath = rule.partition("/")
    return (host == rhost or host.endswith("." + rhost)) and path.startswith("/" + rpath)


URLS = [
    None, "", "nonsense", "http://", "https://EXAMPLE.com/en/x", "https://www.example.com/en/x", "http://a.www.example.com/en/?q", "http://x.net/es/1#a", "http://x.net/es", "http://net/fr/", "http://xnet/fr/",
    "http://a.b/x.net/es/", "http://example.com", "http://example.com?x=/en/", "http://example.com:80/en/", "ftp://u@com/", "http://ads.site.io/a", "http://site.io/login", "http://é.com/ü/" + "x" * 5000, "http://q.io/f.exe", "http://q.org/",
]


def test_url_rules_against_plain_matching(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, registry.url_rules()).collect()}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0].lower() if rest.isascii() else re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        assert (got[i].host, got[i].path) == (host, path)
        fit = [(len(r), r, v) for r, v in registry.HOST_RULES if fits(r, host, path)]
        if fit:
            assert (got[i].rule, got[i].verdict) == max(fit)[1:]
        else:
            assert got[i].rule not in [r for r, _ in registry.HOST_RULES]
    assert url_filter.filter_urls(df.limit(0), registry.url_rules()).count() == 0


def test_a_question_mark_is_one_character_and_repeated_rows_stay(spark):
    globs = ["*.a/?x**", "*.a/??"]
    texts = ["".join(t) for t in (".a/éx", ".a/é", ".a/漢字", ".a/ab", ".a/abc", ".a/🙂x1", ".a/é/x", ".a/éé")]
    want = [[re.fullmatch(p, t) is not None for p in (r"[^/]*\.a/[^/]x.*", r"[^/]*\.a/[^/][^/]")] for t in texts]
    assert url_filter.ShiftAnd(globs).matches([t.encode() for t in texts]).tolist() == want
    rows = spark.createDataFrame([(1, "http://x.com/"), (1, "http://x.com/"), (2, None)], "page_id long, url string")
    assert url_filter.filter_urls(rows, registry.url_rules()).count() == 3 and url_filter.filter_urls(rows.limit(0), registry.url_rules()).count() == 0


def test_automaton_against_regular_expressions():
    globs = ["*.a.b/**", "**ab?c", "*x*/y*z", ".q/" + "w" * 90 + "*", "**", "*/", "?a**"]
    to_re = lambda g: re.compile("".join(p for p in _parts(g)), re.S)
    r = np.random.default_rng(0)
    texts = ["".join(r.choice(list("abxyz/.cqw"), r.integers(0, 12))) for _ in range(3000)] + [".q/" + "w" * 90 + "k", "x.a.b/", ""]
    got = url_filter.ShiftAnd(globs).matches([t.encode() for t in texts])
    for k, g in enumerate(globs):
        rx = to_re(g)
        assert [bool(rx.fullmatch(t)) for t in texts] == got[:, k].tolist(), g


def _parts(g):
    i, slash = 0, False
    while i < len(g):
        if g[i : i + 2] == "**":
            yield ".*"
            i += 2
            continue
        yield (".*" if slash else "[^/]*") if g[i] == "*" else "[^/]" if g[i] == "?" else re.escape(g[i])
        slash |= g[i] == "/"
        i += 1


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    for kind, rx in BASE.items():
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if ok:
                yield kind, m.start(), m.end()


def test_pii_base_spans_are_the_plain_patterns():
    r = np.random.default_rng(5)
    alphabet = list("a.@-1234567890+() %_é") + ["4111111111111111", "x@y.zz", "1.2.3.4", "+1 (499) 555-6503", "4111 1111 1111 1111"]
    for _ in range(4000):
        t = "".join(r.choice(alphabet, r.integers(0, 30)))
        assert [x[:3] for x in pii.find_spans(t) if x[0] in BASE] == list(plain_spans(t)), t
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000):
        pii.find_spans(long)


def test_pii_rows_and_redaction(spark):
    text = "é my iban GB82 WEST 1234 5698 7654 32, mail a@b.cd, token = \"0123456789abcdef0123456789\" and card 4111111111111111."
    rows = [(1, text, "a"), (1, text, "a"), (2, None, "a"), (3, "", "a"), (None, "1.2.3.4", "b")]
    df = docs(spark, rows)
    got = pii.detect(df).collect()
    assert [s.kind for s in got[0].pii] == ["email", "card", "iban", "secret"] and got[0].pii == got[1].pii and got[2].pii == got[3].pii == []
    clean = [r.text for r in pii.redact(df).collect()]
    assert clean[0] == 'é my iban <iban>, mail <email>, token = "<secret>" and card <card>.' and clean[2] is None and clean[3] == "" and clean[4] == "<ip>"
    assert pii.detect(df.limit(0)).count() == 0


def test_op4_digest(spark, tmp_path):
    rows = [(1, "a@b.cd and 1.2.3.4 +1 499 555 6503", "a"), (2, None, "b")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.op4_pii(spark, str(tmp_path)).collect()}
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(rows[0][1]))
    assert got[1].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[1].spans == joined
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 1) and got[2].spans == ""


def test_word_by_word_ids_are_the_whole_texts_ids():
    texts = ["The quick's don't  Brown\tfox\n12345 é é ß İstanbul ΑΣ Σ x y z", "", " \n", "<|endoftext|> a", "that*** this### 'S 's", "a ̈ b", "x" * 500, "\x1c \x85 q"]
    r = np.random.default_rng(11)
    texts += ["".join(r.choice(list("abTHEing09.,!'|-<>éÀßÿÖ×÷ªİΣσς\u0301# ~"), 400)) for _ in range(40)]
    t = Tokenizer.from_file(tokenizer_path())
    got = word_tokenizer(tokenizer_path()).pack([x.encode() for x in texts])
    for x, g in zip(texts, got):
        assert np.frombuffer(g, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    t = Tokenizer.from_file(tokenizer_path())
    rows = [(i, "word " * (i * 37 % 900), "a") for i in range(60)] + [(100, "long text " * 5000, "b"), (101, None, "b"), (102, "", "b"), (102, "", "b"), (None, "none", "b")]
    got = packing.pack(docs(spark, rows).withColumn("start", F.lit(1)), tokenizer_path(), group_pieces=16).collect()
    want = {}
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 4096):
            key = (str(i), s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    have = {}
    for g in got:
        key = (str(g.doc_id), g.start, g.length, g.ids_crc32, g.doc_tokens)
        have[key] = have.get(key, 0) + 1
    assert have == want
    bins = {}
    for g in got:
        bins.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(docs(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_first_fit_decreasing_against_a_plain_loop():
    r = np.random.default_rng(6)
    lengths = r.integers(1, 101, 300).tolist()
    room, want = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        at = next((b for b, x in enumerate(room) if x >= lengths[i]), len(room))
        if at == len(room):
            room.append(100)
        want[i] = (at, 100 - room[at])
        room[at] -= lengths[i]
    assert packing.first_fit_decreasing(lengths, 100) == [want[i] for i in range(300)]
    assert packing.first_fit_decreasing([], 100) == []


def test_quality_gradient_and_held_out_accuracy(spark):
    m = quality.GatedAttention(5, 4, 3)
    r = np.random.default_rng(7)
    x, counts, y = r.standard_normal((9, 5)).astype(np.float32), np.array([2, 4, 3]), np.array([1, 0, 1])
    w = np.ones(3)
    loss = lambda: -np.mean(y * np.log(m.forward(x, counts)["y"]) + (1 - y) * np.log(1 - m.forward(x, counts)["y"]))
    g = m.gradient(x, counts, y, w)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        m.p[k][i] += 1e-4
        up = loss()
        m.p[k][i] -= 2e-4
        assert g[k][i] == pytest.approx((up - loss()) / 2e-4, rel=0.05, abs=1e-4)
        m.p[k][i] += 1e-4


def plain_passages(text):
    """Features of every passage, by their definitions."""
    data = (text or "").encode()
    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'\"?-()", b"!", b"|#*$%&@+=_<>[]{}~^/\\`"]
    lines = [x for x in data.split(b"\n") if x]
    out = []
    for at in range(0, max(1, len(data)), quality.PASSAGE):
        part = data[at : at + quality.PASSAGE]
        size, words = max(1, len(part)), part.split()
        kind = [sum(c in k for c in part) / size for k in kinds]
        pairs = [0.0] * quality.PAIRS
        for a, b in zip(part, part[1:]):
            pairs[(a * 256 + b) * 0x9E3779B97F4A7C15 % 2**64 >> 57] += 1 / size
        own = [len(set(words)) / max(1, len(words)), np.log1p(len(words)) / 6, len(set(lines)) / len(lines) if lines else 1.0, np.log1p(len(data)) / 12, len(words) / 256, sum(x == y for x, y in zip(words, words[1:])) / max(1, len(words)), sum(p * p for p in pairs) ** 0.5, max(pairs)]
        out.append([*kind, len(part) / size - sum(kind), *(p**0.5 for p in pairs), *own])
    return np.array(out)


def test_quality_scores_are_those_of_a_loop_over_passages():
    r = np.random.default_rng(14)
    model = quality.GatedAttention(quality.WIDTH)
    model.mean, model.std = r.standard_normal(quality.WIDTH).astype(np.float32) / 9, (0.5 + r.random(quality.WIDTH)).astype(np.float32)
    texts = [None, "", "One line!\nOne line!\n\nthe end", "é" * 900 + " ß 12 | x", "abc 123 " * 700]
    p = {k: v.astype(float) for k, v in model.p.items()}
    for text, got in zip(texts, model.score(texts)):
        weight, coded = [], []
        for x in plain_passages(text):
            h = np.tanh((x - model.mean) / model.std @ p["W"] + p["b"])
            weight.append(np.exp(float((np.tanh(h @ p["V"]) / (1 + np.exp(-h @ p["U"]))) @ p["w"][:, 0])))
            coded.append(h)
        z = sum(w * h for w, h in zip(weight, coded)) / sum(weight)
        assert got == pytest.approx(1 / (1 + np.exp(-(z @ p["c"][:, 0] + p["d"][0]))), abs=1e-5)


def test_quality_on_given_tables(spark):
    base = "/root/testdata/sf0.01"
    got = registry.op6_quality(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert held.n > 50 and held.a > 0.95


def test_quality_edge_cases(spark):
    df = docs(spark, [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "x", "b"), (4, "w " * 300_000, "b")]).withColumn("score", F.lit("s"))
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.add_score(df, quality.fit_quality(df, none)).collect()] == [0.5] * 5
    model = quality.fit_quality(df, spark.createDataFrame([(1, 1, 0), (4, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in quality.add_score(df, model).collect())
    assert quality.add_score(df.limit(0), model).count() == 0


def test_lm_gradient():
    m = lm.AttentionLM()
    r = np.random.default_rng(8)
    ids, t = r.integers(0, 30, (3, lm.WINDOW)), r.integers(-1, lm.CLASSES, (3, lm.WINDOW))
    g = m.gradient(ids, t)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    loss = lambda: -m.log_prob(ids, t).sum() / (t >= 0).sum()
    for k in m.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        m.p[k][i] += 1e-6
        up = loss()
        m.p[k][i] -= 2e-6
        assert g[k][i] == pytest.approx((up - loss()) / 2e-6, rel=0.02, abs=1e-5), k
        m.p[k][i] += 1e-6


def test_lm_windows_score_each_id_once_and_sum_to_one():
    lengths = np.array([0, 1, 31, 32, 33, 56, 57, 200])
    doc, start = lm.windows(lengths)
    for d, n in enumerate(lengths):
        seen = []
        for s in start[doc == d]:
            seen += [s + c for c in range(lm.WINDOW) if s + c < n and (c >= lm.OVERLAP or s == 0)]
        assert seen == list(range(n))
    ids = lm.Ids(np.arange(lm.VOCABULARY, dtype=float))
    assert np.bincount(ids.klass, np.exp(ids.log_share)) == pytest.approx(np.ones(lm.CLASSES))


RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


def test_words_encoded_together_are_those_encoded_alone():
    r = random.Random(12)
    pool = ["a", "Z", "é", "ß", "7", "42", ".", "'s", "'", "--", "ing", "the", "\u00a0", "漢", "🙂", "\x85", "_", "http://x.y/z?q=1", "don't", "\u2028"]
    words = list({"".join(r.choice(pool) for _ in range(r.randrange(1, 9))).encode() for _ in range(3000)})
    words = [w for w in words if len(w.split()) == 1]
    own = RankTokenizer(RANKS)
    alone = own.encoding.encode_ordinary
    got = own.pack([b" ".join(words[:1500]), b"\n ".join(words[1500:]), words[0]])
    want = [[i for w in part for i in alone(" " + w.decode())] for part in (words[:1500], words[1500:], words[:1])]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def plain_log10(m, ids, doc):
    """Token by token: the window that scores it, attention over the ids before it, class and share."""
    p, d, total = {k: v.astype(float) for k, v in m.p.items()}, lm.DIM, 0.0
    for i, token in enumerate(doc):
        start = 0 if i < lm.WINDOW else (i - lm.OVERLAP) // (lm.WINDOW - lm.OVERLAP) * (lm.WINDOW - lm.OVERLAP)
        rows = [0 if j == 0 else ids.row[doc[j - 1]] for j in range(start, i + 1)]
        x = [p["E"][r] + p["P"][c] for c, r in enumerate(rows)]
        q = x[-1] @ p["QKV"][:, :d]
        weight = np.array([np.exp(q @ (y @ p["QKV"][:, d : 2 * d])) for y in x])
        o = sum(w * (y @ p["QKV"][:, 2 * d :]) for w, y in zip(weight / weight.sum(), x))
        h = x[-1] + o @ p["O"]
        z = h @ p["C"] + p["c"]
        total += z[ids.klass[token]] - np.log(np.exp(z).sum()) + ids.log_share[token]
    return total / np.log(10)


@pytest.mark.parametrize("scale", [1, 30])
def test_scores_are_those_of_a_loop_over_tokens(scale):
    m, r = lm.AttentionLM(), np.random.default_rng(9)
    m.p = {k: v * np.float32(scale**0.5) for k, v in m.p.items()}
    ids = lm.Ids(r.integers(0, 50, lm.VOCABULARY).astype(float))
    docs = [r.integers(0, lm.VOCABULARY, n) for n in (1, 2, 15, 16, 17, 28, 29, 100, 700)]
    assert lm.score_ids(m, ids, docs, chunk=7) == pytest.approx([plain_log10(m, ids, d) for d in docs], rel=1e-4)
    assert len(lm.score_ids(m, ids, [])) == 0


def test_every_id_of_a_document_is_trained_on_once():
    r = np.random.default_rng(10)
    ids, seen = lm.Ids(np.arange(lm.VOCABULARY, dtype=float)), []

    class Watch(lm.AttentionLM):
        def gradient(self, x, y):
            seen.append((x.copy(), y.copy()))
            return super().gradient(x, y)

    docs = [r.integers(0, lm.VOCABULARY, n) for n in (1, 16, 17, 5000, 3, 40_000, 90_000)]
    t = lm.Trainer(Watch(), ids, 0.01, batch=64)
    for d in docs:
        t.add(d)
    t.flush()
    x, y = np.concatenate([a for a, _ in seen]).ravel(), np.concatenate([b for _, b in seen]).ravel()
    assert y[y >= 0].tolist() == np.concatenate([ids.klass[d] for d in docs]).tolist() and t.seen == sum(map(len, docs))
    assert x[y >= 0].tolist() == np.concatenate([[0, *ids.row[d[:-1]]] for d in docs]).tolist()


def test_the_model_learns_and_does_not_depend_on_partitions(spark):
    """Texts of a repeated pattern come to score better than the same words in another order; partitions and files change nothing."""
    r = np.random.default_rng(11)
    pattern = "red blue green white black yellow".split()
    rows = [(i, " ".join(pattern * 20), "a") for i in range(300)] + [(1000 + i, " ".join(r.permutation(pattern * 20)), "b") for i in range(20)]
    df = docs(spark, rows + [(5000, "long " * 60_000, "c")]).withColumn("score", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("words", F.lit(3))
    one, other = ({(g.doc_id, g.score) for g in lm.score_documents(d, RANKS).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert {i for i, _ in one} == {i for i, _ in other}
    assert sorted(v for _, v in one) == pytest.approx(sorted(v for _, v in other), rel=1e-5)
    mean = lambda low, high: np.mean([v for i, v in one if low <= i < high])
    assert mean(0, 300) > mean(1000, 1020)


def test_lm_predicts_held_out_texts_much_better_than_frequencies_of_ids(spark):
    """At sf0.01, in bits an id: 8.1 by the ids' frequencies alone; classes of ids that mean nothing bring half a bit."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    ids = {d: np.append(np.frombuffer(p, "<u4"), lm.END_ID) for d, p in zip(texts, RankTokenizer(RANKS).pack([(t or "").encode().lower() for t in texts.values()]))}
    got = lm.score_documents(df, RANKS).collect()
    assert len(got) == len(texts)
    mass = np.bincount(np.concatenate([ids[g.doc_id] for g in got if not g.held_out]), minlength=lm.VOCABULARY) + 0.5
    held = [g for g in got if g.held_out]
    n, bits = sum(len(ids[g.doc_id]) for g in held), np.log2(mass / mass.sum())
    plain, model = (-sum(v) / n for v in ([bits[ids[g.doc_id]].sum() for g in held], [g.score / np.log10(2) for g in held]))
    assert plain - model > 1.5


def test_classes_are_made_of_ids_with_the_same_neighbours():
    """Ids of equal counts in three ranks that follow each other: shares and classes sum to one, and a class holds ids of one rank."""
    r = np.random.default_rng(13)
    rank = np.arange(lm.SINGLE, lm.SINGLE + 300) % 3
    counts, near = np.zeros(lm.VOCABULARY), np.zeros((lm.VOCABULARY, 2 * lm.GROUPS))
    counts[: lm.SINGLE] = 1000
    counts[lm.SINGLE : lm.SINGLE + 300] = 90
    for i, k in enumerate(rank):
        near[lm.SINGLE + i] = np.concatenate([r.multinomial(90, np.eye(lm.GROUPS)[k] * 0.9 + 0.1 / lm.GROUPS), r.multinomial(90, np.eye(lm.GROUPS)[k + 5] * 0.9 + 0.1 / lm.GROUPS)])
    ids = lm.Ids(counts, near)
    klass = ids.klass[lm.SINGLE : lm.SINGLE + 300]
    assert all(len(set(rank[klass == c])) == 1 for c in set(klass))
    ids.follow(r.integers(0, 5, (lm.CLASSES, lm.VOCABULARY)))
    for c in range(lm.CLASSES):
        assert np.bincount(ids.klass, np.exp(ids.given[c]), lm.CLASSES)[np.unique(ids.klass)] == pytest.approx(1, rel=1e-4)


def test_lm_base_scores_are_brute_force(spark):
    rows = [(i, " ".join(f"W{i * k % 23}" for k in range(i % 11)), "a") for i in range(80)] + [(90, None, "b"), (91, "", "b"), (92, "fresh words only here", "b")]
    df = docs(spark, rows + [rows[5]])
    want = unigram([(i, t) for i, t, _ in rows + [(rows[5][0], rows[5][1], "")]])
    for frequent in (200_000, 5):
        got = lm.score_documents(df, RANKS, frequent=frequent).collect()
        assert len(got) == len(rows) + 1
        extra = zlib.crc32(b"5") % 7 != 2
        for g in got:
            w = want[g.doc_id]
            assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 7 == 2)
            assert g.n_tokens == w[0] and g.n_known == w[1]
            if not extra:
                assert g.train_tokens == w[2] and g.base_score == pytest.approx(w[3])
            assert g.score < 0
    assert lm.score_documents(df.limit(0), RANKS).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
        ("pay DE89370400440532013000 2024", ["DE89370400440532013000"]),
        ("REF AB12 ORDER GB82 WEST 1234 5698 7654 32 DE89370400440532013000 EUR", ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]),
        ("DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX", []),
    ],
)
def test_an_iban_ends_before_what_follows_it(text, want):
    assert [text[s:e] for k, s, e, _ in pii.find_spans(text) if k == "iban"] == want


@pytest.mark.parametrize("length", [20, 198, 202, 5000])
@pytest.mark.parametrize("gap", ["", "    ", " " * 40])
def test_secrets_of_any_length(length, gap):
    from tracelake.llm import pii

    text = f"the api_key{gap}:{gap}\"{'aB3-' * (length // 4)}{'x' * (length % 4)}\", then"
    found = [(s, e) for kind, s, e, _ in pii.find_spans(text) if kind == "secret"]
    assert [e - s for s, e in found] == [length]


def test_tasks_that_tokenize_nothing_forget_the_words_of_earlier_tasks():
    """Workers live on: what reading remembered (up to 800,000 words) would stay through counting, training and scoring."""
    path = str(tokenizer_path("byte_bpe_50k.tiktoken"))
    tokens.rank_tokenizer(path).pack([b"some words to remember"])
    assert tokens.rank_tokenizer(path).known
    lm.keep_memory()
    assert not tokens._HERE and not tokens.rank_tokenizer(path).known


def test_scores_of_frequent_words_come_from_their_counts():
    top = pa.table({"key": pa.array([b"the", b"of", b"a"], pa.binary()), "n": pa.array([9, 99, 9], pa.int64())})
    assert lm.word_scores(top, 999) == pytest.approx({b"the": -2, b"of": -1, b"a": -2})
    assert lm.word_scores(top.slice(0, 0), 0) == {}
