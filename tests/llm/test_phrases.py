import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.util import docs
from tracelake.llm import collocations as op


def brute(rows, least, top, share=80):
    """rows: (lang, text) -> list of result rows."""
    c, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    c[lang, tuple(w[i : i + k])] += 1
    cands = {x: a for x, a in c.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cands.items():
        inside = [b for (m, q), b in cands.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= share * a for b in inside):
            continue
        score, _, l, r = min((2_000_000 * a // (c[lang, p[:k]] + c[lang, p[k:]]), k, c[lang, p[:k]], c[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], k + 1, *x[1:]) for k, x in enumerate(best)]
    return sorted(ranked)


def fixture():
    r = random.Random(11)
    words = ["the", "of", "New", "york", "city", "a", "é", "ß", "x\x00y", "b", "c"] + [f"rare{i}" for i in range(300)]
    weights = [30, 20, 9, 9, 9, 9, 5, 5, 3, 5, 5] + [0.2] * 300
    rows = []
    for i in range(120):
        text = " ".join(r.choices(words, weights, k=60))
        text = re.sub(" ", lambda m: r.choice([" ", "  ", "\t", ". ", ",", " ", " ", " ", " "]), text)
        rows.append((r.choice(["en", "en", "fr", None, "und"]), text + r.choice(["", ".", "\n", " New York City hall is open now and then! "])))
    rows += [("en", "the fixed passage of nine words stays whole always")] * 12 + [("en", None), ("en", ""), ("fr", "..;"), ("de", "allein"), ("en", "na " * 3000), ("fr", "one word. " * 9)]
    return rows + rows[:10]


@pytest.mark.parametrize("most_words", [1 << 19, 4, 0])
def test_phrases_are_those_of_brute_force(spark, most_words):
    """With all words in the dictionary, with few, with none."""
    rows = fixture()
    df = spark.createDataFrame([(1, t, g, "w1") for g, t in rows], "n long, text string, lang string, w1 string").repartition(5)
    got = sorted(tuple(r) for r in op.mine_phrases(df, least=6, top=40, most_words=most_words).collect())
    assert got == brute(rows, 6, 40)


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(op, "hash_id", lambda lang, word: F.when(F.length(word) == 1, F.lit(-5)).otherwise(F.xxhash64(lang, word).bitwiseOR(F.lit(-(1 << 63)))).cast("long"))
    words = op.count_words(df.fillna("und").fillna(""))
    _, held, complete = op.number_words(words, 6, 0)
    assert not complete and {"a", "b", "c", "é", "ß"} <= set(held["en"]) and "the" not in held["en"]


def test_unary_paths(spark):
    """Chains of one weight join, branches and other weights part them, cycles stay single edges."""
    e = lambda words, n: [(*words[i : i + 4], n) for i in range(len(words) - 3)]
    rows = e([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13], 7) + e([21, 22, 23, 24, 25], 7) + e([22, 23, 24, 26], 7) + e([31, 32, 33, 34], 5) + e([32, 33, 34, 35], 6) + e([41, 42, 43, 41, 42, 43], 9) + [(5, 5, 5, 5, 3)]
    df = spark.createDataFrame(rows, "w1 long, w2 long, w3 long, w4 long, n long")
    got = sorted((r.words, r.n) for r in op.compact_paths(df).collect())
    want = [([*range(1, 14)], 7), ([21, 22, 23, 24], 7), ([22, 23, 24, 25], 7), ([22, 23, 24, 26], 7), ([31, 32, 33, 34], 5), ([32, 33, 34, 35], 6), ([5, 5, 5, 5], 3)]
    assert got == sorted(want + [([41, 42, 43, 41], 9), ([42, 43, 41, 42], 9), ([43, 41, 42, 43], 9)])


def test_large_counts_stay_exact(spark):
    """Counts whose products pass 64 bits: by the counts themselves, not by texts."""
    big = 10**16
    rows = [(1, "1", 3 * big), (1, "2", 3 * big + 1), (2, "1,2", 2 * big + 1), (3, "1,2,1", 2 * big), (2, "2,1", 2 * big)]
    counts = spark.createDataFrame(rows, "k int, key string, f long")
    got = {r.key: r for r in op.score_candidates(counts, 30).collect()}
    assert got["1,2"].score == 2_000_000 * (2 * big + 1) // (6 * big + 1)
    assert got["1,2,1"].score == min(2_000_000 * 2 * big // (5 * big), 2_000_000 * 2 * big // (5 * big + 1))
    assert {r.key for r in op.drop_inner(op.score_candidates(counts, 30)).collect()} == {"1,2,1"}


def test_no_documents(spark):
    assert op.mine_phrases(docs(spark, [])).count() == 0
    assert op.mine_phrases(docs(spark, [(1, None, "a"), (2, "", "a")])).count() == 0
