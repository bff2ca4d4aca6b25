import random
import re

import pytest

from tests.llm.util import docs
from tracelake.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows, items, size=10):
    """doc_id -> (n_words, hit words, spans, items) by comparing every window with every place."""
    wins = [(str(i) if i is not None else None, w[k : k + size]) for i, t in items for w in [WORD.findall(low(t))] if w for k in range(max(1, len(w) - size + 1))]
    out = {}
    for i, t, _ in rows:
        found = list(WORD.finditer(low(t)))
        words = [m[0] for m in found]
        hit, ids = set(), set()
        for item, w in wins:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    ids |= {item} - {None}
        spans = []
        for k in sorted(hit):
            if k - 1 in hit:
                spans[-1][1] = found[k].end()
            else:
                spans.append([found[k].start(), found[k].end()])
        out[i] = (len(words), len(hit), [tuple(s) for s in spans], sorted(ids))
    return out


def fixture():
    r = random.Random(3)
    words = [f"wörd{i}" if i % 5 == 0 else f"w{i}" for i in range(40)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(8, 30)))) for k in range(12)]
    items += [(100, "Short one"), (101, "short one"), (102, "ONE"), (103, ""), (104, None), (105, "?!"), (None, "unnamed item of six whole words"), (106, items[0][1]), (0, "zero again here")]
    rows = []
    for i in range(60):
        text = " ".join(r.choice(words) for _ in range(r.randrange(0, 30)))
        if i % 3 == 0:
            text += "\n" + r.choice(items)[1].__str__().replace(" ", ", ").upper() + " — " + text
        rows.append((i, text, "a"))
    return rows + [(60, None, "a"), (61, "", "a"), (62, "…!", "a"), (63, "x " * 50_000 + items[1][1] + " y" * 50_000, "a"), (64, "unnamed item of six whole words", None), (65, "aone one1 one", "a")], items


@pytest.mark.parametrize("per_shard", [10**6, 25])
def test_leaks_are_those_of_brute_force(spark, per_shard):
    """With one automaton, and with a dozen whose hits meet."""
    rows, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows + rows[:4])
    got = op.find_leaks(df.selectExpr("*", "1 as found_", "'x' as leak", "'y' as items"), bench, per_shard=per_shard).collect()
    want = brute(rows, items)
    assert len(got) == len(rows) + 4
    for r in got:
        assert (r.leak.n_words, r.leak.n_hit, [tuple(s) for s in r.leak.spans], r.leak["items"]) == want[r.doc_id]
        assert r["items"] == "y"


def test_other_window_and_nothing_to_find(spark):
    rows, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items, 3)
    for r in op.find_leaks(docs(spark, rows), bench, window=3).collect():
        assert (r.leak.n_hit, r.leak["items"]) == (want[r.doc_id][1], want[r.doc_id][3])
    none = op.find_leaks(docs(spark, rows), bench.limit(0)).collect()
    assert len(none) == len(rows) and all(r.leak.n_hit == 0 and r.leak["items"] == [] and r.leak.n_words == want[r.doc_id][0] for r in none)
    assert op.find_leaks(docs(spark, []), bench).count() == 0
