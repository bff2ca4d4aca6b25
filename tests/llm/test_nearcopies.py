import random

import pytest

from tests.llm.util import components, docs, grams
from tracelake.llm import simhash as op


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(r, words, k):
    words = list(words)
    for i in r.sample(range(len(words)), k):
        words[i] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_every_near_copy_is_linked(spark):
    """Brute force over 300-word texts with 1 to 9 words replaced, shared headers, exact copies, and short and empty texts."""
    r = random.Random(4)
    header = " ".join(f"head{i}" for i in range(60))
    rows, n = [], 0
    for k in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(300)]
        for c in (0, 1, 3, 5, 6, 7, 9):
            rows.append((n, changed(r, words, c), "a"))
            n += 1
        rows.append((n, f"{header} " + " ".join(f"v{r.randrange(5000)}" for _ in range(60 + k)), "b"))
        n += 1
    rows += [(n + i, t, "c") for i, t in enumerate([rows[0][1].upper(), "one two", "One  two", "one two three four five", "one two three four five six", None, "", " \n"])]
    rows.append((None, rows[3][1], "c"))
    root = components(len(rows), lambda i, j: jaccard(rows[i][1], rows[j][1]) >= 0.8)
    ids = [x[0] for x in rows]
    want = sorted((str(ids[i]), min(ids[j] for j in range(len(rows)) if root[j] == root[i] and ids[j] is not None)) for i in range(len(rows)))
    df = docs(spark, rows)
    assert sorted((str(g.doc_id), g.component_id) for g in op.near_copies(df).collect()) == want
    kept = op.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted({str(c) for _, c in want} | {"None"})
    assert op.near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("edits, linked", [(6, True), (20, False)])
def test_the_stage_follows_the_rule(spark, edits, linked):
    from corpus_pipeline import near_duplicate_stage

    words = [f"w{i}" for i in range(300)]
    other = " ".join(f"x{i}" if i % (300 // edits) == 7 else w for i, w in enumerate(words))
    assert (jaccard(" ".join(words), other) >= 0.8) == linked
    kept = near_duplicate_stage(spark, docs(spark, [(1, " ".join(words), "a"), (2, other, "a")]), "")
    assert sorted(x.doc_id for x in kept.collect()) == ([1] if linked else [1, 2])


def test_links_of_small_sets_are_not_lost(spark):
    """Thousands of pairs of 2 to 40 shingles, each just at a similarity of 0.8 or the least above: every pair is one class of its own."""
    r, rows, n = random.Random(9), [], 0
    for size in range(2, 41):
        more = next(m for m in range(0, size) if size / (size + m) >= 0.8 > size / (size + m + 1)) if size >= 4 else 0
        for _ in range(60):
            words = [f"w{r.randrange(10**9)}" for _ in range(size + 4)]
            rows.append((n, " ".join(words), "a"))
            rows.append((n + 1, " ".join(words + [f"z{r.randrange(10**9)}" for _ in range(more)]), "a"))
            n += 2
    assert min(jaccard(rows[i][1], rows[i + 1][1]) for i in range(0, n, 2)) >= 0.8
    got = {g.doc_id: g.component_id for g in op.near_copies(docs(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(n)}
