"""What lexical search writes and shuffles."""

import random

import pytest

from tracelake.operators import lexical as L
from tracelake.operators import retrieval as T
from tracelake.sources.storage import materialize


@pytest.fixture
def corpus(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("ant bee cat dog elk fox gnu hen".split()) for _ in range(r.randrange(1, 9))) for _ in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (80, None), (81, "")], "doc_id long, text string")
    asks = ["ant bee", "gnu", "cat dog elk fox", "ant nowhere", "", texts[0]]
    want = sorted((q, d) for q, a in enumerate(asks) if a for d, t in enumerate(texts) if set(a.split()) <= set(t.split()))
    return docs, spark.createDataFrame(list(enumerate(asks)), "query_id long, query string"), want


@pytest.mark.parametrize("sent", [L.SENT, 0])
def test_exact_hits_need_the_forward_table_alone(corpus, monkeypatch, sent):
    docs, queries, want = corpus
    monkeypatch.setattr(L, "SENT", sent)
    kept = []

    def put(name, build, cluster, order):
        kept.append(name)
        return materialize(build(), name)

    assert sorted((x.query_id, x.doc_id) for x in T.exact_hits(docs, queries, put=put).collect()) == want
    assert kept == ["lexical-forward"]


def test_words_are_counted_where_their_text_is(corpus, capsys):
    """One exchange, of texts; before, every word of every document was shuffled, and the table of counts written besides."""
    plans = []

    def put(name, build, cluster, order):
        df = build()
        df.explain()
        plans.append((name, capsys.readouterr().out.count("Exchange hashpartitioning")))
        return materialize(df, name)

    L.build_index(corpus[0], put=put)
    assert plans[0] == ("lexical-forward", 1) and "lexical-terms" not in dict(plans)


def test_maps_of_documents_are_not_shuffled_by_query(spark, corpus, capsys):
    docs, queries, _ = corpus
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = L.build_index(docs)
        few = sorted(map(repr, L.search(index, queries, 5).collect()))
        capsys.readouterr()
        L.search(index, queries, 5).explain()
        assert "BroadcastHashJoin" in capsys.readouterr().out
        L.SENT, sent = 0, L.SENT
        try:
            assert sorted(map(repr, L.search(index, queries, 5).collect())) == few
        finally:
            L.SENT = sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("cells", [L.CELLS, 1])
def test_search_reads_the_forward_table_alone(corpus, monkeypatch, cells):
    """Few queries are scored where documents are, in blocks of any size; before, postings were made and met them by query."""
    docs, queries, _ = corpus
    kept = []

    def put(name, build, cluster, order):
        kept.append(name)
        return materialize(build(), name)

    monkeypatch.setattr(L, "CELLS", cells)
    got = sorted(map(repr, L.search(L.build_index(docs, put=put), queries, 5).collect()))
    assert kept == ["lexical-forward"]
    monkeypatch.setattr(L, "SENT", 0)
    assert got and got == sorted(map(repr, L.search(L.build_index(docs), queries, 5).collect()))
