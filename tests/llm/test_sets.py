import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.util import components, docs, grams
from tracelake.llm import ann, mixing, pii, quality, registry, warc
from tracelake.llm.common import new_path

BASE = "/root/testdata/sf0.01"


def test_mix_reaches_its_weights(spark):
    rows = [(i, "t", "a" if i % 3 else "b") for i in range(6000)]
    df = docs(spark, rows).withColumn("copy", F.lit(9))
    got = mixing.mix(df, {"a": 1, "b": 3, "none": 5}, epochs=2).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert n["b"] == pytest.approx(12000 * 3 / 4, rel=0.06) and n["a"] == pytest.approx(12000 * 1 / 4, rel=0.06)
    hot = mixing.mix(docs(spark, [(i, "", "a") for i in range(200)]), {"a": 1}, epochs=40)
    assert hot.count() == pytest.approx(8000, rel=0.03)
    per = [r["count"] for r in hot.groupBy("doc_id").count().collect()]
    assert np.var(per) == pytest.approx(40, rel=0.4)


def test_mix_edge_cases(spark):
    df = docs(spark, [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x", None)])
    got = mixing.mix(df, epochs=30).collect()
    assert {r.source for r in got} == {None, "a"} and len([r for r in got if r.doc_id == 1]) % 2 == 0
    assert mixing.mix(df, {}).count() == 0 and mixing.mix(df, {"a": 0}).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mix_keeps_columns_of_any_name(spark, monkeypatch):
    """rate, cdf and n of the documents stay; so with sources beyond the bound, a null one among them."""
    df = docs(spark, [(i, "t", "a" if i % 3 else None) for i in range(300)]).selectExpr("*", "1 as rate", "'c' as cdf", "2 as n", "3 as want", "'k' as shuffle_key")
    few = mixing.mix(df).collect()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    many = mixing.mix(df).collect()
    line = lambda r: (r.doc_id, str(r.source), r.copy, r.rate, r.cdf, r.n, r.want, r.shuffle_key)
    assert sorted(map(line, few)) == sorted(map(line, many)) and {(r.rate, r.cdf, r.n, r.want) for r in few} == {(1, "c", 2, 3)} and {r.source for r in many} == {None, "a"}
    assert "Python" not in mixing.mix(df)._jdf.queryExecution().toString()


@pytest.mark.parametrize("base", [BASE, "/root/testdata/sf0.1"])
def test_ann_recall_and_ties(spark, base):
    """At sf0.1, 128 of 2,000 vectors are measured for a query."""
    e = spark.read.parquet(f"{base}/embeddings.parquet")
    rows = e.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = registry.op5_ann(spark, base).collect()
    found, hits, total = {}, 0, 0
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & set(ids[order]))
        total += 10
    assert hits / total >= 0.9


def test_ann_edge_cases(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(100 * i, v) for i in range(20)] + [(7, [1.0, 0.0, 2.5]), (8, None), (9, [0.0] * 3), (11, [float("nan"), 1.0, 1.0]), (None, v), (0, v), (12, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(by) == 20 and [m[1] for m in sorted(by[0])] == [100 * i for i in range(1, 11)] and all(m[2] == 0 for m in by[0])
    assert [m[1] for m in sorted(by[300])] == [0, 100, 200, 400, 500, 600, 700, 800, 900, 1000]
    few = ann.nearest(df.where("vec_id in (0, 7, 9)"), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in few] == [(7, 0.5)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    lengths = spark.createDataFrame([(i, [float(i), 1.0] if i % 3 else [float(i), 2.0, 3.0]) for i in range(12)], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in ann.nearest(lengths, F.col("vec_id").isin(3, 4), k=2).collect()} == {(3, 0), (3, 6), (4, 2), (4, 5)}


def test_an_index_reads_only_its_own_fronts():
    r = np.random.default_rng(6)
    x, pivots = r.standard_normal((400, 8)), r.standard_normal((32, 8))
    shard = ann.PermutationShard(x, pivots, 8)
    order = np.argsort(((x[:, None] - pivots[None]) ** 2).sum(2), axis=1)[:, :8]
    place = np.full((400, 32), 8)
    np.put_along_axis(place, order, np.arange(8)[None], 1)
    assert (shard.order(x) == order).all() and len(shard.rows) == 400 * 8
    for q in (0, 7, 399):
        assert shard.footrule(order[q]).tolist() == np.abs(place - place[q]).sum(1).tolist()


def test_archives_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE", 20_000)
    rows = [(i, "u", "x" * n) for i, n in enumerate([3, 900, 1500, 2500, 30_000, 9000, 9000, 12, 0, 1200])]
    path = new_path(spark, "warc-size")
    warc.write_archives(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), path, per_file=16)
    got = warc.read_archives(spark, path).collect()
    by: dict = {}
    for g in got:
        by.setdefault(g.file, []).append(g.payload_bytes)
    assert sorted((int(g.page_id), len(g.payload)) for g in got if g.kind != "revisit") == sorted((i, len(t)) for i, _, t in rows if i != 5)
    assert all(sum(v) <= 20_000 or len(v) == 1 for v in by.values())


def test_warc_query_on_an_empty_table_and_repeated_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 2000), (1, "u", "y" * 2000), (2, "u", "y" * 2000), (2, "u", "y" * 2000)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "two/pages.parquet"))
    pages.limit(0).write.parquet(str(tmp_path / "none/pages.parquet"))
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in registry.op10_warc(spark, str(tmp_path / "two")).collect())
    assert got == [(1, 2000, "revisit", 2)] * 2 + [(2, 2000, "response", None)] * 2
    assert registry.op10_warc(spark, str(tmp_path / "none")).count() == 0


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, extra columns with the stages' own names."""
    rows = [(None, None, "a"), (None, "some text here", None), (1, "", "a"), (2, "one two three four five six", "a"), (2, "one two three four five six", "a"), (3, "word " * 60_000, "b"), (4, "mail me: a.b@example.com", None)]
    odd = docs(spark, rows)
    for c in ("score", "component_id", "key", "n", "hash", "pii", "copy", "copies", "grp", "start", "id", "__n", "fp"):
        odd = odd.withColumn(c, F.lit("mine"))
    want = {"near_duplicates": {None, 1, 2, 3, 4}, "pii": {None, 1, 2, 3, 4}}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, BASE)
        assert name == "packing" or got.columns == corpus_pipeline.COLUMNS
        ids = {r.doc_id for r in got.collect()}
        assert ids <= {None, 1, 2, 3, 4} and ids == want.get(name, ids)
        assert stage(spark, odd.limit(0), BASE).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.0\r\nWARC-Type: x\r\n\r\n" + "y" * 2000
    rows = [(1, "http://a/\r\nb", big), (5, None, big), (3, "http://c", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", ""), (8, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in registry.op10_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 5) if i in (1, 3) else ("response", None))
    path = new_path(spark, "warc-gz")
    warc.write_archives(warc.plan_records(pages), path, compression="gzip")
    again = warc.read_archives(spark, path)
    assert again.where("kind = 'gap'").count() == 0 and again.count() == len(rows)
    assert registry.op10_warc.__name__ and warc.plan_records(pages.limit(0)).count() == 0


def _archive(n):
    out = []
    for i in range(n):
        body = f"payload {i} ".encode() * 20
        out.append(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, hashlib.sha1(body).hexdigest().encode(), len(body), body))
    return out


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_recovers_the_records_around_damage(zipped):
    r = random.Random(9)
    records = [gzip.compress(x) if zipped else x for x in _archive(30)]
    for _ in range(60):
        data, begin = bytearray(b"".join(records)), np.cumsum([0] + [len(x) for x in records])
        hurt = set()
        for _ in range(3):
            k = r.randrange(30)
            at = r.randrange(begin[k], begin[k + 1])
            data[at] ^= 0xFF
            hurt.add(k)
        cut = r.choice([0, 25])
        data = bytes(data[: len(data) - cut])
        hurt |= {29} if cut else set()
        got = list(warc.salvage(data))
        ids = {warc._urn(g[2].get(b"warc-record-id")) for g in got if g[2] is not None}
        assert {str(k) for k in range(30)} - {str(k) for k in hurt} <= ids
        assert got[0][0] == 0 and got[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert list(warc.salvage(b"")) == [] and [g[4] for g in warc.salvage(b"junk")] == ["no version line"]


def test_pipeline_stage_by_stage(spark):
    documents = spark.read.parquet(f"{BASE}/documents.parquet")
    now, ids = documents, {r.doc_id for r in documents.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, now, BASE).write.parquet(path)
        before, now = now, spark.read.parquet(path)
        if name != "packing":
            assert now.columns == documents.columns
        rows = now.collect()
        if name == "quality":
            model = quality.fit_quality(documents, spark.read.parquet(f"{BASE}/labels.parquet"))
            b = before.collect()
            want = {r.doc_id for r, s in zip(b, model.score([x.text for x in b])) if s >= 0.7}
            assert {r.doc_id for r in rows} == want
            good = [i for i, q in labels.items() if q == 1 and i in ids]
            assert len([i for i in good if i in want]) / len(good) > 0.97
        elif name == "near_duplicates":
            b = sorted(before.collect(), key=lambda r: r.doc_id)
            sets = [grams(r.text) for r in b]
            like = lambda x, y: min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)
            low = components(len(b), lambda i, j: like(sets[i], sets[j]))
            assert sorted(r.doc_id for r in rows) == [b[i].doc_id for i in sorted(set(low))]
        elif name == "pii":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
            assert not any(s for r in rows for s in pii.find_spans(r.text) if s[0] in pii.BASE_KINDS) and all(r.n_chars == len(r.text) for r in rows)
        elif name == "mixing":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()}
        else:
            assert sorted(r.doc_id for r in rows if r.start == 0) == sorted(r.doc_id for r in before.collect())
    assert corpus_pipeline.run(spark, BASE).count() == now.count()


def test_smallest_hashes_are_exactly_those(spark):
    rows = spark.range(6000).withColumn("h", F.xxhash64("id"))
    want = sorted(r.h for r in rows.collect())
    for n in (7, 500, 5000):
        assert [r.h for r in ann.smallest_hashes(rows, F.col("h"), n).collect()] == want[:n]
