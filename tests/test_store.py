"""Stored projections, the lexical index, split transcripts, bounded walks and two-ended paths, against brute force."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.operators import graph as G
from tracelake.operators import lexical as L
from tracelake.plans import base
from tracelake.sources import readers as RD
from tracelake.sources import store as ST

BASE = "/root/testdata/sf0.01"


def scan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")
    return plan


def test_searches_of_stored_events_prune_and_push(spark):
    from tracelake.plans import registry

    q = registry.queries()
    plan = scan_of(q["p1_multi_filter_search"](spark, BASE))
    assert "projections/events" in plan and "PartitionFilters: [isnotnull(month" in plan and "EqualTo(event_type,ERROR)" in plan and "GreaterThanOrEqual(session_date,2024-01-05)" in plan
    assert "Window" not in plan and "get_json_object" not in plan
    for name, folder, wanted in (("s3_posting_scan", "postings", "layer"), ("s6_facet_scan", "facets", "axis")):
        plan = scan_of(q[name](spark, BASE))
        assert f"projections/{folder}" in plan and f"PartitionFilters: [isnotnull({wanted}" in plan and "Exchange" not in plan
    assert "projections/postings" in scan_of(q["a1_entity_inventory"](spark, BASE))
    assert "projections/graph-edges" in scan_of(q["s5_graph_scan"](spark, BASE))


def test_a_changed_input_is_another_generation(spark, tmp_path):
    src, root, built = f"{tmp_path}/in", f"{tmp_path}/store", []

    def read():
        def build():
            return spark.read.parquet(src).withColumn("twice", F.col("id") * 2)

        return ST.stored(spark, "t", [src], build, ("id",), ("id",), root=root)

    spark.range(5).write.parquet(src)
    assert sorted(r.twice for r in read().collect()) == [0, 2, 4, 6, 8]
    first = ST.generation(spark, "t", [src], "1")
    spark.range(5, 7).write.mode("append").parquet(src)
    assert ST.generation(spark, "t", [src], "1") != first != ST.generation(spark, "t", [src], "2")
    assert read().count() == 7
    # A write that did not finish is no answer.
    now = tmp_path / "store/projections/t" / f"generation-{ST.generation(spark, 't', [src], '1')}"
    (now / "_SUCCESS").unlink()
    for f in now.glob("*.parquet"):
        f.unlink()
    assert read().count() == 7 and not built


def bm25_brute(docs, queries, k):
    words = {i: re.findall("[a-z0-9]+", t.lower()) if t is not None else None for i, t in docs}
    n, lens = len(docs), [len(w) for w in words.values() if w is not None]
    avg = sum(lens) / len(lens)
    counts = {i: collections.Counter(w or []) for i, w in words.items()}
    df = collections.Counter(t for c in counts.values() for t in c)
    out = {}
    for q, text in queries:
        scores = []
        ts = set(re.findall("[a-z0-9]+", text.lower()))
        for i, c in counts.items():
            if got := ts & set(c):
                scores.append((-round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / avg)) for t in got), 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out, {q: {i for i, c in counts.items() if ts <= set(c)} for q, text in queries if (ts := set(re.findall("[a-z0-9]+", text.lower())))}


@pytest.mark.parametrize("salt_docs,seeds", [(4096, 64), (50, 1), (50, 0)])
def test_pruned_search_is_the_exhaustive_one(spark, monkeypatch, salt_docs, seeds):
    monkeypatch.setattr(L, "SALT_DOCS", salt_docs)
    monkeypatch.setattr(L, "SEEDS", seeds)
    r = random.Random(2)
    words = [f"t{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randrange(1, 120)))) for i in range(400)] + [(400, ""), (401, None), (402, "T0 t0"), (403, "!?")]
    docs += [(500 + i, docs[i % 3][1]) for i in range(30)]
    queries = [(i, " ".join(r.choices(words, weights, k=r.randrange(1, 9)))) for i in range(40)] + [(40, "t0"), (41, "t0 t1 t2"), (42, "unknown"), (43, "unknown t5"), (44, ""), (45, docs[0][1])]
    index = L.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame(queries, "query_id long, query string")
    best, exact = bm25_brute(docs, queries, 7)
    got = collections.defaultdict(list)
    for x in sorted(L.search(index, q, 7).collect(), key=lambda x: (x.query_id, x["rank"])):
        got[x.query_id].append((x.doc, x.score))
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in best.items() if v}
    assert all(abs(a[1] - b[1]) < 2e-6 for k, v in got.items() for a, b in zip(v, best[k]))
    hits = collections.defaultdict(set)
    for x in L.exact_hits(index, q).collect():
        hits[x.query_id].add(x.doc)
    assert hits == {k: v for k, v in exact.items() if v}


def test_search_scores_a_falling_share(spark):
    """Of the documents that hold a term of the query, a smaller share is scored in the larger table."""
    share = {}
    for sf in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{sf}"
        asked = spark.read.parquet(f"{d}/benchmark.parquet").selectExpr("item_id as query_id", "text as query")
        n, postings, read, scored = L.pruning_report(base.lexical_index(spark, d), asked).agg(F.count("*"), F.sum("postings"), F.sum("read"), F.sum("scored")).first()
        share[sf] = (scored / n / spark.read.parquet(f"{d}/documents.parquet").count(), read / postings)
    print(share)
    assert share["sf0.1"][0] < share["sf0.01"][0] < 0.35


def test_lines_of_split_files(spark, tmp_path):
    """Files of several blocks, read by several tasks, against a plain loop."""
    r = random.Random(1)
    want = set()
    for name, lines in (("a", 3000), ("b", 1), ("c", 0), ("d", 700)):
        text = [("" if r.random() < 0.1 else f'{{"n": {i}, "x": "' + "é" * r.randrange(40) + '"}') for i in range(lines)]
        body = "".join(t + r.choice(["\n", "\r\n"]) for t in text)
        (tmp_path / f"{name}.jsonl").write_bytes((body if name != "d" else body + "last").encode())
        want |= {(name, i + 1, t) for i, t in enumerate(text + ["last"] * (name == "d"))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = RD.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(want) and {(x.file.rsplit("/", 1)[1][0], x.line, x.raw) for x in got} == want


def graph(r, n, m, prefix=""):
    edges = {}
    for _ in range(m):
        a, b = sorted((min(r.randrange(n), r.randrange(n)), r.randrange(n)))
        if a != b:
            edges[f"{prefix}{a:03}", f"{prefix}{b:03}"] = edges.get((f"{prefix}{a:03}", f"{prefix}{b:03}"), 0) + 1
    return edges


def walk_brute(edges, seed, depth, nodes, most, hub):
    near = collections.defaultdict(dict)
    for (a, b), n in edges.items():
        near[a][b] = near[b][a] = n
    hops, opened, kept, met_all = {seed: 0}, {seed: True}, set(), []
    for hop in range(1, depth + 1):
        met = [(-n, a, b) for a in [x for x, h in hops.items() if h == hop - 1 and opened[x]] for b, n in near[a].items() if not (b in hops and opened[b] and (hops[b] < hop - 1 or (hops[b] == hop - 1 and b < a)))]
        met_all += [(a, b, b not in hops) for _, a, b in met]
        ranked = sorted(met)[: max(0, most - len(kept))]
        new, old = [], dict(hops)
        for _, _a, b in ranked:
            if b not in old and b not in new:
                new.append(b)
        for b in new[: max(0, nodes - len(old))]:
            hops[b], opened[b] = hop, hub is None or len(near[b]) <= hub
        kept |= {(a, b, hop) for _, a, b in ranked if b in hops}
    left = {b for _, b, new in met_all if new and b not in hops}
    return hops, kept, (len(hops), sum(not o for o in opened.values()), len(kept), len(met_all) - len(kept), len(left), bool(left) or len(met_all) > len(kept))


@pytest.mark.parametrize("nodes,most,hub", [(10**6, 10**6, None), (12, 10**6, None), (10**6, 9, None), (15, 20, 8), (1, 5, None)])
def test_bounded_walk(spark, nodes, most, hub):
    r = random.Random(8)
    edges = graph(r, 60, 130)
    links = G.both_ways(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "source string, target string, n long"))
    starts = ["000", "001", "007", "031", "nowhere"]
    w = G.bounded_walk(links, spark.createDataFrame([(s,) for s in starts + ["000"]], "seed string"), 3, nodes, most, hub)
    reached, kept, report = collections.defaultdict(dict), collections.defaultdict(set), {x.seed: (x.nodes, x.hubs, x.edges, x.omitted_edges, x.omitted_nodes, x.truncated) for x in w.report.collect()}
    for x in w.reached.collect():
        reached[x.seed][x.node] = x.hop
    for x in w.edges.collect():
        kept[x.seed].add((x.node, x.other, x.hop))
    for s in starts:
        assert (reached[s], kept[s], report[s]) == walk_brute(edges, s, 3, nodes, most, hub)


def test_paths_between_asked_ends(spark):
    r = random.Random(4)
    edges = graph(r, 150, 190) | {("x1", "x2"): 1}
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    names = sorted(near)
    pairs = [(r.choice(names), r.choice(names)) for _ in range(60)] + [("x1", "000"), ("x1", "x2"), ("000", "000"), (None, "000"), ("nowhere", "000"), ("x1", "x2")]

    def hops(a, b):
        seen, front, d = {a}, {a}, 0
        while front and b not in seen:
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            d += 1
        return d if b in seen else None

    links = G.both_ways(spark.createDataFrame(list(edges), "source string, target string"))
    got = {(x.source, x.target): x for x in G.paths_between(links, spark.createDataFrame(pairs, "source string, target string"), 6).collect()}
    want = {p: h for p in pairs if None not in p and (h := hops(*p)) is not None and h <= 6}
    assert {p: x.hops for p, x in got.items()} == want and max(want.values()) >= 5
    for (a, b), x in got.items():
        assert x.path[0] == a and x.path[-1] == b and len(x.path) == x.hops + 1 and all(q in near[p] for p, q in zip(x.path, x.path[1:]))
