"""Facets of segments: the same however sessions are dealt, and laid out only where they are counted."""

import collections
import random

from pyspark.sql import functions as F

from tracelake.operators import rollups as R


def test_segment_facets_are_counted_where_they_are_laid_out(spark, capsys):
    r = random.Random(4)
    rows = [(f"u{u}", line // 9, line, r.choice("ab"), r.choice(["x", None])) for u, n in enumerate((40, 3, 17)) for line in range(1, n + 1)]
    events = spark.createDataFrame(rows, "session_id string, segment long, line long, kind string, mark string")
    want = collections.defaultdict(list)
    for s, g, line, kind, mark in rows:
        for facet, value in (("kind", kind), ("mark", mark)):
            if value is not None:
                want[s, g, facet, value].append(line)
    want = sorted((*k, len(v), ",".join(map(str, v[:5]))) for k, v in want.items())
    facets = {"kind": F.array("kind"), "mark": F.array("mark")}
    for lines in (4, 20, 65_536):
        assert sorted(map(tuple, R.segment_facets(events, facets, lines=lines).collect())) == want
    capsys.readouterr()
    R.segment_facets(events, facets).explain()
    # Events are dealt once a branch; only long sessions' counts meet again.
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 3
