"""Paths: edges that no path meets are not shuffled."""

import pytest
from counted import shuffled_records

from loomgraph.operators import search

EDGES = "subj_label string, subj string, predicate string, obj_label string, obj string"


def plain(edges, start, hops):
    """(start, end, length, predicates, names) by a walk over all edges."""
    out, front = [], [(s, s, (), (), (s,)) for s in start]
    for k in range(1, hops + 1):
        front = [(s, t, used + (i,), ps + (p,), ns + (t,)) for s, at, used, ps, ns in front for i, (_, a, p, _, b) in enumerate(edges) if i not in used for f, t in {(a, b, 0)[:2], (b, a, 1)[:2]} if f == at]
        out += [(s, t, k, ">".join(ps), ">".join(ns)) for s, t, _, ps, ns in front]
    return sorted(out)


@pytest.mark.parametrize("few", [0, 1000])
def test_paths_go_on_from_their_ends(spark, tmp_path, monkeypatch, few):
    edges = [("N", f"n{i}", "IN", "R", f"r{i % 2}") for i in range(4)] + [("C", f"c{i}", "OF", "N", f"n{i % 4}") for i in range(40)]
    edges += [("C", f"c{i}", "HAS", "P", f"p{i * 7 % 50}") for i in range(40)] + [("X", f"x{i}", "HAS", "P", f"p{i % 50}") for i in range(2000)]
    monkeypatch.setattr(search, "FEW", few)
    spark.createDataFrame(edges, EDGES).write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    start = spark.createDataFrame([("R", "r0"), ("R", "r1"), ("R", "gone")], "label string, canonical_name string")
    got = []
    n = shuffled_records(spark, lambda: got.extend(tuple(r) for r in search.paths(e, start, 3).collect()))
    want = plain(edges, ["r0", "r1"], 3)
    assert sorted(got) == want and {r[2] for r in want} == {1, 2, 3}
    assert n < 1000  # of 4,168 edges in both directions, three times
