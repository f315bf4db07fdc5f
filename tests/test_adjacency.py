from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import adjacency as ad
from cellweave.operators import graph as gr

SCHEMA = "s string, src long, dst long"


def graphs():
    """Two graphs with both directions, a repeated edge and a hub."""
    rng = np.random.default_rng(5)
    rows = []
    for s, n in (("a", 300), ("b", 40)):
        pairs = {(i, i + 1) for i in range(n - 1)} | {(0, int(i)) for i in rng.choice(np.arange(1, n), n // 2, False)}
        pairs |= {tuple(sorted(map(int, rng.choice(n, 2, False)))) for _ in range(2 * n)}
        rows += [(s, 3 * a, 3 * b) for a, b in pairs] + [(s, 3 * b, 3 * a) for a, b in pairs]
    return [*rows, ("a", 0, 3), ("a", 3, 0)]


def test_sums_over_neighbours_come_block_by_block(spark):
    rows = graphs()
    odd = [(None, 1, 2), (None, 2, 1), ("a", 6, 77777), ("a", 9, None), ("a", None, 6)]  # no source at the far end, null ends
    graph = ad.adjacency(spark.createDataFrame(rows + odd, SCHEMA), ["s"], block_edges=100)
    n_blocks, n_edges = graph.blocks.count(), len(rows)
    assert n_blocks > 10 and graph.tiles.count() < n_edges / 4
    state = graph.blocks.select("g", "b", F.flatten(F.transform("ids", lambda v: F.array(v.cast("double"), F.lit(1.0)))).alias("x"), "ids", "deg")
    out = ad.neighbour_round(graph, state.drop("ids", "deg"), lambda block: ad.doubles(block, "x").reshape(-1, 2), lambda block, got: {"x": got}, "x binary")
    assert out.count() == n_blocks
    named = graph.blocks.select("g", "b", "ids").join(out, ["g", "b"])
    got = {(r.s, r.node): r.x for r in ad.node_rows(named, {"x": 2}, "bigint").join(graph.groups, "g").collect()}
    want = {(s, v): [0.0, 0.0] for s, v, _ in rows + odd if v is not None}
    for s, a, b in rows + odd:
        if a is not None and (s, b) in want:
            want[s, b][0] += a
            want[s, b][1] += 1
    assert got == want
    deg = {(r.s, r.node): r.deg for r in ad.node_rows(graph.blocks, {"deg": 1}, "bigint").join(graph.groups, "g").collect()}
    assert deg["a", 9] == sum(s == "a" and v == 9 for s, v, _ in rows) + 1


def test_text_names_and_no_edges(spark):
    graph = ad.adjacency(spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "z"), ("z", "y")], "src string, dst string"), [], block_edges=2)
    assert sorted(r.node for r in ad.node_rows(graph.blocks, {"deg": 1}, "string").collect()) == ["x", "y", "z"]
    none = spark.createDataFrame([], SCHEMA)
    assert gr.pagerank(none, ["s"]).collect() == [] and gr.diffusion_pseudotime(none, ["s"], 3).collect() == []


@pytest.mark.parametrize("block_edges", [64, 1 << 19])
def test_pagerank_in_blocks(spark, monkeypatch, block_edges):
    rows = graphs()
    monkeypatch.setattr(gr, "adjacency", partial(ad.adjacency, block_edges=block_edges))
    out = {(r.s, r.node): r for r in gr.pagerank(spark.createDataFrame([*rows, (None, 1, 2), (None, 2, 1), ("b", None, 0)], SCHEMA), ["s"], tol=1e-8).collect()}
    assert {k for k in out} == {(s, a) for s, a, _ in rows}
    for s, n, nulls in (("a", 300, 0), ("b", 40, 1)):  # a null source counts as a node and gets no row
        m = np.zeros((n, n))
        for t, a, b in rows:
            if t == s:
                m[b // 3, a // 3] += 1
        deg, pr = m.sum(0), np.full(n, 1 / (n + nulls))
        for _ in range(300):
            pr = 0.15 / (n + nulls) + 0.85 * m @ (pr / deg)
        assert np.allclose([out[s, 3 * i].pagerank for i in range(n)], pr, atol=1e-6)
        assert np.allclose([out[s, 3 * i].degree_centrality for i in range(n)], deg / (n + nulls - 1))


def test_pseudotime_in_blocks(spark, monkeypatch):
    e = spark.createDataFrame(graphs(), SCHEMA)
    whole = {(r.s, r.node): r.pseudotime for r in gr.diffusion_pseudotime(e, ["s"], 3, tol=3e-2).collect()}
    monkeypatch.setattr(gr, "adjacency", partial(ad.adjacency, block_edges=100))
    cut = {(r.s, r.node): r.pseudotime for r in gr.diffusion_pseudotime(e, ["s"], 3, tol=3e-2).collect()}
    assert cut.keys() == whole.keys() and len(whole) == 340
    assert all(abs(cut[k] - whole[k]) < 1e-6 for k in whole)
