"""Spatial and graph operators against direct computation on small fixtures."""

import hashlib
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.operators import graph as gr
from cellweave.operators import spatial as sp


def test_hull_distance_and_area(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rng = np.random.default_rng(3)
    pts = square + [tuple(map(float, p)) for p in rng.uniform(0.5, 9.5, size=(200, 2))]
    df = spark.createDataFrame([("a", i, *p) for i, p in enumerate(pts)], "sample_id string, cell_id long, x double, y double").repartition(5)
    shape = sp.tissue_shape(df, ["sample_id"]).first()
    assert (shape["tissue_area"], shape["tissue_perimeter"], shape["n_cells"]) == (100.0, 40.0, 204)
    for r in sp.boundary_distance(df, ["sample_id"]).collect():
        assert r["boundary_distance"] == pytest.approx(min(r["x"], r["y"], 10 - r["x"], 10 - r["y"]), abs=1e-6)


def test_gaussian_filter_mirrors_edges(spark):
    rng = np.random.default_rng(4)
    n, sigma = 12, 1.5
    g = rng.normal(size=(n, n))
    df = spark.createDataFrame([("a", i, j, float(g[i, j])) for i in range(n) for j in range(n)], "sample_id string, gx int, gy int, v double")
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    pad = np.pad(g, r, mode="symmetric")
    rows = np.stack([np.convolve(pad[:, j], w, "valid") for j in range(pad.shape[1])], 1)
    want = np.stack([np.convolve(rows[i], w, "valid") for i in range(n)], 0)
    for q in sp.gaussian_filtered(df, ["sample_id"], ["v"], n, sigma).collect():
        assert q["v"] == pytest.approx(want[q["gx"], q["gy"]], abs=1e-9)


def test_moran_on_a_line(spark):
    n = 30
    x = np.arange(n, dtype=float)
    edges = spark.createDataFrame([("a", i, j, 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "sample_id string, src long, dst long, dist double")
    cells = spark.createDataFrame([("a", i) for i in range(n)], "sample_id string, cell_id long")
    vals = spark.createDataFrame([("a", i, "g", float(x[i])) for i in range(n)], "sample_id string, cell_id long, gene string, count double")
    w = np.zeros((n, n))
    for i in range(n):
        nbr = [j for j in (i - 1, i + 1) if 0 <= j < n]
        w[i, nbr] = 1 / len(nbr)
    z = x - x.mean()
    out = sp.with_norm_p(sp.autocorrelation(edges, cells, vals, ["sample_id"], "moran", n_perm=9)).first()
    assert out["stat"] == pytest.approx(n / w.sum() * (z @ w @ z) / (z @ z))
    assert out["p_norm"] < 1e-4 and out["p_sim"] == pytest.approx(0.1)
    geary = sp.autocorrelation(edges, cells, vals, ["sample_id"], "geary").first()["stat"]
    assert geary == pytest.approx((n - 1) / (2 * w.sum()) * (w * (x[:, None] - x[None, :]) ** 2).sum() / (z @ z))


@pytest.mark.parametrize("positions", [True, False])
def test_permuted_sums_meet_in_blocks(spark, positions, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 7)  # cells of a group lie in several blocks
    rng, n, n_perm = np.random.default_rng(3), 40, 12
    links = [(s, i, j, float(rng.random())) for s in "ab" for i in range(n) for j in rng.choice(n, 3, replace=False).tolist() if i != j]
    vals = [(s, i, g, float(rng.integers(1, 5))) for s in "ab" for i in range(n) for g in "uvw" if rng.random() < 0.4]
    cells = spark.createDataFrame([(s, i, float(rng.random()), float(rng.random())) for s in "ab" for i in range(n)], "s string, cell_id long, x double, y double")
    w = spark.createDataFrame(links, "s string, src long, dst long, w double")
    values = spark.createDataFrame(vals, "s string, id long, f string, v double")
    found = sp._permuted_sums(w, cells if positions else cells.drop("x", "y"), sp.packed_values(values, ["s"], "f"), ["s"], "cell_id", n_perm, 42)
    got = {(r.s, r.perm, r.gene): (r.xm, r.x2m, r.xx) for r in found.collect()}
    want = {}
    for p in range(1, n_perm + 1):
        moved = sorted(range(n), key=lambda i, p=p: hashlib.md5(f"42|{p}|{i}".encode()).digest())  # the content of moved[i] goes to i
        of = {(s, i, g): v for s, i, g, v in vals}
        at = lambda s, i, g, moved=moved, of=of: of.get((s, moved[i], g), 0.0)
        for s, i, j, x in links:
            for g in "uvw":
                a, b = at(s, i, g), at(s, j, g)
                old = want.get((s, p, g), (0.0, 0.0, 0.0))
                want[s, p, g] = (old[0] + x * (a + b), old[1] + x * (a * a + b * b), old[2] + x * a * b)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("text", [False, True])
def test_permuted_sums_of_whole_groups_are_those_of_blocks(spark, monkeypatch, text):
    """Cells and genes that come twice, null ids and keys, edges that lead out; one group is too large for a task, one is not."""
    monkeypatch.setattr(sp, "BLOCK", 5)
    rng, n_perm, name = np.random.default_rng(4), 13, (lambda i: i if i is None else f"c{i}") if text else (lambda i: i)
    size = {"a": 30, "b": 12, None: 9}
    links = [(s, name(i), name(int(j)), float(rng.random())) for s, n in size.items() for i in range(n) for j in rng.choice(n + 1, 3, replace=False) if i != j]
    vals = [(s, name(i), g, float(rng.integers(1, 5))) for s, n in size.items() for i in range(n) for g in ("u", "v", "w", "w") if rng.random() < 0.4]
    rows = [(s, name(i)) for s, n in size.items() for i in [*range(n), 0, 1, None]]
    kind = "string" if text else "long"
    cells = spark.createDataFrame(rows, f"s string, cell_id {kind}").repartition(3)
    w = spark.createDataFrame(links, f"s string, src {kind}, dst {kind}, w double").repartition(4)
    packed = sp.packed_values(spark.createDataFrame(vals, f"s string, id {kind}, f string, v double"), ["s"], "f")
    got = []
    for most in ((0, 0), (20, 1000), (1000, 1000)):
        found = sp._permuted_sums(w, cells, packed, ["s"], "cell_id", n_perm, 42, most).collect()
        got.append({(r.s, r.perm, r.gene): (r.xm, r.x2m, r.xx) for r in found})
        assert len(found) == len(got[-1]) and {r.s for r in found} == set(size)
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(other[k] == pytest.approx(got[0][k]) for k in other)


def random_graph(n=40, p=0.08, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def frame(spark, pairs):
    return spark.createDataFrame([("a", a, b, 1.0) for i, j in pairs for a, b in ((i, j), (j, i))], "sample_id string, src long, dst long, dist double")


def test_betweenness_is_exact_with_all_sources(spark):
    pairs = random_graph()
    adj: dict = {}
    for i, j in pairs:
        adj.setdefault(i, []).append(j), adj.setdefault(j, []).append(i)
    n, want = len(adj), dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, sig, order, q = {s: 0}, {s: 1.0}, [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for u in adj[v]:
                if u not in dist:
                    dist[u], sig[u] = dist[v] + 1, 0.0
                    q.append(u)
                if dist[u] == dist[v] + 1:
                    sig[u] += sig[v]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in adj[v]:
                if dist[u] == dist[v] + 1:
                    delta[v] += sig[v] / sig[u] * (1 + delta[u])
            if v != s:
                want[v] += delta[v]
    rows = gr.betweenness(frame(spark, pairs), ["sample_id"]).collect()
    assert {(r.n_sources, r.error) for r in rows} == {(n, 0.0)}
    got = {r.node: r.betweenness for r in rows}
    for v in adj:
        assert got[v] == pytest.approx(want[v] / ((n - 1) * (n - 2)))


def test_betweenness_stops_at_its_error_and_stays_within_it(spark):
    sizes = {"a": (60, 0.06), "b": (400, 0.01), "c": (5, 0.5)}
    rows = [(g, x, y) for g, (n, p) in sizes.items() for i, j in random_graph(n, p) for x, y in ((i, j), (j, i))]
    e = spark.createDataFrame(rows, "sample_id string, src long, dst long")
    exact = {(r.sample_id, r.node): r for r in gr.betweenness(e, ["sample_id"]).collect()}
    assert {r.error for r in exact.values()} == {0.0}
    blocks = gr.betweenness(e, ["sample_id"], block_rows=100_000).collect()
    assert {(r.sample_id, r.node): r.betweenness for r in blocks} == pytest.approx({k: r.betweenness for k, r in exact.items()})
    some = gr.betweenness(e, ["sample_id"], eps=0.3, first=16).collect()
    assert {r.n_sources for r in some if r.sample_id == "b"} < {exact["b", r.node].n_sources for r in some if r.sample_id == "b"} | {128}
    assert all(r.error <= 0.3 * 400 / 399 and abs(r.betweenness - exact[r.sample_id, r.node].betweenness) <= r.error + 1e-12 for r in some)
    assert {r.error for r in some if r.sample_id == "c"} == {0.0}
    few = gr.betweenness(e, ["sample_id"], n_sources=8).collect()
    assert max(r.n_sources for r in few) == 8 and len(few) == len(exact)


def test_components_and_pagerank(spark):
    pairs = [(i, i + 1) for i in range(15)] + [(20, 21), (21, 22)]
    nodes = spark.createDataFrame([("a", i) for i in [*range(16), 20, 21, 22, 30]], "sample_id string, node long")
    comp = {r["node"]: r["comp"] for r in gr.components(nodes, frame(spark, pairs), ["sample_id"]).collect()}
    assert {comp[i] for i in range(16)} == {0} and comp[22] == 20 and comp[30] == 30
    pr = gr.pagerank(frame(spark, pairs), ["sample_id"]).agg(F.sum("pagerank")).first()[0]
    assert pr == pytest.approx(1.0)
    with pytest.raises(ArithmeticError):  # ranks that have not settled are not handed out
        gr.pagerank(frame(spark, pairs), ["sample_id"], iterations=8)


def test_communities_find_two_cliques(spark):
    pairs = [(i, j) for b in (0, 10) for i in range(b, b + 6) for j in range(i + 1, b + 6)] + [(0, 10)]
    e = frame(spark, pairs)
    labels = gr.communities(e, ["sample_id"], [1.0])
    com = {r["node"]: r["community"] for r in labels.collect()}
    assert len({com[i] for i in range(6)}) == 1 and len({com[i] for i in range(10, 16)}) == 1 and com[0] != com[10]
    q = gr.modularity(e, labels, ["sample_id"]).first()
    assert q["n_communities"] == 2 and q["modularity"] > 0.4


def test_every_community_is_connected_and_modularity_is_that_of_its_labels(spark):
    rng = np.random.default_rng(8)
    blocks = [(i, j) for i in range(90) for j in range(i + 1, 90) if rng.random() < (0.35 if i // 15 == j // 15 else 0.02)]
    loose = [(i + 200, j + 200) for i, j in random_graph(120, 0.02, 9)]
    ring = [(500 + i, 500 + (i + 1) % 30) for i in range(30)]
    pairs = [("a", *p) for p in blocks] + [("b", *p) for p in loose] + [("c", *p) for p in ring]
    e = spark.createDataFrame([(g, x, y) for g, i, j in pairs for x, y in ((i, j), (j, i))], "sample_id string, src long, dst long")
    labels = gr.communities(e, ["sample_id"], [0.5, 1.0, 2.0])
    named = {(r.sample_id, r.resolution, r.node): r.community for r in labels.collect()}
    assert len(named) == 3 * len({(g, v) for g, i, j in pairs for v in (i, j)})
    want = {}
    for res in (0.5, 1.0, 2.0):
        for g in "abc":
            mine = [(i, j) for h, i, j in pairs if h == g]
            com = {v: named[g, res, v] for p in mine for v in p}
            root = {v: v for v in com}

            def find(v):
                while root[v] != v:
                    v = root[v]
                return v

            for i, j in mine:
                if com[i] == com[j]:
                    root[max(find(i), find(j))] = min(find(i), find(j))
            assert all(find(v) == com[v] for v in com)  # one component each, named by its smallest node
            m, deg = len(mine), {v: sum(v in p for p in mine) for v in com}
            want[g, res] = sum(com[i] == com[j] for i, j in mine) / m - res * sum(sum(d for v, d in deg.items() if com[v] == k) ** 2 for k in set(com.values())) / (4 * m * m)
    got = {(r.sample_id, r.resolution): r.modularity for r in gr.modularity(e, labels, ["sample_id"]).collect()}
    assert got == pytest.approx(want)
    truth = sum(i // 15 == j // 15 for i, j in blocks) / len(blocks) - sum((sum(i // 15 == b or j // 15 == b for i, j in blocks) + sum(i // 15 == b == j // 15 for i, j in blocks)) ** 2 for b in range(6)) / (4 * len(blocks) ** 2)
    assert got["a", 1.0] > truth - 1e-9 and got["b", 1.0] > 0.5 and got["c", 1.0] > 0.6


def test_graphs_held_by_a_task_give_what_joins_give(spark):
    """Communities and modularity of whole graphs are those of edges joined one by one, whatever the graph and its neighbours."""
    rng = np.random.default_rng(11)
    blocks = [(i, j) for i in range(70) for j in range(i + 1, 70) if rng.random() < (0.4 if i // 14 == j // 14 else 0.03)]
    pairs = [("a", *p) for p in blocks] + [("b", 7 * i, 7 * j) for i, j in random_graph(50, 0.06, 9)] + [("c", -i, -(i + 1) % -30) for i in range(1, 30)] + [("c", 4, 4), ("a", 0, 1), (None, 1, 2)]
    e = spark.createDataFrame([(g, x, y, 1.0) for g, i, j in pairs for x, y in ((i, j), (j, i))], "sample_id string, src long, dst long, v double").repartition(3)
    found = [gr.communities(e, ["sample_id"], [0.5, 1.5], tol=0.02, weight=weight, most_edges=most) for weight, most in ((None, 0), (None, 10**6), ("v", 10**6))]
    got = [{(r.sample_id, r.resolution, r.node): r.community for r in f.collect()} for f in found]
    assert got[0] == got[1] == got[2] and len(got[0]) > 200
    labels = found[1]
    q = [{(r.sample_id, r.resolution): (r.modularity, r.n_communities) for r in gr.modularity(e, labels, ["sample_id"], most).collect()} for most in (0, 10**6)]
    assert q[0].keys() == q[1].keys() and all(q[0][k] == pytest.approx(q[1][k]) for k in q[0])


def test_betweenness_of_graphs_held_by_a_task(spark):
    pairs = [("a", *p) for p in random_graph(60, 0.06)] + [("b", 7 * i, 7 * j) for i, j in random_graph(30, 0.1, 9)] + [("b", 700, 707), ("b", 0, 0), ("a", 0, 1), (None, 1, 2)]
    e = spark.createDataFrame([(g, x, y) for g, i, j in pairs for x, y in ((i, j), (j, i))], "sample_id string, src long, dst long").repartition(3)
    b = [{(r.sample_id, r.node): (r.betweenness, r.n_sources, r.error) for r in gr.betweenness(e, ["sample_id"], n_sources=16, most_edges=most).collect()} for most in (0, 10**6)]
    assert b[0].keys() == b[1].keys() and all(b[0][k] == pytest.approx(b[1][k]) for k in b[0])


def test_whole_graphs_are_not_taken_where_they_do_not_fit(spark):
    from cellweave.operators import whole as wh

    e = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 2)], "s string, src long, dst long")
    assert wh.whole_graphs(e, ["s"], most=2).n == 2 and wh.whole_graphs(e, ["s"], most=1) is None
    assert wh.whole_graphs(e.where("false"), ["s"]) is None and wh.whole_graphs(e.withColumn("dst", F.expr("nullif(dst, 1)")), ["s"]) is None
    assert wh.whole_graphs(e.withColumns({"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")}), ["s"]) is None
    ids = np.array([0, 1, -5, 2**40, -(2**62)])
    for kind, some in (("bigint", ids), ("int", ids[:3])):
        df = spark.createDataFrame([(int(i),) for i in some], "v long").select(F.col("v").cast(kind))
        h = wh.hash_ids(some, kind)
        want = df.select(F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(7)).alias("k")).collect()
        assert h.view(np.int64).tolist() == [r.h for r in want] and wh.hash_int(h, np.full(len(some), 7)).view(np.int64).tolist() == [r.k for r in want]


def kruskal(pairs):
    root, out = {}, []

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for g, d, i, j in sorted((g, d, min(i, j), max(i, j)) for g, i, j, d in pairs):
        if find((g, i)) != find((g, j)):
            root[find((g, i))] = find((g, j))
            out.append((g, i, j, d))
    return sorted(out)


def test_spanning_forest_and_component_counts_at_any_radius(spark):
    rng = np.random.default_rng(2)
    pairs = [("a", i, j, float(rng.integers(1, 6))) for i, j in random_graph(150, 0.03)]  # many ties
    pairs += [("b", i, i + 1, float(i % 7)) for i in range(300)] + [("b", 0, 1, 9.0)] + [("c", 0, i, 1.0) for i in range(1, 400)] + [(None, 1, 2, 3.0), ("a", 3, 3, 0.0)]
    both = [(g, x, y, d) for g, i, j, d in pairs for x, y in ((i, j), (j, i))]
    e = spark.createDataFrame(both, "sample_id string, src long, dst long, dist double").where("sample_id is not null")
    got = sorted((r.sample_id, r.src, r.dst, r.dist) for r in gr.spanning_forest(e, ["sample_id"]).collect())
    assert got == kruskal([p for p in pairs if p[0] and p[1] != p[2]])
    nodes = spark.createDataFrame([("a", i) for i in range(160)] + [("b", i) for i in range(301)] + [("d", 1), ("d", 2)], "sample_id string, cell_id long")
    radii = [0.0, 1.0, 2.5, 3.0, 6.0]
    counts = {(r.sample_id, r.radius): r.n_components for r in gr.component_counts(nodes, e.where("sample_id <> 'c'"), ["sample_id"], radii).collect()}
    forest = kruskal([p for p in pairs if p[0] in ("a", "b") and p[1] != p[2]])
    size = {"a": 160, "b": 301, "d": 2}
    assert counts == {(g, r): n - sum(h == g and d <= r for h, _, _, d in forest) for g, n in size.items() for r in radii}
    assert gr.spanning_forest(e.where("false"), ["sample_id"]).collect() == []


def test_pseudotime_of_each_graph(spark):
    path = [(i, i + 1) for i in range(19)] + [(i, i + 2) for i in range(18)] + [(0, 5), (0, 4)]
    ring = [(100 + i, 100 + (i * i + 3) % 24) for i in range(24) if i != (i * i + 3) % 24] + [(100 + i, 101 + i) for i in range(23)]
    frames = [frame(spark, p).select(F.lit(k).cast("string").alias("s"), "src", "dst").distinct() for k, p in ((None, path), ("ring", ring))]
    out = gr.diffusion_pseudotime(frames[0].unionByName(frames[1]), ["s"], 3, tol=1e-6).collect()
    for key, pairs in ((None, path), ("ring", ring)):
        got = {r.node: r.pseudotime for r in out if r.s == key}
        nodes = sorted(got)
        m = np.zeros((len(nodes), len(nodes)))
        for a, b in pairs:
            m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = 1
        d = m.sum(1)
        lam, vec = np.linalg.eigh(m / np.sqrt(np.outer(d, d)))
        lam, vec = lam[::-1][:3], vec[:, ::-1][:, :3]
        root = np.abs(vec[:, 1]).argmax()
        assert np.sort(abs(vec[:, 1]))[-2] < abs(vec[root, 1]) - 1e-4
        want = np.sqrt(sum(((vec[:, i] - vec[root, i]) * lam[i] / (1 - lam[i])) ** 2 for i in (1, 2)))
        assert np.allclose([got[n] for n in nodes], want / want.max(), atol=1e-3)


def test_components_with_one_giant_and_a_hub(spark):
    star = [(0, i) for i in range(1, 400)]
    chain = [(1000 + i, 1001 + i) for i in range(120)]
    e = frame(spark, star + chain)
    nodes = e.select("sample_id", F.col("src").alias("node")).distinct().union(spark.createDataFrame([("x", 7)], nodes_schema(e)))
    comp = {(r.sample_id, r.node): r.comp for r in gr.components(nodes, e, ["sample_id"]).collect()}
    key = e.first().sample_id
    assert all(comp[key, i] == 0 for i in range(400)) and all(comp[key, 1000 + i] == 1000 for i in range(121)) and comp["x", 7] == 7
    pr = gr.pagerank(e, ["sample_id"]).agg(F.sum("pagerank"), F.max("pagerank")).first()
    assert abs(pr[0] - 1) < 1e-3 and pr[1] > 0.2


def nodes_schema(e):
    return f"sample_id {e.schema['sample_id'].dataType.simpleString()}, node long"


def test_enrichment_of_separated_labels(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"sample_id": "a", "cell_id": range(60), "x": np.r_[rng.normal(0, 1, 30), rng.normal(50, 1, 30)], "y": rng.normal(size=60), "t": ["p"] * 30 + ["q"] * 30})
    from cellweave.operators.neighbors import nearest_in_plane

    df = spark.createDataFrame(pdf)
    e = nearest_in_plane(df, ["sample_id"], 5)
    z = {(r["a"], r["b"]): r["z"] for r in sp.neighbourhood_enrichment(e, df, ["sample_id"], "t", 20).collect()}
    assert z["p", "p"] > 2 and z["q", "q"] > 2 and z["p", "q"] < -2
    same = sp.neighbourhood_consistency(e, df, ["sample_id"], "t").agg(F.avg("neighborhood_consistency")).first()[0]
    assert same == 1.0


def test_values_meet_edges_as_lists_of_a_cell(spark):
    """Cross products and smoothed values of edges that come twice, cells without values and features that come twice."""
    from cellweave.operators import spatial as sp

    edges = [("a", 1, 2, 1.0), ("a", 1, 2, 1.0), ("a", 2, 1, 2.0), ("a", 1, 3, 0.0), ("a", 4, 1, 1.0), ("b", 1, 2, 1.0), (None, 1, 2, 1.0)]
    values = [("a", 1, "g", 2.0), ("a", 1, "h", 3.0), ("a", 2, "g", 5.0), ("a", 2, "g", 7.0), ("a", 3, "h", 1.0), ("b", 1, "g", 1.0), ("b", 2, "h", 1.0), ("b", 2, "g", 4.0)]
    e = spark.createDataFrame(edges, "s string, src long, dst long, dist double")
    v = spark.createDataFrame(values, "s string, cell_id long, gene string, v double")
    want: dict = {}
    for s, i, j, d in edges:
        for sa, a, g, x in values:
            for sb, b, h, y in values:
                if sa == sb == s and a == i and b == j and g == h:
                    want[s, g] = want.get((s, g), 0.0) + d * x * y
    packed = sp.packed_values(v.withColumnsRenamed({"cell_id": "id", "gene": "f"}), ["s"], "f")
    crossed = sp._cross_products(e.withColumnRenamed("dist", "w"), packed, ["s"])
    assert {(r.s, r.gene): r.xx for r in crossed.collect()} == pytest.approx(want)
    sums, total = {}, {}
    cells = sorted({(s, i) for s, i, _, _ in values})
    for s, i, j, d in [*edges, *[(s, i, i, 0.0) for s, i in cells]]:
        w = 1 / (d + 1e-6)
        total[s, i] = total.get((s, i), 0.0) + w
        for sa, a, g, x in values:
            if sa == s and a == j:
                sums[s, i, g] = sums.get((s, i, g), 0.0) + w * x
    smooth = sp.smoothed(e, v, ["s"], "gene", "v")
    assert {(r.s, r.cell_id, r.gene): r.v for r in smooth.collect()} == pytest.approx({k: x / total[k[:2]] for k, x in sums.items()})
