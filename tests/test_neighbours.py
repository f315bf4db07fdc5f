"""Neighbour joins against brute force, on crowded, copied and sparse positions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.operators import neighbors as nb


def brute(pdf, k, cols):
    out = []
    for _, g in pdf.groupby("s"):
        m, ids = np.stack(g[cols].to_numpy()) if isinstance(cols, str) else g[cols].to_numpy(), g.cell_id.to_numpy()
        for i in range(len(m)):
            d = np.sqrt(((m - m[i]) ** 2).sum(1))
            near = sorted((d[j], ids[j]) for j in range(len(m)) if j != i)[:k]
            out += [(ids[i], r + 1, j, x) for r, (x, j) in enumerate(near)]
    return sorted(out)


def same(df, want):
    got = sorted((r.src, r.rank, r.dst, r.dist) for r in df.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-9)


@pytest.fixture(scope="module")
def plane():
    rng = np.random.default_rng(0)
    spread, crowd = rng.normal(size=(150, 2)) * 100, rng.normal(size=(250, 2)) * 0.01 + 50
    copies, close = np.tile([[7.0, 7.0]], (60, 1)), 1e-9 * rng.normal(size=(80, 2)) + 3
    xy = np.vstack([spread, crowd, copies, close])
    return pd.DataFrame({"s": np.where(np.arange(len(xy)) % 5 == 0, "A", "B"), "cell_id": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})


@pytest.mark.parametrize("cap", [16, 64])
def test_plane(spark, plane, cap):
    same(nb.nearest_in_plane(spark.createDataFrame(plane), ["s"], 6, cap=cap), brute(plane, 6, ["x", "y"]))


def test_fewer_rows_than_k(spark, plane):
    few = plane.head(4).assign(s="A")
    same(nb.nearest_in_plane(spark.createDataFrame(few), ["s"], 6), brute(few, 6, ["x", "y"]))


def test_within_distance_and_counts(spark, plane):
    df = spark.createDataFrame(plane)
    want = sorted((a.cell_id, b.cell_id) for _, g in plane.groupby("s") for a in g.itertuples() for b in g.itertuples() if a.cell_id != b.cell_id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 25)
    got = nb.within_distance(df, ["s"], 5.0)
    assert sorted((r.src, r.dst) for r in got.collect()) == want
    n = {r.cell_id: r.n_within for r in nb.count_within(df, ["s"], 5.0).collect()}
    assert sum(n.values()) == len(want) + len(plane)


@pytest.mark.parametrize("cap", [4, 60, 32_768])
def test_pairs_of_tiles_and_their_pieces(spark, plane, cap):
    """Rows of negative and crowded places, repeated rows, and rows without key, id or place; no row is sent to nine squares."""
    more = pd.DataFrame({"s": [None, "A", "A", "A", "B"], "cell_id": [900, None, 902, 4, 4], "x": [1.0, 7.0, None, 7.0, 7.0], "y": [1.0, 7.0, 2.0, 7.0, 7.0]})
    pdf = pd.concat([plane, plane.tail(30), more]).astype({"cell_id": "Int64"})
    rows = [(s, None if pd.isna(i) else int(i), None if pd.isna(x) else float(x), float(y)) for s, i, x, y in pdf[["s", "cell_id", "x", "y"]].itertuples(index=False)]
    df = spark.createDataFrame(rows, "s string, cell_id long, x double, y double")
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and None not in a + b and a[1] != b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 25)
    assert sorted((r.s, r.src, r.dst) for r in nb.within_distance(df, ["s"], 5.0, cap=cap).collect()) == want
    assert nb.within_distance(df.where("false"), ["s"], 5.0, cap=cap).collect() == []


def test_pairs_are_shuffled_as_a_few_rows_a_cell(spark):
    """One shuffle carries rows to tiles, about one and a half for a cell; the join had ten."""
    cells = spark.range(30_000).select("id", (F.col("id") % 2).alias("s"), (F.pmod(F.xxhash64("id"), F.lit(4000)) / 10).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4000)) / 10).alias("y"))
    plan = nb.within_distance(cells.withColumnRenamed("id", "cell_id"), ["s"], 5.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_local_forest_is_that_of_all_pairs(most):
    """Crowds, copies, chains and many equal distances: the forest of Kruskal's method over all pairs."""
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.normal(size=(60, 2)) * 30, rng.normal(size=(80, 2)) * 0.001 + 5, np.tile([[5.0, 9.0]], (20, 1)), rng.integers(0, 6, (60, 2)) + 40.0, np.c_[np.arange(40) * 3.9, np.full(40, -60.0)]])
    ids = rng.permutation(len(xy))
    for r in (0.0015, 1.0, 4.0, 25.0):
        d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
        root, want = list(range(len(xy))), []

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for d, a, b, i, j in sorted((float(np.sqrt(d2[i, j])), int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), i, j) for i in range(len(xy)) for j in range(i) if d2[i, j] <= r * r):
            if find(i) != find(j):
                root[find(i)] = find(j)
                want.append((a, b, d))
        i, j, d = nb._local_forest(ids, xy[:, 0].copy(), xy[:, 1].copy(), r, most)
        assert sorted(zip(np.minimum(ids[i], ids[j]).tolist(), np.maximum(ids[i], ids[j]).tolist(), d.tolist())) == sorted(want)


def test_local_forest_of_a_crowd_takes_few_pairs():
    """Twenty thousand points within reach of each other: two hundred million pairs, some hundred thousand looked at."""
    rng = np.random.default_rng(2)
    x, y = rng.random(20_000), rng.random(20_000)
    looked = []
    whole = nb._near_squares
    try:
        nb._near_squares = lambda *a: (looked.append(len(e[0])) or e for e in whole(*a))
        i, _, _ = nb._local_forest(np.arange(20_000), x, y, 2.0)
    finally:
        nb._near_squares = whole
    assert len(i) == 19_999 and sum(looked) < 2_000_000


def test_embedding(spark):
    rng = np.random.default_rng(2)
    v = np.vstack([rng.normal(size=(300, 6)), np.tile(rng.normal(size=(1, 6)), (25, 1))])
    pdf = pd.DataFrame({"s": np.where(np.arange(len(v)) % 3 == 0, "A", "B"), "cell_id": np.arange(len(v)), "embedding": list(v)})
    same(nb.nearest_in_embedding(spark.createDataFrame(pdf), ["s"], 5, n_pivots=6, cap=30), brute(pdf, 5, "embedding"))
    some = nb.nearest_in_embedding(spark.createDataFrame(pdf), ["s"], 5, n_pivots=6, cap=30, probes=2)
    assert some.count() > 0


def test_embedding_ties_go_by_id(spark):
    side = np.arange(14)
    v = np.array([(a, b, c) for a in side for b in side for c in side], float) + 1e6  # large norms as well
    ids = np.random.default_rng(5).permutation(len(v))
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :4]
    want = {(int(ids[i]), r + 1): int(ids[j]) for i in range(len(v)) for r, j in enumerate(order[i])}
    df = spark.createDataFrame(pd.DataFrame({"cell_id": ids, "embedding": list(v)})).repartition(5)
    got = {(r.src, r["rank"]): r.dst for r in nb.nearest_in_embedding(df, [], 4, cap=100).collect()}
    assert got == want


def test_embedding_groups_of_any_key(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, [float(x) for x in rng.normal(size=3)]) for i, k in enumerate([True, False, None] * 40)]
    df = spark.createDataFrame(rows, "s boolean, cell_id long, embedding array<double>")
    got = {(r.s, r.src, r["rank"]): r.dst for r in nb.nearest_in_embedding(df, ["s"], 3).collect()}
    want = {}
    for k, i, v in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for q, j, w in rows if q is k and j != i)[:3]
        want.update({(k, i, r + 1): j for r, (_, j) in enumerate(near)})
    assert got == want


@pytest.mark.parametrize("cap", [16, 1024])
def test_pairs_within_a_distance_stay_in_their_blocks(spark, plane, cap):
    """Blocks hold every pair once; the forest and the label counts are those of the pairs, and no row is a pair."""
    from cellweave.operators import graph as gr
    from cellweave.operators import permutations as pm

    pdf = pd.concat([plane.assign(t=[f"t{i % 3}" for i in range(len(plane))]), pd.DataFrame({"s": [None, "A"], "cell_id": [900, 901], "x": [1.0, None], "y": [1.0, 2.0], "t": ["t0", "t1"]})])
    df = spark.createDataFrame(pdf, "s string, cell_id long, x double, y double, t string")
    pairs = nb.within_distance(df, ["s"], 5.0)
    near = nb.PairsWithin(df, ["s"], 5.0)
    held = [(r.s, a.id, b.id) for r in nb.near_blocks(near.rows(), ["s"], 5.0, cap=cap).collect() for i, a in enumerate(r.one) for b in (r.one[i + 1 :] if r.same else r.two)]
    assert len(held) == len({(s, min(a, b), max(a, b)) for s, a, b in held})
    want = {(r.s, min(r.src, r.dst), max(r.src, r.dst)) for r in pairs.collect()}
    assert want <= {(s, min(a, b), max(a, b)) for s, a, b in held}
    some = nb.forest_pairs(near, cap)
    forest = sorted(map(tuple, gr.spanning_forest(pairs, ["s"]).collect()))
    assert sorted(map(tuple, gr.spanning_forest(some, ["s"]).collect())) == forest
    assert some.count() < len(want) / 3
    if cap == 1024:
        p = pm.permuted_codes(df, ["s"], "cell_id", "t", 5, 42)
        counts = lambda d: sorted(map(tuple, d.collect()))
        assert counts(pm.pair_counts_within(near, p)) == counts(pm.pair_counts(pairs, p, ["s"]))
        pm.DENSE_LABELS, before = 1, pm.DENSE_LABELS
        try:
            assert counts(pm.pair_counts_within(near, p)) == counts(pm.pair_counts(pairs, p, ["s"]))
        finally:
            pm.DENSE_LABELS = before


def test_embedding_leaves_a_row_for_each_row_however_many_blocks_meet(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"s": "A", "cell_id": np.arange(240), "embedding": list(rng.normal(size=(240, 12)))})
    seen, across = [], nb._across_blocks
    monkeypatch.setattr(nb, "_across_blocks", lambda local, pairs, *a: seen.append((pairs.count(), across(local, pairs, *a, 3))) or seen[-1][1])
    same(nb.nearest_in_embedding(spark.createDataFrame(pdf), ["s"], 5, n_pivots=8, cap=20), brute(pdf, 5, "embedding"))
    met, rows = seen[0]
    assert met > 100 and rows.count() <= len(pdf)


def test_tiles_are_searched_some_at_a_time(spark):
    """A batch of many tiles leaves as many small ones, ties by id; what a task holds does not follow the size of the batch."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    tiles = [[{"x": float(a), "y": float(b), "ids": [f"{t}-{i}", f"{t}-{i}b"]} for i, (a, b) in enumerate(rng.integers(0, 4, (5, 2)) + [[0, 0.1 * i] for i in range(5)])] for t in range(300)]
    batch = pa.RecordBatch.from_pydict({"tile": [{"n": t} for t in range(300)], "pts": tiles})
    search, _ = nb._tile_search(3, "string", "struct<n:bigint>")
    out = list(search(iter([batch.slice(3)])))
    assert max(b.num_rows for b in out) <= 64 * 5 and sum(b.num_rows for b in out) == 297 * 5
    for r in pa.Table.from_batches(out).to_pylist():
        far = sorted((float(np.sqrt((p["x"] - r["x"]) ** 2 + (p["y"] - r["y"]) ** 2)), v) for p in tiles[r["tile"]["n"]] for v in p["ids"])[:3]
        assert [e["id"] for e in r["near"]] == [v for _, v in far]
        assert np.allclose([e["d"] for e in r["near"]], [d for d, _ in far])


@pytest.mark.parametrize("cap", [8, 1024])
def test_counts_within_a_distance_form_no_pairs(spark, plane, cap):
    pdf = pd.concat([plane, plane.head(90).assign(cell_id=plane.cell_id.head(90) + 1000)])
    got = nb.count_within(spark.createDataFrame(pdf), ["s"], 5.0, cap=cap)
    want = {a.cell_id: sum((g.x - a.x) ** 2 + (g.y - a.y) ** 2 <= 25) for _, g in pdf.groupby("s") for a in g.itertuples()}
    assert {r.cell_id: r.n_within for r in got.collect()} == want


def test_permutations_follow_the_hashes_and_are_cut_by_range(spark, monkeypatch):
    """Labels move as the order of the hashes says, over ranges, blocks and groups; what is shuffled is not a row for each cell."""
    import hashlib

    from cellweave.operators import permutations as pm

    monkeypatch.setattr(pm, "RANGE", 16)
    rows = [("AB"[i % 3 > 1], i, f"t{i * i % 5}") for i in range(150)]
    df = spark.createDataFrame(rows, "s string, cell_id long, t string").repartition(3)
    seen, spread = [], pm.spread
    monkeypatch.setattr(pm, "spread", lambda d, keys: seen.append(d.count()) or spread(d, keys))
    p = pm.permuted_codes(df, ["s"], "cell_id", "t", 7, 42)
    names = {r.g: r.s for r in p.groups.collect()}
    got = {(names[r.g], r.id): [p.labels[x] for x in r.codes] for r in p.rows.collect()}
    for s in "AB":
        cells = [r for r in rows if r[0] == s]
        for perm in range(1, 8):
            moved = sorted(cells, key=lambda r: hashlib.md5(f"42|{perm}|{r[1]}".encode()).digest())
            assert [got[s, r[1]][perm] for r in cells] == [m[2] for m in moved]
        assert [got[s, r[1]][0] for r in cells] == [r[2] for r in cells]
    assert seen[0] < 150 * 7
