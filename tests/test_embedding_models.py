"""Decompositions, batch correction and models against numpy on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.operators import classify as cl
from cellweave.operators import embedding as em
from cellweave.operators import neighbors as nb


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame(pd.DataFrame({"cell_id": range(80), "vec": list(x)}))
    scores, variance, loadings = em.pca(df, k=3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert [r["ratio"] for r in variance.orderBy("pc").collect()] == pytest.approx((s**2 / (s**2).sum())[:3])
    got = np.array([r["pcs"] for r in scores.orderBy("cell_id").collect()])
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :3]), atol=1e-8)
    assert loadings.count() == 15


def test_weights_of_both_modes_are_opposite(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"cell_id": range(50), "r": list(rng.normal(size=(50, 3)) * 3), "p": list(rng.normal(size=(50, 2)))}))
    a = em.weighted_modalities(df, "r", "p", "inverse").first()
    b = em.weighted_modalities(df, "r", "p", "direct").first()
    assert a["rna_weight"] == pytest.approx(b["protein_weight"], abs=1e-9) and a["rna_weight"] < 0.5 and len(a["wnn"]) == 5


def test_batch_offset_is_removed(spark):
    rng = np.random.default_rng(9)
    n = 240
    batch = np.arange(n) % 2
    kind = (np.arange(n) // 2) % 2
    z = rng.normal(size=(n, 3)) * 0.3 + kind[:, None] * np.array([6, 0, 0]) + batch[:, None] * np.array([0, 2.0, 0]) + np.array([1, 1, 3])
    df = spark.createDataFrame(pd.DataFrame({"cell_id": range(n), "b": batch.astype(str), "z": list(z)}))
    out = em.corrected_for_batch(df, "cell_id", "z", "b", n_clusters=4, rounds=4).orderBy("cell_id").collect()
    after = np.array([r["corrected"] for r in out])
    gap = lambda m: np.abs(m[batch == 0].mean(0) - m[batch == 1].mean(0))[1]
    assert gap(after) < 0.25 * gap(z)
    assert np.abs(after[kind == 0].mean(0) - after[kind == 1].mean(0))[0] > 4
    lisi = [em.lisi(nb.nearest_in_embedding(spark.createDataFrame(pd.DataFrame({"cell_id": range(n), "b": batch.astype(str), "v": list(m)})), [], 20, vec="v"), df, "b").agg(F.avg("lisi"), F.min("lisi"), F.max("lisi")).first() for m in (z, after)]
    assert lisi[1][0] > lisi[0][0] and all(1 <= v[1] and v[2] <= 2 for v in lisi)


def test_batch_correction_says_whether_it_settled(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 240
    batch, kind = np.arange(n) % 2, (np.arange(n) // 2) % 2
    z = rng.normal(size=(n, 3)) * 0.3 + kind[:, None] * np.array([6, 0, 0]) + batch[:, None] * np.array([0, 2.0, 0]) + np.array([1, 1, 3])
    df = spark.createDataFrame(pd.DataFrame({"cell_id": range(n), "b": batch.astype(str), "z": list(z)}))
    settled = {k: {r.converged for r in em.corrected_for_batch(df, "cell_id", "z", "b", n_clusters=4, rounds=k).collect()} for k in (2, 20)}
    assert settled == {2: {False}, 20: {True}}
    # the query goes as far as the reference and hands the column on
    from cellweave.plans import catalog, embedding_queries
    from cellweave.plans.tables import Tables

    seen = {}

    def stub(df, id_col, vec, batch, rounds):
        seen["rounds"] = rounds
        return df.withColumn("corrected", F.col(vec)).withColumn("converged", F.lit(True))

    monkeypatch.setattr(embedding_queries.em, "corrected_for_batch", stub)
    rows = spark.range(40).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("label"), F.array(*[F.rand(i) for i in range(12)]).alias("embedding"))
    monkeypatch.setattr(Tables, "read", lambda self, name: rows)
    assert "converged" in catalog.queries()["m7_batch_corrected"](spark, "").columns and seen == {"rounds": 20}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(10)
    n = 24
    y = np.arange(n) % 2
    x = rng.normal(size=(n, 3)) + y[:, None] * np.array([2.0, 0, 0.5])
    pdf = pd.DataFrame(x, columns=["f0", "f1", "f2"]).assign(sample_id=[f"s{i:02d}" for i in range(n)], response=np.where(y == 1, "R", "NR"))
    return spark.createDataFrame(pdf), x, y


def test_lda_downdating_equals_refitting(table):
    df, x, y = table
    d = cl.design(df, "sample_id", ["f0", "f1", "f2"], "response", "R")
    got = {r["id"]: r["score"] for r in cl.lda_leave_one_out(d, 3).collect()}
    for i in range(len(y)):
        m = np.arange(len(y)) != i
        a, b = x[m & (y == 0)], x[m & (y == 1)]
        cov = (np.cov(a.T, ddof=0) * len(a) + np.cov(b.T, ddof=0) * len(b)) / (m.sum() - 2)
        w = np.linalg.solve(cov, b.mean(0) - a.mean(0))
        assert got[f"s{i:02d}"] == pytest.approx(x[i] @ w - w @ (a.mean(0) + b.mean(0)) / 2 + np.log(len(b) / len(a)), rel=1e-6)


def test_pls_downdating_equals_refitting(table):
    df, x, y = table
    d = cl.design(df, "sample_id", ["f0", "f1", "f2"], "response", "R")
    scores = cl.pls_leave_one_out(d, 3, comps=3)
    got = {r["id"]: r["score"] for r in scores.collect()}
    for i in (0, 5, 13):  # with as many components as features this is least squares
        m = np.arange(len(y)) != i
        beta = np.linalg.lstsq(np.column_stack([np.ones(m.sum()), x[m]]), y[m].astype(float), rcond=None)[0]
        assert got[f"s{i:02d}"] == pytest.approx(beta[0] + x[i] @ beta[1:], rel=1e-6)
    vip = cl.pls_importance(d, ["f0", "f1", "f2"], scores).first()
    assert vip["feature"] == "f0"


def test_evaluation_counts(table):
    df, _, y = table
    d = cl.design(df, "sample_id", ["f0", "f1", "f2"], "response", "R")
    r = cl.evaluate(cl.lda_leave_one_out(d, 3).withColumn("model", F.lit("lda"))).first()
    assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == len(y) and 0.5 < r["auc"] <= 1 and r["accuracy"] > 0.6


def test_information_of_a_perfect_split(spark):
    rows = [("g", "R" if i < 10 else "NR", float(i + (100 if i >= 10 else 0))) for i in range(20)] + [("h", "R" if i % 2 else "NR", float(i * i % 17)) for i in range(20)]
    df = spark.createDataFrame(rows, "gene string, response string, value double")
    mi = {r["gene"]: r["mutual_information"] for r in em.mutual_information_units(df, "response", 2).collect()}
    assert mi["g"] > 0.6 and mi["h"] < 0.3


def test_silhouette_takes_every_row(spark):
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(size=(40, 3)), rng.normal(size=(30, 3)) + 4, rng.normal(size=(1, 3)) - 9])
    label = ["a"] * 40 + ["b"] * 30 + ["alone"]
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    want = {}
    for i, own in enumerate(label):
        mean = {g: d[i, [k for k, x in enumerate(label) if x == g]] for g in set(label)}
        a = mean[own].sum() / max(1, len(mean[own]) - 1)
        b = min(m.mean() for g, m in mean.items() if g != own)
        want[i] = (b - a) / max(a, b) if len(mean[own]) > 1 else 0.0
    df = spark.createDataFrame(pd.DataFrame({"cell_id": range(len(v)), "v": list(v), "l": label}))
    got = {r.cell_id: r.silhouette for r in em.silhouette(df, "cell_id", "v", "l").collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_fused_neighbours_against_brute_force(spark):
    rng, n, k = np.random.default_rng(12), 70, 6
    kind = rng.integers(0, 3, n)
    a = (rng.normal(size=(n, 3)) * 0.4 + np.eye(3)[kind] * 3).astype(np.float32).astype(float)
    b = rng.normal(size=(n, 2)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(n)], "cell_id long, rna array<double>, protein array<double>")
    far, near, width, first = {}, {}, {}, {}
    for m, x in (("a", a), ("b", b)):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        order = np.argsort(d + np.diag(np.full(n, np.inf)), axis=1, kind="stable")[:, :k]
        far[m], near[m], first[m] = d, [set(r.tolist()) for r in order], d[np.arange(n), order[:, 0]]
        width[m] = []
        for i in range(n):
            overlap = sorted((len(near[m][i] & near[m][j]) / len(near[m][i] | near[m][j]), j) for j in range(n) if j != i and near[m][i] & near[m][j])
            width[m].append(np.mean([d[i, j] for _, j in overlap[:k]]) if overlap else d[i, order[i, -1]])
    kernel = lambda m, i, v: math.exp(-max(0.0, v - first[m][i]) / max(width[m][i] - first[m][i], 1e-12))
    x = {"a": a, "b": b}
    fit = lambda m, by, i: kernel(m, i, float(np.linalg.norm(x[m][i] - x[m][sorted(near[by][i])].mean(0))))
    weight = []
    for i in range(n):
        ra, rb = fit("a", "a", i) / (fit("a", "b", i) + 1e-4), fit("b", "b", i) / (fit("b", "a", i) + 1e-4)
        weight.append(1 / (1 + math.exp(rb - ra)))
    weights, edges = em.fused_neighbours(df, "cell_id", "rna", "protein", k)
    assert {r.cell_id: r.weight_a for r in weights.collect()} == pytest.approx(dict(enumerate(weight)), abs=1e-6)
    got = {}
    for r in edges.collect():
        got.setdefault(r.src, []).append((-r.similarity, r.dst))
    for i in range(n):
        want = sorted((-(weight[i] * kernel("a", i, far["a"][i, j]) + (1 - weight[i]) * kernel("b", i, far["b"][i, j])), j) for j in near["a"][i] | near["b"][i])[:k]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want] and [s for s, _ in sorted(got[i])] == pytest.approx([s for s, _ in want], abs=1e-6)
    assert np.mean(weight) > 0.55


@pytest.mark.parametrize("text", [False, True])
def test_fused_neighbours_of_all_cells(spark, text):
    """Cells near in both modalities, but in the list of neither, are found; so are copies, in the order of their ids."""
    rng, n, k = np.random.default_rng(5), 150, 3
    a, b = rng.normal(size=(n, 2)), rng.normal(size=(n, 2))
    a[140:], b[140:] = a[3], b[3]
    name = [f"c{i}" if text else i for i in range(n)]
    df = spark.createDataFrame([(name[i], a[i].tolist(), b[i].tolist()) for i in range(n)], f"cell_id {'string' if text else 'long'}, rna array<double>, protein array<double>")
    weights, edges = em.fused_neighbours(df, "cell_id", "rna", "protein", k, every=True)
    w = {r.cell_id: r.weight_a for r in weights.collect()}
    d = {m: np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) for m, x in (("a", a), ("b", b))}
    first = {m: (x + np.diag(np.full(n, np.inf))).min(1) for m, x in d.items()}
    width = {}
    for m, x in (("a", a), ("b", b)):
        v = spark.createDataFrame([(name[i], x[i].tolist()) for i in range(n)], f"id {'string' if text else 'long'}, v array<double>")
        width[m] = {r.id: r.width for r in em.shared_neighbour_width(nb.nearest_in_embedding(v, [], k, "id", "v"), v, k).collect()}
    kernel = lambda m, i, j: math.exp(-max(0.0, d[m][i, j] - first[m][i]) / max(width[m][name[i]] - first[m][i], 1e-12))
    got, missed = {}, 0
    for r in edges.collect():
        got.setdefault(r.src, []).append((-r.similarity, r.dst))
    for i in range(n):
        want = sorted((-round(w[name[i]] * kernel("a", i, j) + (1 - w[name[i]]) * kernel("b", i, j), 9), name[j]) for j in range(n) if j != i)[:k]
        assert sorted((round(s, 9), x) for s, x in got[name[i]]) == want
        lists = {name[j] for m in "ab" for j in np.argsort(d[m][i] + np.where(np.arange(n) == i, np.inf, 0), kind="stable")[:k]}
        missed += any(x not in lists for _, x in want)
    assert missed > 0


def test_fused_neighbours_hold_bounded_rows(spark):
    rng = np.random.default_rng(6)
    cells = spark.createDataFrame([(i, rng.normal(size=2).tolist(), rng.normal(size=2).tolist()) for i in range(60)], "id long, va array<double>, vb array<double>")
    rows = cells.select("*", *[F.lit(x).alias(n) for n, x in (("sa", 1.0), ("sb", 2.0), ("na", 0.1), ("nb", 0.0), ("weight_a", 0.3), ("least", 0.0), ("again", 0.0))])
    one, many = (sorted(map(tuple, em._most_similar(rows, cells, 4, held).collect())) for held in (65_536, 7))
    assert one == many and len(one) == 240
