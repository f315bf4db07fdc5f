"""Trend selection, neighbour information, keyed components, and folds against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.operators import folds as fo
from cellweave.operators import keyed_pca as kp
from cellweave.operators import trends as tr


def direct_trend(x, y, v, span):
    d = np.abs(x - v)
    h = np.sort(d)[int(np.ceil(span * len(x))) - 1]
    w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
    a = np.vander((x - v) / h, 3, increasing=True)
    return np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ y)[0]


def test_local_regression_is_the_direct_one():
    rng = np.random.default_rng(0)
    x = np.sort(np.round(rng.normal(size=300), 2))  # ties
    y = np.sin(x) + 0.1 * rng.normal(size=300)
    at = np.concatenate([x, [-5.0, 5.0, 0.123]])
    got = tr.local_quadratic(x, y, at, 0.3)
    assert got == pytest.approx([direct_trend(x, y, v, 0.3) for v in at], abs=1e-9)
    assert tr.local_quadratic(x, 2 - 3 * x + x * x, at, 0.2) == pytest.approx(2 - 3 * at + at * at, abs=1e-9)
    assert tr.local_quadratic(np.zeros(5), np.arange(5.0), np.zeros(1), 0.3)[0] == pytest.approx(2.0)
    assert tr.local_quadratic(np.array([1.0]), np.array([4.0]), np.array([1.0]), 0.3)[0] == pytest.approx(4.0)


def test_genes_against_the_trend(spark):
    rng, cells, genes = np.random.default_rng(1), 400, 120
    m = rng.poisson(np.exp(rng.normal(0, 1.2, genes))[None, :] * rng.gamma(2.0, 0.5, (cells, genes)))
    m[:, 0], m[7, 1] = 0, 4000  # a gene that is never seen, and one with a single outlier
    rows = [(i, f"g{j:03}", float(v)) for (i, j), v in np.ndenumerate(m) if v]
    df = spark.createDataFrame(rows, "cell_id long, gene string, count double").repartition(6)
    got = {r.gene: r for r in tr.variable_genes_by_trend(df, spark.createDataFrame([(cells,)], "n_cells long"), 30).collect()}
    mean, var = m.mean(0), m.var(0, ddof=1)
    ok = var > 0
    x, y = np.log10(mean[ok]), np.log10(var[ok])
    trend = np.array([direct_trend(x, y, v, 0.3) for v in x])
    sd = np.sqrt(10**trend)
    z = np.minimum(m[:, ok], mean[ok] + np.sqrt(cells) * sd)
    norm = ((z - mean[ok]) ** 2).sum(0) / ((cells - 1) * sd**2)
    names = [f"g{j:03}" for j in np.flatnonzero(ok)]
    assert set(got) == set(names)
    assert [got[n].trend for n in names] == pytest.approx(trend.tolist(), abs=1e-9)
    assert [got[n].variance_norm for n in names] == pytest.approx(norm.tolist(), rel=1e-9)
    assert {n for n in names if got[n].highly_variable} == {names[i] for i in np.argsort(-norm)[:30]}


def digamma(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, n))


def test_digamma(spark):
    rows = spark.range(1, 3000).select("id", tr.digamma(F.col("id")).alias("d")).collect()
    assert all(abs(r.d - digamma(r.id)) < 1e-11 for r in rows)


def ross(values, labels, k):
    keep = [i for i in range(len(values)) if labels.count(labels[i]) > 1]
    terms = []
    for i in keep:
        same = sorted(abs(values[j] - values[i]) for j in keep if j != i and labels[j] == labels[i])
        kk = min(k, len(same))
        d = same[kk - 1]
        m = sum(abs(values[j] - values[i]) < d or d == 0 and values[j] == values[i] for j in keep)
        terms.append(digamma(kk) - digamma(len(same) + 1) - digamma(max(m, 1)))
    return max(0.0, digamma(len(keep)) + sum(terms) / len(keep))


def test_neighbour_information_at_borders_and_ties(spark):
    rng, n = np.random.default_rng(3), 160
    labels = [str(v) for v in rng.integers(0, 3, n)] + ["alone"]
    kinds = {
        "continuous": rng.normal(size=n + 1) + 5 + np.array([len(v) == 1 and v == "2" for v in labels]) * 2,
        "integers": rng.integers(0, 5, n + 1).astype(float), "zeros": rng.integers(0, 40, n + 1) * (rng.random(n + 1) < 0.1).astype(float),
        "constant": np.full(n + 1, 2.0), "halves": rng.integers(0, 60, n + 1) / 2,
    }
    rows = [(i, g, float(v)) for g, vs in kinds.items() for i, v in enumerate(vs) if v > 0]
    df = spark.createDataFrame(rows, "cell_id long, gene string, lognorm double").repartition(5)
    cells = spark.createDataFrame(list(enumerate(labels)), "cell_id long, cell_type string")
    for k in (1, 3):
        got = {r.gene: r.mutual_information for r in tr.neighbour_information(df, cells, "cell_type", k).collect()}
        assert got == pytest.approx({g: ross([float(v) for v in vs], labels, k) for g, vs in kinds.items()}, abs=1e-9)
    assert got["continuous"] > 0.05


def test_components_of_every_group_equal_separate_fits(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)), "b": rng.normal(size=(40, 6)), None: rng.normal(size=(30, 6)) + 3, "one": np.ones((1, 6)), "two": np.array([[0.0] * 6, [1.0] * 6])}
    rows = [(g, i, v.tolist()) for g, m in groups.items() for i, v in enumerate(m)] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "s string, cell_id long, vec array<double>").repartition(7)
    scores, variance, loadings = kp.pca_by_group(df, ["s"], k=4)
    got = {(r.s, r.cell_id): r.pcs for r in scores.collect()}
    values = {}
    for r in variance.orderBy("pc").collect():
        values.setdefault(r.s, []).append(r)
    for g, m in groups.items():
        x = m - m.mean(0)
        w, v = np.linalg.eigh(x.T @ x / len(m))
        keep = max(0, min(4, len(m) - 1))
        w, v = w[::-1][:keep], v[:, ::-1][:, :keep]
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(keep)] < 0, -1, 1)
        assert [r.eigenvalue for r in values.get(g, [])] == pytest.approx(w.tolist(), abs=1e-9)
        assert [r.cumulative for r in values.get(g, [])] == pytest.approx((np.cumsum(w) / max(np.trace(x.T @ x / len(m)), 1e-300)).tolist(), abs=1e-9)
        if g != "two" and keep:
            assert np.array([got[g, i] for i in range(len(m))]) == pytest.approx(x @ v, abs=1e-8)
    fits = kp.eigen_by_group(kp.group_covariances(df, ["s"]), ["s"], 6)
    assert all(r.residual < 1e-12 and r.overlap < 1e-12 for r in kp.eigen_check(fits, ["s"]).collect())


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(26, 4))
    y = (2 * x[:, 0] + 0.5 * x[:, 1] + 0.6 * rng.normal(size=26) > 0).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(e=1.5, s=[f"s{i:02}" for i in range(26)], label=np.where(y == 1, "R", "NR"))
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_linear_fits_of_all_folds_are_minima(spark, samples):
    pdf, df = samples
    cols = list("abcde")
    data = fo.fold_rows(df, "s", cols, "label", "R", "s")
    x, y = pdf[cols].to_numpy(), (pdf["label"] == "R").to_numpy().astype(float)
    for kind, l1, l2 in (*fo.LINEAR.values(), ("logistic", 0.2, 0.1)):
        beta, step = fo.linear_folds(data, 5, kind, l1, l2)
        assert beta.shape == (27, 6) and step.max() < 1e-8
        got = {r.id: r.score for r in fo.linear_predictions(data, 5, beta, kind).collect()}
        for f in [*range(26), None]:
            keep = np.arange(26) != f
            mu, sd = x[keep].mean(0), x[keep].std(0)
            sd[4] = np.inf
            z = np.column_stack([np.ones(keep.sum()), (x[keep] - mu) / sd])
            b = beta[26 if f is None else f]
            _, g, _ = fo._curvature(kind, y[keep], z @ b)
            grad = z.T @ g / keep.sum() + np.concatenate([[0], l2 * b[1:]])
            assert abs(grad[0]) < 1e-6
            for j in range(1, 6):  # the penalty's corner at 0 allows any slope up to l1
                assert abs(grad[j] + l1 * np.sign(b[j])) < 1e-6 if b[j] else abs(grad[j]) <= l1 + 1e-6
            if f is not None:
                assert got[f"s{f:02}"] == pytest.approx(float(b[0] + ((x[f] - mu) / sd) @ b[1:]), abs=1e-8)


def test_forest_of_every_fold_has_not_seen_it(spark, samples):
    pdf, df = samples
    data = fo.fold_rows(df, "s", list("abcde"), "label", "R", "s")
    scored, share = fo.forest_folds(data, 5, trees=60)
    rows = scored.collect()
    assert len(rows) == 26 and all(0 <= r.score <= 1 for r in rows)
    assert share.shape == (26, 5) and share[:, 4].max() == 0 and share.mean(0).argmax() == 0
    assert share.sum(1) == pytest.approx(np.ones(26), abs=0.2)  # a tree without a split has no shares
    assert np.mean([r.score for r in rows if r.y]) > np.mean([r.score for r in rows if not r.y]) + 0.15
    # a fold's forest is that of the table without the fold's rows: grown alone, it gives the same score
    pick = 5
    alone = pdf.assign(fold=np.where(np.arange(26) == pick, "out", "in"))
    again, _ = fo.forest_folds(fo.fold_rows(spark.createDataFrame(alone), "s", list("abcde"), "label", "R", "fold"), 5, trees=60)
    mine = {r.id: r.score for r in again.collect()}
    assert mine[f"s{pick:02}"] == pytest.approx({r.id: r.score for r in rows}[f"s{pick:02}"], abs=1e-12)


def test_models_and_importances(spark, samples):
    pdf, df = samples
    out, importance = fo.folded_models(fo.fold_rows(df, "s", list("abcde"), "label", "R", "s"), list("abcde"), trees=20)
    assert {(r.model, r.n) for r in out.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()} == {(m, 26) for m in ("elastic_net", "logistic", "linear_svm", "random_forest")}
    rows = importance.collect()
    assert len(rows) == 20 and not math.isnan(sum(r.importance for r in rows))
    assert {r.model for r in rows if r.feature == "a" and r.selected} == {r.model for r in rows}
