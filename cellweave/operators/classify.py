"""Sample-level feature tables and two-class models with held-out predictions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.aggregates import composition, diversity, geometry, label_shares, n_rows
from cellweave.operators.embedding import _rows, _tree_sum
from cellweave.operators.statistics import mann_whitney
from cellweave.scale import c, materialize


def sample_features(cells: DataFrame, label: str, labels: Sequence[str], metrics: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """Shares per label, spread and density of positions, diversity, and given metrics, one row per sample."""
    shares = composition(cells, [key], label, labels)
    shares = shares.select(key, *[(c(f"{v}_pct") / 100).alias(f"{v}_prop") for v in labels])
    shape = geometry(cells, [key]).select(key, F.col("x_spread").alias("spatial_spread_x"), F.col("y_spread").alias("spatial_spread_y"), F.col("density").alias("spatial_density"))
    div = diversity(label_shares(cells, [key], label), [key]).select(key, F.col("richness").alias("n_cell_types"), F.col("simpson").alias("simpson_diversity"))
    out = shares.join(shape, key).join(div, key)
    return out if metrics is None else metrics.join(out, key, "left")


def design(df: DataFrame, id_col: str, features: Sequence[str], target: str, positive: str) -> DataFrame:
    """(id, y, x): missing features become 0; ``y`` is 1 for the positive class. Stored once."""
    x = F.array(*[F.coalesce(F.when(~F.isnan(c(f).cast("double")), c(f).cast("double")), F.lit(0.0)) for f in features])
    return materialize(df.select(c(id_col).alias("id"), (c(target) == positive).cast("double").alias("y"), x.alias("x")))


def class_grams(data: DataFrame, d: int) -> np.ndarray:
    """Cross-product matrices of (1, y, x) for both classes, added up over tasks."""
    m = d + 2

    def fn(pdf):
        z = np.column_stack([np.ones(len(pdf)), pdf["y"], _rows(pdf["x"])])
        return np.stack([z[pdf["y"] == v].T @ z[pdf["y"] == v] for v in (0, 1)]).ravel()

    return _tree_sum(data, fn, 2 * m * m).reshape(2, m, m)


def _lda(grams: np.ndarray) -> tuple[np.ndarray, float]:
    """Discriminant direction and offset from the class cross-products (pooled covariance)."""
    n = grams[:, 0, 0]
    means = grams[:, 0, 2:] / n[:, None]
    within = grams[:, 2:, 2:].sum(0) - sum(n[i] * np.outer(means[i], means[i]) for i in (0, 1))
    sd = np.sqrt(np.maximum(np.diag(within) / max(n.sum() - 2, 1), 0))
    inv = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0)
    cov = within / max(n.sum() - 2, 1) * np.outer(inv, inv)
    w = inv * (np.linalg.pinv(cov, rcond=1e-8, hermitian=True) @ (inv * (means[1] - means[0])))
    return w, float(-w @ (means[0] + means[1]) / 2 + np.log(n[1] / n[0]))


def lda_leave_one_out(data: DataFrame, d: int) -> DataFrame:
    """Held-out discriminant score and probability of every row: its own part is subtracted from the totals."""
    total = class_grams(data, d)

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for row, label in zip(_rows(x), y):
            z = np.concatenate([[1.0, label], row])
            g = total.copy()
            g[int(label)] -= np.outer(z, z)
            w, b = _lda(g)
            out.append(float(row @ w + b))
        return pd.Series(out)

    return data.withColumn("score", score("x", "y")).withColumn("probability", 1 / (1 + F.exp(-F.col("score")))).withColumn(
        "prediction", (F.col("score") > 0).cast("double")).drop("x")


def lda_coefficients(data: DataFrame, features: Sequence[str]) -> DataFrame:
    """Coefficients on standardised features, largest first."""
    g = class_grams(data, len(features))
    w, _ = _lda(g)
    tot = g.sum(0)
    sd = np.sqrt(np.maximum(np.diag(tot)[2:] / tot[0, 0] - (tot[0, 2:] / tot[0, 0]) ** 2, 0))
    rows = [(f, float(v * s)) for f, v, s in zip(features, w, sd)]
    out = data.sparkSession.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.abs(F.col("importance")).desc(), "feature")


def _pls(g: np.ndarray, comps: int) -> dict:
    """One-response partial least squares from the cross-products of (1, y, x)."""
    n = g[0, 0]
    mean, my = g[0, 2:] / n, g[0, 1] / n
    cov = (g[2:, 2:] - n * np.outer(mean, mean)) / (n - 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    sy = np.sqrt(max((g[1, 1] - n * my * my) / (n - 1), 1e-300))
    xx = cov / np.outer(sd, sd) * (n - 1)
    xy = (g[2:, 1] - n * mean * my) / sd / sy
    ws, ps, qs, tt = [], [], [], []
    for _ in range(comps):
        norm = np.linalg.norm(xy)
        if norm < 1e-12:
            break
        w = xy / norm
        s = float(w @ xx @ w)
        if s < 1e-12:
            break
        p, q = xx @ w / s, float(xy @ w) / s
        ws.append(w), ps.append(p), qs.append(q), tt.append(s / n)
        xx = xx - s * np.outer(p, p)
        xy = xy - s * p * q
    w, p = np.array(ws).T, np.array(ps).T
    coef = w @ np.linalg.pinv(p.T @ w) @ np.array(qs) if ws else np.zeros(len(mean))
    return {"w": w, "p": p, "tvar": np.array(tt), "coef": coef / sd * sy, "mean": mean, "my": my}


def pls_leave_one_out(data: DataFrame, d: int, comps: int = 2) -> DataFrame:
    """Held-out partial-least-squares score per row, by subtracting the row from the totals."""
    total = class_grams(data, d).sum(0)

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for row, label in zip(_rows(x), y):
            z = np.concatenate([[1.0, label], row])
            m = _pls(total - np.outer(z, z), comps)
            out.append(float((row - m["mean"]) @ m["coef"] + m["my"]))
        return pd.Series(out)

    return data.withColumn("score", score("x", "y")).withColumn("prediction", (F.col("score") > 0.5).cast("double")).drop("x")


def pls_importance(data: DataFrame, features: Sequence[str], scores: DataFrame, comps: int = 2) -> DataFrame:
    """Importance in projection (relative to the spread of the held-out scores) and first loading, largest first."""
    m = _pls(class_grams(data, len(features)).sum(0), comps)
    spread = scores.agg(F.var_pop("score")).first()[0]
    vip = np.sqrt(len(features) * (m["w"] ** 2 @ m["tvar"]) / spread)
    rows = [(f, float(v), float(l)) for f, v, l in zip(features, vip, m["p"][:, 0])]
    return data.sparkSession.createDataFrame(rows, "feature string, vip_ref double, loading_pc1 double").orderBy(F.col("vip_ref").desc(), "feature")


def evaluate(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, area under the curve (by ranks) and the confusion counts."""
    hit = lambda y, p: F.count_if((F.col("y") == y) & (F.col("prediction") == p))
    base = predictions.groupBy(*keys).agg(
        F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("accuracy"), n_rows().alias("n"),
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    arms = predictions.withColumn("arm", F.when(F.col("y") == 1, "pos").otherwise("neg"))
    u = mann_whitney(arms, keys, "arm", "pos", "neg", "score").select(*keys, (F.col("u_stat") / (F.col("n1") * F.col("n2"))).alias("auc"))
    return base.join(u, list(keys), "left")
