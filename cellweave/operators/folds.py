"""Two-class models refitted once for every fold, all folds in the same jobs.

The fold is a key, not a loop: a pass over the rows adds up what the fits of all folds need next, and the fits advance together.
The number of passes depends on the method (Newton steps, tree levels), never on the number of folds, so leaving one row out
costs as many jobs as leaving out a third. The driver holds folds x features x features sums at most (bounded), never rows.

Features are standardised by the rows a fold keeps: totals less the fold's own sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.operators.classify import design
from cellweave.operators.embedding import _rows, _tree_sum
from cellweave.scale import c, materialize

MAX_STATE = 50_000_000  # doubles of sums that the driver adds up in one pass
CHUNK = 2_000_000  # row x fold (x tree) cells looked at together in a task


def fold_rows(df: DataFrame, id_col: str, features: Sequence[str], target: str, positive: str, fold: str) -> DataFrame:
    """(id, fold, y, x): folds numbered from 0 in the order of their values."""
    rows = design(df, id_col, features, target, positive)
    marked = df.select(c(id_col).alias("id"), c(fold).alias("value"))
    numbered = marked.select("value").distinct().withColumn("fold", F.row_number().over(Window.orderBy("value")) - 1)  # folds, not rows
    return materialize(rows.join(marked, "id").join(numbered, "value").select("id", "fold", "y", "x"))


def _sizes(data: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of folds; rows, positives, means and spreads of what each fold keeps."""
    folds = (data.agg(F.max("fold")).first()[0] or 0) + 1
    if folds * (d + 2) * (d + 2) > MAX_STATE:
        raise ValueError(f"{folds} folds of {d} features: more than {MAX_STATE} sums")
    w = 2 * d + 2

    def fn(pdf):
        x, out = _rows(pdf["x"]), np.zeros((folds, w))
        np.add.at(out, pdf["fold"].to_numpy(), np.column_stack([np.ones(len(x)), pdf["y"], x, x * x]))
        return out.ravel()

    own = _tree_sum(data, fn, folds * w).reshape(folds, w)
    kept = own.sum(0) - own
    n = np.maximum(kept[:, 0], 1)
    mean = kept[:, 2 : 2 + d] / n[:, None]
    var = np.maximum(kept[:, 2 + d :] / n[:, None] - mean**2, 0)
    floor = 1e-12 * np.maximum(mean**2, 1e-300)
    sd = np.where(var > floor, np.sqrt(np.where(var > floor, var, 1.0)), np.inf)  # constant features weigh nothing
    return folds, kept[:, 0], kept[:, 1], mean, sd


def _curvature(kind: str, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, its derivative and its second derivative in the score ``s`` of every row (y is 0 or 1)."""
    if kind == "squared_hinge":
        sign = 2 * y - 1
        gap = np.maximum(0.0, 1 - sign * s)
        return gap**2, -2 * sign * gap, 2.0 * (gap > 0)
    p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
    return np.logaddexp(0.0, s) - y * s, p - y, p * (1 - p)


def _descended(beta: np.ndarray, grad: np.ndarray, hess: np.ndarray, l1: float, l2: float, sweeps: int = 200) -> np.ndarray:
    """Minimum of the quadratic model around ``beta`` plus the penalty, by coordinate descent; the intercept (0) is free."""
    h = hess + np.diag(np.full(len(beta), 1e-10))
    out, slope = beta.copy(), grad.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(beta)):
            if h[j, j] <= 1e-9 and j:
                continue
            a = h[j, j] * out[j] - slope[j]
            new = a / h[j, j] if j == 0 else np.sign(a) * max(abs(a) - l1, 0.0) / (h[j, j] + l2)
            step = new - out[j]
            if step:
                slope += h[:, j] * step
                out[j] = new
                most = max(most, abs(step))
        if most < 1e-10:
            break
    return out


def linear_folds(data: DataFrame, d: int, kind: str = "logistic", l1: float = 0.0, l2: float = 0.01, most_steps: int = 50, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (folds + 1) x (intercept, features) on standardised features, and their step at the end.

    Mean loss plus l1 |b| + l2 b^2 / 2. Every pass adds up, for all fits still moving, the gradient and the curvature of the rows
    they keep; a fit takes its (proximal) Newton step, halved while the penalised loss would rise. The last row is the fit on all
    rows. Raises if a fit has not settled in ``most_steps``.
    """
    folds, n, _, mean, sd = _sizes(data, d)
    mean, sd, n = _with_all(data, d, mean, sd, n)
    m = folds + 1
    beta, size = np.zeros((m, d + 1)), (d + 1) * (d + 2) + 1
    best, base, step = np.full(m, np.inf), np.zeros((m, d + 1)), np.zeros((m, d + 1))
    moving = np.ones(m, bool)
    for _ in range(most_steps):
        at = np.flatnonzero(moving)

        def fn(pdf, at=at, beta=beta):
            x, y, fold = _rows(pdf["x"]), pdf["y"].to_numpy(), pdf["fold"].to_numpy()
            out = np.zeros((len(at), size))
            for i, f in enumerate(at):
                keep = fold != f
                z = np.column_stack([np.ones(keep.sum()), (x[keep] - mean[f]) / sd[f]])
                loss, g, h = _curvature(kind, y[keep], z @ beta[f])
                out[i] = np.concatenate([[loss.sum()], z.T @ g, ((z * h[:, None]).T @ z).ravel()])
            return out.ravel()

        sums = _tree_sum(data, fn, len(at) * size).reshape(len(at), size) / n[at][:, None]
        for row, f in zip(sums, at):
            loss = row[0] + l1 * np.abs(beta[f, 1:]).sum() + l2 / 2 * (beta[f, 1:] ** 2).sum()
            if loss > best[f] + 1e-12:  # too far: half the way back
                step[f] /= 2
                beta[f] = base[f] + step[f]
                moving[f] = np.abs(step[f]).max() >= tol
                continue
            grad, hess = row[1 : d + 2], row[d + 2 :].reshape(d + 1, d + 1)
            new = _descended(beta[f], grad, hess, l1, l2)
            best[f], base[f], step[f] = loss, beta[f].copy(), new - beta[f]
            beta[f] = new
            moving[f] = np.abs(step[f]).max() >= tol
        if not moving.any():
            return beta, np.abs(step).max(axis=1)
    raise ArithmeticError(f"{int(moving.sum())} fits did not settle in {most_steps} steps")


def _with_all(data: DataFrame, d: int, mean: np.ndarray, sd: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with one more row, for the fit on all rows."""

    def fn(pdf):
        x = _rows(pdf["x"])
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    t = _tree_sum(data, fn, 2 * d + 1)
    mu = t[1 : d + 1] / max(t[0], 1)
    var = np.maximum(t[d + 1 :] / max(t[0], 1) - mu**2, 0)
    floor = 1e-12 * np.maximum(mu**2, 1e-300)
    s = np.where(var > floor, np.sqrt(np.where(var > floor, var, 1.0)), np.inf)
    return np.vstack([mean, mu]), np.vstack([sd, s]), np.append(n, max(t[0], 1))


def linear_predictions(data: DataFrame, d: int, beta: np.ndarray, kind: str = "logistic") -> DataFrame:
    """(id, y, score, prediction): every row scored by the fit of its own fold, which has not seen it."""
    _, _, _, mean, sd = _sizes(data, d)

    @F.pandas_udf("double")
    def score(x: pd.Series, fold: pd.Series) -> pd.Series:
        f = fold.to_numpy()
        return pd.Series(beta[f, 0] + (((_rows(x) - mean[f]) / sd[f]) * beta[f, 1:]).sum(1))

    return data.withColumn("score", score("x", "fold")).select("id", "y", "score", (F.col("score") > 0).cast("double").alias("prediction"))


# ------------------------------------------------------------------------------------------------------- forests


def _poisson(u: np.ndarray) -> np.ndarray:
    """Bootstrap weights: Poisson with mean 1 from uniform numbers."""
    steps = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 12.0)])))
    return np.searchsorted(steps, u, side="right")


def _uniform(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Uniform numbers fixed by two integers each (a 64-bit mix)."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift in (30, 27):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Forests:
    """Trees of all folds: split feature and threshold bin of every inner node (-1: a leaf), in heap order."""

    def __init__(self, folds: int, trees: int, depth: int, edges: list[np.ndarray], tried: int, seed: int):
        self.folds, self.trees, self.depth, self.edges, self.tried, self.seed = folds, trees, depth, edges, tried, seed
        self.feature = np.full((folds, trees, 2**depth - 1), -1, np.int32)
        self.bin = np.zeros((folds, trees, 2**depth - 1), np.int32)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int32)

    def node_of(self, bins: np.ndarray, folds: np.ndarray, level: int) -> np.ndarray:
        """Node (rows x folds x trees) at ``level`` (0 the root), -1 below a leaf."""
        node = np.zeros((len(bins), len(folds), self.trees), np.int32)
        for _ in range(level):
            f, t = np.arange(len(folds))[None, :, None], np.arange(self.trees)[None, None, :]
            split = self.feature[folds[f], t, np.maximum(node, 0)]
            at = self.bin[folds[f], t, np.maximum(node, 0)]
            value = np.take_along_axis(bins[:, None, :], np.maximum(split, 0).reshape(len(bins), 1, -1), axis=2).reshape(split.shape)
            node = np.where((node >= 0) & (split >= 0), 2 * node + 1 + (value > at), -1)
        return node

    def features_tried(self, tree: np.ndarray, node: np.ndarray, d: int) -> np.ndarray:
        """The features that a node of a tree looks at, by hash; the same in all folds."""
        key = tree.astype(np.int64) * (1 << 20) + node + self.seed
        u = _uniform(np.repeat(key[..., None], d, -1), np.broadcast_to(np.arange(d), (*key.shape, d)))
        return np.argsort(u, axis=-1)[..., : self.tried]


def _counts(data: DataFrame, forest: Forests, level: int, leaves: bool) -> DataFrame:
    """Weighted class counts w0, w1 by (fold, tree, node, feature, bin), or by leaf (feature = bin = -1), of the rows a fold keeps."""
    d = len(forest.edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = max(1, CHUNK // max(1, forest.trees * forest.folds * forest.tried))
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                bins, y = forest.binned(_rows(part["x"])), part["y"].to_numpy()
                weight = _poisson(_uniform(part["h"].to_numpy()[:, None], np.arange(forest.trees)[None, :] + forest.seed))
                node = forest.node_of(bins, np.arange(forest.folds), level)
                own = part["fold"].to_numpy()[:, None, None] == np.arange(forest.folds)[None, :, None]
                i, f, t = np.nonzero((node >= 0) & ~own & (weight[:, None, :] > 0))
                v, w = node[i, f, t], weight[i, t]
                if leaves:
                    key = {"fold": f, "tree": t, "node": v, "feature": np.full(len(v), -1), "bin": np.full(len(v), -1)}
                    ii, ww = i, w
                else:
                    tried = forest.features_tried(t, v, d)
                    ii, ww = np.repeat(i, forest.tried), np.repeat(w, forest.tried)
                    j = tried.ravel()
                    key = {"fold": np.repeat(f, forest.tried), "tree": np.repeat(t, forest.tried), "node": np.repeat(v, forest.tried), "feature": j, "bin": bins[ii, j]}
                out = pd.DataFrame({k: a.astype(np.int32) for k, a in key.items()})
                out["w0"], out["w1"] = ww * (y[ii] == 0), ww * (y[ii] == 1)
                yield out.groupby(list(key), as_index=False, sort=False).sum().astype({"w0": "float64", "w1": "float64"})

    schema = "fold int, tree int, node int, feature int, bin int, w0 double, w1 double"
    keys = ["fold", "tree", "node", "feature", "bin"]
    return data.withColumn("h", F.xxhash64("id")).mapInPandas(run, schema).groupBy(*keys).agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))


def _best_splits(counts: DataFrame) -> DataFrame:
    """(fold, tree, node, feature, bin, fall): the split of the largest fall of weighted Gini impurity, where there is one."""
    node = ["fold", "tree", "node"]
    along = Window.partitionBy(*node, "feature").orderBy("bin")  # bins of a feature
    total = Window.partitionBy(*node, "feature")
    t = counts.select("*", F.sum("w0").over(along).alias("l0"), F.sum("w1").over(along).alias("l1"), F.sum("w0").over(total).alias("a0"), F.sum("w1").over(total).alias("a1"))
    gini = lambda p, q: F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)  # noqa: E731  weight times impurity
    r0, r1 = F.col("a0") - F.col("l0"), F.col("a1") - F.col("l1")
    fall = gini(F.col("a0"), F.col("a1")) - gini(F.col("l0"), F.col("l1")) - gini(r0, r1)
    some = t.where((F.col("l0") + F.col("l1") > 0) & (r0 + r1 > 0)).withColumn("fall", F.round(fall, 9)).where("fall > 0")
    best = some.groupBy(*node).agg(F.max(F.struct("fall", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("s"))
    return best.select(*node, (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.fall")


def forest_folds(data: DataFrame, d: int, trees: int = 100, depth: int = 3, bins: int = 32, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """Held-out predictions (id, y, score, prediction) of a forest for every fold, and the importances (folds x features).

    All trees of all folds grow level by level: a pass counts the classes by (fold, tree, node, feature, bin), Spark finds every
    node's best split, and only splits come to the driver. Bins are cut at quantiles of the whole table; a bootstrap weight is
    fixed by tree and row, the features a node tries by tree and node, so folds differ by the rows they leave out alone.
    """
    folds = (data.agg(F.max("fold")).first()[0] or 0) + 1
    if folds * trees * 2**depth > MAX_STATE // 4:
        raise ValueError(f"{folds} folds of {trees} trees: too many splits for the driver")
    qs = data.select(*[F.percentile_approx(F.col("x")[j], [i / bins for i in range(1, bins)], 10_000).alias(str(j)) for j in range(d)]).first()
    edges = [np.unique(np.array(q or [], float)) for q in qs]
    forest = Forests(folds, trees, depth, edges, max(1, int(np.sqrt(d))), seed)
    fallen = np.zeros((folds, trees, d))
    for level in range(depth):
        for r in _best_splits(_counts(data, forest, level, False)).toLocalIterator(prefetchPartitions=True):
            forest.feature[r["fold"], r["tree"], r["node"]], forest.bin[r["fold"], r["tree"], r["node"]] = r["feature"], r["bin"]
            fallen[r["fold"], r["tree"], r["feature"]] += r["fall"]
    share = np.full((folds, trees, 2 ** (depth + 1) - 1), np.nan)
    for level in range(depth + 1):
        rows = _counts(data, forest, level, True).toArrow()
        f, t, v, w0, w1 = (rows.column(k).to_numpy() for k in ("fold", "tree", "node", "w0", "w1"))
        share[f, t, v] = w1 / (w0 + w1)

    @F.pandas_udf("double")
    def score(x: pd.Series, fold: pd.Series) -> pd.Series:
        bins_, f = forest.binned(_rows(x)), fold.to_numpy()
        t, out = np.arange(trees), np.zeros(len(f))
        for i in range(len(f)):
            node = np.zeros(trees, np.int32)
            p = share[f[i], t, node]
            for _ in range(depth):
                split = np.where(node < 2**depth - 1, forest.feature[f[i], t, np.minimum(node, 2**depth - 2)], -1)
                go = split >= 0
                node = np.where(go, 2 * node + 1 + (bins_[i, np.maximum(split, 0)] > forest.bin[f[i], t, np.minimum(node, 2**depth - 2)]), node)
                p = np.where(go & ~np.isnan(share[f[i], t, node]), share[f[i], t, node], p)
            out[i] = np.nanmean(p) if not np.isnan(p).all() else 0.5
        return pd.Series(out)

    scored = data.withColumn("score", score("x", "fold")).select("id", "y", "score", (F.col("score") > 0.5).cast("double").alias("prediction"))
    each = fallen / np.maximum(fallen.sum(2, keepdims=True), 1e-300)
    return scored, each.mean(1)


# ----------------------------------------------------------------------------------------------------- all models

#: Penalties of the linear models: (loss, l1, l2).
LINEAR = {"elastic_net": ("logistic", 0.05, 0.05), "logistic": ("logistic", 0.0, 0.01), "linear_svm": ("squared_hinge", 0.0, 0.01)}


def folded_models(data: DataFrame, features: Sequence[str], trees: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(model, id, y, score, prediction) by the fit that left the row's fold out, and (model, feature, importance, spread, selected).

    Importance is the mean over folds of a tree's share of the fall in impurity, or the coefficient of the fit on all rows;
    ``spread`` is the deviation over folds, ``selected`` a size above 0.01.
    """
    d, parts, rows = len(features), [], []
    for name, (kind, l1, l2) in LINEAR.items():
        beta, _ = linear_folds(data, d, kind, l1, l2)
        parts.append(linear_predictions(data, d, beta, kind).select(F.lit(name).alias("model"), "id", "y", "score", "prediction"))
        rows += [(name, f, float(b), float(s)) for f, b, s in zip(features, beta[-1, 1:], beta[:-1, 1:].std(0))]
    scored, share = forest_folds(data, d, trees, seed=seed)
    parts.append(scored.select(F.lit("random_forest").alias("model"), "id", "y", "score", "prediction"))
    rows += [("random_forest", f, float(v), float(s)) for f, v, s in zip(features, share.mean(0), share.std(0))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    table = data.sparkSession.createDataFrame(rows, "model string, feature string, importance double, spread double")
    return out, table.withColumn("selected", F.abs("importance") > 0.01)
