"""Principal components of every group at once: one pass of mergeable sums, one eigen step for each key.

A group's centred cross products are the packed upper triangle of its covariance, a vector that adds up over tasks and batches.
No task needs a group's rows together, and no driver sees a group; the eigen step is a row of a table, so groups are solved in
parallel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.embedding import MAX_FEATURES
from cellweave.scale import c, materialize, sized


def group_covariances(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """(keys, n, mean, packed): population covariance of each group, rows of the upper triangle one after another.

    Rows without a vector are left out. The mean is taken first, so products are of centred values.
    """
    ks = [c(k) for k in keys]
    rows = df.where(c(vec).isNotNull()).select(*ks, c(vec).cast("array<double>").alias("__v"))
    stats = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n"), vector_to_array(Summarizer.mean(array_to_vector("__v"))).alias("__mean"))
    stats = materialize(stats.withColumn("__g", F.monotonically_increasing_id()))
    wide = stats.agg(F.max(F.size("__mean"))).first()[0] or 0
    if wide > MAX_FEATURES:
        raise ValueError(f"{wide} features; select at most {MAX_FEATURES} first")
    named = stats.select("__g", "__mean", *[c(k).alias(f"__k_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"__k_{k}")) for k in keys])
    held = rows.join(sized(named), on).select(F.col("__g").alias("g"), F.col("__mean").alias("mean"), F.col("__v").alias("v"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, at in pdf.groupby("g", sort=False).indices.items():
                x = np.stack(pdf["v"].to_numpy()[at]) - pdf["mean"].to_numpy()[at[0]]
                out.append((g, (x.T @ x)[np.triu_indices(x.shape[1])]))
            yield pd.DataFrame(out, columns=["g", "s"])

    sums = held.mapInPandas(partial, "g long, s array<double>").groupBy(F.col("g").alias("__g")).agg(Summarizer.sum(array_to_vector("s")).alias("__s"))
    packed = F.transform(vector_to_array("__s"), lambda x: x / F.col("__n")).alias("packed")
    return stats.join(sums, "__g").select(*ks, F.col("__n").alias("n"), F.col("__mean").alias("mean"), packed)


def eigen_by_group(covariances: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, n, mean, value, vectors, trace): the ``k`` largest eigenvalues and their unit vectors, largest entry positive.

    ``k`` is cut to n - 1 and to the number of features.
    """

    @F.pandas_udf("struct<value:array<double>,vectors:array<array<double>>,trace:double>")
    def solve(packed: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for p, rows in zip(packed, n):
            p = np.asarray(p, float)
            d = int((np.sqrt(8 * len(p) + 1) - 1) / 2)
            a = np.zeros((d, d))
            a[np.triu_indices(d)] = p
            a = a + np.triu(a, 1).T
            w, v = np.linalg.eigh(a)
            m = max(0, min(k, d, int(rows) - 1))
            w, v = w[::-1][:m], v[:, ::-1][:, :m]
            v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(m)] < 0, -1.0, 1.0)
            out.append((w.tolist(), v.T.tolist(), float(np.trace(a))))
        return pd.DataFrame(out, columns=["value", "vectors", "trace"])

    solved = covariances.withColumn("e", solve("packed", "n"))
    return materialize(solved.select(*[c(x) for x in keys], "n", "mean", "packed", "e.value", "e.vectors", "e.trace"))


def pca_by_group(df: DataFrame, keys: Sequence[str], vec: str = "vec", k: int = 30, out: str = "pcs") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores (rows with an array column), variance (keys, pc, eigenvalue, ratio, cumulative), loadings (keys, pc, loading array)."""
    keys = list(keys)
    fits = eigen_by_group(group_covariances(df, keys, vec), keys, k)
    named = fits.select(F.col("mean").alias("__mean"), F.col("vectors").alias("__vectors"), *[c(x).alias(f"__k_{x}") for x in keys])
    on = reduce(lambda a, b: a & b, [c(x).eqNullSafe(c(f"__k_{x}")) for x in keys])

    @F.pandas_udf("array<double>")
    def project(v: pd.Series, mean: pd.Series, vectors: pd.Series) -> pd.Series:
        return pd.Series([[float(np.dot(w, np.asarray(x, float) - m)) for w in ws] for x, m, ws in zip(v, mean, vectors)])

    scores = df.where(c(vec).isNotNull()).join(sized(named), on).withColumn(out, project(c(vec).cast("array<double>"), "__mean", "__vectors"))
    scores = scores.select(*[c(x) for x in df.columns], out)
    one = fits.select(*[c(x) for x in keys], "trace", F.posexplode(F.arrays_zip("value", "vectors")).alias("pos", "e"), "value")
    ratio = lambda v: F.when(F.col("trace") > 0, v / F.col("trace")).otherwise(0.0)
    upto = F.aggregate(F.slice("value", 1, F.col("pos") + 1), F.lit(0.0), lambda s, x: s + x)
    pc = (F.col("pos") + 1).alias("pc")
    variance = one.select(*[c(x) for x in keys], pc, F.col("e.value").alias("eigenvalue"), ratio(F.col("e.value")).alias("ratio"), ratio(upto).alias("cumulative"))
    return scores, variance, one.select(*[c(x) for x in keys], pc, F.col("e.vectors").alias("loading"))


def eigen_check(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, trace, square, residual, overlap): how well vectors and values decompose the covariance.

    ``square`` is the sum of squared eigenvalues, ``residual`` the largest entry of C v - lambda v relative to the trace,
    ``overlap`` the largest departure of the vectors from orthonormal.
    """

    @F.pandas_udf("struct<residual:double,overlap:double,square:double>")
    def check(packed: pd.Series, value: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        out = []
        for p, w, v in zip(packed, value, vectors):
            p, w = np.asarray(p, float), np.asarray(w, float)
            d = int((np.sqrt(8 * len(p) + 1) - 1) / 2)
            a = np.zeros((d, d))
            a[np.triu_indices(d)] = p
            a = a + np.triu(a, 1).T
            m = np.array([np.asarray(x, float) for x in v]).reshape(len(w), d).T
            out.append((np.abs(a @ m - m * w).max(initial=0.0) / max(np.trace(a), 1e-300), np.abs(m.T @ m - np.eye(len(w))).max(initial=0.0), float((w**2).sum())))
        return pd.DataFrame(out, columns=["residual", "overlap", "square"])

    done = fits.withColumn("e", check("packed", "value", "vectors"))
    return done.select(*[c(x) for x in keys], "n", F.aggregate("value", F.lit(0.0), lambda s, x: s + x).alias("trace"), "e.square", "e.residual", "e.overlap")
