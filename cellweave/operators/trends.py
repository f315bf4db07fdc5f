"""Selection of features against a trend over the panel, and information between values and labels of all cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.aggregates import n_rows
from cellweave.operators.statistics import two_group_moments, welch_columns, with_t_p
from cellweave.scale import attach, c, materialize, row_numbers, running_totals, sized

MAX_PANEL = 200_000  # features: their means and variances go to every task


def local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float) -> np.ndarray:
    """Locally weighted quadratic regression of y on the sorted x, at each point of ``at``.

    A point looks at the ``span`` share of the panel that is nearest: in sorted order a window, found by bisection. Weights are
    tricube in the distance over the window's reach; points at the reach weigh nothing. Where too few distinct values weigh
    something, the degree falls, down to the mean.
    """
    n = len(x)
    q = max(1, min(n, int(np.ceil(span * n))))
    out = np.empty(len(at))
    for i, v in enumerate(at):
        low, high = max(0, np.searchsorted(x, v) - q), n - q
        high = min(high, np.searchsorted(x, v, "right"))
        while low < high:  # the window whose ends are equally far
            mid = (low + high) // 2
            if v - x[mid] > x[mid + q] - v:
                low = mid + 1
            else:
                high = mid
        d = x[low : low + q] - v
        reach = np.abs(d).max()
        first, last = np.searchsorted(x, v - reach), np.searchsorted(x, v + reach, "right")  # ties at the reach weigh 0
        d, z = x[first:last] - v, y[first:last]
        w = np.clip(1 - np.abs(d / reach) ** 3, 0, None) ** 3 if reach > 0 else np.ones(len(d))
        degree = min(2, len(np.unique(d[w > 0])) - 1)
        s = reach if reach > 0 else 1.0
        basis = np.vander(d / s, degree + 1, increasing=True) * np.sqrt(w)[:, None]
        out[i] = np.linalg.lstsq(basis, z * np.sqrt(w), rcond=1e-12)[0][0]
    return out


def variable_genes_by_trend(counts: DataFrame, n_cells: DataFrame, n: int = 2000, span: float = 0.3, value: str = "count") -> DataFrame:
    """Genes by the variance of counts standardised by a trend (Stuart et al., 2019): (gene, mean, variance, trend, variance_norm, highly_variable).

    The trend is a local quadratic regression of log10 variance on log10 mean over the panel. Counts are clipped at the mean
    plus sqrt(cells) expected deviations, so that a few cells do not make a gene variable. Zeros are not stored: they enter all
    sums analytically. Genes without variance have no trend, norm 0.
    """
    x, cells = c(value).cast("double"), F.col("n_cells")
    sums = counts.groupBy("gene").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss")).withColumn("__all", F.lit(0))
    m = attach(sums, n_cells.withColumn("__all", F.lit(0)), ["__all"]).drop("__all")
    m = m.withColumn("mean", F.col("s") / cells).withColumn("variance", (F.col("ss") - F.col("s") * F.col("s") / cells) / (cells - 1))
    m = materialize(m.select("gene", "n_cells", "mean", "variance"))
    varied = (F.col("variance") > 0) & (F.col("mean") > 0)
    panel = m.where(varied).select(F.log10("mean").alias("x"), F.log10("variance").alias("y")).limit(MAX_PANEL + 1).toPandas()
    if len(panel) > MAX_PANEL:
        raise ValueError(f"more than {MAX_PANEL} features")
    panel = panel.sort_values(["x", "y"])
    xs, ys = panel["x"].to_numpy(), panel["y"].to_numpy()

    @F.pandas_udf("double")
    def trend(v: pd.Series) -> pd.Series:
        return pd.Series(local_quadratic(xs, ys, v.to_numpy(), span))

    fitted = materialize(m.where(varied).repartition("gene").withColumn("trend", trend(F.log10("mean"))))
    deviation = F.sqrt(F.pow(F.lit(10.0), F.col("trend")))
    most = F.sqrt(cells) * deviation + F.col("mean")
    clipped = F.least(x, F.col("most"))
    t = attach(counts.select("gene", c(value)), fitted.select("gene", most.alias("most")), ["gene"], "inner")
    again = t.groupBy("gene").agg(F.sum(clipped).alias("s"), F.sum(clipped * clipped).alias("ss"))
    norm = (cells * F.col("mean") * F.col("mean") + F.col("ss") - 2 * F.col("mean") * F.col("s")) / ((cells - 1) * deviation * deviation)
    normed = fitted.join(again, "gene").select("gene", "trend", norm.alias("variance_norm"))
    ranked = m.join(normed, "gene", "left").withColumn("variance_norm", F.coalesce("variance_norm", F.lit(0.0)))
    ranked = row_numbers(ranked.withColumn("falling", -F.col("variance_norm")), [], ["falling", "gene"], "place")
    return ranked.select("gene", "mean", "variance", "trend", "variance_norm", (F.col("place") <= n).alias("highly_variable"))


# ------------------------------------------------------------------------------------------------- information


def digamma(n: Column) -> Column:
    """The digamma function of a positive integer column: a shift by eight and the asymptotic series."""
    n = n.cast("double")
    z, shift = n + 8.0, sum((1.0 / (n + float(i)) for i in range(8)), F.lit(0.0))
    r = 1.0 / (z * z)
    return F.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - shift


def neighbour_information(values: DataFrame, cells: DataFrame, label: str, k: int = 3, id_col: str = "cell_id", value: str = "lognorm") -> DataFrame:
    """Information (nats) between a gene's value and the label over all cells, by nearest neighbours (Ross, 2014): (gene, mutual_information).

    Every cell's radius is the distance to its k-th nearest cell of the same label; the estimate compares how many cells of any
    label lie within it. Equal values are one row with a count, zeros, which are not stored, among them. In one dimension the
    k-th neighbour lies at most k distinct values away, so a row meets the k ranks to both sides (the halo of its range) by an
    equi-join; counts within a radius are differences of running totals over values and radii together. Ranks and totals are
    cut by range: no gene and no label is one task. A cell that is alone in its label takes no part.
    """
    tagged = values.where(c(value) > 0).select(c(id_col), "gene", c(value).cast("double").alias("v")).join(cells.select(c(id_col), c(label).alias("l")), id_col)
    stored = tagged.groupBy("gene", "l", "v").agg(n_rows().alias("m"))
    sizes = cells.groupBy(c(label).alias("l")).agg(n_rows().alias("nl")).where("nl > 1")
    genes = values.select("gene").distinct().withColumn("__all", F.lit(0))
    grid = genes.join(sizes.withColumn("__all", F.lit(0)), "__all").drop("__all")  # genes x labels
    held = materialize(stored)
    zero = grid.join(held.groupBy("gene", "l").agg(F.sum("m").alias("nz")), ["gene", "l"], "left").select("gene", "l", F.lit(0.0).alias("v"), (F.col("nl") - F.coalesce("nz", F.lit(0))).alias("m"))
    points = materialize(held.join(sized(sizes.select("l")), "l", "left_semi").select("gene", "l", "v", "m").unionByName(zero.where("m > 0")))
    ranked = materialize(row_numbers(points, ["gene", "l"], ["v"], "rn"))
    asked = ranked.select("gene", "l", F.col("v").alias("at"), F.col("m").alias("own"), F.explode(F.sequence(F.col("rn") - k, F.col("rn") + k)).alias("rn"))
    near = asked.join(ranked, ["gene", "l", "rn"]).groupBy("gene", "l", "at", "own").agg(F.array_sort(F.collect_list(F.struct(F.abs(F.col("v") - F.col("at")).alias("d"), "v", "m"))).alias("ns"))
    near = attach(near, sizes, ["l"]).withColumn("kk", F.least(F.lit(k).cast("long"), F.col("nl") - 1))
    # the row itself comes first, at distance 0, with its copies less one
    step = lambda s, e: F.struct((s["seen"] + e["m"]).alias("seen"), F.when(s["k"].isNull() & (s["seen"] + e["m"] >= F.col("kk")), F.struct(e["d"].alias("d"), e["v"].alias("v"))).otherwise(s["k"]).alias("k"))
    nothing = F.struct(F.lit(-1).cast("long").alias("seen"), F.lit(None).cast("struct<d:double,v:double>").alias("k"))
    radii = materialize(near.withColumn("k", F.aggregate("ns", nothing, step)["k"]).select("gene", "l", "at", "own", "kk", "nl", "k.d", F.col("k.v").alias("edge")))
    every = points.groupBy("gene", "v").agg(F.sum("m").alias("m"))
    # values nearer than d, or equal where d is 0: kind 0 counts before, kind 2 after the values at a place; the neighbour's side ends at
    # its own value, the other as far away
    flat, low, high = F.col("d") == 0, F.when(F.col("edge") < F.col("at"), F.col("edge")).otherwise(F.col("at") - F.col("d")), F.when(F.col("edge") > F.col("at"), F.col("edge")).otherwise(F.col("at") + F.col("d"))
    ends = F.array(
        F.struct(low.alias("v"), F.when(flat, 0).otherwise(2).alias("kind"), F.lit(-1).alias("side")),
        F.struct(high.alias("v"), F.when(flat, 2).otherwise(0).alias("kind"), F.lit(1).alias("side")))
    events = every.select("gene", "v", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("l"), F.lit(None).cast("double").alias("at"), F.lit(0).alias("side"), "m")
    looks = radii.select("gene", F.explode(ends).alias("e"), F.col("l").cast("string").alias("l"), "at").select("gene", "e.v", "e.kind", "l", "at", "e.side", F.lit(0).cast("long").alias("m"))
    totals = running_totals(events.unionByName(looks), ["gene"], ["v", "kind", "l", "at", "side"], {"upto": "m"})
    within = totals.where("side <> 0").groupBy("gene", "l", "at").agg(F.sum(F.col("side") * F.col("upto")).alias("within"))
    t = radii.withColumn("l", F.col("l").cast("string")).join(within, ["gene", "l", "at"])
    w = F.col("own")
    mean = lambda x: F.sum(w * x) / F.sum(w)
    s = t.groupBy("gene").agg(F.sum(w).alias("n"), mean(digamma(F.col("kk"))).alias("pk"), mean(digamma(F.col("nl"))).alias("pn"), mean(digamma(F.greatest(F.col("within"), F.lit(1)))).alias("pm"))
    return s.select("gene", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("pk") - F.col("pn") - F.col("pm")).alias("mutual_information"))


def information_ranking(information: DataFrame, units: DataFrame, label: str, a: str, b: str, n: int = 50, value: str = "value") -> DataFrame:
    """The ``n`` genes of most information with Welch's test between the labels' units, their means and the fold change of a over b."""
    m = with_t_p(welch_columns(two_group_moments(units, ["gene"], label, a, b, value)))
    both = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    only = lambda x, name: F.when(both, x).alias(name)
    test = m.select("gene", only(F.col("welch_p"), "welch_p"), only(F.col("mean1"), "mean_a"), only(F.col("mean2"), "mean_b"), only(F.col("mean1") / (F.col("mean2") + 1e-10), "fold_change"))
    top = information.orderBy(F.col("mutual_information").desc(), "gene").limit(n)  # the report's length
    return top.join(test, "gene", "left")
