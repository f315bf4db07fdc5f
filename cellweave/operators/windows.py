"""Ranks, corrections, bins, selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.scale import attach, c, running_totals, tie_ranks, top_n, with_group_stats, with_quantiles

# Right-closed bins of the immune share.
IMMUNE_BINS = [(0, 18, "Low"), (18, 22, "Medium"), (22, 100, "High")]


def min_max_scaled(df: DataFrame, keys: Sequence[str], cols: Sequence[str], eps: float = 1e-10, suffix: str = "_norm") -> DataFrame:
    t = with_group_stats(df, keys, [f(c(m)).alias(f"__{n}_{m}") for m in cols for n, f in (("lo", F.min), ("hi", F.max))])
    for m in cols:
        t = t.withColumn(f"{m}{suffix}", (c(m) - c(f"__lo_{m}")) / (c(f"__hi_{m}") - c(f"__lo_{m}") + eps))
    return t.drop(*[f"__{n}_{m}" for m in cols for n in ("lo", "hi")])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Average-tie rank on every row: ranks are computed on distinct values and joined back."""
    ranks = tie_ranks(df, keys, value).select(*keys, c(value), F.col("avg_rank").alias(out))
    return df.join(ranks, [*keys, value])


def cumulative_share(df: DataFrame, keys: Sequence[str], value: str, out: str = "cum_dist") -> DataFrame:
    """Share of the group's rows at or below each distinct value (``cume_dist`` without a per-group task)."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(counted, keys, [value], {"__up_to": "n"})
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    return attach(run, total, keys).withColumn(out, F.col("__up_to") / F.col("__total")).drop("__up_to", "__total")


def adjust_p(df: DataFrame, family: Sequence[str], p: str, tie: Sequence[str], method: str = "bh", nan_policy: str = "drop", out: str = "q") -> DataFrame:
    """Benjamini-Hochberg, Holm or Bonferroni over each family of tests.

    ``nan_policy='drop'`` leaves missing p-values missing and out of the count, ``'one'`` turns them into 1
    and counts them. One row per test; a family is as large as the feature panel.
    """
    v = F.when(~F.isnan(c(p)), c(p))
    t = df.withColumn("__p", F.coalesce(v, F.lit(1.0)) if nan_policy == "one" else v)
    fam = [c(k) for k in family]
    present = F.col("__p").isNotNull()
    n = F.count("__p").over(Window.partitionBy(*fam))
    order = Window.partitionBy(*fam, present).orderBy(F.col("__p"), *[c(k) for k in tie])
    rank = F.row_number().over(order)
    t = t.withColumn("__n", n).withColumn("__r", rank)
    if method == "bonferroni":
        adj = F.col("__p") * F.col("__n")
    elif method == "holm":
        adj = F.max(F.col("__p") * (F.col("__n") - F.col("__r") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bh":
        adj = F.min(F.col("__p") * F.col("__n") / F.col("__r")).over(order.rowsBetween(0, Window.unboundedFollowing))
    else:
        raise ValueError(method)
    return t.withColumn(out, F.when(present, F.least(F.lit(1.0), adj))).drop("__p", "__n", "__r")


def cumulative_variance(df: DataFrame, keys: Sequence[str], pc: str, ratio: str, out: str = "cumulative") -> DataFrame:
    """Running sum over the components of one decomposition."""
    w = Window.partitionBy(*[c(k) for k in keys]).orderBy(pc).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(ratio).over(w))


def percentile_flag(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Strictly above the group's quantile."""
    return with_quantiles(df, keys, {"__q": (value, q)}).withColumn(out, c(value) > F.col("__q")).drop("__q")


def median_split(df: DataFrame, value: str, out: str) -> DataFrame:
    """High at or above the overall median, Low below."""
    t = with_quantiles(df, [], {"__md": (value, 0.5)})
    return t.withColumn(out, F.when(c(value) >= F.col("__md"), "High").otherwise("Low")).drop("__md")


def right_closed_bins(value: Column, bins=IMMUNE_BINS) -> Column:
    expr = F
    for low, high, label in bins:
        expr = expr.when((value > low) & (value <= high), label)
    return expr.otherwise(None)


def consensus_ranking(importances: DataFrame, features: DataFrame, models: DataFrame, missing: float = 20.0, top: int = 10) -> DataFrame:
    """Mean rank over models (``missing`` where a model lacks the feature) and how often in the top."""
    w = Window.partitionBy("model").orderBy(F.col("importance").desc(), F.col("feature"))
    ranked = importances.withColumn("rank", F.row_number().over(w)).select("model", "feature", "rank")
    names = models.agg(F.collect_set("model").alias("__m")).withColumn("__all", F.lit(0))
    grid = attach(features.select("feature").withColumn("__all", F.lit(0)), names, ["__all"]).select("feature", F.explode("__m").alias("model"))
    j = grid.join(ranked, ["model", "feature"], "left")
    return j.groupBy("feature").agg(
        F.avg(F.coalesce(F.col("rank").cast("double"), F.lit(missing))).alias("mean_rank"),
        F.count_if(F.col("rank") <= top).alias("n_top"),
    )


def top_by(df: DataFrame, keys: Sequence[str], value: Column, tie: Sequence[str], n: int) -> DataFrame:
    """Top n rows per key with their rank."""
    return top_n(df, keys, [value.desc(), *[c(k) for k in tie]], n)


def largest_overall(df: DataFrame, value: Column, tie: Sequence[str], n: int) -> DataFrame:
    """n largest rows overall; planned as take-ordered, each task keeps n rows."""
    return df.orderBy(value.desc(), *[c(k) for k in tie]).limit(n)


def top_variance_features(df: DataFrame, feature: str, value: str, n: int) -> DataFrame:
    """Features with the largest sample variance."""
    return df.groupBy(feature).agg(F.var_samp(value).alias("variance")).orderBy(F.col("variance").desc(), feature).limit(n)


def volcano(de: DataFrame, lfc: str, padj: str, cut_p: float = 0.05, cut_lfc: float = 0.5) -> DataFrame:
    """Negative log10 of adjusted p and the up / down / ns class."""
    hit = c(padj) < cut_p
    cls = F.when(hit & (c(lfc) > cut_lfc), "up").when(hit & (c(lfc) < -cut_lfc), "down").otherwise("ns")
    return de.withColumn("neg_log10_p", -F.log10(c(padj) + 1e-100)).withColumn("class", cls)
