"""Equi-joins of cell, sample and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.scale import attach, c


def intersect_modalities(cells: DataFrame, rna: DataFrame, protein: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells present in metadata, RNA and protein."""
    return cells.join(rna, list(keys)).join(protein, list(keys))


def with_sample_attributes(cells: DataFrame, samples: DataFrame, names: Sequence[str], default: str = "unknown") -> DataFrame:
    out = attach(cells, samples.select("sample_id", *names), ["sample_id"])
    return out.select(*[c(n) for n in cells.columns], *[F.coalesce(c(n), F.lit(default)).alias(n) for n in names])


def compare_with_baseline(ours: DataFrame, baseline: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Our value, the baseline's, their difference and percent removed, per sample."""
    b = baseline.select(c(key), *[c(m).alias(f"base_{m}") for m in metrics])
    out = ours.join(b, key, "left")
    cols: list[Column] = [c(key)]
    for m in metrics:
        base, mine = c(f"base_{m}"), c(m)
        cols += [
            mine.alias(m),
            base.alias(f"base_{m}"),
            (base - mine).alias(f"diff_{m}"),
            F.when(base > 0, (base - mine) / base * 100).alias(f"pct_removed_{m}"),
        ]
    return out.select(*cols)


def agreement(left: DataFrame, right: DataFrame, keys: Sequence[str], group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of the same columns in two sources, on their common cells."""
    r = right.select(*[c(k) for k in keys], *[c(n).alias(f"__r_{n}") for n in cols])
    j = left.join(r, list(keys))
    return j.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_common"), *[F.corr(c(n), c(f"__r_{n}")).alias(f"r_{n}") for n in cols]
    )


def contingency_long(a: DataFrame, b: DataFrame, keys: Sequence[str], label_a: str, label_b: str) -> DataFrame:
    """Cells per pair of labels from two labellings of the same cells."""
    rhs = b.select(*[c(k) for k in keys], c(label_b).alias("label_b"))
    return a.select(*[c(k) for k in keys], c(label_a).alias("label_a")).join(rhs, list(keys)).groupBy("label_a", "label_b").agg(
        F.count(F.lit(1)).alias("n")
    )


def paired_change(df: DataFrame, keys: Sequence[str], time: str, value: str, before: str = "Pre", after: str = "Post") -> DataFrame:
    """Before/after pairs per key, only where each side has exactly one row; NULL fold change from 0."""
    side = lambda t: F.when(c(time) == t, c(value))
    g = df.groupBy(*keys).agg(
        F.count_if(c(time) == before).alias("__nb"),
        F.count_if(c(time) == after).alias("__na"),
        F.max(side(before)).alias("pre_value"),
        F.max(side(after)).alias("post_value"),
    )
    return g.where("__nb = 1 and __na = 1").select(
        *keys,
        "pre_value",
        "post_value",
        (F.col("post_value") - F.col("pre_value")).alias("change"),
        F.when(F.col("pre_value") != 0, F.col("post_value") / F.col("pre_value")).alias("fold_change"),
    )


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys are only in A, in both, only in B."""
    l = a.select(key).distinct().withColumn("__a", F.lit(True))
    r = b.select(key).distinct().withColumn("__b", F.lit(True))
    category = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").otherwise("both")
    return l.join(r, key, "full_outer").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def type_ratios(shares: DataFrame, keys: Sequence[str], eps: float = 0.001) -> DataFrame:
    """Ratio of every unordered pair of cell types within a sample's composition.

    The table has one row per (sample, type); the pairs are formed inside the sample's short type list.
    """
    entry = F.struct(c("cell_type").alias("t"), c("share").alias("p"))
    packed = shares.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("v"))
    first = packed.select(*keys, "v", F.posexplode("v").alias("i", "a"))
    pairs = first.select(*keys, "a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b"))
    return pairs.select(
        *keys,
        F.col("a.t").alias("type_a"),
        F.col("b.t").alias("type_b"),
        ((F.col("a.p") + eps) / (F.col("b.p") + eps)).alias("ratio"),
    )


def with_network(counts: DataFrame, net: DataFrame, gene: str = "gene") -> DataFrame:
    """Expression rows of the genes a network targets, one row per (cell, source, gene)."""
    return counts.join(net.withColumnRenamed("target", gene), gene)


