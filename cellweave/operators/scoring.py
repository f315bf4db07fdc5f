"""Signature scores, network activities, and sample metrics on gated cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.functions import dist
from cellweave.functions import scalars as sc
from cellweave.operators.aggregates import n_rows
from cellweave.operators.clean import seeded_key
from cellweave.operators.statistics import two_group_moments, welch_columns, with_t_p
from cellweave.operators.windows import min_max_scaled
from cellweave.scale import attach, c, exact_quantiles, sized, top_n, with_quantiles


def microenvironment(gated: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Composition, checkpoint and polarisation metrics per sample of gated cells.

    Expects the PD1 and PDL1 thresholds the gate kept (``__t_PD1``, ``__t_PDL1``).
    """
    pct = lambda v: F.count_if(c(label) == v) / n_rows() * 100
    is_t = c(label).isin(sc.T_CELL_TYPES)
    is_tumor = c(label) == "Epithelial"
    share = lambda of, test: F.when(F.count_if(of) > 0, F.count_if(of & test) / F.count_if(of) * 100).otherwise(0.0)
    base = gated.groupBy(*keys).agg(
        n_rows().alias("n_cells"),
        (F.count_if(c(label).isin(sc.IMMUNE_TYPES)) / n_rows() * 100).alias("total_immune_pct"),
        pct("CD8_T").alias("cd8_pct"),
        pct("Treg").alias("treg_pct"),
        (pct("CD8_T") / (pct("Treg") + 0.01)).alias("cd8_treg_ratio"),
        pct("Macrophage").alias("macrophage_pct"),
        pct("Epithelial").alias("epithelial_pct"),
        pct("Stromal").alias("stromal_pct"),
        share(is_t, c("PD1") > F.col("__t_PD1")).alias("pct_pd1_pos_t_cells"),
        share(is_tumor, c("PDL1") > F.col("__t_PDL1")).alias("pct_pdl1_pos_tumor"),
    )
    macs = gated.where(c(label) == "Macrophage").select(*keys, c("HLA-DR").alias("v"))
    high = with_quantiles(macs, keys, {"md": ("v", 0.5)}).groupBy(*keys).agg(
        F.when(n_rows() > 10, F.count_if(F.col("v") > F.col("md")) / n_rows() * 100).alias("m1_like_pct")
    )
    return base.join(high, list(keys), "left")


def exhaustion(cd8: DataFrame, keys: Sequence[str], min_cells: int = 10) -> DataFrame:
    """Exhaustion of CD8 T cells: scaled PD1 times (1 - scaled KI67); share above P75; needs enough cells."""
    t = min_max_scaled(cd8.select(*keys, "PD1", "KI67"), keys, ["PD1", "KI67"])
    t = t.withColumn("e", c("PD1_norm") * (1 - c("KI67_norm")))
    t = with_quantiles(t, keys, {"q": ("e", 0.75)})
    return t.groupBy(*keys).agg(
        n_rows().alias("n_cd8_t_cells"),
        F.avg("e").alias("cd8_exhaustion_score"),
        (F.count_if(F.col("e") > F.col("q")) / n_rows() * 100).alias("pct_cd8_exhausted"),
    ).where(F.col("n_cd8_t_cells") >= min_cells)


def weighted_gene_sums(counts: DataFrame, weights: DataFrame, cell: Sequence[str], names: Sequence[str], value: str = "count", extra=()) -> DataFrame:
    """Per cell, the weighted sum of expression for each named gene set.

    The weights are pivoted to one row per gene, so the fact table joins a panel-sized table without
    multiplying rows, and all sets are summed in one aggregation. Genes not stored are zeros and add nothing.
    """
    wide = weights.groupBy("gene").pivot("name", list(names)).agg(F.sum("weight"))
    wide = sized(wide.select("gene", *[c(n).alias(f"__w_{n}") for n in names]))
    j = counts.join(wide, "gene", "left")
    return j.groupBy(*cell).agg(
        *[F.coalesce(F.sum(c(value) * c(f"__w_{n}")), F.lit(0.0)).alias(n) for n in names], *extra
    )


def marker_mean_shares(counts: DataFrame, signatures: DataFrame, cell: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean of each type's measured markers, normalised over types; 0 for a cell without any marker."""
    present = signatures.join(counts.select("gene").distinct(), "gene", "left_semi").select("name", "gene").distinct()
    k = F.count(F.lit(1)).over(Window.partitionBy("name"))
    sums = weighted_gene_sums(counts, present.withColumn("weight", 1.0 / k), cell, names)
    total = sum((c(n) for n in names), F.lit(0.0))
    return sums.select(*cell, *[F.when(total > 0, c(n) / total).otherwise(0.0).alias(n) for n in names])


def gene_means(counts: DataFrame, n_cells: DataFrame, value: str = "count") -> DataFrame:
    """Mean per gene over all cells; ``n_cells`` is a one-row table with column n_cells."""
    s = counts.groupBy("gene").agg(F.sum(c(value)).alias("s")).withColumn("__all", F.lit(0))
    return attach(s, n_cells.withColumn("__all", F.lit(0)), ["__all"]).select("gene", (F.col("s") / F.col("n_cells")).alias("mean"))


def signature_weights(means: DataFrame, signatures: DataFrame, n_bins: int = 25, n_controls: int = 50, seed: int = 0) -> DataFrame:
    """+1/n for signature genes, -1/m for expression-matched controls; panel-sized tables only.

    Controls come from the expression bins of the signature's genes, ``n_controls`` per bin in hash order.
    """
    binned = means.withColumn("bin", F.ntile(n_bins).over(Window.orderBy("mean", "gene")))
    sig = signatures.select("name", "gene").distinct().join(binned, "gene").select("name", "gene", "bin")
    wanted = sig.select("name", "bin").distinct()
    pool = binned.withColumn("h", seeded_key(seed, "gene"))
    picked = top_n(wanted.join(pool, "bin"), ["name", "bin"], [F.col("h"), F.col("gene")], n_controls)
    ctrl = picked.select("name", "gene").join(sig.select("name", "gene"), ["name", "gene"], "left_anti")
    w = Window.partitionBy("name")
    pos = sig.select("name", "gene", (1.0 / F.count(F.lit(1)).over(w)).alias("weight"))
    neg = ctrl.select("name", "gene", (-1.0 / F.count(F.lit(1)).over(w)).alias("weight"))
    return pos.unionByName(neg)


def signature_scores(counts: DataFrame, n_cells: DataFrame, signatures: DataFrame, cell: Sequence[str], names: Sequence[str], value: str = "count", **kw) -> DataFrame:
    """Mean of the signature minus mean of its controls, per cell."""
    weights = signature_weights(gene_means(counts, n_cells, value), signatures, **kw)
    return weighted_gene_sums(counts, weights, cell, names, value)


def measured_network(net: DataFrame, genes: DataFrame, min_targets: int = 5) -> DataFrame:
    """Network rows (name, gene, weight) on measured genes, for sources with enough targets."""
    present = net.select(F.col("source").alias("name"), F.col("target").alias("gene"), "weight").join(
        genes.select("gene").distinct(), "gene", "left_semi"
    )
    n = F.count(F.lit(1)).over(Window.partitionBy("name"))
    return present.withColumn("__n", n).where(F.col("__n") >= min_targets).drop("__n")


def univariate_activity(counts: DataFrame, net: DataFrame, cell: Sequence[str], names: Sequence[str], n_genes: int, value: str = "count") -> DataFrame:
    """t-value of the slope of a cell's expression on each source's weights, over all genes of the panel."""
    y, n = c(value), float(n_genes)
    sums = weighted_gene_sums(counts, net, cell, names, value, extra=(F.sum(y).alias("__y"), F.sum(y * y).alias("__yy")))
    moments = net.groupBy("name").agg(F.sum("weight").alias("sx"), F.sum(F.col("weight") * F.col("weight")).alias("sxx"))
    long = sums.unpivot([*[c(k) for k in cell], F.col("__y"), F.col("__yy")], [c(m) for m in names], "source", "xy")
    j = attach(long, moments.withColumnRenamed("name", "source"), ["source"], "inner")
    cov = F.col("xy") - F.col("sx") * F.col("__y") / n
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    var_y = F.col("__yy") - F.col("__y") * F.col("__y") / n
    r = cov / F.sqrt(var_x * var_y)
    return j.withColumn("r", r).select(
        *cell, "source", (F.col("r") * F.sqrt((n - 2) / ((1 - F.col("r")) * (1 + F.col("r"))))).alias("t_value")
    )


MAX_SOURCES = 2_000


def multivariate_activity(counts: DataFrame, net: DataFrame, cell: Sequence[str], names: Sequence[str], n_genes: int, value: str = "count") -> DataFrame:
    """t-values and p of a cell's expression regressed on all sources at once (with intercept).

    The design is shared by all cells: its Gram matrix has the size of the source list and is inverted once;
    per cell only the cross products are aggregated.
    """
    names = list(names)
    if len(names) > MAX_SOURCES:
        raise ValueError(f"{len(names)} sources: the shared Gram matrix is meant for at most {MAX_SOURCES}")
    a = net.select("gene", F.col("name").alias("a"), F.col("weight").alias("wa"))
    b = net.select("gene", F.col("name").alias("b"), F.col("weight").alias("wb"))
    gram_rows = a.join(b, "gene").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("v")).collect()
    col_sums = {r["name"]: r["s"] for r in net.groupBy("name").agg(F.sum("weight").alias("s")).collect()}
    k = len(names)
    at = {nm: i + 1 for i, nm in enumerate(names)}
    gram = np.zeros((k + 1, k + 1))
    gram[0, 0] = n_genes
    for nm, s in col_sums.items():
        gram[0, at[nm]] = gram[at[nm], 0] = s
    for r in gram_rows:
        gram[at[r["a"]], at[r["b"]]] = r["v"]
    inv = np.linalg.inv(gram)
    dof = n_genes - k - 1

    @F.pandas_udf("array<double>")
    def t_values(xy: pd.Series, yy: pd.Series) -> pd.Series:
        m = np.stack(xy.to_numpy())
        beta = m @ inv
        sse = yy.to_numpy() - np.einsum("ij,ij->i", m, beta)
        se = np.sqrt(np.maximum(sse, 1e-300)[:, None] / dof * np.diag(inv)[None, :])
        return pd.Series(list((beta / se)[:, 1:]))

    y = c(value)
    sums = weighted_gene_sums(counts, net, cell, names, value, extra=(F.sum(y).alias("__y"), F.sum(y * y).alias("__yy")))
    t = sums.select(*cell, t_values(F.array(F.col("__y"), *[c(nm) for nm in names]), F.col("__yy")).alias("t"))
    long = t.select(*cell, F.posexplode("t").alias("i", "t_value"))
    source = F.element_at(F.array(*[F.lit(nm) for nm in names]), F.col("i") + 1)
    return long.select(*cell, source.alias("source"), "t_value", dist.call("t_p", F.col("t_value"), F.lit(float(dof))).alias("p_value"))


def activity_by_response(activity: DataFrame, cells: DataFrame, samples: DataFrame, group: str, a: str, b: str, key: str = "sample_id", id_col: str = "cell_id") -> DataFrame:
    """Welch's test of the samples' mean activities between two groups, per source: (source, n, means, t_stat, welch_p) with suffixes of the groups."""
    means = activity.join(cells, id_col).groupBy(key, "source").agg(F.avg("t_value").alias("value")).join(samples.select(key, c(group)), key)
    m = with_t_p(welch_columns(two_group_moments(means, ["source"], group, a, b)))
    names = {"n1": f"n_{a.lower()}", "n2": f"n_{b.lower()}", "mean1": f"mean_{a.lower()}", "mean2": f"mean_{b.lower()}"}
    return m.withColumnsRenamed(names).select("source", *names.values(), "t_stat", "welch_p")
