"""Grouped summaries of cells, samples and markers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.scale import attach, c, exact_quantiles, with_group_stats

# Gene lists of the sample-level module scores.
MODULES = {
    "immune_score": ["CD3D", "CD3E", "CD4", "CD8A", "CD8B", "PTPRC"],
    "tumor_score": ["KRT19", "EPCAM", "KRT7", "KRT8", "MUC1"],
    "stromal_score": ["COL1A1", "COL1A2", "ACTA2", "FAP", "PDGFRA", "PDGFRB"],
    "angiogenesis_score": ["VEGFA", "VEGFB", "VEGFC", "KDR", "FLT1", "PECAM1", "CDH5"],
    "proliferation_score": ["MKI67", "TOP2A", "PCNA", "MCM2", "MCM6"],
    "hypoxia_score": ["HIF1A", "VEGFA", "SLC2A1", "LDHA", "PGK1", "ENO1"],
    "kras_pathway_score": ["KRAS", "HRAS", "NRAS", "BRAF", "RAF1", "MAP2K1", "MAPK1"],
    "tgfb_score": ["TGFB1", "TGFB2", "TGFB3", "TGFBR1", "TGFBR2", "SMAD2", "SMAD3"],
    "ifn_response_score": ["ISG15", "MX1", "OAS1", "IFIT1", "IFIT2", "IRF7", "STAT1"],
    "cytotoxicity_score": ["GZMA", "GZMB", "GZMK", "PRF1", "NKG7", "GNLY"],
}


def n_rows() -> Column:
    return F.count(F.lit(1))


def cell_qc(counts: DataFrame, keys: Sequence[str], mito: Column) -> DataFrame:
    """Total counts, genes detected and percent mitochondrial per cell."""
    total = F.sum("count")
    return counts.groupBy(*keys).agg(
        total.alias("n_counts"),
        F.count_if(F.col("count") > 0).alias("n_genes"),
        F.when(total > 0, F.sum(F.when(mito, F.col("count")).otherwise(0.0)) / total * 100).otherwise(0.0).alias("pct_mt"),
    )


def top_n_sizes(n_genes: int) -> list[int]:
    """Sizes of the 'share in top genes' columns for a panel."""
    if n_genes < 100:
        return [10, 20, 50]
    return [50, 100, 200] if n_genes < 500 else [50, 100, 200, 500]


def percent_in_top(counts: DataFrame, keys: Sequence[str], sizes: Sequence[int] | None = None) -> DataFrame:
    """Percent of a cell's counts in its n largest genes (window over one cell's genes); n by the panel's size unless given."""
    sizes = sizes or top_n_sizes(counts.select("gene").distinct().count())
    w = Window.partitionBy(*[c(k) for k in keys]).orderBy(F.col("count").desc(), F.col("gene"))
    total = F.sum("count")
    return counts.withColumn("__rn", F.row_number().over(w)).groupBy(*keys).agg(
        *[(F.sum(F.when(F.col("__rn") <= n, F.col("count")).otherwise(0.0)) / total * 100).alias(f"pct_top_{n}") for n in sizes]
    )


def sample_qc(cells: DataFrame, keys: Sequence[str] = ("sample_id",), counts: str = "n_counts", genes: str = "n_genes", area: str | None = "area") -> DataFrame:
    """Sample-level QC metrics from the cell table; spreads are population ones."""
    keys = list(keys)
    df = cells
    wanted = {
        "median_counts": (counts, 0.5),
        "median_genes": (genes, 0.5),
        "q25_counts": (counts, 0.25),
        "q75_counts": (counts, 0.75),
    }
    aggs = [
        n_rows().alias("n_cells"),
        F.avg(c(counts)).alias("mean_counts"),
        F.stddev_pop(c(counts)).alias("std_counts"),
        (F.avg((c(counts) == 0).cast("double")) * 100).alias("pct_zero_count_cells"),
    ]
    if area:
        df = df.withColumn("__density", F.when(c(area) > 0, c(counts) / c(area)))
        wanted |= {
            "median_cell_area": (area, 0.5),
            "median_transcript_density": ("__density", 0.5),
            "q25_transcript_density": ("__density", 0.25),
            "q75_transcript_density": ("__density", 0.75),
        }
        aggs += [F.stddev_pop(c(area)).alias("std_cell_area"), F.stddev_pop("__density").alias("std_transcript_density")]
    return df.groupBy(*keys).agg(*aggs).join(exact_quantiles(df, keys, wanted), keys)


def retention(before: DataFrame, after: DataFrame, key: str = "sample_id") -> DataFrame:
    """Cells and genes before and after a filter, with percent kept; inputs are long counts."""
    sizes = lambda df, tag: df.groupBy(key).agg(
        F.count_distinct("cell_id").alias(f"cells_{tag}"), F.count_distinct("gene").alias(f"genes_{tag}")
    )
    zero = F.lit(0).cast("long")
    j = sizes(before, "before").join(sizes(after, "after"), key, "left")
    j = j.withColumn("cells_after", F.coalesce("cells_after", zero)).withColumn("genes_after", F.coalesce("genes_after", zero))
    return j.withColumn("cells_retained_pct", F.col("cells_after") / F.col("cells_before") * 100).withColumn(
        "genes_retained_pct", F.col("genes_after") / F.col("genes_before") * 100
    )


def marker_summary(long: DataFrame, label: str, value: str, ddof: int = 1) -> DataFrame:
    """Mean, median, min, max and spread per label, largest median first.

    Input is one row per (sample, label), so the median's buffer is bounded by the number of samples.
    """
    spread = F.stddev_samp if ddof else F.stddev_pop
    return long.groupBy(label).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        spread(value).alias("std"),
    ).orderBy(F.col("median").desc(), label)


def metric_rows(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """One aggregation, returned as (metric, value) rows."""
    one = df.agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
    return one.unpivot([], [c(n) for n in metrics], "metric", "value")


def label_shares(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Count and share of each label within its group."""
    n = df.groupBy(*keys, label).agg(n_rows().alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*[c(k) for k in keys])))


def composition(df: DataFrame, keys: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    """Wide percent per label and total, absent labels 0; one pass with map-side combine."""
    total = n_rows()
    return df.groupBy(*keys).agg(
        total.alias("total_cells"), *[(F.count_if(c(label) == v) / total * 100).alias(f"{v}_pct") for v in labels]
    )


def contingency(df: DataFrame, row: str, column: str, values: Sequence[str], normalise: bool = False) -> DataFrame:
    """Label by sample table with zeros filled; optionally shares of the row."""
    total = n_rows()
    cell = lambda v: F.count_if(c(column) == v)
    return df.groupBy(row).agg(*[(cell(v) / total if normalise else cell(v)).alias(v) for v in values])


def grouped_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str], stats: Sequence[str] = ("mean",)) -> DataFrame:
    """Mean, sample spread, n of many columns by label."""
    make = {"mean": F.avg, "std": F.stddev_samp, "n": F.count, "min": F.min, "max": F.max}
    return df.groupBy(*keys).agg(*[make[s](c(m)).alias(m if list(stats) == ["mean"] else f"{m}_{s}") for m in cols for s in stats])


def pseudobulk(counts: DataFrame, unit: Sequence[str], genes: DataFrame | None = None) -> DataFrame:
    """Summed counts per unit and gene; with ``genes`` given, zero rows are added for unmeasured pairs."""
    total = counts.groupBy(*unit, "gene").agg(F.sum("count").alias("total"))
    if genes is None:
        return total
    # units x panel: both are dimension-sized, and the array keeps it a projection rather than a join
    panel = genes.select("gene").distinct().agg(F.array_sort(F.collect_set("gene")).alias("__panel"))
    units = total.select(*unit).distinct().withColumn("__all", F.lit(0))
    grid = attach(units, panel.withColumn("__all", F.lit(0)), ["__all"]).select(*unit, F.explode("__panel").alias("gene"))
    return grid.join(total, [*unit, "gene"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def unit_sizes(cells: DataFrame, unit: Sequence[str]) -> DataFrame:
    return cells.groupBy(*unit).agg(n_rows().alias("n_cells"))


def pseudobulk_mean(counts: DataFrame, cells: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Mean per unit and gene over all cells of the unit, implicit zeros included."""
    return pseudobulk(counts, unit).join(unit_sizes(cells, unit), list(unit)).withColumn("mean", F.col("total") / F.col("n_cells"))


def enough_cells(cells: DataFrame, unit: Sequence[str], minimum: int) -> DataFrame:
    """Units with their cell count and whether they reach the minimum."""
    return unit_sizes(cells, unit).withColumn("kept", F.col("n_cells") >= minimum)


def share_by_group(df: DataFrame, group: str, label: str, values: Sequence[str]) -> DataFrame:
    """Share of units per label within each group, wide."""
    total = n_rows()
    return df.groupBy(group).agg(*[(F.count_if(c(label) == v) / total).alias(v) for v in values])


def marker_positive(counts: DataFrame, cells: DataFrame, unit: Sequence[str], genes: Sequence[str]) -> DataFrame:
    """Mean and percent positive per unit and marker, over all cells of the unit."""
    hits = counts.where(F.col("gene").isin(list(genes))).groupBy(*unit, "gene").agg(
        F.sum("count").alias("__s"), F.count_if(F.col("count") > 0).alias("__p")
    )
    markers = F.explode(F.array(*[F.lit(g) for g in genes])).alias("gene")
    grid = unit_sizes(cells, unit).select(*unit, "n_cells", markers)
    j = grid.join(hits, [*unit, "gene"], "left")
    zero = F.lit(0)
    return j.select(
        *unit,
        F.col("gene").alias("marker"),
        (F.coalesce("__s", zero) / F.col("n_cells")).alias("mean_expr"),
        (F.coalesce("__p", zero) / F.col("n_cells") * 100).alias("pct_positive"),
    )


def flag_rate(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Flagged share per label."""
    return df.groupBy(*keys).agg(
        n_rows().alias("total_cells"),
        F.count_if(c(flag)).alias("flagged_cells"),
        (F.count_if(c(flag)) / n_rows() * 100).alias("pct_flagged"),
    )


def lane_rollup(samples: DataFrame) -> DataFrame:
    """Per-sample, per-lane and overall rows in one rollup of sample metrics."""
    return samples.rollup("lane", "sample_id").agg(
        n_rows().alias("n_samples"),
        F.sum("n_cells").alias("n_cells"),
        F.avg("median_counts").alias("mean_median_counts"),
        F.count_if(F.col("status") == "PASS").alias("n_pass"),
        F.count_if(F.col("status") == "WARN").alias("n_warn"),
        F.count_if(F.col("status") == "FAIL").alias("n_fail"),
    )


def density_alerts(samples: DataFrame, value: str) -> DataFrame:
    """z-score of a sample metric and OK / MONITOR / INVESTIGATE at one and two spreads."""
    t = with_group_stats(samples, [], [F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s")])
    z = (c(value) - F.col("__m")) / F.col("__s")
    label = F.when(F.abs(z) > 2, "INVESTIGATE").when(F.abs(z) > 1, "MONITOR").otherwise("OK")
    return t.withColumn("z", z).withColumn("alert", label).drop("__m", "__s")


def cluster_sizes(df: DataFrame, resolution: str, cluster: str) -> DataFrame:
    """Number of clusters and size statistics per resolution."""
    return df.groupBy(resolution, cluster).agg(n_rows().alias("size")).groupBy(resolution).agg(
        n_rows().alias("n_clusters"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.avg("size").alias("mean_size"),
        F.stddev_pop("size").alias("std_size"),
    )


def pick_resolution(sizes: DataFrame, resolution: str, target: int = 8, min_size: int = 10) -> DataFrame:
    """Resolution without tiny clusters whose cluster count is closest to the target (lowest on ties)."""
    order = F.struct(F.abs(F.col("n_clusters") - target), c(resolution))
    return sizes.where(F.col("min_size") >= min_size).agg(F.min_by(c(resolution), order).alias("chosen"))


def subset_share_stability(df: DataFrame, cluster: str, subsets: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cluster shares within each boolean subset, and their correlation with the first subset."""
    per = df.groupBy(cluster).agg(*[F.count_if(c(s)).alias(s) for s in subsets])
    shares = with_group_stats(per, [], [F.sum(c(s)).alias(f"__t_{s}") for s in subsets]).select(
        cluster, *[(c(s) / c(f"__t_{s}")).alias(s) for s in subsets]
    )
    base = subsets[0]
    return shares, shares.agg(*[F.corr(c(base), c(s)).alias(f"r_{base}_{s}") for s in subsets[1:]])


def diversity(shares: DataFrame, keys: Sequence[str], share: str = "share") -> DataFrame:
    """Shannon (bits and nats), Simpson and richness over labels above one percent."""
    p = c(share)
    return shares.where(p > 0).groupBy(*keys).agg(
        (-F.sum(p * F.log2(p))).alias("shannon_bits"),
        (-F.sum(p * F.log(p))).alias("shannon_nats"),
        (1 - F.sum(p * p)).alias("simpson"),
        F.count_if(p > 0.01).alias("richness"),
    )


def expression_entropy(counts: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shannon entropy of the normalised gene variances (zeros counted) per group."""
    n = unit_sizes(cells, keys)
    per = counts.groupBy(*keys, "gene").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("ss"))
    var = per.join(n, list(keys)).withColumn("v", F.col("ss") / F.col("n_cells") - F.pow(F.col("s") / F.col("n_cells"), 2))
    p = F.col("v") / F.sum("v").over(Window.partitionBy(*[c(k) for k in keys]))
    return var.where("v > 1e-12").withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log("p"))).alias("expression_entropy"))


def grid_bins(df: DataFrame, keys: Sequence[str], n: int, x: str = "x", y: str = "y", closed: bool = True) -> DataFrame:
    """Grid index of each row between its group's bounds; ``closed`` puts the upper edge into the last bin."""
    t = with_group_stats(df, keys, [F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1")])
    index = lambda v, lo, hi: F.floor((c(v) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / n)).cast("int")
    gx, gy = index(x, "__x0", "__x1"), index(y, "__y0", "__y1")
    if closed:
        gx, gy = F.least(gx, F.lit(n - 1)), F.least(gy, F.lit(n - 1))
    return t.withColumn("gx", gx).withColumn("gy", gy).drop("__x0", "__x1", "__y0", "__y1")


def grid_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str], n: int) -> DataFrame:
    """Dense n by n grid per group: count and mean per bin, 0 where empty."""
    filled = grid_bins(df, keys, n).groupBy(*keys, "gx", "gy").agg(n_rows().alias("n"), *[F.avg(c(m)).alias(m) for m in cols])
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    groups = df.select(*keys).distinct().select(*keys, F.explode(axis).alias("gx")).select(*keys, "gx", F.explode(axis).alias("gy"))
    j = groups.join(filled, [*keys, "gx", "gy"], "left")
    return j.select(*keys, "gx", "gy", F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[F.coalesce(c(m), F.lit(0.0)).alias(m) for m in cols])


def _entropy_of_counts(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*[c(k) for k in keys]))
    return df.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log("p"))).alias(out), F.sum("n").alias("n_total"))


def binned_type_entropy(df: DataFrame, keys: Sequence[str], label: str, n_bins: int = 10, min_cells: int = 5) -> DataFrame:
    """Mean and spread over bins of the entropy of cell types in the bin (half-open bins)."""
    per = grid_bins(df, keys, n_bins, closed=False).where(f"gx < {n_bins} and gy < {n_bins}").groupBy(*keys, "gx", "gy", label).agg(n_rows().alias("n"))
    bins = _entropy_of_counts(per, [*keys, "gx", "gy"], "h").where(F.col("n_total") > min_cells)
    return bins.groupBy(*keys).agg(F.avg("h").alias("mean_entropy"), F.stddev_pop("h").alias("std_entropy"), n_rows().alias("n_bins"))


def type_dispersion(df: DataFrame, keys: Sequence[str], label: str, n_bins: int = 10, min_cells: int = 10) -> DataFrame:
    """Entropy of each type's cells over bins laid between that type's own bounds (upper edge included)."""
    own = [*keys, label]
    per = grid_bins(df, own, n_bins).groupBy(*own, "gx", "gy").agg(n_rows().alias("n"))
    return _entropy_of_counts(per, own, "spatial_entropy").where(F.col("n_total") > min_cells)


def shifted_entropy(df: DataFrame, keys: Sequence[str], value: str = "value", eps: float = 1e-10) -> DataFrame:
    """Entropy of values shifted to start just above 0; rows are the few labels of one group."""
    w = Window.partitionBy(*[c(k) for k in keys])
    v = df.withColumn("__v", c(value) - F.min(c(value)).over(w) + eps)
    p = v.withColumn("__p", F.col("__v") / F.sum("__v").over(w))
    return p.groupBy(*keys).agg((-F.sum(F.col("__p") * F.log("__p"))).alias("cell_type_entropy"))


def multimodal_entropy(composition: DataFrame, expression: DataFrame, keys: Sequence[str], weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Weighted sum of the two entropies; the composition one alone when expression is missing."""
    j = composition.join(expression, list(keys), "left")
    both = weights[0] * F.col("cell_type_entropy") + weights[1] * F.col("expression_entropy")
    return j.withColumn("combined_entropy", F.coalesce(both, F.col("cell_type_entropy")))


def geometry(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Extent, density, variances, covariance and spread of the positions."""
    w, h = F.max(x) - F.min(x), F.max(y) - F.min(y)
    return df.groupBy(*keys).agg(
        n_rows().alias("n_cells"), w.alias("x_range"), h.alias("y_range"),
        (n_rows() / (w * h + 1)).alias("density"),
        F.var_pop(x).alias("x_var"), F.var_pop(y).alias("y_var"), F.covar_samp(x, y).alias("xy_cov"),
        F.stddev_pop(x).alias("x_spread"), F.stddev_pop(y).alias("y_spread"),
    )


def module_means(counts: DataFrame, cells: DataFrame, modules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean expression of each gene list over cells and its measured genes; ``modules(name, gene)``."""
    measured = modules.join(counts.select("gene").distinct(), "gene", "left_semi")
    k = measured.groupBy("name").agg(F.count_distinct("gene").alias("k"))
    s = counts.join(measured, "gene").groupBy(*keys, "name").agg(F.sum("count").alias("s"))
    return s.join(k, "name").join(unit_sizes(cells, keys), list(keys)).select(
        *keys, "name", (F.col("s") / (F.col("n_cells") * F.col("k"))).alias("score")
    )


def patient_summary(samples: DataFrame, key: str = "patient") -> DataFrame:
    """Totals, medians over samples, presence of each timepoint and the joined sample list."""
    return samples.groupBy(key).agg(
        n_rows().alias("n_samples"),
        F.sum("n_cells").alias("total_cells"),
        F.percentile("n_cells", F.lit(0.5)).alias("median_cells"),
        F.bool_or(F.col("timepoint") == "Pre").alias("has_pre"),
        F.bool_or(F.col("timepoint") == "Post").alias("has_post"),
        F.array_join(F.sort_array(F.collect_set("sample_id")), ", ").alias("sample_list"),
    )


def activity_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, spread and exact median of an activity per group."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return s.join(exact_quantiles(df, keys, {"median": (value, 0.5)}), list(keys))


def class_load(counts: DataFrame, cells: DataFrame, keys: Sequence[str], in_class: Column) -> DataFrame:
    """Load of a gene class per sample: total, mean and variance of the cell sums, percent of cells with any."""
    per = counts.where(in_class).groupBy(*keys, "cell_id").agg(F.sum("count").alias("v"))
    s = per.groupBy(*keys).agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.count_if(F.col("v") > 0).alias("pos"))
    j = unit_sizes(cells, keys).join(s, list(keys), "left").fillna(0, ["s", "ss", "pos"])
    mean = F.col("s") / F.col("n_cells")
    return j.select(
        *keys, F.col("s").alias("total"), mean.alias("mean"),
        (F.col("ss") / F.col("n_cells") - mean * mean).alias("variance"),
        (F.col("pos") / F.col("n_cells") * 100).alias("pct_cells"),
    )
