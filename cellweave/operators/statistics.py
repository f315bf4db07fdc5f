"""Group tests. Sums, ranks and counts are Spark aggregations; only tail probabilities use pandas UDFs.

Every test reads a long table (keys, group, value): all metrics of a table are tested in one plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import dist
from cellweave.functions import scalars as sc
from cellweave.operators.windows import adjust_p
from cellweave.scale import attach, c, exact_quantiles, row_numbers, tie_ranks, with_group_stats


def n_rows() -> Column:
    return F.count(F.lit(1))


def two_group_moments(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str = "value") -> DataFrame:
    """n, mean and sample variance of both groups per key, in one pass."""
    v = lambda g: F.when(c(group) == g, c(value))
    return df.where(c(group).isin(a, b) & c(value).isNotNull() & ~F.isnan(c(value))).groupBy(*keys).agg(
        F.count(v(a)).alias("n1"), F.count(v(b)).alias("n2"),
        F.avg(v(a)).alias("mean1"), F.avg(v(b)).alias("mean2"),
        F.var_samp(v(a)).alias("var1"), F.var_samp(v(b)).alias("var2"),
    )


def welch_columns(m: DataFrame) -> DataFrame:
    """t and Satterthwaite df from moments; p is 1 where a group has one row or no spread at all."""
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("var1"), F.col("var2")
    se2 = v1 / n1 + v2 / n2
    usable = (n1 > 1) & (n2 > 1) & (se2 > 0)
    t = F.when(usable, (F.col("mean1") - F.col("mean2")) / F.sqrt(se2))
    df_ = F.when(usable, se2 * se2 / (F.pow(v1 / n1, 2) / (n1 - 1) + F.pow(v2 / n2, 2) / (n2 - 1)))
    return m.withColumn("t_stat", t).withColumn("dof", df_)


def with_t_p(m: DataFrame, t: str = "t_stat", dof: str = "dof", out: str = "welch_p", missing: float | None = None) -> DataFrame:
    p = dist.call("t_p", c(t), c(dof))
    return m.withColumn(out, p if missing is None else F.coalesce(p, F.lit(missing)))


def student_columns(m: DataFrame) -> DataFrame:
    """Equal-variance t and its df."""
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = ((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / (n1 + n2 - 2)
    t = F.when(pooled > 0, (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled * (1 / n1 + 1 / n2)))
    return m.withColumn("t_stat", t).withColumn("dof", (n1 + n2 - 2).cast("double"))


def effect_columns(m: DataFrame, ddof: int = 1) -> DataFrame:
    """Cohen d (pooled), mean difference and ratio of means; d is NULL when a group has one row."""
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("var1"), F.col("var2")
    if ddof == 1:
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    else:  # mean of the two population variances
        pooled = (v1 * (n1 - 1) / n1 + v2 * (n2 - 1) / n2) / 2
    diff = F.col("mean1") - F.col("mean2")
    d = F.when((n1 > 1) & (n2 > 1) & (pooled > 0), diff / F.sqrt(pooled))
    return m.withColumn("effect_size", d).withColumn("mean_diff", diff).withColumn(
        "fold_change", sc.plain_ratio(F.col("mean1"), F.col("mean2"))
    )


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str = "value", min_n: int = 1) -> DataFrame:
    """U of group a, group sizes, tie term and rank-biserial r; ranks live on distinct values only."""
    rows = df.where(c(group).isin(a, b) & ~F.isnan(c(value).cast("double")))
    ranked = tie_ranks(rows, keys, value, [F.count_if(c(group) == a).alias("__a"), F.count_if(c(group) == b).alias("__b")])
    n, t = F.col("cnt").cast("double"), ranked.groupBy(*keys)
    agg = t.agg(
        F.sum("__a").alias("n1"), F.sum("__b").alias("n2"),
        F.sum(F.col("__a") * F.col("avg_rank")).alias("__r1"),
        F.sum(n * n * n - n).alias("tie_term"),
    ).where((F.col("n1") >= min_n) & (F.col("n2") >= min_n))
    u = F.col("__r1") - F.col("n1") * (F.col("n1") + 1) / 2
    out = agg.withColumn("u_stat", u).drop("__r1")
    return out.withColumn("rank_biserial", 1 - 2 * F.col("u_stat") / (F.col("n1") * F.col("n2")))


def with_mwu_p(m: DataFrame, out: str = "mwu_p", method: str = "auto") -> DataFrame:
    """p by ``method`` (exact, asymptotic, or auto: exact for a small tie-free group) and the method used."""
    used = dist.mwu_method(F.col("n1"), F.col("n2"), F.col("tie_term"), method)
    exact = F.when(used == "exact", 1).otherwise(0)
    p = dist.call("mwu_p", F.col("u_stat"), F.col("n1"), F.col("n2"), F.col("tie_term"), exact)
    return m.withColumn(out, p).withColumn(f"{out}_method", used)


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str = "value", min_n: int = 3) -> DataFrame:
    """Tie-corrected H over groups with enough rows; needs two such groups."""
    keys = list(keys)
    rows = df.where(c(value).isNotNull() & c(group).isNotNull())
    big = rows.groupBy(*keys, group).agg(n_rows().alias("__n")).where(F.col("__n") >= min_n).select(*keys, group)
    rows = attach(rows, big, [*keys, group], "left_semi")
    per_value = rows.groupBy(*keys, value, group).agg(n_rows().alias("m"))
    ranks = tie_ranks(rows, keys, value)
    per_group = per_value.join(ranks, [*keys, value]).groupBy(*keys, group).agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * F.col("avg_rank")).alias("r")
    )
    t = F.col("cnt").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum(t * t * t - t).alias("ties"))
    h = per_group.groupBy(*keys).agg(
        F.sum("n").alias("n_total"), n_rows().alias("n_groups"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")
    ).where("n_groups >= 2").join(ties, keys)
    n = F.col("n_total").cast("double")  # the cube of two million leaves the longs
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    corr = 1 - F.col("ties") / (n * n * n - n)
    return h.withColumn("h_stat", F.when(corr > 0, raw / corr)).select(*keys, "n_total", "n_groups", "h_stat")


def with_kruskal_p(m: DataFrame, out: str = "kruskal_p") -> DataFrame:
    return m.withColumn(out, dist.call("chi2_p", F.col("h_stat"), F.col("n_groups") - 1))


def dual_test(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str = "value", ddof: int = 1) -> DataFrame:
    """Welch and Mann-Whitney together with moments, effect size and fold change."""
    m = effect_columns(welch_columns(two_group_moments(df, keys, group, a, b, value)), ddof)
    u = mann_whitney(df, keys, group, a, b, value).select(*keys, "u_stat", "tie_term", "rank_biserial")
    return m.join(u, list(keys), "left")


def with_dual_p(m: DataFrame) -> DataFrame:
    return with_mwu_p(with_t_p(m))


def compare_by_group(df: DataFrame, metrics: Sequence[str], group: str, pair: tuple[str, str] | None) -> DataFrame:
    """All metric columns against one grouping: Mann-Whitney for a pair, Kruskal otherwise."""
    cast = df.select(c(group), *[c(m).cast("double").alias(m) for m in metrics])
    long = cast.unpivot([c(group)], [c(m) for m in metrics], "metric", "value")
    if pair:
        m = mann_whitney(long, ["metric"], group, *pair, min_n=3)
        return m.select(F.lit(group).alias("group_var"), "metric", F.lit("mann_whitney").alias("test"), F.col("u_stat").alias("statistic"), "rank_biserial", "n1", "n2", "u_stat", "tie_term")
    k = kruskal(long, ["metric"], group)
    return k.select(F.lit(group).alias("group_var"), "metric", F.lit("kruskal").alias("test"), F.col("h_stat").alias("statistic"), "n_groups", "h_stat")


def compared_with_p(df: DataFrame, metrics: Sequence[str], group: str, pair: tuple[str, str] | None) -> DataFrame:
    """The comparison record: test, statistic and p, and for a pair both groups' names, means and spreads."""
    m = compare_by_group(df, metrics, group, pair)
    if not pair:
        return with_kruskal_p(m, "p_value")
    long = df.select(c(group), *[c(k).cast("double").alias(k) for k in metrics]).unpivot([c(group)], [c(k) for k in metrics], "metric", "value")
    moments = two_group_moments(long, ["metric"], group, *pair).select(
        "metric", F.lit(pair[0]).alias("group1"), F.lit(pair[1]).alias("group2"), "mean1", "mean2", F.sqrt("var1").alias("std1"), F.sqrt("var2").alias("std2")
    )
    return with_mwu_p(m, "p_value").join(moments, "metric")


def anova(df: DataFrame, keys: Sequence[str], group: str, value: str = "value") -> DataFrame:
    """F, its degrees of freedom and R2 (between over total) per key, by one grouping."""
    per = df.groupBy(*keys, group).agg(n_rows().alias("__n"), F.avg(value).alias("__m"), F.var_pop(value).alias("__v"))
    per = per.withColumn("__ss", F.col("__n") * F.col("__v"))
    grand = per.groupBy(*keys).agg((F.sum(F.col("__n") * F.col("__m")) / F.sum("__n")).alias("__grand"))
    j = per.join(grand, list(keys)).groupBy(*keys).agg(
        n_rows().alias("k"), F.sum("__n").alias("n_total"), F.sum("__ss").alias("ssw"),
        F.sum(F.col("__n") * F.pow(F.col("__m") - F.col("__grand"), 2)).alias("ssb"),
    )
    d1, d2 = F.col("k") - 1, F.col("n_total") - F.col("k")
    return j.select(
        *keys, d1.alias("df_between"), d2.alias("df_within"),
        F.when((d1 > 0) & (d2 > 0) & (F.col("ssw") > 0), (F.col("ssb") / d1) / (F.col("ssw") / d2)).alias("f_stat"),
        F.when(F.col("ssb") + F.col("ssw") > 0, F.greatest(F.lit(0.0), F.col("ssb") / (F.col("ssb") + F.col("ssw")))).otherwise(0.0).alias("r_squared"),
    )


def with_f_p(m: DataFrame, out: str = "f_p") -> DataFrame:
    return m.withColumn(out, dist.call("f_p", F.col("f_stat"), F.col("df_between"), F.col("df_within")))


def variance_partition(df: DataFrame, component: str, factors: Mapping[str, str], value: str = "value") -> DataFrame:
    """R2 of each factor per component, with the factor's kind (technical or biological)."""
    names = list(factors)
    long = df.select(component, value, F.explode(F.array(*[
        F.struct(F.lit(f).alias("factor"), F.lit(k).alias("kind"), c(f).cast("string").alias("level")) for f, k in factors.items()
    ])).alias("f")).select(component, value, "f.*")
    assert names
    return anova(long, [component, "factor", "kind"], "level", value).select(component, "factor", "kind", "r_squared")


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Independence test of two labels with Cramer's V; Yates correction for 2x2."""
    cells = df.groupBy(row, column).agg(n_rows().alias("o"))
    rows, cols = cells.groupBy(row).agg(F.sum("o").alias("r")), cells.groupBy(column).agg(F.sum("o").alias("k"))
    packed = cols.agg(F.collect_list(F.struct(column, "k")).alias("cs"), F.sum("k").alias("n"), n_rows().alias("n_cols")).withColumn("__all", F.lit(0))
    grid = attach(rows.withColumn("__all", F.lit(0)), packed, ["__all"]).select(row, "r", "n", "n_cols", F.explode("cs").alias("cc"))
    grid = grid.select(row, F.col(f"cc.{column}").alias(column), (F.col("r") * F.col("cc.k") / F.col("n")).alias("e"), "n", "n_cols")
    full = grid.join(cells, [row, column], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    dev = F.abs(F.col("o") - F.col("e"))
    plain, yates = dev * dev / F.col("e"), F.pow(dev - F.least(F.lit(0.5), dev), 2) / F.col("e")
    s = full.agg(
        F.sum(plain).alias("plain"), F.sum(yates).alias("yates"), F.max("n").alias("n"),
        F.count_distinct(row).alias("n_rows"), F.max("n_cols").alias("n_cols"),
    )
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    chi = F.when(dof == 1, F.col("yates")).otherwise(F.col("plain"))
    v = F.sqrt(chi / (F.col("n") * F.least(F.col("n_rows") - 1, F.col("n_cols") - 1)))
    return s.select(chi.alias("chi2"), dof.alias("dof"), F.col("n"), v.alias("cramers_v"))


def with_chi2_p(m: DataFrame, out: str = "chi2_p") -> DataFrame:
    return m.withColumn(out, dist.call("chi2_p", F.col("chi2"), F.col("dof")))


def label_vs_rest(df: DataFrame, group: str, a: str, b: str, label: str) -> DataFrame:
    """2x2 counts per label against the rest between two groups, with the odds ratio."""
    n = df.where(c(group).isin(a, b)).groupBy(label).agg(F.count_if(c(group) == a).alias("a"), F.count_if(c(group) == b).alias("b"))
    t = with_group_stats(n, [], [F.sum("a").alias("ta"), F.sum("b").alias("tb")])
    t = t.select(label, "a", "b", (F.col("ta") - F.col("a")).alias("c"), (F.col("tb") - F.col("b")).alias("d"))
    odds = F.when((F.col("b") > 0) & (F.col("c") > 0), F.col("a") * F.col("d") / (F.col("b") * F.col("c"))).otherwise(F.lit(float("inf")))
    return t.withColumn("odds_ratio", odds)


def with_fisher_p(m: DataFrame, label: str, out: str = "fisher_p") -> DataFrame:
    p = m.withColumn(out, dist.call("fisher_p", F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    return adjust_p(p, [], out, [label], "bonferroni", out=f"{out}_bonferroni")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key, on the distinct (x, y) pairs with their multiplicity."""
    keys = list(keys)
    rows = df.where(c(x).isNotNull() & c(y).isNotNull())
    joint = rows.groupBy(*keys, x, y).agg(n_rows().alias("m"))
    rx = tie_ranks(rows, keys, x).select(*keys, x, F.col("avg_rank").alias("rx"))
    ry = tie_ranks(rows, keys, y).select(*keys, y, F.col("avg_rank").alias("ry"))
    n = rows.groupBy(*keys).agg(n_rows().alias("n"))
    j = attach(joint, n, keys).join(rx, [*keys, x]).join(ry, [*keys, y])
    mid = (F.col("n") + 1) / 2.0
    dx, dy, m = F.col("rx") - mid, F.col("ry") - mid, F.col("m")
    s = j.groupBy(*keys, "n").agg(F.sum(m * dx * dy).alias("sxy"), F.sum(m * dx * dx).alias("sxx"), F.sum(m * dy * dy).alias("syy"))
    return s.select(*keys, "n", F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("spearman_r"))


def guarded_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 10) -> DataFrame:
    """Pearson and Spearman with a note where they are not defined; also the least-squares line."""
    keys = list(keys)
    ok = df.where(c(x).isNotNull() & c(y).isNotNull() & ~F.isnan(c(x)) & ~F.isnan(c(y)))
    p = ok.groupBy(*keys).agg(
        n_rows().alias("n"), F.corr(x, y).alias("r"), F.regr_slope(c(y), c(x)).alias("slope"),
        F.regr_intercept(c(y), c(x)).alias("intercept"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"),
    )
    s = spearman(ok, keys, x, y).select(*keys, "spearman_r")
    j = p.join(s, keys, "left")
    note = F.when(F.col("n") < min_n, "insufficient_data").when((F.col("sx") == 0) | (F.col("sy") == 0), "zero_variance")
    t = j.withColumn("note", note)
    good = F.col("note").isNull()
    return t.select(
        *keys, "n", F.when(good, F.col("r")).alias("pearson_r"), F.when(good, F.col("spearman_r")).alias("spearman_r"),
        F.when(good, F.col("slope")).alias("slope"), F.when(good, F.col("intercept")).alias("intercept"), "note",
    )


def with_correlation_p(m: DataFrame, r: str, out: str, n: str = "n") -> DataFrame:
    """Two-sided p of a correlation by the t approximation."""
    t = c(r) * F.sqrt((c(n) - 2) / ((1 - c(r)) * (1 + c(r))))
    return m.withColumn(out, F.when(F.abs(c(r)) >= 1, 0.0).otherwise(dist.call("t_p", t, c(n) - 2)))


def rna_protein_correlation(counts: DataFrame, protein: DataFrame, pairs: DataFrame, sample: Sequence[str], min_cells: int = 100) -> DataFrame:
    """Correlation of each mapped protein and gene over the sample's cells; cells with neither are left out."""
    keys = list(sample)
    mapped = protein.join(pairs.withColumnRenamed("protein", "marker"), "marker")
    both = mapped.join(counts.select(*keys, "cell_id", "gene", c("count").alias("rna")), [*keys, "cell_id", "gene"], "left")
    both = both.withColumn("rna", F.coalesce("rna", F.lit(0.0))).where((F.col("intensity") > 0) | (F.col("rna") > 0))
    out = guarded_correlation(both, [*keys, "marker", "gene"], "intensity", "rna", min_n=0)
    return out.where(F.col("n") >= min_cells).select(*keys, "marker", "gene", "n", "pearson_r", "spearman_r")


def match_gene_map(proteins: DataFrame, genes: DataFrame, mode: str = "exact") -> DataFrame:
    """Protein to gene pairs by exact, case-insensitive or substring name match (panel-sized tables)."""
    if mode == "exact":
        return proteins.join(genes, proteins["protein"] == genes["gene"])
    if mode == "ignore_case":
        return proteins.join(genes, F.lower("protein") == F.lower("gene"))
    packed = genes.agg(F.collect_set("gene").alias("gs")).withColumn("__all", F.lit(0))
    j = attach(proteins.withColumn("__all", F.lit(0)), packed, ["__all"]).drop("__all")
    hits = F.filter("gs", lambda g: F.contains(F.upper(g), F.upper(F.col("protein"))))
    return j.select("protein", F.explode(hits).alias("gene"))


def correlation_matrix(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.groupBy(*keys).agg(*[F.corr(c(a), c(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")


def hash_index(seed: int, n: Column, *parts: Column) -> Column:
    """A reproducible index in 1..n from hashed parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n + 1


def bootstrap_ci(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, id_col: str, value: str = "value", n_boot: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile intervals of effect size, fold change and mean difference by resampling within groups."""
    keys = list(keys)
    rows = df.where(c(group).isin(a, b) & c(value).isNotNull()).select(*keys, c(group).alias("g"), c(id_col).alias("id"), c(value).alias("v"))
    sizes = rows.groupBy(*keys, "g").agg(n_rows().alias("n"))
    numbered = row_numbers(rows, [*keys, "g"], ["id"], "i")
    slots = attach(numbered.select(*keys, "g", F.col("i").alias("slot")), sizes, [*keys, "g"])
    draws = slots.select(*keys, "g", "slot", "n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep"))
    draws = draws.withColumn("i", hash_index(seed, F.col("n"), F.col("rep"), F.col("g"), F.col("slot")))
    picked = draws.join(numbered.select(*keys, "g", "i", "v"), [*keys, "g", "i"])
    m = effect_columns(two_group_moments(picked, [*keys, "rep"], "g", a, b, "v"))
    m = m.withColumn("fold_change", F.when(F.col("mean2") != 0, F.col("mean1") / F.col("mean2")))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    wanted = {}
    for col in ("effect_size", "fold_change", "mean_diff"):
        wanted[f"{col}_lower"], wanted[f"{col}_upper"] = (col, lo), (col, hi)
    return exact_quantiles(m, keys, wanted)


def leave_one_out(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, id_col: str, value: str = "value") -> DataFrame:
    """The two-group record with each row removed in turn, by subtracting that row from the totals.

    Means and variances come from shifted sums; U loses the removed row's own wins, which are its overall rank
    minus its rank within its group. No self-join.
    """
    keys = list(keys)
    rows = df.where(c(group).isin(a, b) & c(value).isNotNull()).select(*keys, c(group).alias("g"), c(id_col).alias("removed"), c(value).alias("value"))
    rows = with_group_stats(rows, keys, [F.avg("value").alias("__mid")]).withColumn("s", F.col("value") - F.col("__mid"))
    tot = rows.groupBy(*keys, "__mid").agg(*[
        agg.alias(f"{n}_{i}") for i, g in enumerate((a, b)) for n, agg in (
            ("n", F.count(F.when(F.col("g") == g, 1))),
            ("s", F.coalesce(F.sum(F.when(F.col("g") == g, F.col("s"))), F.lit(0.0))),
            ("q", F.coalesce(F.sum(F.when(F.col("g") == g, F.col("s") * F.col("s"))), F.lit(0.0))),
        )
    ])
    in_a = F.col("g") == a
    u = mann_whitney(rows, keys, "g", a, b).select(*keys, "u_stat", "tie_term")
    ranks = tie_ranks(rows, keys, "value").select(*keys, "value", F.col("avg_rank").alias("r_all"), F.col("cnt").alias("ties"))
    within = tie_ranks(rows, [*keys, "g"], "value").select(*keys, "g", "value", F.col("avg_rank").alias("r_own"))
    j = attach(rows.drop("__mid"), tot.join(u, keys), keys).join(ranks, [*keys, "value"]).join(within, [*keys, "g", "value"])
    cut = {i: F.when(in_a if i == 0 else ~in_a, 1).otherwise(0) for i in (0, 1)}
    sel = {}
    for i in (0, 1):
        n = F.col(f"n_{i}") - cut[i]
        s = F.col(f"s_{i}") - cut[i] * F.col("s")
        q = F.col(f"q_{i}") - cut[i] * F.col("s") * F.col("s")
        sel[f"n{i + 1}"] = n
        sel[f"mean{i + 1}"] = F.when(n > 0, s / n + F.col("__mid"))
        sel[f"var{i + 1}"] = F.when(n > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))
    # the removed row beat this many rows of the other group (ties count half)
    wins = F.col("r_all") - F.col("r_own")
    other = F.when(in_a, F.col("n_1")).otherwise(F.col("n_0"))
    u_left = F.when(in_a, F.col("u_stat") - wins).otherwise(F.col("u_stat") - (other - wins))
    t = F.col("ties").cast("double")
    tie_left = F.col("tie_term") - (t * t * t - t) + (F.pow(t - 1, 3) - (t - 1))
    m = j.select(*keys, F.col("g").alias("removed_group"), "removed", *[v.alias(k) for k, v in sel.items()], u_left.alias("u_stat"), tie_left.alias("tie_term"))
    return effect_columns(welch_columns(m))


def sensitivity_range(loo: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest and largest p over all removals."""
    p = with_dual_p(loo)
    return p.groupBy(*keys).agg(
        F.min("welch_p").alias("loo_welch_min"), F.max("welch_p").alias("loo_welch_max"),
        F.min("mwu_p").alias("loo_mwu_min"), F.max("mwu_p").alias("loo_mwu_max"),
    )


def full_battery(df: DataFrame, keys: Sequence[str], group: str, a: str, b: str, id_col: str, value: str = "value", n_boot: int = 1000) -> DataFrame:
    """Dual test, intervals, leave-one-out range and interpretation for every metric."""
    base = with_dual_p(dual_test(df, keys, group, a, b, value))
    ci = bootstrap_ci(df, keys, group, a, b, id_col, value, n_boot)
    loo = sensitivity_range(leave_one_out(df, keys, group, a, b, id_col, value), keys)
    j = base.join(ci, list(keys), "left").join(loo, list(keys), "left")
    min_p = F.least("welch_p", "mwu_p")
    return j.withColumn("interpretation", sc.significance_label(min_p, F.col("effect_size"), F.col("n1"), F.col("n2")))


def pseudobulk_de(values: DataFrame, keys: Sequence[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """Per gene between two stages: U, means, log2 of the ratio of means; genes with two rows per side."""
    m = two_group_moments(values, [*keys, "gene"], group, a, b, value).where("n1 >= 2 and n2 >= 2")
    u = mann_whitney(values, [*keys, "gene"], group, a, b, value).select(*keys, "gene", "u_stat", "tie_term")
    inf = F.lit(float("inf"))
    m1, m2 = F.col("mean1"), F.col("mean2")
    lfc = F.when((m1 > 0) & (m2 > 0), F.log2(m1 / m2)).when(m1 > m2, inf).when(m1 < m2, -inf).otherwise(0.0)
    return m.join(u, [*keys, "gene"]).withColumn("log2fc", lfc).drop("var1", "var2")


def with_de_q(de: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p, and Benjamini-Hochberg with missing p counted as 1; smallest p first."""
    p = with_mwu_p(de, "pval")
    return adjust_p(p, keys, "pval", ["gene"], "bh", "one", "qval_bh").orderBy("pval", "gene")


def rank_sum_de(expr: DataFrame, cells: DataFrame, group: str, groups: Sequence[str], value: str = "lognorm", min_cells: int = 10) -> DataFrame:
    """Rank-sum differential expression of each group against the rest, zeros ranked analytically.

    Only stored (positive) values are ordered; the zero block of a gene has one known average rank and shifts all
    others. The ranking is shared by all groups. ``expr`` has gene, group and value; ``cells`` one row per cell.
    """
    sizes = cells.agg(n_rows().alias("n"), *[F.count_if(c(group) == g).alias(f"n_{i}") for i, g in enumerate(groups)]).withColumn("__all", F.lit(0))
    hits = [F.count_if(c(group) == g).alias(f"k_{i}") for i, g in enumerate(groups)]
    ranked = tie_ranks(expr.where(c(value) > 0), ["gene"], value, hits)
    per = ranked.groupBy("gene").agg(
        F.sum("cnt").alias("nnz"), F.sum(c(value) * F.col("cnt")).alias("s"),
        *[x for i in range(len(groups)) for x in (
            F.sum(f"k_{i}").alias(f"nz_{i}"), F.sum(F.col(f"k_{i}") * F.col("avg_rank")).alias(f"r_{i}"), F.sum(F.col(f"k_{i}") * c(value)).alias(f"s_{i}"))],
    ).withColumn("__all", F.lit(0))
    j = attach(per, sizes, ["__all"])
    # doubles: the product of three counts leaves the longs at some four million cells
    n, structs = F.col("n").cast("double"), []
    zeros = n - F.col("nnz")
    for i, g in enumerate(groups):
        n1 = F.col(f"n_{i}").cast("double")
        n2 = n - n1
        r1 = F.col(f"r_{i}") + F.col(f"nz_{i}") * zeros + (n1 - F.col(f"nz_{i}")) * (zeros + 1) / 2
        z = (r1 - n1 * (n + 1) / 2) / F.sqrt(n1 * n2 * (n + 1) / 12)
        m1, m2 = F.col(f"s_{i}") / n1, (F.col("s") - F.col(f"s_{i}")) / n2
        lfc = F.log2((F.expm1(m1) + 1e-9) / (F.expm1(m2) + 1e-9))
        structs.append(F.when((n1 >= min_cells) & (n2 >= min_cells), F.struct(F.lit(g).alias("group"), z.alias("z_score"), lfc.alias("logfc"))))
    return j.select("gene", F.explode(F.array_compact(F.array(*structs))).alias("d")).select("gene", "d.*")


def with_rank_sum_q(de: DataFrame) -> DataFrame:
    return adjust_p(de.withColumn("pval", dist.call("normal_p", F.col("z_score"))), ["group"], "pval", ["gene"], "bh", out="padj")


def composition_test(shares: DataFrame, label: str, group: str, a: str, b: str, share: str = "share") -> DataFrame:
    """Share of each type between two groups of samples: means, log2 fold change b over a, Welch statistic."""
    m = welch_columns(two_group_moments(shares, [label], group, a, b, share))
    return m.withColumn("log2fc", sc.log2_ratio_offset(F.col("mean2"), F.col("mean1")))


def progression(df: DataFrame, keys: Sequence[str], stage: str, order: Sequence[str], value: str = "value", min_samples: int = 4) -> DataFrame:
    """Kruskal over stages and Spearman against the stage's ordinal position."""
    ordinal = F
    for i, s in enumerate(order):
        ordinal = ordinal.when(c(stage) == s, float(i))
    rows = df.withColumn("__ord", ordinal.otherwise(None)).where("__ord is not null")
    k = kruskal(rows, keys, stage, value, min_n=1).select(*keys, "n_total", "n_groups", "h_stat")
    r = spearman(rows, keys, "__ord", value).select(*keys, "spearman_r")
    return k.join(r, list(keys)).where(F.col("n_total") >= min_samples)


def ratio_tests(ratios: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Both tests of every cell-type ratio between two groups of samples, each with its false discovery rate."""
    keys = ["type_a", "type_b"]
    m = with_dual_p(dual_test(ratios, keys, group, a, b, "ratio"))
    for p in ("welch_p", "mwu_p"):
        m = adjust_p(m, [], p, keys, "bh", out=f"{p}_fdr")
    return m


def over_representation(hits: DataFrame, sets: DataFrame) -> DataFrame:
    """Overlap of a gene list with each gene set: count and share of the set."""
    size = sets.groupBy("name").agg(F.count_distinct("gene").alias("set_size"))
    n = sets.select("name", "gene").distinct().join(hits.select("gene").distinct(), "gene", "left_semi").groupBy("name").agg(n_rows().alias("overlap"))
    j = size.join(n, "name", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    return j.withColumn("ratio", F.col("overlap") / F.col("set_size"))
