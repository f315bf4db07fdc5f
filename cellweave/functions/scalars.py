"""Column-level derivations: normalisation, fold changes, gates, scores, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.scale import attach, c, exact_quantiles, with_group_stats, with_quantiles, zscored

# ---------------------------------------------------------------------------------------------- normalise


def log_normalised(counts: DataFrame, cell: Sequence[str], target: float = 1e4, count: str = "count", out: str = "lognorm") -> DataFrame:
    """Library-size scaling and log1p as a new column; ``count`` itself is never overwritten.

    The window spans the genes of one cell, a group bounded by the panel size.
    """
    total = F.sum(c(count)).over(Window.partitionBy(*[c(k) for k in cell]))
    return counts.withColumn(out, F.log1p(c(count) * target / total))


def log_cpm(pseudobulk: DataFrame, unit: Sequence[str], value: str = "total", out: str = "logcpm") -> DataFrame:
    """Counts per million and log1p on pseudobulk rows (window over the genes of one unit)."""
    total = F.sum(c(value)).over(Window.partitionBy(*[c(k) for k in unit]))
    return pseudobulk.withColumn(out, F.when(total > 0, F.log1p(c(value) * 1e6 / total)).otherwise(0.0))


def log2_ratio_offset(b: Column, a: Column, eps: float = 0.001) -> Column:
    """log2 of group b over group a with a small offset."""
    return F.log2((b + eps) / (a + eps))


def log2_ratio_guarded(a: Column, b: Column) -> Column:
    """log2(a/b): +Inf when only b is 0, -Inf when only a is 0, 0 when both are."""
    inf = F.lit(float("inf"))
    return (
        F.when((a > 0) & (b > 0), F.log2(a / b))
        .when((a > 0) & (b == 0), inf)
        .when((a == 0) & (b > 0), -inf)
        .otherwise(0.0)
    )


def plain_ratio(a: Column, b: Column) -> Column:
    """a/b: Inf when b is 0 and a positive, NaN when both are 0."""
    return F.when(b != 0, a / b).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))


# ------------------------------------------------------------------------------------------------- gating


@dataclass(frozen=True)
class Gate:
    label: str
    positive: tuple[str, ...]
    negative: tuple[str, ...] = ()


# Hierarchical gate, in application order (a later match overrides an earlier one).
HIERARCHICAL_GATE = [
    Gate("Epithelial", ("PanCK",), ("CD45",)),
    Gate("Stromal", ("aSMA",), ("PanCK", "CD45")),
    Gate("Endothelial", ("CD31",), ("PanCK", "CD45")),
    Gate("CD8_T", ("CD45", "CD3", "CD8"), ("CD4",)),
    Gate("Treg", ("CD45", "CD3", "CD4", "FOXP3"), ("CD8",)),
    Gate("CD4_T", ("CD45", "CD3", "CD4"), ("CD8", "FOXP3")),
    Gate("T_cell", ("CD45", "CD3"), ("CD4", "CD8")),
    Gate("B_cell", ("CD45", "CD20"), ("CD3",)),
    Gate("Macrophage", ("CD45", "CD68"), ("CD3", "CD20")),
    Gate("DC", ("CD45", "CD11c", "HLA-DR"), ("CD3", "CD20", "CD68")),
]
IMMUNE_FALLBACK = Gate("Immune_other", ("CD45",))

# The looser gate, in application order (a later match overrides an earlier one).
LOOSE_GATE = [
    Gate("Epithelial", ("PanCK",)),
    Gate("Stromal", ("aSMA",), ("PanCK",)),
    Gate("Endothelial", ("CD31",)),
    Gate("Macrophage", ("CD45", "CD68")),
    Gate("B_cell", ("CD45", "CD20")),
    Gate("T_cell", ("CD45", "CD3")),
    Gate("CD8_T", ("CD45", "CD3", "CD8")),
    Gate("CD4_T", ("CD45", "CD3", "CD4")),
    Gate("Treg", ("CD45", "CD3", "CD4", "FOXP3")),
    Gate("DC", ("CD45", "CD11c", "HLA-DR")),
]

IMMUNE_TYPES = ["CD8_T", "CD4_T", "Treg", "T_cell", "B_cell", "Macrophage", "DC", "Immune_other"]
T_CELL_TYPES = ["CD8_T", "CD4_T", "T_cell", "Treg"]

# Decision list on z-scores, first match wins: (label, ((marker, cut), ...)).
DECISION_LIST = [
    ("Epithelial", (("PanCK", 1.0),)),
    ("CD8+ T cell", (("CD8", 0.5),)),
    ("Treg", (("CD4", 0.5), ("FOXP3", 0.5))),
    ("CD4+ T cell", (("CD4", 0.5),)),
    ("T cell", (("CD3", 0.5),)),
    ("B cell", (("CD20", 0.5),)),
    ("Macrophage", (("CD68", 0.5),)),
    ("Dendritic cell", (("CD11c", 0.5),)),
    ("Fibroblast", (("aSMA", 0.5),)),
    ("Endothelial", (("CD31", 0.5),)),
    ("Other immune", (("CD45", 0.5),)),
]

# One marker per lineage, in column order.
LINEAGE_MARKERS = {"epithelial": "PanCK", "immune": "CD45", "stromal": "aSMA", "endothelial": "CD31"}

# Immune refinement, in application order (a later match overrides an earlier one).
IMMUNE_REFINEMENT = [
    ("T_cell", ("CD3",)),
    ("CD4_T", ("CD3", "CD4")),
    ("CD8_T", ("CD3", "CD8")),
    ("Treg", ("CD3", "CD4", "FOXP3")),
    ("B_cell", ("CD20",)),
    ("Macrophage", ("CD68",)),
    ("DC", ("CD11c", "HLA-DR")),
    ("Proliferating", ("KI67",)),
    ("PD1_positive", ("PD1",)),
    ("PDL1_positive", ("PDL1",)),
]

# Positive and negative markers per type.
SIGNED_MARKERS = [
    Gate("T cell (CD4+)", ("CD3", "CD4", "CD45"), ("CD8", "CD20", "CD68")),
    Gate("T cell (CD8+)", ("CD3", "CD8", "CD45"), ("CD4", "CD20", "CD68")),
    Gate("Treg", ("CD3", "CD4", "FOXP3", "CD45"), ("CD8",)),
    Gate("B cell", ("CD20", "CD45"), ("CD3", "CD68")),
    Gate("Macrophage", ("CD68", "CD45"), ("CD3", "CD20")),
    Gate("Dendritic cell", ("CD11c", "HLA-DR", "CD45"), ("CD3", "CD20", "CD68")),
    Gate("Epithelial", ("PanCK",), ("CD45", "aSMA", "CD31")),
    Gate("Fibroblast", ("aSMA",), ("CD45", "PanCK", "CD31")),
    Gate("Endothelial", ("CD31",), ("CD45", "PanCK", "aSMA")),
    Gate("Immune (other)", ("CD45",), ("CD3", "CD20", "CD68", "CD11c")),
]
LINEAGE_SIGNED = [
    Gate("Epithelial", ("PanCK",), ("CD45", "aSMA", "CD31")),
    Gate("Immune", ("CD45",), ("PanCK",)),
    Gate("Stromal", ("aSMA",), ("CD45", "PanCK")),
    Gate("Endothelial", ("CD31",), ("CD45", "PanCK")),
]
IMMUNE_SIGNED = [
    Gate("T_cell", ("CD3",), ("CD20", "CD68")),
    Gate("CD4_T", ("CD3", "CD4"), ("CD8",)),
    Gate("CD8_T", ("CD3", "CD8"), ("CD4",)),
    Gate("Treg", ("CD3", "CD4", "FOXP3"), ("CD8",)),
    Gate("B_cell", ("CD20",), ("CD3",)),
    Gate("Macrophage", ("CD68",), ("CD3", "CD20")),
    Gate("Dendritic", ("CD11c", "HLA-DR"), ("CD68",)),
]

# Marker pairs that should not be high together.
GRADED_CONFLICTS = [("PanCK", "CD45"), ("PanCK", "aSMA"), ("CD45", "aSMA"), ("CD31", "CD45"), ("CD3", "CD68"), ("CD4", "CD8")]
COUNTED_CONFLICTS = [*GRADED_CONFLICTS, ("CD3", "PanCK")]
ADMIX_PERCENTILE = 0.7
ADMIX_CUTOFF = 0.3


def gate_markers(gates: Sequence[Gate]) -> list[str]:
    return list(dict.fromkeys(m for g in gates for m in (*g.positive, *g.negative)))


def conjunction(gate: Gate, is_high) -> Column:
    test = F.lit(True)
    for m in gate.positive:
        test = test & is_high(m)
    for m in gate.negative:
        test = test & ~is_high(m)
    return test


def last_match(gates: Sequence[Gate], is_high, fallback: Gate | None, default: str = "Other") -> Column:
    """Label of the last matching rule: the rule list read backwards as one CASE expression."""
    expr = F
    for gate in reversed(list(gates)):
        expr = expr.when(conjunction(gate, is_high), gate.label)
    if fallback is not None:
        expr = expr.when(conjunction(fallback, is_high), fallback.label)
    return expr.otherwise(default)


def gate_by_quantile(df: DataFrame, keys: Sequence[str], q: float, gates: Sequence[Gate], fallback: Gate | None = None, out: str = "gated_type", keep_thresholds: Sequence[str] = ()) -> DataFrame:
    """Gate with per-group quantile thresholds (positive means strictly above)."""
    markers = gate_markers([*gates, *([fallback] if fallback else [])])
    markers += [m for m in keep_thresholds if m not in markers]
    t = with_quantiles(df, keys, {f"__t_{m}": (m, q) for m in markers})
    labelled = t.withColumn(out, last_match(gates, lambda m: c(m) > c(f"__t_{m}"), fallback))
    drop = [f"__t_{m}" for m in markers if m not in keep_thresholds]
    return labelled.drop(*drop)


def decide_by_zscore(df: DataFrame, keys: Sequence[str], rules=DECISION_LIST, out: str = "gated_type") -> DataFrame:
    """First rule whose z-scores all exceed their cuts; a rule on an absent marker never fires."""
    markers = [m for m in dict.fromkeys(m for _, conds in rules for m, _ in conds) if m in df.columns]
    z = zscored(df, keys, markers, ddof=0, floor=0.0, suffix="__z")
    expr = F
    for label, conds in rules:
        test = F.lit(all(m in markers for m, _ in conds))
        for m, cut in conds:
            if m in markers:
                test = test & (c(f"{m}__z") > cut)
        expr = expr.when(test, label)
    return z.withColumn(out, expr.otherwise("Other")).drop(*[f"{m}__z" for m in markers])


def arg_max(cols: Mapping[str, Column]) -> tuple[Column, Column]:
    """(name, value) of the largest of several columns; ties go to the first."""
    best = F.greatest(*cols.values()) if len(cols) > 1 else next(iter(cols.values()))
    expr = F
    for name, v in cols.items():
        expr = expr.when(v == best, name)
    return expr.otherwise(None), best


def assign_by_scores(df: DataFrame, scores: Mapping[str, Column], min_diff: float = 0.1) -> DataFrame:
    """Arg-max label; Unknown when the best is negative, Low_Confidence when the runner-up is close."""
    name, best = arg_max(scores)
    ordered = F.sort_array(F.array(*scores.values()), asc=False)
    label = F.when(best < 0, "Unknown").when(ordered[0] - ordered[1] < min_diff, "Low_Confidence").otherwise(name)
    return df.withColumn("assigned", label).withColumn("best_score", best)


def lineage_by_zscore(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lineage with the highest marker z-score."""
    z = zscored(df, keys, list(LINEAGE_MARKERS.values()), ddof=1, floor=0.0, eps=1e-8, suffix="__z")
    name, best = arg_max({lin: c(f"{m}__z") for lin, m in LINEAGE_MARKERS.items()})
    return z.withColumn("lineage", name).withColumn("lineage_score", best).drop(*[f"{m}__z" for m in LINEAGE_MARKERS.values()])


def refine_immune(df: DataFrame, keys: Sequence[str], out: str = "refined_type") -> DataFrame:
    """Within immune cells, the last type all of whose markers exceed the immune median."""
    markers = list(dict.fromkeys(m for _, ms in IMMUNE_REFINEMENT for m in ms))
    medians = exact_quantiles(df.where("lineage = 'immune'"), keys, {f"__md_{m}": (m, 0.5) for m in markers})
    t = attach(df, medians, keys)
    expr = F.when(F.col("lineage") != "immune", F.col("lineage"))
    for label, ms in reversed(IMMUNE_REFINEMENT):
        test = F.lit(True)
        for m in ms:
            test = test & (c(m) > c(f"__md_{m}"))
        expr = expr.when(test, label)
    return t.withColumn(out, expr.otherwise(F.col("lineage"))).drop(*[f"__md_{m}" for m in markers])


def signed_score(gate: Gate, value=c, penalty: float = 0.5) -> Column:
    """Mean of the positive markers minus half the mean of the negative ones."""
    mean = lambda ms: sum((value(m) for m in ms), F.lit(0.0)) / len(ms)
    return mean(gate.positive) - penalty * mean(gate.negative) if gate.negative else mean(gate.positive)


def label_by_signed_score(df: DataFrame, keys: Sequence[str], gates: Sequence[Gate] = SIGNED_MARKERS, min_score: float = 0.5, out: str = "scored_type") -> DataFrame:
    markers = gate_markers(gates)
    z = zscored(df, keys, markers, ddof=0, floor=0.0, eps=1e-8, suffix="__z")
    name, best = arg_max({g.label: signed_score(g, lambda m: c(f"{m}__z")) for g in gates})
    done = z.withColumn(out, F.when(best >= min_score, name).otherwise("Unknown")).withColumn(f"{out}_score", best)
    return done.drop(*[f"{m}__z" for m in markers])


# ----------------------------------------------------------------------------------- robust scale, softmax


def robust_scaled(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str], low: float, high: float, eps: float = 1e-10) -> DataFrame:
    """New columns scaled to [0, 1] between two quantiles; ``cols`` maps output to input name."""
    wanted = {}
    for out, src in cols.items():
        wanted[f"__lo_{out}"] = (src, low)
        wanted[f"__hi_{out}"] = (src, high)
    t = with_quantiles(df, keys, wanted)
    for out, src in cols.items():
        lo, hi = c(f"__lo_{out}"), c(f"__hi_{out}")
        t = t.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c(src) - lo) / (hi - lo + eps))))
    return t.drop(*wanted)


def softmax(cols: Mapping[str, Column], factor: float) -> dict[str, Column]:
    e = {n: F.exp(v * factor) for n, v in cols.items()}
    total = sum(e.values(), F.lit(0.0))
    return {n: v / total for n, v in e.items()}


def normalised_entropy(ps: Sequence[Column], floor: float = 1e-10) -> Column:
    """Entropy of a few probabilities divided by its maximum."""
    clipped = [F.greatest(p, F.lit(floor)) for p in ps]
    return -sum((p * F.log(p) for p in clipped), F.lit(0.0)) / F.log(F.lit(float(len(ps))))


def lineage_probabilities(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Softmax over P1-P99 scaled lineage markers, with normalised entropy."""
    t = robust_scaled(df, keys, {f"s_{lin}": m for lin, m in LINEAGE_MARKERS.items()}, 0.01, 0.99)
    ps = softmax({lin: c(f"s_{lin}") for lin in LINEAGE_MARKERS}, 3.0)
    for lin, p in ps.items():
        t = t.withColumn(f"p_{lin}", p)
    return t.withColumn("lineage_entropy", normalised_entropy([c(f"p_{lin}") for lin in LINEAGE_MARKERS])).drop(
        *[f"s_{lin}" for lin in LINEAGE_MARKERS]
    )


def lineage_assignment(df: DataFrame, keys: Sequence[str], gates: Sequence[Gate] = LINEAGE_SIGNED, temperature: float = 2.0) -> DataFrame:
    """Signed scores, P5-P95 scaling, softmax at a temperature; label, confidence and entropy."""
    t = df
    for g in gates:
        t = t.withColumn(f"__raw_{g.label}", signed_score(g))
    t = robust_scaled(t, keys, {f"s_{g.label}": f"__raw_{g.label}" for g in gates}, 0.05, 0.95)
    name, _ = arg_max({g.label: c(f"s_{g.label}") for g in gates})
    ps = softmax({g.label: c(f"s_{g.label}") for g in gates}, 1.0 / temperature)
    for label, p in ps.items():
        t = t.withColumn(f"p_{label}", p)
    probs = [c(f"p_{g.label}") for g in gates]
    entropy = -sum((p * F.log(p + 1e-10) for p in probs), F.lit(0.0)) / F.log(F.lit(float(len(gates))))
    t = t.withColumn("lineage", name).withColumn("lineage_confidence", F.greatest(*probs)).withColumn("lineage_entropy", entropy)
    return t.drop(*[f"__raw_{g.label}" for g in gates], *[f"s_{g.label}" for g in gates])


# --------------------------------------------------------------------------------------------- admixture


def graded_conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of markers both above P70: number, and mean of the smaller scaled excess."""
    markers = list(dict.fromkeys(m for p in GRADED_CONFLICTS for m in p))
    t = with_quantiles(df, keys, {f"__t_{m}": (m, ADMIX_PERCENTILE) for m in markers})
    t = with_group_stats(t, keys, [F.max(c(m)).alias(f"__x_{m}") for m in markers])
    excess = {
        m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c(m) - c(f"__t_{m}")) / (c(f"__x_{m}") - c(f"__t_{m}") + 1e-10)))
        for m in markers
    }
    n = F.lit(0)
    score = F.lit(0.0)
    for a, b in GRADED_CONFLICTS:
        n = n + ((c(a) > c(f"__t_{a}")) & (c(b) > c(f"__t_{b}"))).cast("int")
        score = score + F.least(excess[a], excess[b])
    t = t.withColumn("n_conflicts", n).withColumn("conflict_score", score / len(GRADED_CONFLICTS))
    return t.drop(*[f"__t_{m}" for m in markers], *[f"__x_{m}" for m in markers])


def counted_conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of conflicting pairs that are both high, and the admixture flag."""
    markers = list(dict.fromkeys(m for p in COUNTED_CONFLICTS for m in p))
    t = with_quantiles(df, keys, {f"__t_{m}": (m, ADMIX_PERCENTILE) for m in markers})
    n = F.lit(0)
    for a, b in COUNTED_CONFLICTS:
        n = n + ((c(a) > c(f"__t_{a}")) & (c(b) > c(f"__t_{b}"))).cast("int")
    score = n / len(COUNTED_CONFLICTS)
    t = t.withColumn("admixture_score", score)
    return t.withColumn("is_admixed", F.col("admixture_score") > ADMIX_CUTOFF).drop(*[f"__t_{m}" for m in markers])


def composite_admixture(df: DataFrame) -> DataFrame:
    """Weighted admixture from conflict_score, neighborhood_consistency and lineage_entropy."""
    score = 0.5 * F.col("conflict_score") + 0.3 * (1 - F.col("neighborhood_consistency")) + 0.2 * F.col("lineage_entropy")
    return df.withColumn("admixture_score", score).withColumn("admixture_flag", F.col("admixture_score") > ADMIX_CUTOFF)


def composite_segmentation_qc(df: DataFrame, keys: Sequence[str], admix: str, density: str, boundary: str, genes: str) -> DataFrame:
    """0.4 admixture + 0.3 density + 0.2 closeness to the boundary + 0.1 low gene count."""
    t = robust_scaled(df, keys, {"density_score": density, "__gene": genes}, 0.05, 0.95)
    t = with_quantiles(t, keys, {"__edge": (boundary, 0.95)})
    t = t.withColumn("boundary_score", 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(boundary) / F.col("__edge"))))
    t = t.withColumn("gene_score", 1 - F.col("__gene"))
    score = 0.4 * c(admix) + 0.3 * F.col("density_score") + 0.2 * F.col("boundary_score") + 0.1 * F.col("gene_score")
    return t.withColumn("composite_qc_score", score).drop("__gene", "__edge")


def qc_subsets(df: DataFrame, keys: Sequence[str], baseline: Column, score: str, flag: str | None) -> DataFrame:
    """Membership in the baseline, strict (score under P90) and clean subsets."""
    t = with_quantiles(df, keys, {"__p90": (score, 0.9), "__p70": (score, 0.7)})
    t = t.withColumn("baseline", baseline).withColumn("qc_strict", baseline & (c(score) < F.col("__p90")))
    by_score = baseline & (c(score) < F.col("__p70"))
    t = t.withColumn("clean_by_score", by_score)
    return t.withColumn("clean", baseline & ~c(flag) if flag else by_score).drop("__p90", "__p70")


# ------------------------------------------------------------------------------- deconvolution by scores


def scores_to_shares(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), threshold: float = 0.25) -> DataFrame:
    """Shift all scores by their overall minimum (+0.01), normalise rows; dominant type and row entropy."""
    low = F.min(F.least(*[c(n) for n in cols])).alias("__low")
    t = with_group_stats(df, keys, [low])
    shifted = {n: c(n) - F.col("__low") + 0.01 for n in cols}
    total = sum(shifted.values(), F.lit(0.0))
    for n in cols:
        t = t.withColumn(f"share_{n}", shifted[n] / total)
    name, best = arg_max({n: c(f"share_{n}") for n in cols})
    ps = [c(f"share_{n}") + 1e-10 for n in cols]
    psum = sum(ps, F.lit(0.0))
    entropy = -sum(((p / psum) * F.log(p / psum) for p in ps), F.lit(0.0))
    t = t.withColumn("dominant_type", F.when(best < threshold, "Mixed").otherwise(name))
    return t.withColumn("mixture_entropy", entropy).drop("__low")


# --------------------------------------------------------------------------------- gene and id patterns

# Gene-name patterns in order, case-insensitive, first match wins.
NCRNA_PATTERNS = [
    (r"^LINC\d+", "lincRNA"),
    (r"^LINC-", "lincRNA"),
    (r"^LOC\d{6,}", "lincRNA"),
    (r"^MIR\d+", "miRNA"),
    (r"^MIRLET\d+", "miRNA"),
    (r"^MIR\d+HG", "miRNA_host"),
    (r"^SNORD\d+", "snoRNA"),
    (r"^SNORA\d+", "snoRNA"),
    (r"^SNHG\d+", "snoRNA_host"),
    (r"-AS\d*$", "antisense"),
    (r"-IT\d*$", "intronic"),
    (r"-OT\d*$", "overlapping"),
    (r"^AC\d{6}\.\d+", "gencode_lncRNA"),
    (r"^AL\d{6}\.\d+", "gencode_lncRNA"),
    (r"^AP\d{6}\.\d+", "gencode_lncRNA"),
    (r"^BX\d{6}\.\d+", "gencode_lncRNA"),
    (r"^CR\d{6}\.\d+", "gencode_lncRNA"),
    (r"^CTD-\d+", "gencode_lncRNA"),
    (r"^CTB-\d+", "gencode_lncRNA"),
    (r"^CTC-\d+", "gencode_lncRNA"),
    (r"^RP\d+-\d+", "gencode_lncRNA"),
    (r"^RP\d+\.\d+", "gencode_lncRNA"),
    (r"^KB-\d+", "gencode_lncRNA"),
    (r"^AC\d{6}", "gencode_lncRNA"),
    (r"^AL\d{6}", "gencode_lncRNA"),
    (r"^NEAT\d+", "known_lncRNA"),
    (r"^MALAT\d*", "known_lncRNA"),
    (r"^XIST$", "known_lncRNA"),
    (r"^HOTAIR$", "known_lncRNA"),
    (r"^MEG\d+", "known_lncRNA"),
    (r"^H19$", "known_lncRNA"),
    (r"^KCNQ1OT\d*", "known_lncRNA"),
    (r"^PVT1$", "known_lncRNA"),
    (r"^GAS5$", "known_lncRNA"),
    (r"^DANCR$", "known_lncRNA"),
    (r"^TUG1$", "known_lncRNA"),
    (r"^ANRIL$", "known_lncRNA"),
    (r"^RN7S", "scRNA"),
    (r"^RNU\d+", "snRNA"),
    (r"^RNVU\d+", "snRNA"),
    (r"^RNA5S", "rRNA"),
    (r"^RNA5-", "rRNA"),
    (r"^MT-R", "mt_rRNA"),
    (r"^MT-T", "mt_tRNA"),
    (r"^VTRNA\d+", "vault_RNA"),
    (r"^RNY\d+", "Y_RNA"),
]

# Name fragments and their class; a gene may match several.
NCRNA_FRAGMENTS = [
    ("LINC", "Long intergenic ncRNA"),
    ("MIR", "miRNA host genes"),
    ("SNORD", "Small nucleolar RNA"),
    ("SNORA", "Small nucleolar RNA"),
    ("SNHG", "snoRNA host genes"),
    ("-AS", "Antisense transcripts"),
    ("AC0", "Ensembl lncRNA"),
    ("AL0", "Ensembl lncRNA"),
    ("AL1", "Ensembl lncRNA"),
    ("AP0", "Ensembl lncRNA"),
]


def gene_class(name: Column) -> Column:
    """Class of a gene by the first matching name pattern, else protein_coding."""
    expr = F
    for pattern, label in NCRNA_PATTERNS:
        expr = expr.when(name.rlike(f"(?i){pattern}"), label)
    return expr.otherwise("protein_coding")


def gene_fragment_classes(genes: DataFrame, name: str) -> DataFrame:
    """One row per (gene, matching fragment)."""
    hits = F.array(*[
        F.when(F.contains(F.upper(c(name)), F.lit(f)), F.struct(F.lit(f).alias("fragment"), F.lit(d).alias("class")))
        for f, d in NCRNA_FRAGMENTS
    ])
    return genes.select("*", F.explode(F.array_compact(hits)).alias("hit")).select(*[c(n) for n in genes.columns], "hit.*")


def parse_ids(df: DataFrame, sample: str, label: str) -> DataFrame:
    """Lane from the last character, prefix letters, and the first part of an underscore label."""
    return df.withColumn("lane_no", F.substring(c(sample), -1, 1)).withColumn(
        "prefix", F.regexp_replace(c(sample), r"\d+$", "")
    ).withColumn("base_type", F.element_at(F.split(c(label), "_"), 1))


# ------------------------------------------------------------------------------------------- text labels


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def significance_label(min_p: Column, d: Column, n1: Column, n2: Column) -> Column:
    """Interpretation text of a two-group comparison, with a note on small groups."""
    effect = F.when(d.isNull() | F.isnan(d), "indeterminate effect").otherwise(F.concat(effect_label(d), F.lit(" effect")))
    text = (
        F.when(min_p < 0.05, F.concat(F.lit("Significant at p<0.05 ("), effect, F.lit(")")))
        .when(min_p < 0.10, F.concat(F.lit("Trending (p<0.10): "), effect, F.lit(", hypothesis-generating")))
        .otherwise(F.concat(F.lit("Not significant ("), effect, F.lit(")")))
    )
    n = n1 + n2
    note = F.when(n < 10, "\nNote: VERY LIMITED POWER (n<10)").when(n < 20, "\nNote: Limited power (n<20)").otherwise("")
    return F.concat(text, note)


# Sample-level QC limits.
SAMPLE_LIMITS = {
    "min_cells": 20_000,
    "min_median_transcripts_per_cell": 30,
    "min_median_genes_per_cell": 20,
    "max_pct_empty": 5.0,
    "min_median_protein_counts": 5.0,
    "min_pct_protein_positive": 80.0,
}


# Column, side of the limit that counts, limit, level, text, format of the measured value, unit.
STATUS_RULES = [
    ("n_cells", "<", "min_cells", "WARN", "Low cell count", "%,d", ""),
    ("median_counts", "<", "min_median_transcripts_per_cell", "FAIL", "Low median transcripts", "%.1f", ""),
    ("median_genes", "<", "min_median_genes_per_cell", "FAIL", "Low median genes", "%.1f", ""),
    ("pct_zero_count_cells", ">", "max_pct_empty", "WARN", "High empty cells", "%.1f", "%"),
    ("median_protein_counts", "<", "min_median_protein_counts", "WARN", "Low protein counts", "%.1f", ""),
    ("pct_protein_positive", "<", "min_pct_protein_positive", "WARN", "Low protein+ cells", "%.1f", "%"),
]


def sample_status(df: DataFrame, limits: Mapping[str, float] = SAMPLE_LIMITS) -> DataFrame:
    """PASS, WARN or FAIL with the joined reasons, each with its measured value, or "OK"; rules on absent columns are skipped."""
    fail, warn, reasons = F.lit(False), F.lit(False), []
    for col, op, limit, level, text, form, unit in STATUS_RULES:
        if col not in df.columns or limit not in limits:
            continue
        hit = F.coalesce(c(col) < limits[limit] if op == "<" else c(col) > limits[limit], F.lit(False))
        value = F.format_string(form, c(col).cast("long" if form == "%,d" else "double"))
        shown = f"{limits[limit]:,}" if form == "%,d" else str(limits[limit])
        reasons.append(F.when(hit, F.concat(F.lit(f"{text}: "), value, F.lit(f"{unit} {op} {shown}{unit}"))))
        if level == "FAIL":
            fail = fail | hit
        else:
            warn = warn | hit
    status = F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS")
    joined = F.array_join(F.array_compact(F.array(*reasons)), "; ") if reasons else F.lit("")
    return df.withColumn("status", status).withColumn("reasons", F.when(joined == "", "OK").otherwise(joined))


def dict_rows(df: DataFrame, keys: Sequence[str], text: str, status: str = "success") -> DataFrame:
    """Rows (key, name, value) from a JSON dict column whose status says success."""
    parsed = F.from_json(c(text), "status string, mean_proportions map<string,double>")
    return (
        df.select(*[c(k) for k in keys], parsed.alias("j"))
        .where(F.col("j.status") == status)
        .select(*[c(k) for k in keys], F.explode("j.mean_proportions").alias("name", "value"))
    )
