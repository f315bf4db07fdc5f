"""Queries for aggregations, windows, selections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import scalars as sc
from cellweave.operators import aggregates as ag
from cellweave.operators import windows as win
from cellweave.plans.clean_queries import QC_SQL, SHARES_SQL, SIG_SQL, TYPES, qc_of, signatures
from cellweave.plans.registry import query
from cellweave.plans.tables import MARKERS
from cellweave.scale import c, exact_quantiles, materialize, with_group_stats, zscored

def mito():
    return F.col("gene").startswith("G1")


def q_sql(name, q):
    return f"quantile_cont({name}, {q})"


@query("a1_cell_qc", """
SELECT sample_id, cell_id, sum(count) AS n_counts, CAST(count(*) AS BIGINT) AS n_genes,
  sum(CASE WHEN gene LIKE 'G1%' THEN count ELSE 0 END) / sum(count) * 100 AS pct_mt FROM scounts GROUP BY 1, 2""", rnd="pct_mt")
def _(t):
    return ag.cell_qc(t.scounts, ["sample_id", "cell_id"], mito())


@query("a2_percent_in_top_genes", """
SELECT cell_id, sum(CASE WHEN rn <= 1 THEN count ELSE 0 END) / sum(count) * 100 AS pct_top_1, sum(CASE WHEN rn <= 2 THEN count ELSE 0 END) / sum(count) * 100 AS pct_top_2,
  sum(CASE WHEN rn <= 5 THEN count ELSE 0 END) / sum(count) * 100 AS pct_top_5
FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY count DESC, gene) AS rn FROM counts) GROUP BY 1""", rnd="pct_top_1 pct_top_2 pct_top_5")
def _(t):
    return ag.percent_in_top(t.counts, ["cell_id"], [1, 2, 5])


@query("a2_percent_in_top_of_panel", "SELECT cell_id, " + ", ".join(f"sum(CASE WHEN rn <= {n} THEN count ELSE 0 END) / sum(count) * 100 AS pct_top_{n}" for n in (50, 100, 200)) + """
FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY count DESC, gene) AS rn FROM counts) GROUP BY 1""", rnd="pct_top_50 pct_top_100 pct_top_200")
def _(t):
    return ag.percent_in_top(t.counts, ["cell_id"])


@query("a3_sample_qc_metrics", f"""
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cells, avg(n_counts) AS mean_counts, stddev_pop(n_counts) AS std_counts,
  avg(CASE WHEN n_counts = 0 THEN 1 ELSE 0 END) * 100 AS pct_zero_count_cells,
  {q_sql("n_counts", .5)} AS median_counts, {q_sql("CAST(n_genes AS DOUBLE)", .5)} AS median_genes, {q_sql("n_counts", .25)} AS q25_counts, {q_sql("n_counts", .75)} AS q75_counts,
  {q_sql("area", .5)} AS median_cell_area, stddev_pop(area) AS std_cell_area,
  {q_sql("d", .5)} AS median_transcript_density, {q_sql("d", .25)} AS q25_transcript_density, {q_sql("d", .75)} AS q75_transcript_density, stddev_pop(d) AS std_transcript_density
FROM (SELECT *, n_counts / area AS d FROM cells JOIN {QC_SQL} USING (cell_id)) GROUP BY 1""",
    rnd="mean_counts std_counts pct_zero_count_cells median_counts median_genes q25_counts q75_counts median_cell_area std_cell_area median_transcript_density q25_transcript_density q75_transcript_density std_transcript_density")
def _(t):
    # the per-cell QC table is an artefact of its own: stored once, read by both passes
    return ag.sample_qc(materialize(t.cells.select("sample_id", "cell_id", "area").join(qc_of(t), "cell_id")))


@query("a4_retention_stats", f"""
SELECT b.*, CAST(coalesce(a.cells_after, 0) AS BIGINT) AS cells_after, CAST(coalesce(a.genes_after, 0) AS BIGINT) AS genes_after,
  coalesce(a.cells_after, 0) / cells_before * 100 AS cells_retained_pct, coalesce(a.genes_after, 0) / genes_before * 100 AS genes_retained_pct
FROM (SELECT sample_id, CAST(count(DISTINCT cell_id) AS BIGINT) AS cells_before, CAST(count(DISTINCT gene) AS BIGINT) AS genes_before FROM scounts GROUP BY 1) b
LEFT JOIN (SELECT sample_id, count(DISTINCT cell_id) AS cells_after, count(DISTINCT gene) AS genes_after FROM scounts JOIN {QC_SQL} USING (cell_id) WHERE n_genes >= 4 GROUP BY 1) a ON b.sample_id = a.sample_id""",
    rnd="cells_retained_pct genes_retained_pct")
def _(t):
    return ag.retention(t.scounts, t.scounts.join(qc_of(t).where("n_genes >= 4"), "cell_id", "left_semi"))


@query("a5_marker_snr_summary", """
SELECT marker, avg(snr) AS mean, quantile_cont(snr, 0.5) AS median, min(snr) AS min, max(snr) AS max, stddev_samp(snr) AS std
FROM (SELECT sample_id, marker, avg(intensity) / stddev_pop(intensity) AS snr FROM prot GROUP BY 1, 2) GROUP BY 1""", rnd="mean median min max std")
def _(t):
    snr = t.prot.groupBy("sample_id", "marker").agg((F.avg("intensity") / F.stddev_pop("intensity")).alias("snr"))
    return ag.marker_summary(snr, "marker", "snr")


@query("a6_dataset_summary_rows", f"""
SELECT metric, value FROM (UNPIVOT (SELECT CAST(count(DISTINCT sample_id) AS DOUBLE) AS n_samples, CAST(count(*) AS DOUBLE) AS n_cells, sum(n_counts) AS n_transcripts,
  avg(n_counts) AS mean_counts, avg(CAST(n_genes AS DOUBLE)) AS mean_genes, CAST(count(*) FILTER (n_counts > 100) AS DOUBLE) AS cells_over_100, CAST(count(*) FILTER (pct_mt > 50) AS DOUBLE) AS cells_high_mt
  FROM cells JOIN {QC_SQL} USING (cell_id)) ON COLUMNS(*) INTO NAME metric VALUE value)""", rnd="value")
def _(t):
    return ag.metric_rows(t.cells.join(qc_of(t), "cell_id"), {
        "n_samples": F.count_distinct("sample_id"), "n_cells": ag.n_rows(), "n_transcripts": F.sum("n_counts"),
        "mean_counts": F.avg("n_counts"), "mean_genes": F.avg("n_genes"),
        "cells_over_100": F.count_if(F.col("n_counts") > 100), "cells_high_mt": F.count_if(F.col("pct_mt") > 50),
    })


# --- the gate, as SQL built from the same fixed rules


def gate_sql(gates, fallback, source="pw", q=0.8, keys=("sample_id",)):
    markers = list(dict.fromkeys([*sc.gate_markers([*gates, *([fallback] if fallback else [])]), "PD1", "PDL1"]))
    th = ", ".join(f'quantile_cont("{m}", {q}) AS "t_{m}"' for m in markers)
    cond = lambda g: " AND ".join([f'"{m}" > "t_{m}"' for m in g.positive] + [f'NOT "{m}" > "t_{m}"' for m in g.negative])
    whens = " ".join(f"WHEN {cond(g)} THEN '{g.label}'" for g in reversed(gates))
    if fallback:
        whens += f" WHEN {cond(fallback)} THEN '{fallback.label}'"
    k = ", ".join(keys)
    return f"(SELECT *, CASE {whens} ELSE 'Other' END AS gated_type FROM {source} JOIN (SELECT {k}, {th} FROM {source} GROUP BY {k}) USING ({k}))"


GATED_SQL = gate_sql(sc.HIERARCHICAL_GATE, sc.IMMUNE_FALLBACK)
GATE_LABELS = [g.label for g in sc.HIERARCHICAL_GATE] + ["Immune_other", "Other"]


def gated(t, keep=()):
    return sc.gate_by_quantile(t.pw, ["sample_id"], 0.8, sc.HIERARCHICAL_GATE, sc.IMMUNE_FALLBACK, keep_thresholds=keep)


@query("a7_composition_per_sample", f"""
SELECT sample_id, CAST(count(*) AS BIGINT) AS total_cells, {", ".join(f"count(*) FILTER (gated_type = '{l}') / count(*) * 100 AS \"{l}_pct\"" for l in GATE_LABELS)}
FROM {GATED_SQL} GROUP BY 1""", rnd=" ".join(f"{l}_pct" for l in GATE_LABELS))
def _(t):
    return ag.composition(gated(t), ["sample_id"], "gated_type", GATE_LABELS).orderBy("sample_id")


@query("a8_group_mean_composition", f"""
SELECT response, {", ".join(f"avg(share) FILTER (cell_type = '{l}') AS {l}" for l in TYPES)} FROM {SHARES_SQL} JOIN samples USING (sample_id) GROUP BY 1""", rnd=" ".join(TYPES))
def _(t):
    sh = ag.label_shares(t.cells, ["sample_id"], "cell_type").join(t.samples, "sample_id")
    return sh.groupBy("response").pivot("cell_type", TYPES).agg(F.avg("share"))


@query("a9_marker_mean_by_label", f"""
SELECT cell_type, {", ".join(f'avg("{m}") AS "{m}_mean", stddev_samp("{m}") AS "{m}_std"' for m in MARKERS)} FROM pw GROUP BY 1""",
    rnd=" ".join(f"{m}_mean {m}_std" for m in MARKERS), digits=8)
def _(t):
    return ag.grouped_stats(t.pw, ["cell_type"], MARKERS, ["mean", "std"])


@query("a10_correlation_summary", """
SELECT cell_type, round(avg(r), 3) AS r_mean, round(stddev_samp(r), 3) AS r_std, round(min(r), 3) AS r_min, round(max(r), 3) AS r_max
FROM (SELECT sample_id, cell_type, corr(x, y) AS r FROM cells GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    r = t.cells.groupBy("sample_id", "cell_type").agg(F.corr("x", "y").alias("r"))
    make = [("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]
    return r.groupBy("cell_type").agg(*[F.round(f("r"), 3).alias(f"r_{n}") for n, f in make])


PB_SQL = """(SELECT s.sample_id, s.cell_type, g.gene, coalesce(p.total, 0) AS total FROM (SELECT DISTINCT sample_id, cell_type FROM scounts) s CROSS JOIN (SELECT DISTINCT gene FROM genes) g
  LEFT JOIN (SELECT sample_id, cell_type, gene, sum(count) AS total FROM scounts GROUP BY 1, 2, 3) p ON p.sample_id = s.sample_id AND p.cell_type = s.cell_type AND p.gene = g.gene)"""


@query("a11_pseudobulk_sum", f"SELECT * FROM {PB_SQL}")
def _(t):
    return ag.pseudobulk(t.scounts, ["sample_id", "cell_type"], t.genes)


@query("a12_pseudobulk_mean", """
SELECT sample_id, gene, total, n_cells, total / n_cells AS mean FROM (SELECT sample_id, gene, sum(count) AS total FROM scounts GROUP BY 1, 2)
JOIN (SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cells FROM cells GROUP BY 1) USING (sample_id)""", rnd="mean")
def _(t):
    return ag.pseudobulk_mean(t.scounts, t.cells, ["sample_id"])


@query("a13_min_cells_filter", """
SELECT sample_id, cell_type, CAST(count(*) AS BIGINT) AS n_cells, count(*) >= 110 AS kept FROM cells GROUP BY 1, 2""")
def _(t):
    return ag.enough_cells(t.cells, ["sample_id", "cell_type"], 110)


SIG_SCORE_SQL = f"""(SELECT sample_id, name, sum(count) / any_value(n_cells) / any_value(k) AS score FROM scounts JOIN {SIG_SQL} USING (gene)
  JOIN (SELECT name, count(DISTINCT gene) AS k FROM {SIG_SQL} WHERE gene IN (SELECT gene FROM counts) GROUP BY 1) USING (name)
  JOIN (SELECT sample_id, count(*) AS n_cells FROM cells GROUP BY 1) USING (sample_id) GROUP BY 1, 2)"""
CAF = ["mCAF", "iCAF", "apCAF"]


@query("a14_signature_dominance_by_stage", f"""
SELECT stage, {", ".join(f"count(*) FILTER (dominant = '{x}') / count(*) AS {x}" for x in CAF)} FROM (
  SELECT sample_id, arg_max(name, score) AS dominant FROM {SIG_SCORE_SQL} WHERE name IN ('mCAF', 'iCAF', 'apCAF') GROUP BY 1) JOIN samples USING (sample_id) GROUP BY 1""", rnd=" ".join(CAF))
def _(t):
    s = ag.module_means(t.scounts, t.cells, signatures(t).where(F.col("name").isin(CAF)), ["sample_id"])
    wide = s.groupBy("sample_id").pivot("name", CAF).agg(F.first("score")).join(t.samples, "sample_id")
    name, _ = sc.arg_max({n: F.col(n) for n in CAF})
    return ag.share_by_group(wide.withColumn("dominant", name), "stage", "dominant", CAF)


@query("a15_marker_mean_and_positive", """
SELECT s.sample_id, g.gene AS marker, coalesce(h.s, 0) / n_cells AS mean_expr, coalesce(h.p, 0) / n_cells * 100 AS pct_positive
FROM (SELECT sample_id, count(*) AS n_cells FROM cells GROUP BY 1) s CROSS JOIN (VALUES ('G5'), ('G6'), ('G7'), ('ABSENT')) g(gene)
LEFT JOIN (SELECT sample_id, gene, sum(count) AS s, count(*) AS p FROM scounts GROUP BY 1, 2) h ON h.sample_id = s.sample_id AND h.gene = g.gene""", rnd="mean_expr pct_positive")
def _(t):
    return ag.marker_positive(t.scounts, t.cells, ["sample_id"], ["G5", "G6", "G7", "ABSENT"])


@query("a16_flag_rate_per_label", """
SELECT cell_type, CAST(count(*) AS BIGINT) AS total_cells, CAST(count(*) FILTER (admixed) AS BIGINT) AS flagged_cells, count(*) FILTER (admixed) / count(*) * 100 AS pct_flagged FROM cells GROUP BY 1""", rnd="pct_flagged")
def _(t):
    return ag.flag_rate(t.cells, ["cell_type"], "admixed")


STATUS_SQL = f"""(SELECT lane, s.sample_id, n_cells, median_counts, CASE WHEN median_counts < 95 THEN 'FAIL' WHEN n_cells < 580 THEN 'WARN' ELSE 'PASS' END AS status FROM samples s JOIN (
  SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cells, quantile_cont(n_counts, 0.5) AS median_counts FROM cells JOIN {QC_SQL} USING (cell_id) GROUP BY 1) m ON s.sample_id = m.sample_id)"""


def sample_table(t):
    qc = materialize(t.cells.select("sample_id", "cell_id").join(qc_of(t), "cell_id"))
    m = ag.sample_qc(qc, area=None).select("sample_id", "n_cells", "median_counts", "median_genes", "pct_zero_count_cells")
    return m.join(t.samples, "sample_id")


LIMITS = {"min_cells": 580, "min_median_transcripts_per_cell": 95, "min_median_genes_per_cell": 2, "max_pct_empty": 5.0}


@query("a17_lane_rollup", f"""
SELECT lane, sample_id, CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(n_cells) AS BIGINT) AS n_cells, avg(median_counts) AS mean_median_counts,
  CAST(count(*) FILTER (status = 'PASS') AS BIGINT) AS n_pass, CAST(count(*) FILTER (status = 'WARN') AS BIGINT) AS n_warn, CAST(count(*) FILTER (status = 'FAIL') AS BIGINT) AS n_fail
FROM {STATUS_SQL} GROUP BY ROLLUP (lane, sample_id)""", rnd="mean_median_counts")
def _(t):
    return ag.lane_rollup(sc.sample_status(sample_table(t), LIMITS))


@query("a17_density_alerts", """
SELECT sample_id, z, CASE WHEN abs(z) > 2 THEN 'INVESTIGATE' WHEN abs(z) > 1 THEN 'MONITOR' ELSE 'OK' END AS alert FROM (
  SELECT sample_id, (n_cells - avg(n_cells) OVER ()) / stddev_samp(n_cells) OVER () AS z FROM (SELECT sample_id, count(*) AS n_cells FROM cells GROUP BY 1))""", rnd="z")
def _(t):
    return ag.density_alerts(t.cells.groupBy("sample_id").agg(ag.n_rows().alias("n_cells")), "n_cells").select("sample_id", "z", "alert")


@query("a17_lane_status_crosstab", f"""
SELECT lane, {", ".join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS \"{s}\"" for s in ["PASS", "WARN", "FAIL"])} FROM {STATUS_SQL} GROUP BY 1""")
def _(t):
    return ag.contingency(sc.sample_status(sample_table(t), LIMITS), "lane", "status", ["PASS", "WARN", "FAIL"])


@query("a18_stage_summary_of_markers", """
SELECT stage, gene, avg(total) AS total_mean, stddev_samp(total) AS total_std, CAST(count(total) AS BIGINT) AS total_n
FROM (SELECT sample_id, gene, sum(count) AS total FROM scounts GROUP BY 1, 2) JOIN samples USING (sample_id) GROUP BY 1, 2""", rnd="total_mean total_std")
def _(t):
    pb = ag.pseudobulk(t.scounts, ["sample_id"]).join(t.samples, "sample_id")
    return ag.grouped_stats(pb, ["stage", "gene"], ["total"], ["mean", "std", "n"])


LANES = ["L1", "L2", "L3", "L4"]


@query("a19_contingency_table", f"""
SELECT cell_type, {", ".join(f"CAST(count(*) FILTER (lane = '{l}') AS BIGINT) AS {l}" for l in LANES)} FROM cells JOIN samples USING (sample_id) GROUP BY 1""")
def _(t):
    return ag.contingency(t.cells.join(t.samples, "sample_id"), "cell_type", "lane", LANES)


@query("a19_contingency_row_normalised", f"""
SELECT cell_type, {", ".join(f"count(*) FILTER (lane = '{l}') / count(*) AS {l}" for l in LANES)} FROM cells JOIN samples USING (sample_id) GROUP BY 1""", rnd="L1 L2 L3 L4")
def _(t):
    return ag.contingency(t.cells.join(t.samples, "sample_id"), "cell_type", "lane", LANES, normalise=True)


CLUSTERINGS_SQL = """(SELECT 0.3 AS resolution, cell_type AS cluster FROM cells UNION ALL SELECT 0.5, cell_type || cluster FROM cells UNION ALL SELECT 0.8, sample_id FROM cells UNION ALL SELECT 1.0, sample_id || cell_type FROM cells)"""


def clusterings(t):
    labels = {0.3: F.col("cell_type"), 0.5: F.concat("cell_type", "cluster"), 0.8: F.col("sample_id"), 1.0: F.concat("sample_id", "cell_type")}
    rows = F.array(*[F.struct(F.lit(r).alias("resolution"), v.alias("cluster")) for r, v in labels.items()])
    return t.cells.select(F.explode(rows).alias("s")).select("s.*")


@query("a20_cluster_size_stats", f"""
SELECT CAST(resolution AS DOUBLE) AS resolution, CAST(count(*) AS BIGINT) AS n_clusters, min(size) AS min_size, max(size) AS max_size, avg(size) AS mean_size, stddev_pop(size) AS std_size
FROM (SELECT resolution, cluster, CAST(count(*) AS BIGINT) AS size FROM {CLUSTERINGS_SQL} GROUP BY 1, 2) GROUP BY 1""", rnd="mean_size std_size")
def _(t):
    return ag.cluster_sizes(clusterings(t), "resolution", "cluster")


@query("a20_pick_resolution", f"""
SELECT arg_min(resolution, d) AS chosen FROM (SELECT CAST(resolution AS DOUBLE) AS resolution, abs(count(*) - 8) + resolution / 1000 AS d FROM (
  SELECT resolution, cluster, count(*) AS size FROM {CLUSTERINGS_SQL} GROUP BY 1, 2) GROUP BY resolution HAVING min(size) >= 10)""")
def _(t):
    return ag.pick_resolution(ag.cluster_sizes(clusterings(t), "resolution", "cluster"), "resolution")


SUBSETS = {"baseline": "x > 100", "qc_strict": "x > 100 AND y < 2000", "clean": "x > 100 AND NOT admixed"}
SUB_SHARES_SQL = "(SELECT cluster, " + ", ".join(f"CAST(count(*) FILTER ({w}) AS DOUBLE) / sum(count(*) FILTER ({w})) OVER () AS {n}" for n, w in SUBSETS.items()) + " FROM cells GROUP BY 1)"


@query("a21_cluster_share_stability", f"SELECT * FROM {SUB_SHARES_SQL}", rnd="baseline qc_strict clean")
def _(t):
    df = t.cells.withColumns({n: F.expr(w) for n, w in SUBSETS.items()})
    return ag.subset_share_stability(df, "cluster", list(SUBSETS))[0]


@query("a21_cluster_share_correlation", f"SELECT corr(baseline, qc_strict) AS r_baseline_qc_strict, corr(baseline, clean) AS r_baseline_clean FROM {SUB_SHARES_SQL}", rnd="r_baseline_qc_strict r_baseline_clean", digits=5)
def _(t):
    df = t.cells.withColumns({n: F.expr(w) for n, w in SUBSETS.items()})
    return ag.subset_share_stability(df, "cluster", list(SUBSETS))[1]


@query("a22_diversity_per_sample", f"""
SELECT sample_id, -sum(share * log2(share)) AS shannon_bits, -sum(share * ln(share)) AS shannon_nats, 1 - sum(share * share) AS simpson, CAST(count(*) FILTER (share > 0.01) AS BIGINT) AS richness
FROM {SHARES_SQL} GROUP BY 1""", rnd="shannon_bits shannon_nats simpson")
def _(t):
    return ag.diversity(ag.label_shares(t.cells, ["sample_id"], "cell_type"), ["sample_id"])


@query("a23_multimodal_entropy", f"""
WITH g AS (SELECT sample_id, gene, sum(count * count) / any_value(n) - pow(sum(count) / any_value(n), 2) AS v FROM scounts JOIN (SELECT sample_id, count(*) AS n FROM cells GROUP BY 1) USING (sample_id) GROUP BY 1, 2),
e AS (SELECT sample_id, -sum(p * ln(p)) AS expression_entropy FROM (SELECT sample_id, v / sum(v) OVER (PARTITION BY sample_id) AS p FROM g) GROUP BY 1),
s AS (SELECT sample_id, share - min(share) OVER (PARTITION BY sample_id) + 1e-10 AS v FROM {SHARES_SQL}),
t AS (SELECT sample_id, -sum(p * ln(p)) AS cell_type_entropy FROM (SELECT sample_id, v / sum(v) OVER (PARTITION BY sample_id) AS p FROM s) GROUP BY 1)
SELECT sample_id, cell_type_entropy, expression_entropy, 0.5 * cell_type_entropy + 0.5 * expression_entropy AS combined_entropy FROM t LEFT JOIN e USING (sample_id)""",
    rnd="cell_type_entropy expression_entropy combined_entropy")
def _(t):
    comp = ag.shifted_entropy(ag.label_shares(t.cells, ["sample_id"], "cell_type"), ["sample_id"], "share")
    return ag.multimodal_entropy(comp, ag.expression_entropy(t.scounts, t.cells, ["sample_id"]), ["sample_id"])


def bins_sql(keys, n, closed, source="cells"):
    idx = lambda v, lo, hi: f"floor(({v} - {lo}) / (({hi} - {lo}) / {n}))"
    gx, gy = idx("x", "x0", "x1"), idx("y", "y0", "y1")
    if closed:
        gx, gy = f"least({gx}, {n - 1})", f"least({gy}, {n - 1})"
    return f"(SELECT *, CAST({gx} AS INTEGER) AS gx, CAST({gy} AS INTEGER) AS gy FROM {source} JOIN (SELECT {keys}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {source} GROUP BY {keys}) USING ({keys}))"


@query("a24_grid_means", f"""
SELECT s.sample_id, g.gx, h.gy, CAST(coalesce(b.n, 0) AS BIGINT) AS n, coalesce(b.area, 0) AS area FROM (SELECT DISTINCT sample_id FROM cells) s
CROSS JOIN (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS gx) g CROSS JOIN (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS gy) h
LEFT JOIN (SELECT sample_id, gx, gy, count(*) AS n, avg(area) AS area FROM {bins_sql("sample_id", 50, True)} GROUP BY 1, 2, 3) b ON b.sample_id = s.sample_id AND b.gx = g.gx AND b.gy = h.gy""", rnd="area", digits=10)
def _(t):
    return ag.grid_means(t.cells, ["sample_id"], ["area"], 50)


@query("a25_binned_type_entropy", f"""
WITH b AS (SELECT sample_id, gx, gy, cell_type, count(*) AS n FROM {bins_sql("sample_id", 10, False)} WHERE gx < 10 AND gy < 10 GROUP BY 1, 2, 3, 4),
h AS (SELECT sample_id, gx, gy, -sum(p * ln(p)) AS h, sum(n) AS n FROM (SELECT *, n / sum(n) OVER (PARTITION BY sample_id, gx, gy) AS p FROM b) GROUP BY 1, 2, 3 HAVING sum(n) > 5)
SELECT sample_id, avg(h) AS mean_entropy, stddev_pop(h) AS std_entropy, CAST(count(*) AS BIGINT) AS n_bins FROM h GROUP BY 1""", rnd="mean_entropy std_entropy")
def _(t):
    return ag.binned_type_entropy(t.cells, ["sample_id"], "cell_type")


@query("a25_type_dispersion", f"""
WITH b AS (SELECT sample_id, cell_type, gx, gy, count(*) AS n FROM {bins_sql("sample_id, cell_type", 10, True)} GROUP BY 1, 2, 3, 4)
SELECT sample_id, cell_type, -sum(p * ln(p)) AS spatial_entropy, CAST(sum(n) AS BIGINT) AS n_total FROM (SELECT *, n / sum(n) OVER (PARTITION BY sample_id, cell_type) AS p FROM b) GROUP BY 1, 2 HAVING sum(n) > 10""", rnd="spatial_entropy")
def _(t):
    return ag.type_dispersion(t.cells, ["sample_id"], "cell_type")


@query("a26_sample_geometry", """
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cells, max(x) - min(x) AS x_range, max(y) - min(y) AS y_range, count(*) / ((max(x) - min(x)) * (max(y) - min(y)) + 1) AS density,
  var_pop(x) AS x_var, var_pop(y) AS y_var, covar_samp(x, y) AS xy_cov, stddev_pop(x) AS x_spread, stddev_pop(y) AS y_spread FROM cells GROUP BY 1""",
    rnd="x_range y_range density x_var y_var xy_cov x_spread y_spread", digits=4)
def _(t):
    return ag.geometry(t.cells, ["sample_id"])


@query("a27_module_means_per_sample", f"SELECT sample_id, name, score FROM {SIG_SCORE_SQL}", rnd="score")
def _(t):
    return ag.module_means(t.scounts, t.cells, signatures(t), ["sample_id"])


# the measured genes stand in for the listed ones, in alphabetical order
_listed = sorted({g for genes in ag.MODULES.values() for g in genes})
_named = "(VALUES " + ", ".join(f"('G{i}', '{g}')" for i, g in enumerate(_listed)) + ") AS named(gene, symbol)"
_lists = "(VALUES " + ", ".join(f"('{n}', '{g}')" for n, genes in ag.MODULES.items() for g in genes) + ") AS lists(name, symbol)"


@query("a27_fixed_gene_lists", f"""
WITH s AS (SELECT sample_id, symbol, sum(count) AS s FROM scounts JOIN {_named} USING (gene) GROUP BY 1, 2),
k AS (SELECT name, count(DISTINCT symbol) AS k FROM {_lists} WHERE symbol IN (SELECT symbol FROM s) GROUP BY 1)
SELECT sample_id, name, sum(s) / (any_value(n) * any_value(k)) AS score FROM s JOIN {_lists} USING (symbol) JOIN k USING (name) JOIN (SELECT sample_id, count(*) AS n FROM cells GROUP BY 1) USING (sample_id) GROUP BY 1, 2""", rnd="score")
def _(t):
    named = t.literal([(f"G{i}", g) for i, g in enumerate(_listed)], "gene string, symbol string")
    counts = t.scounts.join(named, "gene").drop("gene").withColumnRenamed("symbol", "gene")
    lists = t.literal([(n, g) for n, genes in ag.MODULES.items() for g in genes], "name string, gene string")
    return ag.module_means(counts, t.cells, lists, ["sample_id"])


@query("a28_patient_summary", """
SELECT patient, CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(n_cells) AS BIGINT) AS total_cells, quantile_cont(CAST(n_cells AS DOUBLE), 0.5) AS median_cells,
  bool_or(timepoint = 'Pre') AS has_pre, bool_or(timepoint = 'Post') AS has_post, string_agg(sample_id, ', ' ORDER BY sample_id) AS sample_list
FROM samples JOIN (SELECT sample_id, count(*) AS n_cells FROM cells GROUP BY 1) USING (sample_id) GROUP BY 1""")
def _(t):
    return ag.patient_summary(t.samples.join(ag.unit_sizes(t.cells, ["sample_id"]), "sample_id"))


@query("a29_activity_stats", """
SELECT sample_id, cell_type, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.5) AS median FROM cells GROUP BY 1, 2""", rnd="mean std median")
def _(t):
    return ag.activity_stats(t.cells, ["sample_id", "cell_type"], "x")


@query("a30_interaction_summary", """
SELECT a.cell_type AS type1, b.cell_type AS type2, response, avg(a.n * b.n) AS score_mean, stddev_samp(a.n * b.n) AS score_std, CAST(count(*) AS BIGINT) AS score_n
FROM (SELECT sample_id, cell_type, count(*) AS n FROM cells GROUP BY 1, 2) a JOIN (SELECT sample_id, cell_type, count(*) AS n FROM cells GROUP BY 1, 2) b ON a.sample_id = b.sample_id
JOIN samples s ON s.sample_id = a.sample_id GROUP BY 1, 2, 3""", rnd="score_mean score_std", digits=3)
def _(t):
    n = t.cells.groupBy("sample_id", "cell_type").agg(ag.n_rows().alias("n"))
    pairs = n.select("sample_id", F.col("cell_type").alias("type1"), F.col("n").alias("n1")).join(
        n.select("sample_id", F.col("cell_type").alias("type2"), F.col("n").alias("n2")), "sample_id"
    ).withColumn("score", F.col("n1") * F.col("n2")).join(t.samples, "sample_id")
    return ag.grouped_stats(pairs, ["type1", "type2", "response"], ["score"], ["mean", "std", "n"])


@query("a31_gene_class_load", """
WITH v AS (SELECT sample_id, cell_id, sum(count) AS v FROM scounts WHERE gene LIKE 'G2%' GROUP BY 1, 2),
s AS (SELECT sample_id, sum(v) AS s, sum(v * v) AS ss, count(*) AS pos FROM v GROUP BY 1), n AS (SELECT sample_id, count(*) AS n FROM cells GROUP BY 1)
SELECT sample_id, s AS total, s / n AS mean, ss / n - pow(s / n, 2) AS variance, pos / n * 100 AS pct_cells FROM n JOIN s USING (sample_id)""", rnd="mean variance pct_cells")
def _(t):
    return ag.class_load(t.scounts, t.cells, ["sample_id"], F.col("gene").startswith("G2"))


@query("a32_validation_rollup", f"""
SELECT metric, value FROM (UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS n_samples, CAST(sum(n_cells) AS DOUBLE) AS total_cells, avg(median_counts) AS mean_median_counts,
  count(*) FILTER (status = 'PASS') / count(*) * 100 AS pct_pass FROM {STATUS_SQL}) ON COLUMNS(*) INTO NAME metric VALUE value)""", rnd="value")
def _(t):
    return ag.metric_rows(sc.sample_status(sample_table(t), LIMITS), {
        "n_samples": ag.n_rows(), "total_cells": F.sum("n_cells"), "mean_median_counts": F.avg("median_counts"),
        "pct_pass": F.count_if(F.col("status") == "PASS") / ag.n_rows() * 100,
    })


# ------------------------------------------------------------------------------------------------ windows


@query("w1_marker_quantile_gate", """
SELECT cell_id, marker, intensity, t AS threshold, intensity > t AS positive FROM prot JOIN (SELECT sample_id, marker, quantile_cont(intensity, 0.8) AS t FROM prot GROUP BY 1, 2) USING (sample_id, marker)""", rnd="threshold intensity", digits=8)
def _(t):
    from cellweave.scale import with_quantiles

    d = with_quantiles(t.prot, ["sample_id", "marker"], {"threshold": ("intensity", 0.8)})
    return d.select("cell_id", "marker", "intensity", "threshold", (F.col("intensity") > F.col("threshold")).alias("positive"))


@query("w2_zscore_per_sample", """
SELECT cell_id, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x_z, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS y_z FROM cells WINDOW w AS (PARTITION BY sample_id)""", rnd="x_z y_z")
def _(t):
    return zscored(t.cells, ["sample_id"], ["x", "y"]).select("cell_id", "x_z", "y_z")


@query("w3_min_max_scale", """
SELECT cell_id, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w + 1e-10) AS x_norm FROM cells WINDOW w AS (PARTITION BY sample_id)""", rnd="x_norm")
def _(t):
    return win.min_max_scaled(t.cells, ["sample_id"], ["x"]).select("cell_id", "x_norm")


@query("w4_robust_scale", """
SELECT cell_id, greatest(0, least(1, (x - lo) / (hi - lo + 1e-10))) AS scaled FROM cells JOIN (SELECT sample_id, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM cells GROUP BY 1) USING (sample_id)""", rnd="scaled")
def _(t):
    return sc.robust_scaled(t.cells, ["sample_id"], {"scaled": "x"}, 0.05, 0.95).select("cell_id", "scaled")


@query("w5_average_ranks", """
SELECT cell_id, gene, rank() OVER (PARTITION BY gene ORDER BY count) + (count(*) OVER (PARTITION BY gene, count) - 1) / 2.0 AS avg_rank FROM counts""")
def _(t):
    return win.average_ranks(t.counts, ["gene"], "count").select("cell_id", "gene", "avg_rank")


@query("w6_top_genes_per_sample", """
SELECT sample_id, gene, total, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY total DESC, gene) AS rank FROM (
  SELECT sample_id, gene, sum(count) AS total FROM scounts GROUP BY 1, 2)) WHERE rank <= 20""")
def _(t):
    return win.top_by(ag.pseudobulk(t.scounts, ["sample_id"]), ["sample_id"], F.col("total"), ["gene"], 20)


# a p-like number per gene and contrast to adjust: share of cells at or above a cut
P_SQL = "(SELECT cell_type, gene, CASE WHEN count(*) % 17 = 0 THEN NULL ELSE count(*) FILTER (count >= 40) / count(*) END AS p FROM scounts GROUP BY 1, 2)"


def p_table(t):
    n = ag.n_rows()
    p = F.when(n % 17 != 0, F.count_if(F.col("count") >= 40) / n)
    return t.scounts.groupBy("cell_type", "gene").agg(p.alias("p"))


@query("w7_adjusted_p_values", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY p, gene) AS rk, count(p) OVER (PARTITION BY cell_type) AS n FROM {P_SQL} WHERE p IS NOT NULL)
SELECT cell_type, gene, p, least(1, p * n) AS bonferroni,
  least(1, max(p * (n - rk + 1)) OVER (PARTITION BY cell_type ORDER BY rk)) AS holm,
  least(1, min(p * n / rk) OVER (PARTITION BY cell_type ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh FROM r
UNION ALL SELECT cell_type, gene, p, NULL, NULL, NULL FROM {P_SQL} WHERE p IS NULL""", rnd="p bonferroni holm bh")
def _(t):
    df = p_table(t)
    for m in ("bonferroni", "holm", "bh"):
        df = win.adjust_p(df, ["cell_type"], "p", ["gene"], m, out=m)
    return df


@query("w7_bh_missing_as_one", f"""
SELECT cell_type, gene, least(1, min(p * n / rk) OVER (PARTITION BY cell_type ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (
  SELECT cell_type, gene, coalesce(p, 1) AS p, row_number() OVER (PARTITION BY cell_type ORDER BY coalesce(p, 1), gene) AS rk, count(*) OVER (PARTITION BY cell_type) AS n FROM {P_SQL})""", rnd="q")
def _(t):
    return win.adjust_p(p_table(t), ["cell_type"], "p", ["gene"], "bh", "one").select("cell_type", "gene", "q")


@query("w8_cumulative_variance", """
SELECT marker, ratio, sum(ratio) OVER (ORDER BY ratio DESC, marker ROWS UNBOUNDED PRECEDING) AS cumulative FROM (SELECT marker, v / sum(v) OVER () AS ratio FROM (SELECT marker, var_pop(intensity) AS v FROM prot GROUP BY 1))""", rnd="ratio cumulative")
def _(t):
    v = t.prot.groupBy("marker").agg(F.var_pop("intensity").alias("v"))
    r = with_group_stats(v, [], [F.sum("v").alias("s")]).select("marker", (F.col("v") / F.col("s")).alias("ratio"))
    ordered = r.withColumn("g", F.lit("all")).withColumn("pc", F.struct(-F.col("ratio"), F.col("marker")))
    return win.cumulative_variance(ordered, ["g"], "pc", "ratio").select("marker", "ratio", "cumulative")


@query("w9_arg_max_label", """
SELECT cell_id, CASE WHEN best < 0 THEN 'Unknown' WHEN best - second < 0.1 THEN 'Low_Confidence' ELSE name END AS assigned, best AS best_score FROM (
  SELECT cell_id, greatest("CD3", "CD20", "CD68") AS best, CASE WHEN "CD3" >= "CD20" AND "CD3" >= "CD68" THEN 'T' WHEN "CD20" >= "CD68" THEN 'B' ELSE 'M' END AS name,
    "CD3" + "CD20" + "CD68" - greatest("CD3", "CD20", "CD68") - least("CD3", "CD20", "CD68") AS second FROM pw)""", rnd="best_score", digits=8)
def _(t):
    return sc.assign_by_scores(t.pw, {"T": c("CD3"), "B": c("CD20"), "M": c("CD68")}).select("cell_id", "assigned", "best_score")


@query("w10_percentile_flag", """
SELECT cell_id, x > p AS is_hub FROM cells JOIN (SELECT sample_id, quantile_cont(x, 0.95) AS p FROM cells GROUP BY 1) USING (sample_id)""")
def _(t):
    return win.percentile_flag(t.cells, ["sample_id"], "x", 0.95, "is_hub").select("cell_id", "is_hub")


@query("w11_cumulative_distribution", """
SELECT DISTINCT sample_id, y, cume_dist() OVER (PARTITION BY sample_id ORDER BY y) AS cum_dist FROM cells""", rnd="cum_dist")
def _(t):
    return win.cumulative_share(t.cells, ["sample_id"], "y").select("sample_id", "y", "cum_dist")


@query("w12_median_split_and_bins", f"""
SELECT sample_id, cell_type, CASE WHEN share >= (SELECT quantile_cont(share, 0.5) FROM {SHARES_SQL}) THEN 'High' ELSE 'Low' END AS share_group,
  CASE WHEN share * 100 > 0 AND share * 100 <= 18 THEN 'Low' WHEN share * 100 > 18 AND share * 100 <= 22 THEN 'Medium' WHEN share * 100 > 22 THEN 'High' END AS immune_group FROM {SHARES_SQL}""")
def _(t):
    sh = win.median_split(ag.label_shares(t.cells, ["sample_id"], "cell_type"), "share", "share_group")
    return sh.select("sample_id", "cell_type", "share_group", win.right_closed_bins(F.col("share") * 100).alias("immune_group"))


@query("w13_consensus_ranking", """
WITH imp AS (SELECT sample_id AS model, gene AS feature, sum(count) AS importance FROM scounts GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rk FROM imp)
SELECT f.feature, avg(coalesce(CAST(rk AS DOUBLE), 20)) AS mean_rank, CAST(count(*) FILTER (rk <= 10) AS BIGINT) AS n_top
FROM (SELECT DISTINCT feature FROM imp) f CROSS JOIN (SELECT DISTINCT model FROM imp) m LEFT JOIN r ON r.feature = f.feature AND r.model = m.model GROUP BY 1""", rnd="mean_rank")
def _(t):
    imp = t.scounts.groupBy(F.col("sample_id").alias("model"), F.col("gene").alias("feature")).agg(F.sum("count").alias("importance"))
    return win.consensus_ranking(imp, imp.select("feature").distinct(), imp.select("model").distinct())


# ---------------------------------------------------------------------------------------- sorts and limits


@query("o1_largest_by_absolute", """
SELECT cell_id, x - 2500 AS centred FROM cells ORDER BY abs(x - 2500) DESC, cell_id LIMIT 50""", rnd="centred")
def _(t):
    df = t.cells.select("cell_id", (F.col("x") - 2500).alias("centred"))
    return win.largest_overall(df, F.abs(F.col("centred")), ["cell_id"], 50)


@query("o2_top_variance_genes", """
SELECT gene, variance FROM (SELECT gene, var_samp(total) AS variance FROM (SELECT sample_id, gene, sum(count) AS total FROM scounts GROUP BY 1, 2) GROUP BY 1) ORDER BY variance DESC, gene LIMIT 50""", rnd="variance")
def _(t):
    return win.top_variance_features(ag.pseudobulk(t.scounts, ["sample_id"]), "gene", "total", 50)


@query("o3_volcano_table", f"""
SELECT cell_type, gene, lfc, p, -log10(p + 1e-100) AS neg_log10_p, CASE WHEN p < 0.2 AND lfc > 0.05 THEN 'up' WHEN p < 0.2 AND lfc < -0.05 THEN 'down' ELSE 'ns' END AS class
FROM {P_SQL} JOIN (SELECT cell_type, gene, log2(avg(count) / 25.5) AS lfc FROM scounts GROUP BY 1, 2) USING (cell_type, gene) WHERE p IS NOT NULL""", rnd="lfc p neg_log10_p")
def _(t):
    lfc = t.scounts.groupBy("cell_type", "gene").agg(F.log2(F.avg("count") / 25.5).alias("lfc"))
    return win.volcano(p_table(t).where("p is not null").join(lfc, ["cell_type", "gene"]), "lfc", "p", 0.2, 0.05)


# ---------------------------------------------------------------------------------------- scalar functions


@query("c1_log_normalise", """
SELECT cell_id, gene, count, ln(1 + count * 1e4 / sum(count) OVER (PARTITION BY cell_id)) AS lognorm FROM counts""", rnd="lognorm")
def _(t):
    return sc.log_normalised(t.counts, ["cell_id"])


@query("c2_log_cpm", """
SELECT sample_id, gene, total, ln(1 + total * 1e6 / sum(total) OVER (PARTITION BY sample_id)) AS logcpm FROM (SELECT sample_id, gene, sum(count) AS total FROM scounts GROUP BY 1, 2)""", rnd="logcpm")
def _(t):
    return sc.log_cpm(ag.pseudobulk(t.scounts, ["sample_id"]), ["sample_id"])


@query("c3_fold_changes", """
SELECT gene, log2((b + 0.001) / (a + 0.001)) AS lfc_offset, CASE WHEN a > 0 AND b > 0 THEN log2(a / b) WHEN a > 0 THEN 'Infinity'::DOUBLE WHEN b > 0 THEN '-Infinity'::DOUBLE ELSE 0 END AS lfc_guarded,
  CASE WHEN b <> 0 THEN a / b WHEN a > 0 THEN 'Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS ratio
FROM (SELECT gene, coalesce(sum(count) FILTER (count > 90), 0) AS a, coalesce(sum(count) FILTER (count > 60 AND count < 63), 0) AS b FROM counts GROUP BY 1)""", rnd="lfc_offset lfc_guarded ratio")
def _(t):
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0.0))
    n = F.col("count")
    df = t.counts.groupBy("gene").agg(pick(n > 90).alias("a"), pick((n > 60) & (n < 63)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return df.select("gene", sc.log2_ratio_offset(b, a).alias("lfc_offset"), sc.log2_ratio_guarded(a, b).alias("lfc_guarded"), sc.plain_ratio(a, b).alias("ratio"))


LIN = sc.LINEAGE_MARKERS


def scaled_sql(cols, low, high, source="pw"):
    q = ", ".join(f'quantile_cont({e}, {low}) AS lo_{n}, quantile_cont({e}, {high}) AS hi_{n}' for n, e in cols.items())
    s = ", ".join(f"greatest(0, least(1, ({e} - lo_{n}) / (hi_{n} - lo_{n} + 1e-10))) AS s_{n}" for n, e in cols.items())
    return f"(SELECT *, {s} FROM {source} JOIN (SELECT sample_id, {q} FROM {source} GROUP BY 1) USING (sample_id))"


_c4 = scaled_sql({n: f'"{m}"' for n, m in LIN.items()}, 0.01, 0.99)
_tot = " + ".join(f"exp(3 * s_{n})" for n in LIN)
LINEAGE_P_SQL = f"(SELECT *, -({' + '.join(f'p_{n} * ln(greatest(p_{n}, 1e-10))' for n in LIN)}) / ln(4) AS lineage_entropy FROM (SELECT *, {', '.join(f'exp(3 * s_{n}) / ({_tot}) AS p_{n}' for n in LIN)} FROM {_c4}))"


@query("c4_lineage_softmax", f"SELECT cell_id, {', '.join(f'p_{n}' for n in LIN)}, lineage_entropy FROM {LINEAGE_P_SQL}", rnd=" ".join(f"p_{n}" for n in LIN) + " lineage_entropy")
def _(t):
    return sc.lineage_probabilities(t.pw, ["sample_id"]).select("cell_id", *[f"p_{n}" for n in LIN], "lineage_entropy")


def signed_sql(g, pen=0.5, f=lambda m: f'"{m}"'):
    mean = lambda ms: f"(({' + '.join(f(m) for m in ms)}) / {len(ms)})"
    return mean(g.positive) + (f" - {pen} * {mean(g.negative)}" if g.negative else "")


_lin = {g.label: f"({signed_sql(g)})" for g in sc.LINEAGE_SIGNED}
_lt = " + ".join(f"exp(s_{n} / 2.0)" for n in _lin)
_names = list(_lin)
_arg = " ".join("WHEN " + " AND ".join(f"s_{n} >= s_{o}" for o in _names if o != n) + f" THEN '{n}'" for n in _names)


@query("c4_lineage_assignment", f"""
SELECT cell_id, lineage, greatest({", ".join(f"p_{n}" for n in _names)}) AS lineage_confidence, -({" + ".join(f"p_{n} * ln(p_{n} + 1e-10)" for n in _names)}) / ln(4) AS lineage_entropy
FROM (SELECT *, CASE {_arg} END AS lineage, {", ".join(f"exp(s_{n} / 2.0) / ({_lt}) AS p_{n}" for n in _names)} FROM {scaled_sql(_lin, 0.05, 0.95)})""", rnd="lineage_confidence lineage_entropy")
def _(t):
    return sc.lineage_assignment(t.pw, ["sample_id"]).select("cell_id", "lineage", "lineage_confidence", "lineage_entropy")


_pm = list(dict.fromkeys(m for p in sc.GRADED_CONFLICTS for m in p))
_ex = lambda m: f'greatest(0, least(1, ("{m}" - "t_{m}") / ("x_{m}" - "t_{m}" + 1e-10)))'
_stats = ", ".join(f'quantile_cont("{m}", 0.7) AS "t_{m}", max("{m}") AS "x_{m}"' for m in _pm)
_high = lambda a, b: f'("{a}" > "t_{a}" AND "{b}" > "t_{b}")'
CONFLICT_SQL = f"""(SELECT *, {" + ".join(f"CAST({_high(a, b)} AS INTEGER)" for a, b in sc.GRADED_CONFLICTS)} AS n_conflicts,
  ({" + ".join(f"least({_ex(a)}, {_ex(b)})" for a, b in sc.GRADED_CONFLICTS)}) / 6 AS conflict_score,
  ({" + ".join(f"CAST({_high(a, b)} AS INTEGER)" for a, b in sc.COUNTED_CONFLICTS)}) / 7 AS counted_score
  FROM pw JOIN (SELECT sample_id, {_stats} FROM pw GROUP BY 1) USING (sample_id))"""


@query("c5_graded_conflicts", f"SELECT cell_id, n_conflicts, conflict_score FROM {CONFLICT_SQL}", rnd="conflict_score")
def _(t):
    return sc.graded_conflicts(t.pw, ["sample_id"]).select("cell_id", "n_conflicts", "conflict_score")


@query("c6_admixture_flag", f"SELECT cell_id, counted_score AS admixture_score, counted_score > 0.3 AS is_admixed FROM {CONFLICT_SQL}", rnd="admixture_score")
def _(t):
    return sc.counted_conflicts(t.pw, ["sample_id"]).select("cell_id", "admixture_score", "is_admixed")


@query("c9_hierarchical_gate", f"SELECT cell_id, gated_type FROM {GATED_SQL}")
def _(t):
    return gated(t).select("cell_id", "gated_type")


@query("c10_loose_gate", f"SELECT cell_id, gated_type FROM {gate_sql(sc.LOOSE_GATE, None, q=0.7)}")
def _(t):
    return sc.gate_by_quantile(t.pw, ["sample_id"], 0.7, sc.LOOSE_GATE).select("cell_id", "gated_type")


_dm = list(dict.fromkeys(m for _, cs in sc.DECISION_LIST for m, _ in cs))
_dz = ", ".join(f'("{m}" - avg("{m}") OVER w) / stddev_pop("{m}") OVER w AS "z_{m}"' for m in _dm)


def _whens(rules):
    return " ".join("WHEN " + " AND ".join(f'"z_{m}" > {cut}' for m, cut in cs) + f" THEN '{l}'" for l, cs in rules)


@query("c11_decision_list", f"""
SELECT cell_id, CASE {_whens(sc.DECISION_LIST)} ELSE 'Other' END AS gated_type FROM (SELECT cell_id, {_dz} FROM pw WINDOW w AS (PARTITION BY sample_id))""")
def _(t):
    return sc.decide_by_zscore(t.pw, ["sample_id"]).select("cell_id", "gated_type")


_lz = ", ".join(f'("{m}" - avg("{m}") OVER w) / (stddev_samp("{m}") OVER w + 1e-8) AS z_{n}' for n, m in LIN.items())
_larg = " ".join("WHEN " + " AND ".join(f"z_{n} >= z_{o}" for o in LIN if o != n) + f" THEN '{n}'" for n in LIN)
LINEAGE_SQL = f"(SELECT *, CASE {_larg} END AS lineage, greatest({', '.join(f'z_{n}' for n in LIN)}) AS lineage_score FROM (SELECT *, {_lz} FROM pw WINDOW w AS (PARTITION BY sample_id)))"
_im = list(dict.fromkeys(m for _, ms in sc.IMMUNE_REFINEMENT for m in ms))
_imq = ", ".join(f'quantile_cont("{m}", 0.5) AS "d_{m}"' for m in _im)
_imw = " ".join("WHEN " + " AND ".join(f'"{m}" > "d_{m}"' for m in ms) + f" THEN '{l}'" for l, ms in reversed(sc.IMMUNE_REFINEMENT))


@query("c12_lineage_then_immune_type", f"""
SELECT cell_id, lineage, lineage_score, CASE WHEN lineage <> 'immune' THEN lineage {_imw} ELSE lineage END AS refined_type
FROM {LINEAGE_SQL} l LEFT JOIN (SELECT sample_id, {_imq} FROM {LINEAGE_SQL} WHERE lineage = 'immune' GROUP BY 1) USING (sample_id)""", rnd="lineage_score")
def _(t):
    return sc.refine_immune(sc.lineage_by_zscore(t.pw, ["sample_id"]), ["sample_id"]).select("cell_id", "lineage", "lineage_score", "refined_type")


_sm = sc.gate_markers(sc.SIGNED_MARKERS)
_sz = ", ".join(f'("{m}" - avg("{m}") OVER w) / (stddev_pop("{m}") OVER w + 1e-8) AS "z_{m}"' for m in _sm)
_srow = ", ".join(f"{{'i': {i}, 'n': '{g.label}', 's': {signed_sql(g, f=lambda m: chr(34) + 'z_' + m + chr(34))}}}" for i, g in enumerate(sc.SIGNED_MARKERS))


@query("c13_signed_marker_score", f"""
SELECT cell_id, CASE WHEN best.s >= 0.5 THEN best.n ELSE 'Unknown' END AS scored_type, best.s AS scored_type_score FROM (
  SELECT cell_id, arg_max(r, (r.s, -r.i)) AS best FROM (SELECT cell_id, unnest([{_srow}]) AS r FROM (SELECT cell_id, {_sz} FROM pw WINDOW w AS (PARTITION BY sample_id))) GROUP BY 1)""", rnd="scored_type_score")
def _(t):
    return sc.label_by_signed_score(t.pw, ["sample_id"]).select("cell_id", "scored_type", "scored_type_score")


def _tme():
    pct = lambda l: f"count(*) FILTER (gated_type = '{l}') / count(*) * 100"
    imm = ", ".join(f"'{x}'" for x in sc.IMMUNE_TYPES)
    tc = ", ".join(f"'{x}'" for x in sc.T_CELL_TYPES)
    return f"""SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cells, count(*) FILTER (gated_type IN ({imm})) / count(*) * 100 AS total_immune_pct, {pct("CD8_T")} AS cd8_pct, {pct("Treg")} AS treg_pct,
  {pct("CD8_T")} / ({pct("Treg")} + 0.01) AS cd8_treg_ratio, {pct("Macrophage")} AS macrophage_pct, any_value(m1) AS m1_like_pct, {pct("Epithelial")} AS epithelial_pct, {pct("Stromal")} AS stromal_pct,
  coalesce(count(*) FILTER (gated_type IN ({tc}) AND "PD1" > "t_PD1") / nullif(count(*) FILTER (gated_type IN ({tc})), 0) * 100, 0) AS pct_pd1_pos_t_cells,
  coalesce(count(*) FILTER (gated_type = 'Epithelial' AND "PDL1" > "t_PDL1") / nullif(count(*) FILTER (gated_type = 'Epithelial'), 0) * 100, 0) AS pct_pdl1_pos_tumor
FROM {GATED_SQL} LEFT JOIN (SELECT sample_id, CASE WHEN count(*) > 10 THEN count(*) FILTER ("HLA-DR" > md) / count(*) * 100 END AS m1 FROM {GATED_SQL} JOIN (
    SELECT sample_id, quantile_cont("HLA-DR", 0.5) AS md FROM {GATED_SQL} WHERE gated_type = 'Macrophage' GROUP BY 1) USING (sample_id) WHERE gated_type = 'Macrophage' GROUP BY 1) USING (sample_id) GROUP BY 1"""


@query("c15_microenvironment_metrics", _tme(), rnd="total_immune_pct cd8_pct treg_pct cd8_treg_ratio macrophage_pct m1_like_pct epithelial_pct stromal_pct pct_pd1_pos_t_cells pct_pdl1_pos_tumor")
def _(t):
    from cellweave.operators.scoring import microenvironment

    return microenvironment(gated(t, ("PD1", "PDL1")), ["sample_id"], "gated_type")


@query("c14_t_cell_exhaustion", """
WITH s AS (SELECT sample_id, pd1 * (1 - ki) AS e FROM (SELECT sample_id, ("PD1" - min("PD1") OVER w) / (max("PD1") OVER w - min("PD1") OVER w + 1e-10) AS pd1,
  ("KI67" - min("KI67") OVER w) / (max("KI67") OVER w - min("KI67") OVER w + 1e-10) AS ki FROM pw WHERE "CD8" > 0 WINDOW w AS (PARTITION BY sample_id)))
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cd8_t_cells, avg(e) AS cd8_exhaustion_score, count(*) FILTER (e > q) / count(*) * 100 AS pct_cd8_exhausted
FROM s JOIN (SELECT sample_id, quantile_cont(e, 0.75) AS q FROM s GROUP BY 1) USING (sample_id) GROUP BY 1 HAVING count(*) >= 10""", rnd="cd8_exhaustion_score pct_cd8_exhausted")
def _(t):
    from cellweave.operators.scoring import exhaustion

    return exhaustion(t.pw.where(c("CD8") > 0), ["sample_id"])


@query("c16_macrophage_polarisation", f"""
SELECT sample_id, m1, m2, m1 / (m2 + 0.01) AS m1_m2_ratio FROM (SELECT sample_id, max(score) FILTER (name = 'M1') AS m1, max(score) FILTER (name = 'M2') AS m2 FROM {SIG_SCORE_SQL} GROUP BY 1)""", rnd="m1 m2 m1_m2_ratio")
def _(t):
    s = ag.module_means(t.scounts, t.cells, signatures(t), ["sample_id"]).groupBy("sample_id").pivot("name", ["M1", "M2"]).agg(F.first("score"))
    return s.select("sample_id", F.col("M1").alias("m1"), F.col("M2").alias("m2"), (F.col("M1") / (F.col("M2") + 0.01)).alias("m1_m2_ratio"))


_sh = MARKERS
_shv = lambda m: f'("{m}" - low + 0.01)'
_sht = "(" + " + ".join(_shv(m) for m in _sh) + ")"


@query("c17_scores_to_shares", f"""
SELECT cell_id, {", ".join(f'{_shv(m)} / {_sht} AS "share_{m}"' for m in _sh)},
  CASE WHEN greatest({", ".join(f'{_shv(m)} / {_sht}' for m in _sh)}) < 0.3 THEN 'Mixed' {" ".join("WHEN " + " AND ".join(f'"{m}" >= "{o}"' for o in _sh if o != m) + f" THEN '{m}'" for m in _sh)} END AS dominant_type,
  -({" + ".join(f'(({_shv(m)} / {_sht} + 1e-10) / (1 + {len(_sh)}e-10)) * ln(({_shv(m)} / {_sht} + 1e-10) / (1 + {len(_sh)}e-10))' for m in _sh)}) AS mixture_entropy
FROM pw JOIN (SELECT sample_id, min(least({", ".join(f'"{m}"' for m in _sh)})) AS low FROM pw GROUP BY 1) USING (sample_id)""", rnd=" ".join(f"share_{m}" for m in _sh) + " mixture_entropy")
def _(t):
    return sc.scores_to_shares(t.pw, _sh, ["sample_id"], 0.3).select("cell_id", *[c(f"share_{m}") for m in _sh], "dominant_type", "mixture_entropy")


@query("c18_marker_mean_deconvolution", f"""
WITH k AS (SELECT name, count(DISTINCT gene) AS k FROM {SIG_SQL} WHERE gene IN (SELECT gene FROM counts) GROUP BY 1),
s AS (SELECT cell_id, name, sum(count) / any_value(k) AS m FROM counts JOIN {SIG_SQL} USING (gene) JOIN k USING (name) GROUP BY 1, 2)
SELECT cell_id, {", ".join(f"coalesce(max(m) FILTER (name = '{n}') / sum(m), 0) AS \"{n}\"" for n in ["mCAF", "iCAF", "apCAF", "M1", "M2"])}
FROM (SELECT DISTINCT cell_id FROM counts) LEFT JOIN s USING (cell_id) GROUP BY 1""", rnd="mCAF iCAF apCAF M1 M2")
def _(t):
    from cellweave.operators.scoring import marker_mean_shares

    return marker_mean_shares(t.counts, signatures(t), ["cell_id"], ["mCAF", "iCAF", "apCAF", "M1", "M2"])


@query("c19_sample_status", f"""
SELECT sample_id, status, coalesce(nullif(concat_ws('; ', CASE WHEN n_cells < 580 THEN 'Low cell count: ' || format('{{:,}}', n_cells) || ' < 580' END, CASE WHEN median_counts < 95 THEN 'Low median transcripts: ' || printf('%.1f', median_counts) || ' < 95' END), ''), 'OK') AS reasons FROM {STATUS_SQL}""")
def _(t):
    return sc.sample_status(sample_table(t), LIMITS).select("sample_id", "status", "reasons")


@query("c20_gene_class_by_pattern", f"""
SELECT symbol, CASE {" ".join(f"WHEN regexp_matches(symbol, '(?i){p}') THEN '{l}'" for p, l in sc.NCRNA_PATTERNS)} ELSE 'protein_coding' END AS gene_class FROM symbols""")
def _(t):
    return t.symbols.select("symbol", sc.gene_class(F.col("symbol")).alias("gene_class"))


_frag = "(VALUES " + ", ".join(f"('{f}', '{d}')" for f, d in sc.NCRNA_FRAGMENTS) + ") AS f(fragment, class)"


@query("c21_gene_fragment_classes", f"SELECT symbol, fragment, class FROM symbols JOIN {_frag} ON contains(upper(symbol), fragment)")
def _(t):
    return sc.gene_fragment_classes(t.symbols.select("symbol"), "symbol")


@query("c22_parse_ids", """
SELECT o_orderkey AS cell_id, right(o_clerk, 1) AS lane_no, regexp_replace(o_clerk, '[0-9]+$', '') AS prefix, split_part(label, '_', 1) AS base_type
FROM (SELECT o_orderkey, 'N' || CAST(o_custkey AS VARCHAR) AS o_clerk, replace(replace(o_orderpriority, '-', '_'), ' ', '_') AS label FROM orders)""")
def _(t):
    o = t.read("orders").select(
        F.col("o_orderkey").alias("cell_id"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("s"),
        F.regexp_replace("o_orderpriority", "[- ]", "_").alias("label"),
    )
    return sc.parse_ids(o, "s", "label").select("cell_id", "lane_no", "prefix", "base_type")


_RES = f"(SELECT cell_type, gene, p, log2(m / 25.5) AS d, n FROM {P_SQL} JOIN (SELECT cell_type, gene, avg(count) AS m, CAST(count(*) AS BIGINT) AS n FROM scounts GROUP BY 1, 2) USING (cell_type, gene) WHERE p IS NOT NULL)"
_EFF = "CASE WHEN abs(d * 4) < 0.2 THEN 'negligible' WHEN abs(d * 4) < 0.5 THEN 'small' WHEN abs(d * 4) < 0.8 THEN 'medium' ELSE 'large' END"


@query("c23_significance_labels", f"""
SELECT cell_type, gene, {_EFF} AS effect, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars,
  CASE WHEN p < 0.05 THEN 'Significant at p<0.05 (' || {_EFF} || ' effect)' WHEN p < 0.10 THEN 'Trending (p<0.10): ' || {_EFF} || ' effect, hypothesis-generating' ELSE 'Not significant (' || {_EFF} || ' effect)' END
  || CASE WHEN n + 1 < 10 THEN chr(10) || 'Note: VERY LIMITED POWER (n<10)' WHEN n + 1 < 20 THEN chr(10) || 'Note: Limited power (n<20)' ELSE '' END AS interpretation FROM {_RES}""")
def _(t):
    n = t.scounts.groupBy("cell_type", "gene").agg(F.log2(F.avg("count") / 25.5).alias("d"), ag.n_rows().alias("n"))
    df, d = p_table(t).where("p is not null").join(n, ["cell_type", "gene"]), F.col("d") * 4
    return df.select("cell_type", "gene", sc.effect_label(d).alias("effect"), sc.significance_stars(F.col("p")).alias("stars"),
                     sc.significance_label(F.col("p"), d, F.col("n"), F.lit(1)).alias("interpretation"))


@query("c24_json_dict_rows", """
SELECT event_id AS sample_id, 'k' AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events WHERE event_type <> 'error'""")
def _(t):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    ev = t.read("events").select(
        F.col("event_id").alias("sample_id"),
        F.format_string('{"status": "%s", "mean_proportions": %s}', status, F.col("props")).alias("text"),
    )
    return sc.dict_rows(ev, ["sample_id"], "text")
