"""Queries for sources, filters, joins and reshaping."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from cellweave.functions import scalars
from cellweave.operators import clean, joins, reshape
from cellweave.plans.registry import query
from cellweave.plans.tables import MARKERS, MARKERS_Q, Tables
from cellweave.scale import c, shared_folder
from cellweave.sources import readers, registry, sinks

TYPES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("s1_counts_from_triplets", """
SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, 'G' || CAST(l_partkey % 300 AS VARCHAR) AS gene, sum(l_quantity) AS count
FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0""")
def _(t: Tables):
    li = t.read("lineitem").withColumn("g", F.concat(F.lit("G"), (F.col("l_partkey") % 300).cast("string")))
    return readers.counts_from_triplets(li, "l_orderkey", "g", "l_quantity")


@query("s2_wide_to_long", """
SELECT cell_id, marker AS gene, intensity AS count FROM prot WHERE intensity <> 0""")
def _(t):
    return readers.melt_wide(t.pw.drop("sample_id", "cell_type"), ["cell_id"], "gene", "count", keep=MARKERS, drop_zero=True)


def wide_file(t, values, suffix=""):
    """A gzipped CSV of the protein table as instruments write it: label and one column per marker."""
    folder = os.path.join(scratch(t), "wide")
    wide = t.pw.select(F.col("cell_id").alias("label"), *[values(c(m)).alias(f"{m}{suffix}") for m in MARKERS])
    sinks.write_table(wide, folder, "csv", (), "gzip")
    return folder


@query("s2_wide_gzip_csv_roundtrip", """
SELECT CAST(cell_id AS VARCHAR) AS cell_id, marker AS gene, intensity AS count FROM prot WHERE intensity <> 0 AND intensity <= 0.2""")
def _(t):
    return readers.read_transcripts_wide(t.spark, wide_file(t, lambda v: F.when(v > 0.2, float("nan")).otherwise(v)))


@query("s3_protein_csv_roundtrip", """
SELECT CAST(cell_id AS VARCHAR) AS cell_id, marker, CASE WHEN intensity <= 0.2 THEN intensity END AS intensity FROM prot""")
def _(t):
    return readers.read_protein_csv(t.spark, wide_file(t, lambda v: F.when(v > 0.2, float("inf")).otherwise(v), readers.INTENSITY))


@query("s5_vendor_csv_roundtrip", """
SELECT s_nationkey AS batch, CAST(count(*) AS BIGINT) AS n_samples, avg(s_acctbal) AS mean_metric FROM supplier GROUP BY 1""", rnd="mean_metric")
def _(t):
    folder = os.path.join(scratch(t), "vendor")
    sinks.write_table(t.read("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), folder, "csv", ())
    df = readers.read_vendor_table(t.spark, folder, ["s_suppkey", "s_nationkey", "s_acctbal"])
    return df.groupBy(F.col("s_nationkey").cast(t.read("supplier").schema["s_nationkey"].dataType).alias("batch")).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("s_acctbal").alias("mean_metric"))


@query("s10_workbook_roundtrip", """
SELECT 'cells' AS sheet, CAST(count(*) AS BIGINT) AS n, CAST(sum(cell_id) AS BIGINT) AS total FROM cells
UNION ALL SELECT 'samples', CAST(count(*) AS BIGINT), CAST(sum(length(sample_id)) AS BIGINT) FROM samples""")
def _(t):
    folder = os.path.join(scratch(t), "workbook")
    sinks.write_workbook({"cells": t.cells.select("cell_id", "x"), "samples": t.samples}, folder)
    sheet = lambda name: t.spark.read.option("header", True).csv(f"{folder}/{name}")
    parts = [sheet("cells").select(F.lit("cells").alias("sheet"), F.col("cell_id").cast("long").alias("v")), sheet("samples").select(F.lit("samples").alias("sheet"), F.length("sample_id").cast("long").alias("v"))]
    return reshape.outer_concat(parts).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("s3_protein_long", """
SELECT CAST(cell_id AS VARCHAR) AS cell_id, marker, intensity FROM prot""")
def _(t):
    wide = t.pw.select(
        c("cell_id").cast("string").alias("label"),
        *[c(m).alias(f"{m}_intensity_mean") for m in MARKERS],
        c("CD3").alias("nuclearstain_intensity_mean"),
        c("CD4").alias("cytoplasmicstain_intensity_mean"),
    )
    return readers.protein_long(wide, "label")


@query("s4_cell_metadata_csv_roundtrip", """
SELECT CAST(cell_id AS VARCHAR) AS label, x AS cell_x, y AS cell_y, area AS nuclei_area,
  CAST(n AS BIGINT) AS n_genes_by_counts, tot AS total_counts
FROM cells JOIN (SELECT cell_id, count(*) AS n, sum(count) AS tot FROM counts GROUP BY 1) USING (cell_id)""", rnd="cell_x nuclei_area")
def _(t):
    qc = t.counts.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes_by_counts"), F.sum("count").alias("total_counts"))
    meta = t.cells.join(qc, "cell_id").select(
        F.col("cell_id").alias("label"), F.col("x").alias("cell_x"), F.col("y").alias("cell_y"),
        F.col("area").alias("nuclei_area"), "n_genes_by_counts", "total_counts",
    )
    folder = os.path.join(scratch(t), "cell_metadata")
    sinks.write_table(meta, folder, "csv")
    return readers.read_cell_metadata(t.spark, folder)


@query("s5_vendor_metrics", """
SELECT s_nationkey AS batch, CAST(count(*) AS BIGINT) AS n_samples, avg(s_acctbal) AS mean_metric FROM supplier GROUP BY 1""", rnd="mean_metric")
def _(t):
    df = readers.require_columns(t.read("supplier"), ["s_suppkey", "s_nationkey", "s_acctbal"])
    return df.groupBy(F.col("s_nationkey").alias("batch")).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("s_acctbal").alias("mean_metric"))


@query("s6_discover_samples_by_path", """
SELECT lane, sample_id, CAST(count(*) AS BIGINT) AS n_cells FROM cells JOIN (SELECT sample_id, lane FROM samples) USING (sample_id) GROUP BY 1, 2""")
def _(t):
    folder = os.path.join(scratch(t), "by_lane")
    df = joins.with_sample_attributes(t.cells.select("sample_id", "cell_id"), t.samples, ["lane"])
    sinks.write_table(df.withColumnRenamed("sample_id", "sample"), folder, "csv", ["lane", "sample"])
    found = readers.discover_samples(t.spark, f"{folder}/*/*", r"lane=(L\d+)/sample=(S\d+)/")
    return found.groupBy("lane", "sample_id").agg(F.count(F.lit(1)).alias("n_cells"))


@query("s7_sample_lookup", """
SELECT sample_id, patient, timepoint, response FROM samples WHERE response = 'R' AND timepoint = 'Pre' AND sample_id NOT IN ('S04')""")
def _(t):
    return registry.pick_samples(t.samples, ["S04"], response="R", timepoint="Pre").select("sample_id", "patient", "timepoint", "response")


@query("s8_thresholds_with_default", """
SELECT sample_id, tissue AS platform, CASE tissue WHEN 'ASIA' THEN 'G4X' ELSE 'Visium' END AS limits_from,
  CASE tissue WHEN 'ASIA' THEN 50 ELSE 200 END AS min_genes, CASE tissue WHEN 'ASIA' THEN 10000 ELSE 50000 END AS max_counts
FROM samples""")
def _(t):
    platform = F.when(F.col("tissue") == "ASIA", "G4X").otherwise(F.col("tissue"))
    df = t.samples.withColumn("platform", platform)
    out = registry.with_thresholds(df, registry.thresholds(t.spark))
    return out.select("sample_id", F.col("tissue").alias("platform"), "limits_from", "min_genes", "max_counts")


@query("s9_load_manifest", """
SELECT sample_id, CAST(coalesce(n_cells, 0) AS BIGINT) AS n_cells, CAST(coalesce(n_genes, 0) AS BIGINT) AS n_genes,
  CASE WHEN n_cells IS NULL THEN 'no data' END AS error
FROM (SELECT sample_id FROM samples UNION SELECT 'S99')
LEFT JOIN (SELECT sample_id, count(DISTINCT cell_id) AS n_cells, count(DISTINCT gene) AS n_genes FROM scounts GROUP BY 1) USING (sample_id)""")
def _(t):
    expected = t.samples.select("sample_id").union(t.literal([("S99",)], "sample_id string"))
    return readers.load_manifest(t.scounts, expected)


@query("s10_table_sinks_roundtrip", """
SELECT 'parquet' AS sink, sample_id, CAST(count(*) AS BIGINT) AS n, sum(y) AS sum_y FROM cells GROUP BY 2
UNION ALL SELECT 'json', sample_id, CAST(count(*) AS BIGINT), sum(y) FROM cells GROUP BY 2
UNION ALL SELECT 'csv', sample_id, CAST(count(*) AS BIGINT), sum(y) FROM cells GROUP BY 2""")
def _(t):
    parts = []
    for fmt in ("parquet", "json", "csv"):
        folder = os.path.join(scratch(t), f"sink_{fmt}")
        sinks.write_table(t.cells.select("sample_id", "cell_id", "y"), folder, fmt)
        back = t.spark.read.format(fmt).schema("cell_id long, y double, sample_id string").option("header", True).load(folder)
        parts.append(back.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y")).select(F.lit(fmt).alias("sink"), "*"))
    return reshape.outer_concat(parts)


def scratch(t: Tables) -> str:
    """A new folder, in the folder that driver and executors share, for tables a query writes."""
    return f"{shared_folder(t.spark)}/tables-{t.spark.sparkContext.applicationId}-{os.urandom(4).hex()}"


@query("s11_metadata_only_read", """
SELECT CAST(count(*) AS BIGINT) AS n_cells, CAST(count(DISTINCT sample_id) AS BIGINT) AS n_samples FROM cells""")
def _(t):
    return t.cells.select("sample_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct("sample_id").alias("n_samples"))


@query("p1_keep_targets", """
SELECT symbol AS gene, probe_type FROM symbols
WHERE coalesce(probe_type = 'targeting', NOT (symbol LIKE 'NCP-%' OR symbol LIKE 'NCS-%'))""")
def _(t):
    return clean.keep_targets(t.symbols.select(F.col("symbol").alias("gene"), "probe_type"))


QC_SQL = """(SELECT cell_id, sum(count) AS n_counts, CAST(count(*) AS BIGINT) AS n_genes,
  sum(CASE WHEN gene LIKE 'G1%' THEN count ELSE 0 END) / sum(count) * 100 AS pct_mt FROM counts GROUP BY 1)"""


def qc_of(t):
    mt = F.col("gene").startswith("G1")
    return t.counts.groupBy("cell_id").agg(
        F.sum("count").alias("n_counts"),
        F.count(F.lit(1)).alias("n_genes"),
        (F.sum(F.when(mt, F.col("count")).otherwise(0)) / F.sum("count") * 100).alias("pct_mt"),
    )


@query("p2_filter_cells_by_range", f"""
SELECT cell_id, n_counts, n_genes, pct_mt FROM {QC_SQL} WHERE n_genes BETWEEN 2 AND 6 AND n_counts >= 50 AND n_counts <= 180 AND pct_mt <= 60""", rnd="pct_mt")
def _(t):
    return clean.filter_cells(qc_of(t), {"n_genes": (2, 6), "n_counts": (50, 180), "pct_mt": (None, 60.0)})


@query("p3_filter_genes_by_cells", """
SELECT cell_id, gene, count FROM counts WHERE gene IN (SELECT gene FROM counts WHERE count > 0 GROUP BY 1 HAVING count(*) >= 190)""")
def _(t):
    return clean.filter_genes(t.counts, 190).select("cell_id", "gene", "count")


@query("p4_cell_qc_removal_counters", f"""
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_before,
  CAST(count(*) FILTER (n_genes < 3) AS BIGINT) AS removed_low_genes, CAST(count(*) FILTER (n_counts < 60) AS BIGINT) AS removed_low_counts,
  CAST(count(*) FILTER (admixed) AS BIGINT) AS removed_admixed,
  CAST(count(*) FILTER (NOT (n_genes < 3 OR n_counts < 60 OR admixed)) AS BIGINT) AS n_after
FROM cells JOIN {QC_SQL} USING (cell_id) GROUP BY 1""")
def _(t):
    df = t.cells.join(qc_of(t), "cell_id")
    return clean.removal_report(df, ["sample_id"], {
        "low_genes": F.col("n_genes") < 3, "low_counts": F.col("n_counts") < 60, "admixed": F.col("admixed"),
    })


@query("p5_hard_segmentation_filter", f"""
SELECT cell_id, area, n_genes FROM cells JOIN {QC_SQL} USING (cell_id)
WHERE n_genes BETWEEN 2 AND 7 AND n_counts BETWEEN 20 AND 250 AND area BETWEEN 5 AND 80""", rnd="area")
def _(t):
    df = t.cells.join(qc_of(t), "cell_id")
    limits = {"n_genes": (2, 7), "n_counts": (20, 250), "area": (5, 80), "nucleus_circularity": (0.1, None)}
    return clean.filter_cells(df, limits).select("cell_id", "area", "n_genes")


@query("p6_qc_subsets", """
SELECT cell_id, area BETWEEN 5 AND 95 AS baseline, area BETWEEN 5 AND 95 AND x < p90 AS qc_strict,
  area BETWEEN 5 AND 95 AND NOT admixed AS clean, area BETWEEN 5 AND 95 AND x < p70 AS clean_by_score
FROM cells JOIN (SELECT sample_id, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.7) AS p70 FROM cells GROUP BY 1) USING (sample_id)""")
def _(t):
    return scalars.qc_subsets(
        t.cells, ["sample_id"], baseline=F.col("area").between(5, 95), score="x", flag="admixed"
    ).select("cell_id", "baseline", "qc_strict", "clean", "clean_by_score")


@query("p7_exclude_samples", """
SELECT cell_id, sample_id FROM cells WHERE sample_id NOT IN ('S03', 'S07', 'S11')""")
def _(t):
    failed = t.literal([("S03",), ("S07",), ("S11",)], "sample_id string")
    return clean.without(t.cells.select("cell_id", "sample_id"), failed, ["sample_id"])


@query("p8_restrict_cell_types", """
SELECT cell_id, cell_type, CASE cell_type WHEN 'BUILDING' THEN 'stromal' ELSE 'epithelial' END AS cell_group
FROM cells WHERE cell_type IN ('BUILDING', 'MACHINERY') AND NOT admixed""")
def _(t):
    mapping = t.literal([("BUILDING", "stromal"), ("MACHINERY", "epithelial")], "cell_type string, cell_group string")
    return clean.restrict_types(t.cells, mapping, drop_admixed=True).select("cell_id", "cell_type", "cell_group")


SIGNATURES = [
    ("mCAF", "G1"), ("mCAF", "G2"), ("mCAF", "G3"), ("iCAF", "G10"), ("iCAF", "G11"), ("iCAF", "ABSENT1"),
    ("apCAF", "G20"), ("apCAF", "ABSENT2"), ("M1", "G30"), ("M1", "G31"), ("M2", "G40"), ("M2", "G41"),
]
SIG_SQL = "(VALUES " + ", ".join(f"('{n}', '{g}')" for n, g in SIGNATURES) + ") AS sig(name, gene)"


def signatures(t):
    return t.literal(SIGNATURES, "name string, gene string")


@query("p9_present_signature_genes", f"""
WITH present AS (SELECT name, gene FROM {SIG_SQL} WHERE gene IN (SELECT gene FROM counts))
SELECT name, gene, n_present FROM present JOIN (SELECT name, CAST(count(DISTINCT gene) AS BIGINT) AS n_present FROM present GROUP BY 1 HAVING count(DISTINCT gene) >= 2) USING (name)""")
def _(t):
    return clean.present_signatures(signatures(t), t.counts, 2).select("name", "gene", "n_present")


PROFILE_SQL = """(SELECT sample_id, min(v) AS min_value, max(v) AS max_value, avg(v) AS mean_value, bool_and(v = round(v)) AS all_integer,
  CAST(count(v) AS BIGINT) AS n_values FROM (SELECT sample_id, count AS v FROM scounts) GROUP BY 1)"""


@query("p10_raw_count_check", f"""
SELECT *, min_value >= 0 AND all_integer AND max_value >= 1 AS is_raw_counts,
  max_value < 20 AND min_value >= 0 AND NOT (all_integer AND max_value > 10) AS is_normalised FROM {PROFILE_SQL}""", rnd="mean_value")
def _(t):
    return clean.raw_and_normalised_flags(clean.value_profile(t.scounts, ["sample_id"], "count"))


@query("p11_normalised_check", """
SELECT sample_id, max_value, max_value < 20 AND min_value >= 0 AND NOT (all_integer AND max_value > 10) AS is_normalised
FROM (SELECT sample_id, min(v) AS min_value, max(v) AS max_value, bool_and(v = round(v)) AS all_integer
  FROM (SELECT sample_id, ln(1 + count * 1e4 / sum(count) OVER (PARTITION BY cell_id)) AS v FROM scounts) GROUP BY 1)""", rnd="max_value")
def _(t):
    norm = scalars.log_normalised(t.scounts, ["cell_id"])
    p = clean.raw_and_normalised_flags(clean.value_profile(norm, ["sample_id"], "lognorm"))
    return p.select("sample_id", "max_value", "is_normalised")


@query("p12_validation_report", f"""
SELECT sample_id AS target, "check", status FROM (
  SELECT sample_id, 'no_negatives' AS "check", CASE WHEN min_value < 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM {PROFILE_SQL}
  UNION ALL SELECT sample_id, 'integer_valued', CASE WHEN NOT all_integer THEN 'FAIL' ELSE 'PASS' END FROM {PROFILE_SQL}
  UNION ALL SELECT sample_id, 'depth', CASE WHEN max_value < 1 THEN 'FAIL' WHEN max_value < 95 THEN 'WARN' ELSE 'PASS' END FROM {PROFILE_SQL})""")
def _(t):
    p = clean.value_profile(t.scounts, ["sample_id"], "count")
    never = F.lit(False)
    return clean.validation_report(p, "sample_id", [
        ("no_negatives", F.col("min_value") < 0, never),
        ("integer_valued", ~F.col("all_integer"), never),
        ("depth", F.col("max_value") < 1, F.col("max_value") < 95),
    ])


@query("p13_seeded_subsample", """
SELECT sample_id, cell_id FROM (SELECT sample_id, cell_id, row_number() OVER (PARTITION BY sample_id ORDER BY md5('42|' || CAST(cell_id AS VARCHAR)), cell_id) AS rn FROM cells) WHERE rn <= 200""")
def _(t):
    return clean.subsample(t.cells.select("sample_id", "cell_id"), ["sample_id"], 200, "cell_id")


@query("p14_unique_ids", """
SELECT cell_id, CASE WHEN k = 1 THEN b ELSE b || '-' || CAST(k - 1 AS VARCHAR) END AS unique_id FROM (
  SELECT cell_id, sample_id || '_' || cell_type AS b, row_number() OVER (PARTITION BY sample_id, cell_type ORDER BY cell_id) AS k FROM cells)""")
def _(t):
    return clean.unique_ids(t.cells, "sample_id", "cell_type", "cell_id").select("cell_id", "unique_id")


_alias_sql = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in clean.MARKER_ALIASES.items())


@query("p15_canonical_markers", f"""
SELECT cell_id, spelled, CASE replace(replace(lower(spelled), '_', '-'), ' ', '') {_alias_sql} ELSE spelled END AS canonical
FROM (SELECT cell_id, CASE WHEN cell_id % 2 = 0 THEN replace(upper(marker), '-', '_') ELSE ' ' || lower(marker) END AS spelled FROM prot)""")
def _(t):
    m = F.col("marker")
    spelled = F.when(F.col("cell_id") % 2 == 0, F.regexp_replace(F.upper(m), "-", "_")).otherwise(F.concat(F.lit(" "), F.lower(m)))
    return clean.canonical_markers(t.prot.select("cell_id", spelled.alias("spelled")), "spelled", "canonical")


@query("p16_mean_impute", """
SELECT cell_id, coalesce(v, avg(v) OVER (PARTITION BY sample_id)) AS filled, coalesce(v, 0) AS zeroed
FROM (SELECT cell_id, sample_id, CASE WHEN cell_id % 7 IN (0, 3) THEN NULL ELSE "CD3" END AS v FROM pw)""", rnd="filled zeroed", digits=8)
def _(t):
    k = F.col("cell_id") % 7
    broken = F.when(k == 0, F.lit(float("nan"))).when(k == 3, F.lit(float("inf"))).otherwise(c("CD3"))
    df = t.pw.select("cell_id", "sample_id", broken.alias("filled")).withColumn("zeroed", clean.finite_or_zero(F.col("filled")))
    return clean.mean_impute(df, ["sample_id"], ["filled"]).select("cell_id", "filled", "zeroed")


@query("p17_resolve_column", "SELECT cell_id, x AS cell_x FROM cells", rnd="cell_x")
def _(t):
    name = readers.resolve_column(t.cells, ["cell_x", "x_centroid", "x"])
    return t.cells.select("cell_id", c(name).alias("cell_x"))


@query("j1_intersect_modalities", """
SELECT cells.cell_id, cells.sample_id, n.n_genes, pw."CD3" AS cd3
FROM cells JOIN (SELECT cell_id, CAST(count(*) AS BIGINT) AS n_genes FROM counts GROUP BY 1) n ON cells.cell_id = n.cell_id JOIN pw ON cells.cell_id = pw.cell_id""")
def _(t):
    rna = t.counts.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_genes"))
    return joins.intersect_modalities(t.cells.select("cell_id", "sample_id"), rna, t.pw.select("cell_id", c("CD3").alias("cd3")), ["cell_id"])


@query("j2_sample_attributes", """
SELECT cell_id, c.sample_id, coalesce(s.patient, 'unknown') AS patient, coalesce(s.stage, 'unknown') AS stage
FROM cells c LEFT JOIN (SELECT * FROM samples WHERE tissue <> 'ASIA') s ON c.sample_id = s.sample_id""")
def _(t):
    dim = t.samples.where("tissue <> 'ASIA'")
    return joins.with_sample_attributes(t.cells.select("cell_id", "sample_id"), dim, ["patient", "stage"])


@query("j3_keep_passing_samples", """
SELECT cell_id, sample_id, status FROM cells JOIN (
  SELECT sample_id, CASE WHEN count(*) < 550 THEN 'FAIL' WHEN count(*) < 600 THEN 'WARN' ELSE 'PASS' END AS status FROM cells GROUP BY 1) USING (sample_id)
WHERE status <> 'FAIL' AND sample_id <> 'S01'""")
def _(t):
    n = F.count(F.lit(1))
    status = F.when(n < 550, "FAIL").when(n < 600, "WARN").otherwise("PASS")
    summary = t.cells.groupBy("sample_id").agg(status.alias("status"))
    manifest = t.samples.select("sample_id", F.when(F.col("sample_id") == "S01", "missing file").alias("error"))
    return clean.keep_passing(t.cells.select("cell_id", "sample_id"), summary, manifest)


@query("j4_baseline_comparison", """
SELECT sample_id, n_cells, base_n_cells, base_n_cells - n_cells AS diff_n_cells, (base_n_cells - n_cells) / base_n_cells * 100 AS pct_removed_n_cells
FROM (SELECT sample_id, CAST(count(*) FILTER (NOT admixed) AS BIGINT) AS n_cells, CAST(count(*) AS BIGINT) AS base_n_cells FROM cells GROUP BY 1)""", rnd="pct_removed_n_cells")
def _(t):
    n = F.count(F.lit(1)).alias("n_cells")
    ours = t.cells.groupBy("sample_id").agg(F.count_if(~F.col("admixed")).alias("n_cells"))
    return joins.compare_with_baseline(ours, t.cells.groupBy("sample_id").agg(n), "sample_id", ["n_cells"])


@query("j5_cross_source_correlation", """
SELECT a.sample_id, CAST(count(*) AS BIGINT) AS n_common, corr(a.x, b.x) AS r_x, corr(a.y, b.y) AS r_y FROM cells a JOIN (
  SELECT l_orderkey AS cell_id, sum(l_extendedprice) AS x, sum(l_quantity) AS y FROM lineitem GROUP BY 1) b ON a.cell_id = b.cell_id GROUP BY 1""", rnd="r_x r_y")
def _(t):
    other = t.read("lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.sum("l_extendedprice").alias("x"), F.sum("l_quantity").alias("y"))
    return joins.agreement(t.cells, other, ["cell_id"], ["sample_id"], ["x", "y"])


@query("j6_cluster_concordance", """
SELECT cell_type AS label_a, top_flag AS label_b, CAST(count(*) AS BIGINT) AS n FROM cells JOIN (
  SELECT l_orderkey AS cell_id, max(l_returnflag) AS top_flag FROM lineitem GROUP BY 1) USING (cell_id) GROUP BY 1, 2""")
def _(t):
    other = t.read("lineitem").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.max("l_returnflag").alias("flag"))
    return joins.contingency_long(t.cells, other, ["cell_id"], "cell_type", "flag")


@query("j7_feature_table_joins", """
SELECT s.sample_id, s.response, a.mean_x, b.n_admixed FROM samples s
LEFT JOIN (SELECT sample_id, avg(x) AS mean_x FROM cells GROUP BY 1) a ON s.sample_id = a.sample_id
JOIN (SELECT sample_id, CAST(count(*) AS BIGINT) AS n_admixed FROM cells WHERE admixed GROUP BY 1) b ON s.sample_id = b.sample_id""", rnd="mean_x")
def _(t):
    a = t.cells.groupBy("sample_id").agg(F.avg("x").alias("mean_x"))
    b = t.cells.where("admixed").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_admixed"))
    return t.samples.select("sample_id", "response").join(a, "sample_id", "left").join(b, "sample_id")


SHARES_SQL = """(SELECT sample_id, cell_type, count(*) / sum(count(*)) OVER (PARTITION BY sample_id) AS share FROM cells GROUP BY 1, 2)"""


@query("j8_paired_pre_post_change", f"""
SELECT patient, cell_type, pre_value, post_value, post_value - pre_value AS change, CASE WHEN pre_value <> 0 THEN post_value / pre_value END AS fold_change
FROM (SELECT patient, cell_type, max(share) FILTER (timepoint = 'Pre') AS pre_value, max(share) FILTER (timepoint = 'Post') AS post_value
  FROM {SHARES_SQL} JOIN samples USING (sample_id) GROUP BY 1, 2 HAVING count(*) FILTER (timepoint = 'Pre') = 1 AND count(*) FILTER (timepoint = 'Post') = 1)""",
    rnd="pre_value post_value change fold_change")
def _(t):
    from cellweave.operators.aggregates import label_shares

    df = label_shares(t.cells, ["sample_id"], "cell_type").join(t.samples, "sample_id")
    return joins.paired_change(df, ["patient", "cell_type"], "timepoint", "share")


@query("j9_gene_set_overlap", """
SELECT CASE WHEN b.gene IS NULL THEN 'only_a' WHEN a.gene IS NULL THEN 'only_b' ELSE 'both' END AS category, CAST(count(*) AS BIGINT) AS n
FROM (SELECT gene FROM counts GROUP BY 1 HAVING sum(count) > 5500) a FULL OUTER JOIN (SELECT gene FROM counts GROUP BY 1 HAVING max(count) >= 85) b ON a.gene = b.gene GROUP BY 1""")
def _(t):
    g = t.counts.groupBy("gene").agg(F.sum("count").alias("s"), F.max("count").alias("m"))
    return joins.overlap_counts(g.where("s > 5500"), g.where("m >= 85"), "gene")


@query("j13_cell_type_ratios", f"""
SELECT a.sample_id, a.cell_type AS type_a, b.cell_type AS type_b, (a.share + 0.001) / (b.share + 0.001) AS ratio
FROM {SHARES_SQL} a JOIN {SHARES_SQL} b ON a.sample_id = b.sample_id AND a.cell_type < b.cell_type""", rnd="ratio")
def _(t):
    from cellweave.operators.aggregates import label_shares

    return joins.type_ratios(label_shares(t.cells, ["sample_id"], "cell_type"), ["sample_id"])


NET = [("EGFR", f"G{i}", 1.0 - i % 3 * 0.75) for i in range(0, 60, 2)] + [("TNFA", f"G{i}", 0.25 + i % 5 * 0.5) for i in range(5, 90, 3)]
NET_SQL = "(VALUES " + ", ".join(f"('{s}', '{g}', {w}::DOUBLE)" for s, g, w in NET) + ") AS net(source, gene, weight)"


def network(t):
    return t.literal(NET, "source string, target string, weight double")


@query("j14_expression_network_join", f"""
SELECT cell_id, source, sum(count * weight) AS weighted_sum, CAST(count(*) AS BIGINT) AS n_targets FROM counts JOIN {NET_SQL} USING (gene) GROUP BY 1, 2""", rnd="weighted_sum")
def _(t):
    j = joins.with_network(t.counts, network(t))
    return j.groupBy("cell_id", "source").agg(F.sum(F.col("count") * F.col("weight")).alias("weighted_sum"), F.count(F.lit(1)).alias("n_targets"))


@query("u1_outer_concat", """
SELECT sample_id, sum(a) AS sum_a, sum(b) AS sum_b, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT sample_id, x AS a, 0 AS b FROM cells WHERE cell_type = 'BUILDING' UNION ALL SELECT sample_id, 0, y FROM cells WHERE cell_type <> 'BUILDING') GROUP BY 1""", rnd="sum_a sum_b", digits=3)
def _(t):
    one = t.cells.where("cell_type = 'BUILDING'").select("sample_id", F.col("x").alias("a"))
    two = t.cells.where("cell_type <> 'BUILDING'").select("sample_id", F.col("y").alias("b"))
    return reshape.outer_concat([one, two], 0.0).groupBy("sample_id").agg(F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), F.count(F.lit(1)).alias("n"))


@query("u2_inner_concat_common_genes", """
SELECT gene, CAST(count(*) AS BIGINT) AS n, sum(count) AS total FROM scounts WHERE gene IN (
  SELECT gene FROM scounts GROUP BY 1 HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM scounts)) GROUP BY 1""")
def _(t):
    return reshape.inner_concat(t.scounts).groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


@query("u3_shared_and_unique_genes", """
WITH a AS (SELECT gene FROM counts GROUP BY 1 HAVING sum(count) > 5400), b AS (SELECT gene FROM counts GROUP BY 1 HAVING count(*) > 200)
SELECT gene, 'shared' AS category FROM (SELECT gene FROM a INTERSECT SELECT gene FROM b)
UNION ALL SELECT gene, 'only_a' FROM (SELECT gene FROM a EXCEPT SELECT gene FROM b) UNION ALL SELECT gene, 'only_b' FROM (SELECT gene FROM b EXCEPT SELECT gene FROM a)""")
def _(t):
    g = t.counts.groupBy("gene").agg(F.sum("count").alias("s"), F.count(F.lit(1)).alias("n"))
    return reshape.shared_and_unique(g.where("s > 5400").select("gene"), g.where("n > 200").select("gene"))


@query("u4_first_row_per_key", """
SELECT sample_id, cell_type, cell_id, x FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, cell_type ORDER BY x DESC, cell_id) AS rn FROM cells) WHERE rn = 1""", rnd="x")
def _(t):
    return clean.first_per_key(t.cells, ["sample_id", "cell_type"], [F.col("x").desc(), F.col("cell_id")]).select("sample_id", "cell_type", "cell_id", "x")


@query("u5_melt_and_pivot", f"""
SELECT marker, {", ".join(f"coalesce(avg(intensity) FILTER (sample_id = 'S{i}'), 0) AS S{i}" for i in range(4))} FROM prot GROUP BY 1""", rnd="S0 S1 S2 S3", digits=8)
def _(t):
    long = t.pw.unpivot(["sample_id", "cell_id"], MARKERS_Q, "marker", "intensity")
    return reshape.pivot_filled(long, ["marker"], "sample_id", [f"S{i}" for i in range(4)], F.avg("intensity"), 0.0)
