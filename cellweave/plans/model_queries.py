"""Queries on sample features, two-class models and incremental processing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cellweave.functions.scalars import sample_status
from cellweave.operators import aggregates as ag
from cellweave.operators import classify as cl
from cellweave.operators import folds as fo
from cellweave.plans.clean_queries import QC_SQL, TYPES, qc_of
from cellweave.plans.registry import query
from cellweave.scale import c, materialize, shared_folder
from cellweave.streaming.incremental import process_new_samples

FEATURES = [f"{v}_prop" for v in TYPES] + ["spatial_spread_x", "spatial_spread_y", "spatial_density", "n_cell_types", "simpson_diversity"]


def features(t):
    return cl.sample_features(t.cells, "cell_type", TYPES, t.samples.select("sample_id", "response"))


@query("m15_sample_features", f"""
SELECT s.sample_id, response, {', '.join(f"{v}_prop" for v in TYPES)}, spatial_spread_x, spatial_spread_y, spatial_density, n_cell_types, simpson_diversity FROM samples s LEFT JOIN (
  SELECT sample_id, {', '.join(f"count(*) FILTER (cell_type = '{v}') / count(*) AS {v}_prop" for v in TYPES)}, stddev_pop(x) AS spatial_spread_x, stddev_pop(y) AS spatial_spread_y,
    count(*) / ((max(x) - min(x)) * (max(y) - min(y)) + 1) AS spatial_density FROM cells GROUP BY 1) USING (sample_id)
LEFT JOIN (SELECT sample_id, CAST(count(*) FILTER (p > 0.01) AS BIGINT) AS n_cell_types, 1 - sum(p * p) AS simpson_diversity FROM (SELECT sample_id, count(*) / sum(count(*)) OVER (PARTITION BY sample_id) AS p FROM cells GROUP BY sample_id, cell_type) GROUP BY 1) USING (sample_id)""",
    rnd=" ".join(f for f in FEATURES if f != "n_cell_types"))
def _(t):
    return features(t)


def data(t):
    return cl.design(features(t), "sample_id", FEATURES, "response", "R")


@query("m13_lda_leave_one_out")
def _(t):
    return cl.lda_leave_one_out(data(t), len(FEATURES)).select("id", "y", F.round("score", 4).alias("score"), "prediction")


@query("m13_lda_evaluation")
def _(t):
    return cl.evaluate(cl.lda_leave_one_out(data(t), len(FEATURES)).withColumn("model", F.lit("lda")))


@query("m13_lda_coefficients")
def _(t):
    return cl.lda_coefficients(data(t), FEATURES)


def folded(t):
    """Every sample its own fold."""
    return fo.fold_rows(features(t), "sample_id", FEATURES, "response", "R", "sample_id")


@query("m13_cross_validated_models")
def _(t):
    return cl.evaluate(materialize(fo.folded_models(folded(t), FEATURES)[0]))


@query("m13_model_importance")
def _(t):
    return fo.folded_models(folded(t), FEATURES)[1]


@query("m14_pls_leave_one_out")
def _(t):
    return cl.pls_leave_one_out(data(t), len(FEATURES)).select("id", "y", F.round("score", 5).alias("score"), "prediction")


@query("m14_pls_importance")
def _(t):
    d = data(t)
    return cl.pls_importance(d, FEATURES, cl.pls_leave_one_out(d, len(FEATURES)))


LIMITS = {"min_cells": 580, "min_median_transcripts_per_cell": 95}


def summary(cells):
    return sample_status(ag.sample_qc(cells), LIMITS).select("sample_id", "n_cells", "median_counts", "median_cell_area", "status")


@query("x1_incremental_sample_qc", f"""
SELECT sample_id, n_cells, median_counts, median_cell_area, CASE WHEN median_counts < 95 THEN 'FAIL' WHEN n_cells < 580 THEN 'WARN' ELSE 'PASS' END AS status FROM (
  SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cells, quantile_cont(n_counts, 0.5) AS median_counts, quantile_cont(area, 0.5) AS median_cell_area FROM cells JOIN {QC_SQL} USING (cell_id) GROUP BY 1)""", rnd="median_counts median_cell_area")
def _(t):
    cells = materialize(t.cells.select("sample_id", "cell_id", "area").join(qc_of(t), "cell_id").select("sample_id", "cell_id", "area", "n_counts", "n_genes"))
    root = f"{shared_folder(t.spark)}/cellweave-stream-{uuid.uuid4().hex}"
    early = F.pmod(F.xxhash64("sample_id"), F.lit(2)) == 0
    out = None
    # the samples arrive in two deliveries, the second of which repeats the first
    for part in (cells.where(early), cells):
        part.write.mode("append").parquet(f"{root}/in")
        out = process_new_samples(t.spark, f"{root}/in", cells.schema, f"{root}/summary", f"{root}/checkpoint", summary)
    return out.select("sample_id", "n_cells", c("median_counts"), c("median_cell_area"), "status")
