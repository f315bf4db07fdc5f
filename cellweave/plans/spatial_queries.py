"""Queries on positions and neighbour edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import scalars as sc
from cellweave.operators import descent as dn
from cellweave.operators import neighbors as nb
from cellweave.operators import spatial as sp
from cellweave.plans.registry import query
from cellweave.plans.summary_queries import CONFLICT_SQL, LINEAGE_P_SQL
from cellweave.scale import c, materialize

S = ["sample_id"]


def knn_sql(k, source="cells"):
    d = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"
    return f"""(SELECT * FROM (SELECT a.sample_id, a.cell_id AS src, b.cell_id AS dst, {d} AS dist, row_number() OVER (PARTITION BY a.cell_id ORDER BY {d}, b.cell_id) AS rank
      FROM {source} a JOIN {source} b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id) WHERE rank <= {k})"""


def near_sql(r, source="cells", self_too=False):
    return f"""(SELECT a.sample_id, a.cell_id AS src, b.cell_id AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM {source} a JOIN {source} b
      ON a.sample_id = b.sample_id {'' if self_too else 'AND a.cell_id <> b.cell_id'} AND abs(a.x - b.x) <= {r} WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {r * r})"""


def knn(t, k, source=None):
    return nb.nearest_in_plane(t.cells if source is None else source, S, k)


@query("j10_pairs_within_distance", f"SELECT * FROM {near_sql(100)}", rnd="dist")
def _(t):
    return nb.within_distance(t.cells, S, 100.0)


@query("j11_nearest_in_plane", f"SELECT * FROM {knn_sql(6)}", rnd="dist")
def _(t):
    return knn(t, 6)


@query("j12_nearest_in_embedding", """
SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS dist, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS INTEGER) AS rank
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE rank <= 10""", rnd="dist")
def _(t):
    return nb.nearest_in_embedding(t.read("embeddings"), [], 10, "vec_id")


@query("j12_neighbour_descent")
def _(t):
    return dn.nearest_by_descent(t.read("embeddings"), [], 10, "vec_id")


@query("j12_descent_recall", "SELECT least(200, count(*)) AS n_queries, true AS enough FROM embeddings")
def _(t):
    e = t.read("embeddings")
    found = dn.nearest_by_descent(e, [], 10, "vec_id")
    return dn.recall(found, e, [], 10, "vec_id").select("n_queries", (F.col("recall") >= 0.95).alias("enough"))


@query("g1_spatial_graph", f"SELECT sample_id, CAST(count(*) AS BIGINT) AS n_edges, avg(dist) AS mean_dist FROM {knn_sql(6)} GROUP BY 1", rnd="mean_dist")
def _(t):
    return sp.edge_counts(knn(t, 6), S)


PERMS = 50


def enrichment_sql(edges, source, min_cells=0):
    big = f"WHERE (sample_id, a) IN (SELECT (sample_id, cell_type) FROM {source} GROUP BY sample_id, cell_type HAVING count(*) > {min_cells}) AND (sample_id, b) IN (SELECT (sample_id, cell_type) FROM {source} GROUP BY sample_id, cell_type HAVING count(*) > {min_cells})"
    return f"""(WITH base AS (SELECT sample_id, cell_id, cell_type, row_number() OVER (PARTITION BY sample_id ORDER BY cell_id) AS rn FROM {source}),
    moved AS (SELECT sample_id, perm, cell_type, row_number() OVER (PARTITION BY sample_id, perm ORDER BY md5('42|' || CAST(perm AS VARCHAR) || '|' || CAST(cell_id AS VARCHAR))) AS rn FROM {source} CROSS JOIN (SELECT unnest(range(1, {PERMS + 1})) AS perm)),
    labels AS (SELECT sample_id, 0 AS perm, cell_id, cell_type FROM base UNION ALL SELECT m.sample_id, perm, b.cell_id, m.cell_type FROM moved m JOIN base b ON m.sample_id = b.sample_id AND m.rn = b.rn),
    n AS (SELECT e.sample_id, s.perm, s.cell_type AS a, d.cell_type AS b, CAST(count(*) AS DOUBLE) AS n FROM {edges} e JOIN labels s ON s.cell_id = e.src JOIN labels d ON d.cell_id = e.dst AND d.perm = s.perm GROUP BY 1, 2, 3, 4),
    f AS (SELECT sample_id, a, b, coalesce(sum(n) FILTER (perm = 0), 0) AS observed, coalesce(sum(n) FILTER (perm > 0), 0) / {PERMS} AS expected, coalesce(sum(n * n) FILTER (perm > 0), 0) / {PERMS} AS sq FROM n GROUP BY 1, 2, 3)
    SELECT sample_id, a, b, observed, expected, sqrt(greatest(0, sq - expected * expected)) AS std, (observed - expected) / (sqrt(greatest(0, sq - expected * expected)) + 1e-10) AS z FROM f {big})"""


KNN_Z_SQL = enrichment_sql(knn_sql(6), "cells")


@query("g2_neighbourhood_enrichment_knn", f"SELECT * FROM {KNN_Z_SQL}", rnd="expected std z", digits=5)
def _(t):
    return sp.neighbourhood_enrichment(knn(t, 6), t.cells, S, "cell_type", PERMS)


@query("g2_neighbourhood_enrichment_radius", f"SELECT * FROM {enrichment_sql(near_sql(100), 'cells', 80)}", rnd="expected std z", digits=5)
def _(t):
    return sp.neighbourhood_enrichment(nb.PairsWithin(t.cells, S, 100.0), t.cells, S, "cell_type", PERMS, min_cells=80)


@query("g2_mean_enrichment_by_response", f"SELECT response, a, b, avg(z) AS mean_z, CAST(count(*) AS BIGINT) AS n_samples FROM {enrichment_sql(near_sql(100), 'cells')} JOIN samples USING (sample_id) GROUP BY 1, 2, 3", rnd="mean_z", digits=5)
def _(t):
    z = sp.neighbourhood_enrichment(nb.PairsWithin(t.cells, S, 100.0), t.cells, S, "cell_type", PERMS)
    return sp.mean_enrichment(z.join(t.samples, "sample_id"), ["response"])


@query("g2_notable_pairs", f"SELECT *, CASE WHEN z > 0 THEN 'enriched' ELSE 'depleted' END AS interaction FROM {enrichment_sql(near_sql(100), 'cells')} WHERE abs(z) > 2", rnd="expected std z", digits=5)
def _(t):
    return sp.notable_pairs(sp.neighbourhood_enrichment(nb.PairsWithin(t.cells, S, 100.0), t.cells, S, "cell_type", PERMS))


@query("g3_local_density", f"SELECT sample_id, src AS cell_id, CAST(count(*) AS BIGINT) AS n_within FROM {near_sql(100, self_too=True)} GROUP BY 1, 2")
def _(t):
    return nb.count_within(t.cells, S, 100.0)


def consistency_sql(k, source):
    return f"(SELECT e.sample_id, src AS cell_id, avg(CASE WHEN a.cell_type = b.cell_type THEN 1.0 ELSE 0.0 END) AS neighborhood_consistency FROM {knn_sql(k, source)} e JOIN {source} a ON a.cell_id = src JOIN {source} b ON b.cell_id = dst GROUP BY 1, 2)"


@query("g4_neighbourhood_consistency", f"SELECT * FROM {consistency_sql(10, 'cells')}", rnd="neighborhood_consistency")
def _(t):
    return sp.neighbourhood_consistency(knn(t, 10), t.cells, S, "cell_type")


@query("g5_boundary_distance")
def _(t):
    return sp.boundary_distance(t.cells.select("sample_id", "cell_id", "x", "y"), S).select("sample_id", "cell_id", "boundary_distance")


@query("g5_hull_holds_all_points", "SELECT sample_id, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_foreign FROM cells GROUP BY 1")
def _(t):
    return sp.hull_faults(t.cells.select("sample_id", "x", "y"), S)


@query("g6_tissue_shape")
def _(t):
    return sp.tissue_shape(t.cells, S).join(sp.nearest_distance_stats(knn(t, 1), S), "sample_id")


@query("g6_nearest_distance", f"SELECT sample_id, avg(dist) AS mean_nn_distance, stddev_pop(dist) AS std_nn_distance FROM {knn_sql(1)} GROUP BY 1", rnd="mean_nn_distance std_nn_distance")
def _(t):
    return sp.nearest_distance_stats(knn(t, 1), S)


def auto_sql(mode):
    stat = {
        "moran": "n / s0 * (xx - s / n * xm + s / n * s / n * s0) / (ss - s * s / n)",
        "geary": "(n - 1) / (2 * s0) * (x2m - 2 * xx) / (ss - s * s / n)",
    }[mode]
    var = {
        "moran": "(n * n * s1 - n * s2 + 3 * s0 * s0) / ((n - 1) * (n + 1) * s0 * s0) - 1 / ((n - 1) * (n - 1))",
        "geary": "((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)",
    }[mode]
    mu = {"moran": "-1 / (n - 1)", "geary": "1.0"}[mode]
    return f"""(WITH e AS MATERIALIZED (SELECT * FROM {knn_sql(6)}), w AS (SELECT sample_id, src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e),
    mg AS (SELECT sample_id, id, sum(r) AS r, sum(k) AS k FROM (SELECT sample_id, src AS id, w AS r, 0 AS k FROM w UNION ALL SELECT sample_id, dst, 0, w FROM w) GROUP BY 1, 2),
    g1 AS (SELECT a.sample_id, sum(a.w) AS s0, sum(a.w * a.w + a.w * coalesce(b.w, 0)) AS s1 FROM w a LEFT JOIN w b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
    g2 AS (SELECT sample_id, sum(pow(r + k, 2)) AS s2 FROM mg GROUP BY 1), nn AS (SELECT sample_id, CAST(count(*) AS DOUBLE) AS n FROM cells GROUP BY 1),
    st AS (SELECT sample_id, gene, sum(count) AS s, sum(count * count) AS ss FROM scounts GROUP BY 1, 2),
    m AS (SELECT v.sample_id, gene, sum(count * (r + k)) AS xm, sum(count * count * (r + k)) AS x2m FROM scounts v JOIN mg ON mg.id = v.cell_id GROUP BY 1, 2),
    x AS (SELECT a.sample_id, a.gene, sum(w * a.count * b.count) AS xx FROM w JOIN scounts a ON a.cell_id = src JOIN scounts b ON b.cell_id = dst AND a.gene = b.gene GROUP BY 1, 2)
    SELECT sample_id, gene, stat, var_norm, (stat - mu) / sqrt(var_norm) AS z_norm FROM (SELECT m.sample_id, m.gene, {stat} AS stat, {var} AS var_norm, {mu} AS mu
      FROM m JOIN st USING (sample_id, gene) JOIN g1 USING (sample_id) JOIN g2 USING (sample_id) JOIN nn USING (sample_id) LEFT JOIN (SELECT sample_id, gene, xx AS xx0 FROM x) xs USING (sample_id, gene) CROSS JOIN LATERAL (SELECT coalesce(xx0, 0) AS xx)))"""


@query("g7_moran_i", f"SELECT * FROM {auto_sql('moran')}", rnd="stat var_norm z_norm", digits=8)
def _(t):
    return sp.autocorrelation(knn(t, 6), t.cells, t.scounts, S, "moran")


@query("g7_geary_c", f"SELECT * FROM {auto_sql('geary')}", rnd="stat var_norm z_norm", digits=8)
def _(t):
    return sp.autocorrelation(knn(t, 6), t.cells, t.scounts, S, "geary")


@query("g7_moran_with_p")
def _(t):
    return sp.with_norm_p(sp.autocorrelation(knn(t, 6), t.cells, t.scounts, S, "moran", n_perm=100))


@query("g8_spatially_variable_genes")
def _(t):
    return sp.spatially_variable(sp.with_norm_p(sp.autocorrelation(knn(t, 6), t.cells, t.scounts, S, "moran")))


@query("g8_strongest_genes", f"SELECT * FROM {auto_sql('moran')} ORDER BY stat DESC, gene LIMIT 50", rnd="stat var_norm z_norm", digits=8)
def _(t):
    return sp.spatially_variable(sp.autocorrelation(knn(t, 6), t.cells, t.scounts, S, "moran"))


@query("g9_smoothed_expression", f"""
WITH e AS (SELECT sample_id, src, dst, 1 / (dist + 1e-6) AS w FROM (SELECT sample_id, src, dst, dist FROM {knn_sql(4)} UNION ALL SELECT sample_id, cell_id, cell_id, 0 FROM scounts GROUP BY 1, 2)),
tw AS (SELECT src, sum(w) AS tw FROM e GROUP BY 1)
SELECT e.sample_id, e.src AS cell_id, gene, sum(w * count) / any_value(tw) AS count FROM e JOIN scounts v ON v.cell_id = e.dst JOIN tw ON tw.src = e.src GROUP BY 1, 2, 3""", rnd="count")
def _(t):
    return sp.smoothed(knn(t, 4), t.scounts, S, "gene", "count")


# ------------------------------------------------------------------------------------------------------- grids


def bins_sql(source, n):
    i = lambda v: f"CAST(least(floor(({v} - {v}0) / (({v}1 - {v}0) / {n})), {n - 1}) AS INTEGER)"
    return f"(SELECT *, {i('x')} AS gx, {i('y')} AS gy FROM {source} JOIN (SELECT sample_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {source} GROUP BY 1) USING (sample_id))"


def kernel_sql(n, sigma, truncate=4.0):
    r = int(truncate * sigma + 0.5)
    return f"""(SELECT o, CASE WHEN p < {n} THEN p ELSE {2 * n - 1} - p END AS s, sum(exp(-0.5 * pow(t / {sigma}, 2)) / (SELECT sum(exp(-0.5 * pow(u / {sigma}, 2))) FROM range({-r}, {r + 1}) q(u))) AS k
      FROM (SELECT o, t, (o + t + {2 * n}) % {2 * n} AS p FROM range({n}) a(o) CROSS JOIN range({-r}, {r + 1}) b(t)) GROUP BY 1, 2)"""


def filter_sql(source, keys, cols, n, sigma):
    k = kernel_sql(n, sigma)
    one = f"(SELECT {keys}, o AS gx, gy, {', '.join(f'sum(k * {c_}) AS {c_}' for c_ in cols)} FROM {source} JOIN {k} kk ON s = gx GROUP BY {keys}, o, gy)"
    return f"(SELECT {keys}, gx, o AS gy, {', '.join(f'sum(k * {c_}) AS {c_}' for c_ in cols)} FROM {one} JOIN {k} kk ON s = gy GROUP BY {keys}, gx, o)"


def ssim_sql(grid, keys, a, b, n):
    unit = lambda v: f"({v} - min({v}) OVER w) / (max({v}) OVER w - min({v}) OVER w + 1e-9)"
    u = f"(SELECT *, m1 * m1 AS q1, m2 * m2 AS q2, m1 * m2 AS q12 FROM (SELECT {keys}, gx, gy, {unit(a)} AS m1, {unit(b)} AS m2 FROM {grid} WINDOW w AS (PARTITION BY {keys})))"
    f = filter_sql(u, keys, ["m1", "m2", "q1", "q2", "q12"], n, 7 / 6)
    return f"(SELECT {keys}, avg(((2 * m1 * m2 + 0.0001) * (2 * (q12 - m1 * m2) + 0.0009)) / ((m1 * m1 + m2 * m2 + 0.0001) * (q1 - m1 * m1 + q2 - m2 * m2 + 0.0009))) AS ssim FROM {f} GROUP BY {keys})"


def full_grid_sql(source, n, select, fill):
    return f"""(SELECT g.sample_id, g.gx, g.gy, {fill} FROM (SELECT sample_id, gx, gy FROM (SELECT DISTINCT sample_id FROM {source}) CROSS JOIN range({n}) a(gx) CROSS JOIN range({n}) b(gy)) g
      LEFT JOIN (SELECT sample_id, gx, gy, {select} FROM {bins_sql(source, n)} GROUP BY 1, 2, 3) USING (sample_id, gx, gy))"""


NG = 20


@query("g11_structural_similarity", f"SELECT * FROM {ssim_sql(full_grid_sql('cells', NG, 'avg(area) AS area, CAST(count(*) AS DOUBLE) AS n', 'coalesce(area, 0) AS area, coalesce(n, 0) AS n'), 'sample_id', 'area', 'n', NG)}", rnd="ssim")
def _(t):
    from cellweave.operators.aggregates import grid_means

    g = grid_means(t.cells, S, ["area"], NG).withColumn("n", F.col("n").cast("double"))
    return sp.structural_similarity(g, S, "area", "n", NG)


@query("g12_density_map", f"SELECT sample_id, gx, gy, density FROM {filter_sql(full_grid_sql('cells', 50, 'CAST(count(*) AS DOUBLE) AS n', 'coalesce(n, 0) AS density'), 'sample_id', ['density'], 50, 1.5)}", rnd="density")
def _(t):
    return sp.density_map(t.cells, S).select("sample_id", F.col("gx").cast("long"), F.col("gy").cast("long"), "density")


PAIRS = [("CD3", "G3"), ("CD8", "G8"), ("PanCK", "G14"), ("Nope", "G1"), ("CD4", "GX")]
_pairs = "(VALUES " + ", ".join(f"('{p}', '{g}')" for p, g in PAIRS) + ") AS pm(protein, gene)"
_both = f"""(SELECT p.sample_id, p.cell_id, marker AS protein, pm.gene, intensity, coalesce(k.count, 0) AS rna, b.gx, b.gy FROM prot p JOIN {_pairs} ON pm.protein = marker
  JOIN (SELECT DISTINCT pw.sample_id, gene FROM counts JOIN pw USING (cell_id)) ms ON ms.sample_id = p.sample_id AND ms.gene = pm.gene JOIN {bins_sql('pw', 10)} b ON b.cell_id = p.cell_id
  LEFT JOIN counts k ON k.cell_id = p.cell_id AND k.gene = pm.gene)"""
_grid = f"""(SELECT u.sample_id, u.protein, u.gene, gx, gy, coalesce(p, 0) AS p, coalesce(r, 0) AS r FROM (SELECT sample_id, protein, gene, gx, gy FROM (SELECT DISTINCT sample_id, protein, gene FROM {_both}) CROSS JOIN range(10) a(gx) CROSS JOIN range(10) b(gy)) u
  LEFT JOIN (SELECT sample_id, protein, gene, gx, gy, avg(intensity) AS p, avg(rna) AS r FROM {_both} GROUP BY ALL) USING (sample_id, protein, gene, gx, gy))"""
_z = "(SELECT sample_id, protein, gene, gx, gy, (p - avg(p) OVER w) / stddev_pop(p) OVER w AS p, coalesce((r - avg(r) OVER w) / nullif(stddev_pop(r) OVER w, 0), 0) AS r FROM " + _grid + " WINDOW w AS (PARTITION BY sample_id, protein, gene))"


@query("t13_rna_protein_concordance", f"""
SELECT u.sample_id, u.protein, u.gene, n_cells, CASE WHEN u.protein = 'Nope' THEN 'protein_column_missing' WHEN NOT measured THEN 'gene_not_found' END AS error,
  protein_mean, rna_mean, rna_std, cell_pearson_r, grid_pearson_r, ssim
FROM (SELECT sample_id, n_cells, protein, gene, (sample_id, gene) IN (SELECT DISTINCT (pw.sample_id, gene) FROM counts JOIN pw USING (cell_id)) AS measured
  FROM (SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cells FROM pw GROUP BY 1) CROSS JOIN {_pairs}) u
LEFT JOIN (SELECT sample_id, protein, gene, avg(intensity) AS protein_mean, avg(rna) AS rna_mean, stddev_pop(rna) AS rna_std, CASE WHEN stddev_pop(rna) > 0 THEN corr(intensity, rna) END AS cell_pearson_r FROM {_both} GROUP BY ALL) c USING (sample_id, protein, gene)
LEFT JOIN (SELECT sample_id, protein, gene, CASE WHEN stddev_pop(r) > 0 THEN corr(p, r) END AS grid_pearson_r FROM {_grid} GROUP BY ALL) g USING (sample_id, protein, gene)
LEFT JOIN {ssim_sql(_z, 'sample_id, protein, gene', 'p', 'r', 10)} s USING (sample_id, protein, gene)""", rnd="protein_mean rna_mean rna_std cell_pearson_r grid_pearson_r ssim", digits=5)
def _(t):
    pairs = t.literal(PAIRS, "protein string, gene string")
    rna = t.counts.join(t.pw.select("cell_id", "sample_id"), "cell_id")
    out = sp.rna_protein_concordance(t.pw.select("sample_id", "cell_id", "x", "y"), rna, t.prot, pairs, S, 10, 50)
    return out.select("sample_id", "protein", "gene", "n_cells", "error", "protein_mean", "rna_mean", "rna_std", "cell_pearson_r", "grid_pearson_r", "ssim")


@query("t13_rna_protein_concordance_with_p")
def _(t):
    rna = t.counts.join(t.pw.select("cell_id", "sample_id"), "cell_id")
    pairs = t.literal(PAIRS, "protein string, gene string")
    return sp.rna_protein_concordance(t.pw.select("sample_id", "cell_id", "x", "y"), rna, t.prot, pairs, S)


# ------------------------------------------------------------------------------------------------ composite scores


@query("c7_composite_admixture", f"""
SELECT cell_id, 0.5 * conflict_score + 0.3 * (1 - neighborhood_consistency) + 0.2 * lineage_entropy AS admixture_score,
  0.5 * conflict_score + 0.3 * (1 - neighborhood_consistency) + 0.2 * lineage_entropy > 0.3 AS admixture_flag
FROM (SELECT cell_id, conflict_score FROM {CONFLICT_SQL}) JOIN (SELECT cell_id, lineage_entropy FROM {LINEAGE_P_SQL}) USING (cell_id) JOIN {consistency_sql(10, 'pw')} USING (cell_id)""", rnd="admixture_score")
def _(t):
    conflict = sc.graded_conflicts(t.pw, S).select("cell_id", "conflict_score")
    entropy = sc.lineage_probabilities(t.pw, S).select("cell_id", "lineage_entropy")
    near = sp.neighbourhood_consistency(knn(t, 10, t.pw), t.pw, S, "cell_type")
    return sc.composite_admixture(conflict.join(entropy, "cell_id").join(near, "cell_id")).select("cell_id", "admixture_score", "admixture_flag")


@query("c8_composite_segmentation_qc")
def _(t):
    genes = t.counts.groupBy("cell_id").agg(F.count(F.lit(1)).cast("double").alias("n_genes"))
    parts = sp.boundary_distance(t.cells, S).join(nb.count_within(t.cells, S, 100.0), [*S, "cell_id"]).join(genes, "cell_id")
    parts = materialize(parts.select("sample_id", "cell_id", c("admixed").cast("double").alias("admix"), c("n_within").cast("double").alias("density"), "boundary_distance", "n_genes"))
    return sc.composite_segmentation_qc(parts, S, "admix", "density", "boundary_distance", "n_genes").select("sample_id", "cell_id", "composite_qc_score")
