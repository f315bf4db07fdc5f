"""Queries on embeddings, activities and gene selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import scalars as sc
from cellweave.operators import aggregates as ag
from cellweave.operators import embedding as em
from cellweave.operators import keyed_pca as kp
from cellweave.operators import neighbors as nb
from cellweave.operators import scoring
from cellweave.operators import spatial as sp
from cellweave.operators import trends as tr
from cellweave.plans.clean_queries import SIG_SQL, signatures
from cellweave.plans.registry import query
from cellweave.plans.spatial_queries import knn
from cellweave.plans.tables import MARKERS
from cellweave.scale import c, materialize

GENES = [f"G{i}" for i in range(300)]
LN_SQL = "(SELECT sample_id, cell_type, cell_id, gene, round(ln(1 + count * 1e4 / sum(count) OVER (PARTITION BY cell_id)), 9) AS v FROM scounts)"


def lognorm(t):
    return sc.log_normalised(t.scounts, ["cell_id"]).withColumn("lognorm", F.round("lognorm", 9))


def embedded(t):
    return t.read("embeddings").select(F.col("vec_id").alias("cell_id"), F.concat(F.lit("S"), (F.col("vec_id") % 4).cast("string")).alias("sample_id"), F.concat(F.lit("T"), F.col("label").cast("string")).alias("cell_type"), F.col("embedding").cast("array<double>").alias("vec"))


EMB_SQL = "(SELECT vec_id AS cell_id, 'S' || CAST(vec_id % 4 AS VARCHAR) AS sample_id, 'T' || CAST(label AS VARCHAR) AS cell_type, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


def protein_vectors(t):
    return em.column_vectors(t.pw, ["cell_id", "sample_id", "cell_type"], MARKERS)


@query("m1_pca_explained_variance")
def _(t):
    return em.pca(em.cell_vectors(lognorm(t), ["cell_id"], GENES), k=20)[1]


@query("m1_pca_cell_scores")
def _(t):
    scores = em.pca(materialize(em.scaled(protein_vectors(t))), k=5)[0]
    return scores.select("cell_id", F.posexplode("pcs").alias("pc", "score")).withColumn("score", F.round("score", 6))


@query("m1_top_loadings")
def _(t):
    return em.top_loadings(em.pca(materialize(em.scaled(protein_vectors(t))), k=5, features=MARKERS)[2], 3)


_entries = f"(SELECT sample_id, cell_id, marker, intensity AS v FROM prot)"
_cov = f"""(SELECT a.sample_id, a.marker AS i, b.marker AS j, count(*) AS n, avg(a.v * b.v) - avg(a.v) * avg(b.v) AS v FROM {_entries} a JOIN {_entries} b ON a.sample_id = b.sample_id AND a.cell_id = b.cell_id GROUP BY 1, 2, 3)"""


@query("m1_pca_per_sample", f"""
SELECT sample_id, CAST(any_value(n) AS BIGINT) AS n, sum(v) FILTER (i = j) AS trace, sum(v * v) AS square, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS overlap FROM {_cov} GROUP BY 1""", rnd="trace square residual overlap", digits=7)
def _(t):
    fits = kp.eigen_by_group(kp.group_covariances(protein_vectors(t), ["sample_id"]), ["sample_id"], len(MARKERS))
    return kp.eigen_check(fits, ["sample_id"])


@query("m1_pca_per_sample_scores", f"""
SELECT sample_id, CAST(any_value(n) AS BIGINT) AS n_cells, sum(v) FILTER (i = j) AS score_variance FROM {_cov} GROUP BY 1""", rnd="score_variance", digits=7)
def _(t):
    # the scores on all components spread as far as the values do
    scores, _, _ = kp.pca_by_group(protein_vectors(t), ["sample_id"], k=len(MARKERS))
    one = scores.select("sample_id", "cell_id", F.posexplode("pcs").alias("pc", "s")).groupBy("sample_id", "pc").agg(ag.n_rows().alias("n"), F.var_pop("s").alias("v"))
    return one.groupBy("sample_id").agg(F.max("n").alias("n_cells"), F.sum("v").alias("score_variance"))


def pseudobulk_vectors(t):
    pb = sc.log_cpm(ag.pseudobulk(t.scounts, ["sample_id"]), ["sample_id"])
    return em.cell_vectors(pb, ["sample_id"], GENES, value="logcpm")


@query("m2_pseudobulk_pca")
def _(t):
    scores = em.pca(materialize(em.scaled(pseudobulk_vectors(t))), k=5)[0]
    return scores.join(t.samples, "sample_id").select("sample_id", "stage", "lane", F.posexplode("pcs").alias("pc", "score"))


def modalities(t):
    """RNA and protein components of the cells both tables have."""
    protein = protein_vectors(t)
    joined = em.cell_vectors(lognorm(t), ["cell_id"], GENES, out="rvec", of=protein)
    both = materialize(em.scaled(em.scaled(joined, "vec"), "rvec"))
    r = em.pca(both, "rvec", 10, out="rna")[0]
    return materialize(em.pca(r, "vec", 10, out="protein")[0].select("cell_id", "sample_id", "cell_type", "vec", "rvec", "rna", "protein"))


@query("m3_joint_modality_pca")
def _(t):
    both = modalities(t).select("cell_id", F.concat("vec", "rvec").alias("joint"))
    return em.pca(both, "joint", 5)[1]


def _eigen_sql(name, rows):
    """Trace and sum of squared eigenvalues of the correlations of long rows (u, f, v); a constant feature counts nothing."""
    return f"""WITH x AS ({rows}), z AS (SELECT u, f, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM x WINDOW w AS (PARTITION BY f)),
c AS (SELECT a.f AS i, b.f AS j, avg(a.z * b.z) AS v FROM z a JOIN z b USING (u) GROUP BY 1, 2)
SELECT '{name}' AS fit, (SELECT CAST(count(DISTINCT u) AS BIGINT) FROM x) AS n, sum(v) FILTER (i = j) AS trace, sum(v * v) AS square, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS overlap FROM c"""


def checked_fit(vectors, name, vec="vec"):
    """How well the components of one table decompose its covariance."""
    fits = kp.eigen_by_group(kp.group_covariances(vectors.withColumn("fit", F.lit(name)), ["fit"], vec), ["fit"], em.MAX_FEATURES)
    return kp.eigen_check(fits, ["fit"])


@query("m2_pseudobulk_pca_check", _eigen_sql("pseudobulk", """
SELECT u, f, coalesce(logcpm, 0) AS v FROM (SELECT DISTINCT sample_id AS u FROM scounts) CROSS JOIN (SELECT 'G' || CAST(i AS VARCHAR) AS f FROM range(300) q(i))
LEFT JOIN (SELECT sample_id AS u, gene AS f, ln(1 + total * 1e6 / sum(total) OVER (PARTITION BY sample_id)) AS logcpm FROM (SELECT sample_id, gene, sum(count) AS total FROM scounts GROUP BY 1, 2)) USING (u, f)"""),
    rnd="trace square residual overlap", digits=5)
def _(t):
    return checked_fit(em.scaled(pseudobulk_vectors(t)), "pseudobulk")


@query("m3_joint_modality_pca_check", _eigen_sql("joint", f"""
SELECT cell_id AS u, marker AS f, intensity AS v FROM prot WHERE cell_id IN (SELECT cell_id FROM scounts) UNION ALL
SELECT u, f, coalesce(e.v, 0) FROM (SELECT DISTINCT cell_id AS u FROM pw WHERE cell_id IN (SELECT cell_id FROM scounts)) CROSS JOIN (SELECT 'G' || CAST(i AS VARCHAR) AS f FROM range(300) q(i))
LEFT JOIN (SELECT cell_id AS u, gene AS f, v FROM {LN_SQL}) e USING (u, f)"""), rnd="trace square residual overlap", digits=4)
def _(t):
    return checked_fit(modalities(t).select("cell_id", F.concat("vec", "rvec").alias("joint")), "joint", "joint")


@query("m4_variable_genes", f"""
WITH g AS (SELECT gene, sum(exp(v) - 1) AS s, sum((exp(v) - 1) * (exp(v) - 1)) AS ss, (SELECT count(*) FROM cells) AS n FROM {LN_SQL} GROUP BY 1),
m AS (SELECT gene, s / n AS mean, (ss - s * s / n) / (n - 1) AS var FROM g),
b AS (SELECT gene, mean, ln(var / mean) AS dispersion, CAST(least(floor((ln(1 + mean) - min(ln(1 + mean)) OVER ()) / (max(ln(1 + mean)) OVER () - min(ln(1 + mean)) OVER ()) * 20), 19) AS BIGINT) AS bin FROM m)
SELECT *, row_number() OVER (ORDER BY dispersion_norm DESC, gene) <= 100 AS highly_variable FROM (
  SELECT gene, mean, dispersion, bin, CASE WHEN stddev_samp(dispersion) OVER w > 0 THEN (dispersion - avg(dispersion) OVER w) / stddev_samp(dispersion) OVER w ELSE 1 END AS dispersion_norm FROM b WINDOW w AS (PARTITION BY bin))""", rnd="mean dispersion dispersion_norm", digits=5)
def _(t):
    n = t.cells.agg(F.count(F.lit(1)).alias("n_cells"))
    return em.variable_genes(lognorm(t), n, 100)


SPAN = 0.3
_moment = lambda k: f"sum(w * pow(d, {k}))"
_moment_y = lambda k: f"sum(w * pow(d, {k}) * y)"


@query("m4_variable_genes_by_trend", f"""
WITH n AS (SELECT count(*)::DOUBLE AS n FROM cells), s AS (SELECT gene, sum(count)::DOUBLE AS s, sum(count * count)::DOUBLE AS ss FROM scounts GROUP BY 1),
m AS (SELECT gene, n, s / n AS mean, (ss - s * s / n) / (n - 1) AS variance FROM s, n), v AS (SELECT *, log10(mean) AS x, log10(variance) AS y FROM m WHERE variance > 0 AND mean > 0),
near AS (SELECT a.gene, b.x - a.x AS d, b.y, row_number() OVER (PARTITION BY a.gene ORDER BY abs(b.x - a.x)) AS rn FROM v a, v b),
reach AS (SELECT gene, max(abs(d)) AS h FROM near WHERE rn <= ceil({SPAN} * (SELECT count(*) FROM v)) GROUP BY 1),
w AS (SELECT gene, d / h AS d, y, pow(1 - pow(abs(d / h), 3), 3) AS w FROM near JOIN reach USING (gene) WHERE abs(d) < h),
f AS (SELECT gene, {', '.join(f'{_moment(i)} AS s{i}' for i in range(5))}, {', '.join(f'{_moment_y(i)} AS t{i}' for i in range(3))} FROM w GROUP BY 1),
fit AS (SELECT gene, (t0 * (s2 * s4 - s3 * s3) - t1 * (s1 * s4 - s2 * s3) + t2 * (s1 * s3 - s2 * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) AS trend FROM f),
g AS (SELECT v.*, trend, sqrt(pow(10, trend)) AS sd FROM v JOIN fit USING (gene)),
k AS (SELECT gene, sum(least(count::DOUBLE, sqrt(n) * sd + mean)) AS s, sum(pow(least(count::DOUBLE, sqrt(n) * sd + mean), 2)) AS ss FROM scounts JOIN g USING (gene) GROUP BY 1),
r AS (SELECT m.gene, m.mean, m.variance, trend, coalesce((m.n * m.mean * m.mean + ss - 2 * m.mean * s) / ((m.n - 1) * sd * sd), 0) AS variance_norm FROM m LEFT JOIN g ON g.gene = m.gene LEFT JOIN k ON k.gene = m.gene)
SELECT *, row_number() OVER (ORDER BY variance_norm DESC, gene) <= 100 AS highly_variable FROM r""", rnd="mean variance trend variance_norm", digits=7)
def _(t):
    n = t.cells.agg(F.count(F.lit(1)).alias("n_cells"))
    return tr.variable_genes_by_trend(t.scounts.withColumn("count", F.col("count").cast("double")), n, 100, SPAN)


@query("m5_weighted_modalities")
def _(t):
    w = em.weighted_modalities(modalities(t), "rna", "protein", "inverse")
    return w.select("cell_id", "rna_weight", "protein_weight", F.size("wnn").alias("n_dims"), F.round(F.aggregate("wnn", F.lit(0.0), lambda s, v: s + v * v), 6).alias("norm2"))


@query("m5_direct_weights")
def _(t):
    return em.weighted_modalities(modalities(t), "rna", "protein", "direct").select("rna_weight", "protein_weight").distinct()


@query("m6_fused_neighbours")
def _(t):
    weights, edges = em.fused_neighbours(modalities(t), "cell_id", "rna", "protein", 10, every=True)
    return edges.groupBy(F.col("src").alias("cell_id")).agg(ag.n_rows().alias("n"), F.avg("similarity").alias("mean_similarity")).join(weights, "cell_id")


@query("m7_batch_corrected")
def _(t):
    base = materialize(em.pca(em.scaled(embedded(t)), k=10)[0])
    out = em.corrected_for_batch(base, "cell_id", "pcs", "sample_id", rounds=20)
    return out.select("cell_id", "sample_id", "converged", F.posexplode("corrected").alias("pc", "score"))


_lisi = """(SELECT src, CAST(sum(n) * sum(n) AS DOUBLE) / sum(n * n) AS lisi FROM (SELECT src, sample_id, count(*) AS n FROM (
  SELECT a.cell_id AS src, b.sample_id, row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.vec, b.vec), b.cell_id) AS rank FROM {0} a JOIN {0} b ON a.cell_id <> b.cell_id) WHERE rank <= 90 GROUP BY 1, 2) GROUP BY 1)""".format(EMB_SQL)


@query("g10_lisi", f"SELECT src AS cell_id, lisi FROM {_lisi}", rnd="lisi")
def _(t):
    e = materialize(embedded(t))
    return em.lisi(nb.nearest_in_embedding(e, [], 90, vec="vec"), e, "sample_id")


_sil = """(SELECT a.cell_id, a.cell_type, m.cell_type AS other, sum(pow(list_distance(a.vec, m.vec), 2)) AS total, count(*) AS n FROM {0} a JOIN {0} m ON TRUE GROUP BY 1, 2, 3)""".format(EMB_SQL)


@query("g15_silhouette", f"""
SELECT cell_id, cell_type, (b - a) / greatest(a, b) AS silhouette FROM (SELECT cell_id, cell_type, sum(total) FILTER (other = cell_type) / (sum(n) FILTER (other = cell_type) - 1) AS a, min(total / n) FILTER (other <> cell_type) AS b FROM {_sil} GROUP BY 1, 2)""", rnd="silhouette")
def _(t):
    return em.silhouette(embedded(t), "cell_id", "vec", "cell_type")


@query("g10_batch_mixing_report", f"""
SELECT mean_lisi, mean_silhouette, mean_lisi >= 3 AND mean_silhouette < 0.3 AS passes FROM (SELECT avg(lisi) AS mean_lisi FROM {_lisi}) CROSS JOIN (
  SELECT avg((b - a) / greatest(a, b)) AS mean_silhouette FROM (SELECT cell_id, sum(total) FILTER (other = sample_id) / (sum(n) FILTER (other = sample_id) - 1) AS a, min(total / n) FILTER (other <> sample_id) AS b
    FROM (SELECT a.cell_id, a.sample_id, m.sample_id AS other, sum(pow(list_distance(a.vec, m.vec), 2)) AS total, count(*) AS n FROM {EMB_SQL} a JOIN {EMB_SQL} m ON TRUE GROUP BY 1, 2, 3) GROUP BY 1, sample_id))""", rnd="mean_lisi mean_silhouette")
def _(t):
    e = materialize(embedded(t))
    return em.batch_report(em.lisi(nb.nearest_in_embedding(e, [], 90, vec="vec"), e, "sample_id"), em.silhouette(e, "cell_id", "vec", "sample_id"))


@query("g9_spatial_pca")
def _(t):
    smooth = sp.smoothed(knn(t, 14), lognorm(t), ["sample_id"], "gene", "lognorm")
    return em.pca(materialize(em.scaled(em.cell_vectors(smooth, ["cell_id"], GENES))), k=5)[1]


_bins = f"(SELECT gene, mean, ntile(25) OVER (ORDER BY mean, gene) AS bin FROM (SELECT gene, sum(count) / (SELECT count(*) FROM cells) AS mean FROM scounts GROUP BY 1))"
_sigw = f"""(WITH sig AS (SELECT DISTINCT name, s.gene, bin FROM (SELECT * FROM {SIG_SQL}) s JOIN {_bins} b ON b.gene = s.gene),
ctl AS (SELECT DISTINCT name, gene FROM (SELECT w.name, p.gene, row_number() OVER (PARTITION BY w.name, p.bin ORDER BY md5('0|' || p.gene), p.gene) AS rn FROM (SELECT DISTINCT name, bin FROM sig) w JOIN {_bins} p USING (bin)) WHERE rn <= 50 AND (name, gene) NOT IN (SELECT (name, gene) FROM sig))
SELECT name, gene, 1.0::DOUBLE / count(*) OVER (PARTITION BY name) AS weight FROM sig UNION ALL SELECT name, gene, -1.0::DOUBLE / count(*) OVER (PARTITION BY name) FROM ctl)"""


def _sig_names(t):
    return sorted(r[0] for r in signatures(t).select("name").distinct().collect())


@query("m8_signature_scores", f"""
SELECT cell_id, name, coalesce(sum(count * weight), 0) AS score FROM (SELECT cell_id, name FROM (SELECT DISTINCT cell_id FROM scounts) CROSS JOIN (SELECT DISTINCT name FROM {SIG_SQL}))
LEFT JOIN (SELECT cell_id, name, count, weight FROM scounts JOIN {_sigw} USING (gene)) USING (cell_id, name) GROUP BY 1, 2""", rnd="score")
def _(t):
    names = _sig_names(t)
    n = t.cells.agg(F.count(F.lit(1)).alias("n_cells"))
    wide = scoring.signature_scores(t.scounts, n, signatures(t), ["cell_id"], names, n_controls=50)
    return wide.unpivot(["cell_id"], [c(m) for m in names], "name", "score")


NETS = {"A": 7, "B": 11, "C": 13}
_net = " UNION ALL ".join(f"SELECT '{s}' AS name, 'G' || CAST(i AS VARCHAR) AS gene, CAST(i % 5 - 1.5 AS DOUBLE) AS weight FROM range(300) q(i) WHERE i % {m} = 0" for s, m in NETS.items())


def network(t):
    rows = t.spark.range(300).select(F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(m).alias("m")) for s, m in NETS.items()])).alias("s"), "id")
    net = rows.where("id % s.m = 0").select("s.source", F.concat(F.lit("G"), F.col("id").cast("string")).alias("target"), (F.col("id") % 5 - 1.5).cast("double").alias("weight"))
    return scoring.measured_network(net, t.counts)


@query("m9_univariate_activity", f"""
WITH net AS ({_net}), x AS (SELECT cell_id, name, coalesce(sum(count * weight), 0) AS xy FROM (SELECT cell_id, name FROM (SELECT DISTINCT cell_id FROM counts) CROSS JOIN (SELECT DISTINCT name FROM net))
  LEFT JOIN (SELECT cell_id, name, count, weight FROM counts JOIN net USING (gene)) USING (cell_id, name) GROUP BY 1, 2),
r AS (SELECT cell_id, x.name, (xy - sx * y / 300) / sqrt((sxx - sx * sx / 300) * (yy - y * y / 300)) AS r FROM x JOIN (SELECT cell_id, sum(count) AS y, sum(count * count) AS yy FROM counts GROUP BY 1) USING (cell_id)
  JOIN (SELECT name, sum(weight) AS sx, sum(weight * weight) AS sxx FROM net GROUP BY 1) s ON s.name = x.name)
SELECT cell_id, name AS source, r * sqrt(298 / ((1 - r) * (1 + r))) AS t_value FROM r""", rnd="t_value")
def _(t):
    return scoring.univariate_activity(t.counts, network(t), ["cell_id"], list(NETS), 300)


def _mlm_sql():
    """Normal equations on centred sums: Gram matrix of the three sources, its inverse by cofactors, slopes and their errors."""
    k = list(NETS)
    g = lambda a, b: f"g_{min(a, b)}{max(a, b)}"
    sums = ", ".join(f"coalesce(sum(a.weight * b.weight) FILTER (a.name = '{x}' AND b.name = '{y}'), 0) AS r_{x}{y}" for x in k for y in k if x <= y)
    centred = ", ".join(f"r_{x}{y} - s_{x} * s_{y} / 300 AS g_{x}{y}" for x in k for y in k if x <= y)
    single = ", ".join(f"sum(weight) FILTER (name = '{x}') AS s_{x}" for x in k)
    cof = {}
    for i in range(3):
        for j in range(3):
            (p, q), (u, v) = [x for n, x in enumerate(k) if n != i], [x for n, x in enumerate(k) if n != j]
            cof[i, j] = f"{'' if (i + j) % 2 == 0 else '-'}({g(p, u)} * {g(q, v)} - {g(p, v)} * {g(q, u)})"
    det = " + ".join(f"{g(k[0], k[j])} * ({cof[0, j]})" for j in range(3))
    inverse = ", ".join(f"({cof[i, j]}) / det AS i_{k[i]}{k[j]}" for i in range(3) for j in range(3))
    xy = ", ".join(f"coalesce(sum(count * weight) FILTER (name = '{x}'), 0) AS xy_{x}" for x in k)
    beta = ", ".join(" + ".join(f"i_{x}{y} * (xy_{y} - s_{y} * sy / 300)" for y in k) + f" AS b_{x}" for x in k)
    explained = " + ".join(f"b_{y} * (xy_{y} - s_{y} * sy / 300)" for y in k)
    rows = " UNION ALL ".join(f"SELECT cell_id, '{x}' AS source, b_{x} / sqrt(i_{x}{x} * sse / 296) AS t_value FROM fit" for x in k)
    return f"""WITH net AS ({_net}), one AS (SELECT {single} FROM net), two AS (SELECT {sums} FROM net a JOIN net b USING (gene)), gram AS (SELECT *, {centred} FROM two, one),
d AS (SELECT *, {det} AS det FROM gram), inv AS (SELECT *, {inverse} FROM d),
y AS (SELECT cell_id, sum(count)::DOUBLE AS sy, sum(count * count)::DOUBLE AS syy FROM counts GROUP BY 1), x AS (SELECT cell_id, {xy} FROM counts LEFT JOIN net USING (gene) GROUP BY 1),
b AS (SELECT cell_id, sy, syy, {', '.join(f'xy_{n}, s_{n}' for n in k)}, {', '.join(f'i_{n}{n}' for n in k)}, {beta} FROM y JOIN x USING (cell_id), inv),
fit AS (SELECT *, greatest(syy - sy * sy / 300 - ({explained}), 1e-300) AS sse FROM b)
{rows}"""


MLM_SQL = _mlm_sql()


def activities(t):
    return scoring.multivariate_activity(t.counts, materialize(network(t)), ["cell_id"], list(NETS), 300)


@query("m10_multivariate_activity", MLM_SQL, rnd="t_value")
def _(t):
    return activities(t).select("cell_id", "source", "t_value")


@query("m10_multivariate_activity_with_p")
def _(t):
    return activities(t)


@query("m10_activity_by_response", f"""
WITH a AS ({MLM_SQL}), s AS (SELECT sample_id, source, avg(t_value) AS mean_activity FROM a JOIN cells USING (cell_id) GROUP BY 1, 2)
SELECT source, CAST(count(*) FILTER (response = 'R') AS BIGINT) AS n_r, CAST(count(*) FILTER (response = 'NR') AS BIGINT) AS n_nr, avg(mean_activity) FILTER (response = 'R') AS mean_r, avg(mean_activity) FILTER (response = 'NR') AS mean_nr,
  (avg(mean_activity) FILTER (response = 'R') - avg(mean_activity) FILTER (response = 'NR')) / sqrt(var_samp(mean_activity) FILTER (response = 'R') / count(*) FILTER (response = 'R') + var_samp(mean_activity) FILTER (response = 'NR') / count(*) FILTER (response = 'NR')) AS t_stat
FROM s JOIN samples USING (sample_id) GROUP BY 1""", rnd="mean_r mean_nr t_stat")
def _(t):
    return scoring.activity_by_response(activities(t), t.cells.select("cell_id", "sample_id"), t.samples, "response", "R", "NR").select("source", "n_r", "n_nr", "mean_r", "mean_nr", "t_stat")


@query("m11_kmeans_protein")
def _(t):
    return em.kmeans_labels(protein_vectors(t), "vec", 12).groupBy("cluster").agg(ag.n_rows().alias("n"))


@query("m12_mutual_information", f"""
WITH e AS (SELECT cell_id, cell_type AS l, gene, v FROM {LN_SQL}), b AS (SELECT gene, l, CAST(least(floor(v / max(v) OVER (PARTITION BY gene) * 10), 9) AS BIGINT) AS bin FROM e),
st AS (SELECT gene, l, bin, count(*) AS m FROM b GROUP BY 1, 2, 3), nl AS (SELECT cell_type AS l, count(*) AS nl FROM cells GROUP BY 1),
z AS (SELECT g.gene, nl.l, 0 AS bin, nl.nl - coalesce(k.nz, 0) AS m FROM (SELECT DISTINCT gene FROM st) g CROSS JOIN nl LEFT JOIN (SELECT gene, l, sum(m) AS nz FROM st GROUP BY 1, 2) k ON k.gene = g.gene AND k.l = nl.l),
j AS (SELECT gene, l, bin, CAST(sum(m) AS DOUBLE) AS m FROM (SELECT * FROM st UNION ALL SELECT * FROM z) GROUP BY 1, 2, 3 HAVING sum(m) > 0)
SELECT gene, sum(m / t * ln(m * t / (mb * ml))) AS mutual_information FROM (SELECT *, sum(m) OVER (PARTITION BY gene) AS t, sum(m) OVER (PARTITION BY gene, bin) AS mb, sum(m) OVER (PARTITION BY gene, l) AS ml FROM j) GROUP BY 1""", rnd="mutual_information", digits=7)
def _(t):
    return em.mutual_information(lognorm(t), t.cells, "cell_type")


@query("m12_mutual_information_pseudobulk")
def _(t):
    pb = ag.pseudobulk_mean(t.scounts, t.cells, ["sample_id"]).join(t.samples, "sample_id")
    return em.mutual_information_units(pb.select("gene", "response", F.col("mean").alias("value")), "response")


@query("m12_neighbour_information")
def _(t):
    return tr.neighbour_information(lognorm(t), t.cells, "cell_type")


@query("m12_information_ranking")
def _(t):
    pb = ag.pseudobulk_mean(t.scounts, t.cells, ["sample_id"]).join(t.samples, "sample_id").select("gene", "response", F.col("mean").alias("value"))
    pb = materialize(pb)
    return tr.information_ranking(em.mutual_information_units(pb, "response"), pb, "response", "R", "NR")
