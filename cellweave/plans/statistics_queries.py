"""Queries for the statistical tests; p-values themselves are checked in the unit tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import dist
from cellweave.functions import scalars as sc
from cellweave.operators import aggregates as ag
from cellweave.operators import joins
from cellweave.operators import statistics as st
from cellweave.plans.clean_queries import SHARES_SQL, SIG_SQL, TYPES, signatures
from cellweave.plans.registry import query
from cellweave.plans.tables import MARKERS
from cellweave.scale import c, materialize

# Tests with their p-values. The tails have no SQL form; tests/ checks them against closed forms and counted cases.


def per_sample(t, *attributes):
    per = t.cells.join(t.samples, "sample_id").groupBy("sample_id", *attributes).agg(ag.n_rows().alias("n_cells"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    return materialize(per)


VALUES_SQL = f"(SELECT cell_type AS metric, sample_id, response, stage, lane, share AS value FROM {SHARES_SQL} JOIN samples USING (sample_id))"


def values(t):
    sh = ag.label_shares(t.cells, ["sample_id"], "cell_type").join(t.samples, "sample_id")
    return sh.select(F.col("cell_type").alias("metric"), "sample_id", "response", "stage", "lane", F.col("share").alias("value"))


def moments_sql(src, keys, group="response", a="R", b="NR", v="value"):
    f = lambda g: f"FILTER ({group} = '{g}')"
    return f"""(SELECT {keys}, CAST(count({v}) {f(a)} AS BIGINT) AS n1, CAST(count({v}) {f(b)} AS BIGINT) AS n2, avg({v}) {f(a)} AS mean1, avg({v}) {f(b)} AS mean2,
      var_samp({v}) {f(a)} AS var1, var_samp({v}) {f(b)} AS var2 FROM {src} WHERE {group} IN ('{a}', '{b}') GROUP BY {keys})"""


def mwu_sql(src, keys, group="response", a="R", b="NR", v="value"):
    return f"""(SELECT {keys}, n1, n2, tie_term, r1 - n1 * (n1 + 1) / 2 AS u_stat, 1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) AS rank_biserial FROM (
      SELECT {keys}, CAST(count(*) FILTER (g = '{a}') AS BIGINT) AS n1, CAST(count(*) FILTER (g = '{b}') AS BIGINT) AS n2, sum(rk) FILTER (g = '{a}') AS r1, sum(CAST(t * t - 1 AS DOUBLE)) AS tie_term FROM (
        SELECT {keys}, {group} AS g, rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {keys}, {v}) AS t
        FROM {src} WHERE {group} IN ('{a}', '{b}')) GROUP BY {keys}))"""


WELCH_COLS = "(mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t_stat, pow(var1 / n1 + var2 / n2, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1)) AS dof"
POOLED = "(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2))"


@query("t1_welch_t", f"SELECT *, {WELCH_COLS} FROM {moments_sql(VALUES_SQL, 'metric')}", rnd="mean1 mean2 var1 var2 t_stat dof")
def _(t):
    return st.welch_columns(st.two_group_moments(values(t), ["metric"], "response", "R", "NR"))


@query("t2_student_t", f"SELECT metric, (mean1 - mean2) / sqrt({POOLED} * (1 / n1 + 1 / n2)) AS t_stat, CAST(n1 + n2 - 2 AS DOUBLE) AS dof FROM {moments_sql(VALUES_SQL, 'metric')}", rnd="t_stat dof")
def _(t):
    m = st.student_columns(st.two_group_moments(values(t), ["metric"], "response", "R", "NR"))
    return m.select("metric", "t_stat", "dof")


@query("t3_mann_whitney", f"SELECT * FROM {mwu_sql('scounts', 'gene', 'cell_type', 'BUILDING', 'MACHINERY', 'count')}", rnd="rank_biserial")
def _(t):
    return st.mann_whitney(t.scounts, ["gene"], "cell_type", "BUILDING", "MACHINERY", "count")


def kruskal_sql(src, keys, group, v, min_n=3):
    return f"""(SELECT {keys}, CAST(sum(n) AS BIGINT) AS n_total, CAST(count(*) AS BIGINT) AS n_groups, (12 / (sum(n) * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - any_value(ties) / CAST(sum(n) * sum(n) * sum(n) - sum(n) AS DOUBLE)) AS h_stat FROM (
      SELECT {keys}, {group}, count(*) AS n, sum(rk) AS r, any_value(ties) AS ties FROM (SELECT *, sum(CAST(t * t - 1 AS DOUBLE)) OVER (PARTITION BY {keys}) AS ties FROM (
        SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {keys}, {v}) AS t
        FROM (SELECT *, count(*) OVER (PARTITION BY {keys}, {group}) AS gn FROM {src}) WHERE gn >= {min_n})) GROUP BY {keys}, {group}) GROUP BY {keys} HAVING count(*) >= 2)"""


@query("t4_kruskal_wallis", f"SELECT * FROM {kruskal_sql('scounts', 'gene', 'cell_type', 'count')}", rnd="h_stat")
def _(t):
    return st.kruskal(t.scounts, ["gene"], "cell_type", "count")


@query("t5_dual_test", f"""
SELECT m.*, {WELCH_COLS}, (mean1 - mean2) / sqrt{POOLED} AS effect_size, mean1 - mean2 AS mean_diff, mean1 / mean2 AS fold_change, u_stat, tie_term, rank_biserial
FROM {moments_sql(VALUES_SQL, 'metric')} m JOIN (SELECT metric, u_stat, tie_term, rank_biserial FROM {mwu_sql(VALUES_SQL, 'metric')}) u USING (metric)""",
    rnd="mean1 mean2 var1 var2 t_stat dof effect_size mean_diff fold_change rank_biserial")
def _(t):
    return st.dual_test(values(t), ["metric"], "response", "R", "NR")


@query("t5_dual_test_with_p")
def _(t):
    return st.with_dual_p(st.dual_test(values(t), ["metric"], "response", "R", "NR"))


@query("t6_compare_metrics_by_group", f"""
SELECT 'lane' AS group_var, metric, 'kruskal' AS test, h_stat AS statistic, n_groups FROM {kruskal_sql("(UNPIVOT (SELECT sample_id, any_value(lane) AS lane, CAST(count(*) AS DOUBLE) AS n_cells, avg(x) AS mean_x, avg(y) AS mean_y FROM cells JOIN samples USING (sample_id) GROUP BY 1) ON n_cells, mean_x, mean_y INTO NAME metric VALUE value)", 'metric', 'lane', 'value')}""", rnd="statistic")
def _(t):
    per = t.cells.join(t.samples, "sample_id").groupBy("sample_id", "lane").agg(ag.n_rows().alias("n_cells"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    return st.compare_by_group(materialize(per), ["n_cells", "mean_x", "mean_y"], "lane", None).select("group_var", "metric", "test", "statistic", "n_groups")


@query("t6_compare_metrics_pairwise", f"""
SELECT 'response' AS group_var, metric, 'mann_whitney' AS test, u_stat AS statistic, rank_biserial FROM {mwu_sql("(UNPIVOT (SELECT sample_id, any_value(response) AS response, CAST(count(*) AS DOUBLE) AS n_cells, avg(x) AS mean_x, avg(y) AS mean_y FROM cells JOIN samples USING (sample_id) GROUP BY 1) ON n_cells, mean_x, mean_y INTO NAME metric VALUE value)", 'metric')}""", rnd="statistic rank_biserial")
def _(t):
    per = t.cells.join(t.samples, "sample_id").groupBy("sample_id", "response").agg(ag.n_rows().alias("n_cells"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    out = st.compare_by_group(materialize(per), ["n_cells", "mean_x", "mean_y"], "response", ("R", "NR"))
    return out.select("group_var", "metric", "test", "statistic", "rank_biserial")


def anova_sql(src, keys, group, v):
    return f"""(SELECT {keys}, CAST(count(*) - 1 AS BIGINT) AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f_stat,
      sum(n * pow(m - g, 2)) / (sum(n * pow(m - g, 2)) + sum(ss)) AS r_squared FROM (
      SELECT *, sum(n * m) OVER (PARTITION BY {keys}) / sum(n) OVER (PARTITION BY {keys}) AS g FROM (SELECT {keys}, {group}, count(*) AS n, avg({v}) AS m, var_pop({v}) * count(*) AS ss FROM {src} GROUP BY {keys}, {group})) GROUP BY {keys})"""


@query("t7_anova_by_lane", f"SELECT * FROM {anova_sql('prot', 'marker', 'sample_id', 'intensity')}", rnd="f_stat r_squared")
def _(t):
    return st.anova(t.prot, ["marker"], "sample_id", "intensity")


@query("t8_variance_partition", f"""
SELECT marker, 'sample_id' AS factor, 'technical' AS kind, r_squared FROM {anova_sql('prot', 'marker', 'sample_id', 'intensity')}
UNION ALL SELECT marker, 'cell_type', 'biological', r_squared FROM {anova_sql('prot', 'marker', 'cell_type', 'intensity')}""", rnd="r_squared")
def _(t):
    return st.variance_partition(t.prot, "marker", {"sample_id": "technical", "cell_type": "biological"}, "intensity")


@query("t9_chi_square", """
WITH o AS (SELECT cell_type, sample_id, count(*) AS o FROM cells GROUP BY 1, 2), g AS (SELECT r.cell_type, k.sample_id, r.r * k.k / n AS e FROM (SELECT cell_type, sum(o) AS r FROM o GROUP BY 1) r
  CROSS JOIN (SELECT sample_id, sum(o) AS k FROM o GROUP BY 1) k CROSS JOIN (SELECT sum(o) AS n FROM o))
SELECT chi2, dof, n, sqrt(chi2 / (n * least(nr, nc))) AS cramers_v FROM (SELECT sum(pow(coalesce(o, 0) - e, 2) / e) AS chi2, CAST((count(DISTINCT cell_type) - 1) * (count(DISTINCT sample_id) - 1) AS BIGINT) AS dof,
  CAST(sum(coalesce(o, 0)) AS BIGINT) AS n, count(DISTINCT cell_type) - 1 AS nr, count(DISTINCT sample_id) - 1 AS nc FROM g LEFT JOIN o USING (cell_type, sample_id))""", rnd="chi2 cramers_v")
def _(t):
    return st.chi_square(t.cells, "cell_type", "sample_id")


REST_SQL = """
SELECT cell_type, a, b, ta - a AS c, tb - b AS d, a * (tb - b) / (b * (ta - a)) AS odds_ratio FROM (SELECT *, CAST(sum(a) OVER () AS BIGINT) AS ta, CAST(sum(b) OVER () AS BIGINT) AS tb FROM (
  SELECT cell_type, CAST(count(*) FILTER (response = 'R') AS BIGINT) AS a, CAST(count(*) FILTER (response = 'NR') AS BIGINT) AS b FROM cells JOIN samples USING (sample_id) GROUP BY 1))"""


@query("t10_label_vs_rest", REST_SQL, rnd="odds_ratio")
def _(t):
    return st.label_vs_rest(t.cells.join(t.samples, "sample_id"), "response", "R", "NR", "cell_type")


def _choose(n, k):
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


@query("t10_fisher_exact_p", f"""
WITH m AS ({REST_SQL}), k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM m),
l AS (SELECT *, {_choose('(a + b)', 'k')} + {_choose('(c + d)', '(a + c - k)')} - {_choose('(a + b + c + d)', '(a + c)')} AS lp FROM k),
p AS (SELECT cell_type, sum(exp(lp)) FILTER (lp <= seen + 1e-7) AS p FROM l JOIN (SELECT cell_type, lp AS seen FROM l WHERE k = a) USING (cell_type) GROUP BY 1)
SELECT m.*, least(1.0, p) AS fisher_p, least(1.0, least(1.0, p) * (SELECT count(*) FROM m)) AS fisher_p_bonferroni FROM m JOIN p USING (cell_type)""", rnd="odds_ratio fisher_p fisher_p_bonferroni")
def _(t):
    m = st.label_vs_rest(t.cells.join(t.samples, "sample_id"), "response", "R", "NR", "cell_type")
    return st.with_fisher_p(m, "cell_type")


def spearman_sql(src, keys, x, y):
    rk = lambda v: f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0"
    return f"(SELECT {keys}, corr(rx, ry) AS spearman_r FROM (SELECT {keys}, {rk(x)} AS rx, {rk(y)} AS ry FROM {src}) GROUP BY {keys})"


@query("t11_guarded_correlation", f"""
SELECT sample_id, cell_type, n, CASE WHEN n >= 100 THEN r END AS pearson_r, CASE WHEN n >= 100 THEN spearman_r END AS spearman_r, CASE WHEN n >= 100 THEN slope END AS slope, CASE WHEN n >= 100 THEN icpt END AS intercept,
  CASE WHEN n < 100 THEN 'insufficient_data' END AS note
FROM (SELECT sample_id, cell_type, CAST(count(*) AS BIGINT) AS n, corr(x, y) AS r, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt FROM cells GROUP BY 1, 2) JOIN {spearman_sql('cells', 'sample_id, cell_type', 'x', 'y')} USING (sample_id, cell_type)""",
    rnd="pearson_r spearman_r slope intercept", digits=5)
def _(t):
    return st.guarded_correlation(t.cells, ["sample_id", "cell_type"], "x", "y", min_n=100)


PAIRS = [("CD3", "G3"), ("CD8", "G8"), ("PanCK", "G14"), ("aSMA", "G15")]
_pairs = "(VALUES " + ", ".join(f"('{p}', '{g}')" for p, g in PAIRS) + ") AS pm(marker, gene)"
# counts keyed by the protein cells' samples
RP_SQL = f"""(SELECT * FROM (SELECT p.sample_id, p.cell_id, p.marker, pm.gene, intensity, coalesce(k.count, 0) AS rna FROM prot p JOIN {_pairs} USING (marker) LEFT JOIN counts k ON k.cell_id = p.cell_id AND k.gene = pm.gene) WHERE intensity > 0 OR rna > 0)"""


@query("t12_rna_protein_correlation", f"""
SELECT sample_id, marker, gene, n, pearson_r, spearman_r FROM (SELECT sample_id, marker, gene, CAST(count(*) AS BIGINT) AS n, CASE WHEN stddev_pop(rna) > 0 THEN corr(intensity, rna) END AS pearson_r FROM {RP_SQL} GROUP BY 1, 2, 3)
LEFT JOIN (SELECT sample_id, marker, gene, CASE WHEN isnan(spearman_r) THEN NULL ELSE spearman_r END AS spearman_r FROM {spearman_sql(RP_SQL, 'sample_id, marker, gene', 'intensity', 'rna')}) USING (sample_id, marker, gene) WHERE n >= 50""", rnd="pearson_r spearman_r")
def _(t):
    pairs = t.literal(PAIRS, "protein string, gene string")
    rna = t.counts.join(t.pw.select("cell_id", "sample_id"), "cell_id")
    return st.rna_protein_correlation(rna, t.prot.select("sample_id", "cell_id", "marker", "intensity"), pairs, ["sample_id"], 50)


@query("t12_gene_map_by_substring", """
SELECT protein, symbol AS gene FROM (VALUES ('linc1'), ('MIR'), ('Snord9')) AS p(protein) JOIN symbols ON contains(upper(symbol), upper(protein))""")
def _(t):
    proteins = t.literal([("linc1",), ("MIR",), ("Snord9",)], "protein string")
    return st.match_gene_map(proteins, t.symbols.select(F.col("symbol").alias("gene")), "substring")


_cm = MARKERS


@query("t14_correlation_matrix", " UNION ALL ".join(f"SELECT sample_id, '{a}' AS a, '{b}' AS b, corr(\"{a}\", \"{b}\") AS r FROM pw GROUP BY 1" for i, a in enumerate(_cm) for b in _cm[i:]), rnd="r")
def _(t):
    return st.correlation_matrix(t.pw, ["sample_id"], _cm)


NBOOT = 1000
_boot = f"""WITH v AS (SELECT metric, response AS g, value, row_number() OVER (PARTITION BY metric, response ORDER BY sample_id) AS i, count(*) OVER (PARTITION BY metric, response) AS n FROM {VALUES_SQL}),
d AS (SELECT metric, g, rep, CAST('0x' || substr(md5('42|' || CAST(rep AS VARCHAR) || '|' || g || '|' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % n + 1 AS pick FROM v CROSS JOIN (SELECT unnest(range(1, {NBOOT + 1})) AS rep)),
b AS (SELECT d.metric, d.rep, d.g, v.value FROM d JOIN v ON v.metric = d.metric AND v.g = d.g AND v.i = d.pick),
m AS (SELECT metric, (mean1 - mean2) / sqrt{POOLED} AS effect_size, mean1 / mean2 AS fold_change, mean1 - mean2 AS mean_diff FROM {moments_sql('b', 'metric, rep', 'g')})
SELECT metric, {", ".join(f"quantile_cont({x}, {q}) AS {x}_{n}" for x in ("effect_size", "fold_change", "mean_diff") for n, q in (("lower", 0.025), ("upper", 0.975)))} FROM m GROUP BY 1"""


@query("t15_bootstrap_interval", _boot, rnd="effect_size_lower effect_size_upper fold_change_lower fold_change_upper mean_diff_lower mean_diff_upper")
def _(t):
    return st.bootstrap_ci(materialize(values(t)), ["metric"], "response", "R", "NR", "sample_id", n_boot=NBOOT)


_loo = f"(SELECT a.metric, r.sample_id AS removed, r.response AS removed_group, a.response, a.value FROM {VALUES_SQL} a JOIN {VALUES_SQL} r ON a.metric = r.metric AND a.sample_id <> r.sample_id)"


@query("t16_leave_one_out", f"""
SELECT m.*, {WELCH_COLS}, (mean1 - mean2) / sqrt{POOLED} AS effect_size, mean1 - mean2 AS mean_diff, mean1 / mean2 AS fold_change, u_stat, tie_term
FROM {moments_sql(_loo, 'metric, removed, removed_group')} m JOIN (SELECT metric, removed, u_stat, tie_term FROM {mwu_sql(_loo, 'metric, removed')}) USING (metric, removed)""",
    rnd="mean1 mean2 var1 var2 t_stat dof effect_size mean_diff fold_change u_stat tie_term", digits=5)
def _(t):
    return st.leave_one_out(materialize(values(t)), ["metric"], "response", "R", "NR", "sample_id")


@query("t16_full_battery_with_p")
def _(t):
    return st.full_battery(materialize(values(t)), ["metric"], "response", "R", "NR", "sample_id", n_boot=NBOOT)


CPM_SQL = "(SELECT sample_id, gene, stage, ln(1 + total * 1e6 / sum(total) OVER (PARTITION BY sample_id)) AS logcpm FROM (SELECT sample_id, gene, sum(count) AS total FROM scounts GROUP BY 1, 2) JOIN samples USING (sample_id))"


def logcpm(t):
    return sc.log_cpm(ag.pseudobulk(t.scounts, ["sample_id"]), ["sample_id"]).join(t.samples, "sample_id")


@query("t17_pseudobulk_de", f"""
SELECT gene, n1, n2, mean1, mean2, u_stat, tie_term, log2(mean1 / mean2) AS log2fc FROM {moments_sql(CPM_SQL, 'gene', 'stage', 'normal', 'cancer', 'logcpm')}
JOIN (SELECT gene, u_stat, tie_term FROM {mwu_sql(CPM_SQL, 'gene', 'stage', 'normal', 'cancer', 'logcpm')}) USING (gene) WHERE n1 >= 2 AND n2 >= 2""", rnd="mean1 mean2 log2fc")
def _(t):
    return st.pseudobulk_de(materialize(logcpm(t)), [], "stage", "normal", "cancer", "logcpm")


@query("t17_pseudobulk_de_with_q")
def _(t):
    return st.with_de_q(st.pseudobulk_de(materialize(logcpm(t)), [], "stage", "normal", "cancer", "logcpm"), [])


_ln = "(SELECT cell_id, cell_type, gene, ln(1 + count * 1e4 / sum(count) OVER (PARTITION BY cell_id)) AS v FROM scounts)"


@query("t18_rank_sum_de", f"""
WITH e AS MATERIALIZED (SELECT cell_id, cell_type, gene, round(v, 9) AS v FROM {_ln}), n AS (SELECT count(*) AS n FROM cells), ng AS (SELECT cell_type AS "group", count(*) AS n1 FROM cells GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS rk FROM e),
g AS (SELECT gene, count(*) AS nnz, sum(v) AS s FROM e GROUP BY 1), p AS (SELECT gene, cell_type AS "group", count(*) AS nz, sum(rk) AS r, sum(v) AS sv FROM r GROUP BY 1, 2),
f AS (SELECT g.gene, ng."group", n, n1, n - n1 AS n2, n - nnz AS z, s, coalesce(nz, 0) AS nz, coalesce(r, 0) AS r, coalesce(sv, 0) AS sv FROM g CROSS JOIN ng CROSS JOIN n LEFT JOIN p ON p.gene = g.gene AND p."group" = ng."group")
SELECT gene, "group", (r + nz * z + (n1 - nz) * (z + 1) / 2 - n1 * (n + 1) / 2) / sqrt(n1 * n2 * (n + 1) / 12) AS z_score, log2((exp(sv / n1) - 1 + 1e-9) / (exp((s - sv) / n2) - 1 + 1e-9)) AS logfc FROM f""", rnd="z_score logfc", digits=5)
def _(t):
    e = sc.log_normalised(t.scounts, ["cell_id"]).withColumn("lognorm", F.round("lognorm", 9))
    return st.rank_sum_de(e, t.cells, "cell_type", TYPES)


@query("t18_rank_sum_de_with_q")
def _(t):
    e = sc.log_normalised(t.scounts, ["cell_id"])
    return st.with_rank_sum_q(st.rank_sum_de(e, t.cells, "cell_type", TYPES))


@query("t19_composition_test", f"""
SELECT metric AS cell_type, n1, n2, mean1, mean2, var1, var2, {WELCH_COLS}, log2((mean2 + 0.001) / (mean1 + 0.001)) AS log2fc FROM {moments_sql(VALUES_SQL, 'metric')}""", rnd="mean1 mean2 var1 var2 t_stat dof log2fc")
def _(t):
    return st.composition_test(values(t).withColumnRenamed("metric", "cell_type"), "cell_type", "response", "R", "NR", "value")


@query("t20_metric_table_test", f"""
SELECT metric, n1, n2, mean1, mean2, {WELCH_COLS}, (mean1 - mean2) / sqrt((var1 * (n1 - 1) / n1 + var2 * (n2 - 1) / n2) / 2) AS effect_size, u_stat
FROM (SELECT name AS metric, * EXCLUDE (name) FROM {moments_sql('(SELECT name, response, score AS value FROM (SELECT sample_id, name, sum(count) AS score FROM scounts JOIN ' + SIG_SQL + ' USING (gene) GROUP BY 1, 2) JOIN samples USING (sample_id))', 'name')})
JOIN (SELECT name AS metric, u_stat FROM {mwu_sql('(SELECT name, response, score AS value FROM (SELECT sample_id, name, sum(count) AS score FROM scounts JOIN ' + SIG_SQL + ' USING (gene) GROUP BY 1, 2) JOIN samples USING (sample_id))', 'name')}) USING (metric)""",
    rnd="mean1 mean2 t_stat dof effect_size")
def _(t):
    s = t.scounts.join(signatures(t), "gene").groupBy("sample_id", F.col("name").alias("metric")).agg(F.sum("count").alias("value"))
    out = st.dual_test(materialize(s.join(t.samples, "sample_id")), ["metric"], "response", "R", "NR", ddof=0)
    return out.select("metric", "n1", "n2", "mean1", "mean2", "t_stat", "dof", "effect_size", "u_stat")


STAGES = ["normal", "control", "metaplasia", "cancer"]
_ord = "(SELECT *, CASE stage " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STAGES)) + f" END AS o FROM {VALUES_SQL})"


@query("t21_stage_progression", f"""
SELECT metric, n_total, n_groups, h_stat, spearman_r FROM {kruskal_sql(VALUES_SQL, 'metric', 'stage', 'value', 1)} JOIN {spearman_sql(_ord, 'metric', 'o', 'value')} USING (metric)""", rnd="h_stat spearman_r")
def _(t):
    return st.progression(materialize(values(t)), ["metric"], "stage", STAGES)


@query("t22_protein_two_samples", f"""
SELECT marker, n1, n2, u_stat, rank_biserial, mean1 / mean2 AS fold_change FROM {mwu_sql('prot', 'marker', 'sample_id', 'S0', 'S1', 'intensity')} JOIN (SELECT marker, mean1, mean2 FROM {moments_sql('prot', 'marker', 'sample_id', 'S0', 'S1', 'intensity')}) USING (marker)""", rnd="u_stat rank_biserial fold_change")
def _(t):
    return st.dual_test(t.prot, ["marker"], "sample_id", "S0", "S1", "intensity").select("marker", "n1", "n2", "u_stat", "rank_biserial", "fold_change")


@query("t23_over_representation", f"""
SELECT name, set_size, CAST(coalesce(k, 0) AS BIGINT) AS overlap, coalesce(k, 0) / set_size AS ratio FROM (SELECT name, CAST(count(DISTINCT gene) AS BIGINT) AS set_size FROM {SIG_SQL} GROUP BY 1)
LEFT JOIN (SELECT name, count(*) AS k FROM {SIG_SQL} WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING sum(count) > 5100) GROUP BY 1) USING (name)""", rnd="ratio")
def _(t):
    hits = t.counts.groupBy("gene").agg(F.sum("count").alias("s")).where("s > 5100")
    return st.over_representation(hits, signatures(t))


@query("t2_student_t_with_p")
def _(t):
    m = st.student_columns(st.two_group_moments(values(t), ["metric"], "response", "R", "NR"))
    return st.with_t_p(m, out="student_p")


@query("t4_kruskal_wallis_with_p")
def _(t):
    return st.with_kruskal_p(st.kruskal(t.scounts, ["gene"], "cell_type", "count"))


@query("t6_compare_metrics_with_p")
def _(t):
    return st.compared_with_p(per_sample(t, "lane"), ["n_cells", "mean_x", "mean_y"], "lane", None)


@query("t6_compare_metrics_pairwise_with_p")
def _(t):
    return st.compared_with_p(per_sample(t, "response"), ["n_cells", "mean_x", "mean_y"], "response", ("R", "NR"))


@query("t7_anova_by_lane_with_p")
def _(t):
    return st.with_f_p(st.anova(t.prot, ["marker"], "sample_id", "intensity"))


@query("t9_chi_square_with_p")
def _(t):
    return st.with_chi2_p(st.chi_square(t.cells, "cell_type", "sample_id"))


@query("t11_guarded_correlation_with_p")
def _(t):
    m = st.guarded_correlation(t.cells, ["sample_id", "cell_type"], "x", "y", min_n=100)
    return st.with_correlation_p(st.with_correlation_p(m, "pearson_r", "pearson_p"), "spearman_r", "spearman_p")


@query("t12_rna_protein_correlation_with_p")
def _(t):
    pairs = t.literal(PAIRS, "protein string, gene string")
    rna = t.counts.join(t.pw.select("cell_id", "sample_id"), "cell_id")
    m = st.rna_protein_correlation(rna, t.prot.select("sample_id", "cell_id", "marker", "intensity"), pairs, ["sample_id"], 50)
    return st.with_correlation_p(st.with_correlation_p(m, "pearson_r", "pearson_p"), "spearman_r", "spearman_p")


@query("t19_composition_test_with_p")
def _(t):
    m = st.composition_test(values(t).withColumnRenamed("metric", "cell_type"), "cell_type", "response", "R", "NR", "value")
    return st.with_t_p(m).orderBy("welch_p", "cell_type")


@query("t20_metric_table_with_p")
def _(t):
    s = t.scounts.join(signatures(t), "gene").groupBy("sample_id", F.col("name").alias("metric")).agg(F.sum("count").alias("value"))
    return st.with_dual_p(st.dual_test(materialize(s.join(t.samples, "sample_id")), ["metric"], "response", "R", "NR", ddof=0))


@query("t21_stage_progression_with_p")
def _(t):
    m = st.progression(materialize(values(t)), ["metric"], "stage", STAGES)
    return st.with_correlation_p(st.with_kruskal_p(m), "spearman_r", "spearman_p", "n_total")


@query("t22_protein_two_samples_with_p")
def _(t):
    m = st.with_mwu_p(st.dual_test(t.prot, ["marker"], "sample_id", "S0", "S1", "intensity"))
    return st.adjust_p(m, [], "mwu_p", ["marker"], "bonferroni", out="mwu_p_bonferroni")


@query("j13_cell_type_ratio_tests")
def _(t):
    ratios = joins.type_ratios(ag.label_shares(t.cells, ["sample_id"], "cell_type"), ["sample_id"])
    return st.ratio_tests(materialize(ratios.join(t.samples, "sample_id")), "response", "R", "NR")


@query("f4_tail_functions_from_sql", """
SELECT cell_id, 1 - 2 * atan(x / 1000) / pi() AS t_tail, exp(-x / 2000) AS chi2_tail, pow(1 + 2 * (x / 1000) / 7, -3.5) AS f_tail FROM cells""", rnd="t_tail chi2_tail f_tail", digits=9)
def _(t):
    dist.register(t.spark)
    return t.cells.selectExpr("cell_id", "t_p(x / 1000, 1D) AS t_tail", "chi2_p(x / 1000, 2D) AS chi2_tail", "f_p(x / 1000, 2D, 7D) AS f_tail")
