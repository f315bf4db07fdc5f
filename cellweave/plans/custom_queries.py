"""Queries on the ways a caller brings own rules: marker dictionaries, row rules, aggregates and per-sample functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import scalars as sc
from cellweave.functions import table_functions as tf
from cellweave.plans.registry import query
from cellweave.scale import c

# A caller's own dictionary: label -> (positive markers, negative markers).
OWN = {"lymphoid": (["CD3", "CD20"], ["CD68"]), "myeloid": (["CD68", "CD11c"], ["CD3"]), "vessel": (["CD31"], []), "stroma": (["aSMA"], ["PanCK", "CD45"])}
_score = {k: f"({' + '.join(chr(34) + m + chr(34) for m in p)}) / {len(p)}" + (f" - 0.5 * ({' + '.join(chr(34) + m + chr(34) for m in n)}) / {len(n)}" if n else "") for k, (p, n) in OWN.items()}


@query("f1_marker_dictionary", f"""
SELECT sample_id, cell_id, CASE {' '.join(f"WHEN s_{k} = best THEN '{k}'" for k in OWN)} END AS label, best AS score FROM (
  SELECT *, greatest({', '.join(f's_{k}' for k in OWN)}) AS best FROM (SELECT sample_id, cell_id, {', '.join(f'{v} AS s_{k}' for k, v in _score.items())} FROM pw))""", rnd="score")
def _(t):
    name, best = sc.arg_max({k: sc.signed_score(sc.Gate(k, tuple(p), tuple(n))) for k, (p, n) in OWN.items()})
    return t.pw.select("sample_id", "cell_id", name.alias("label"), best.alias("score"))


RULES = [("proliferating", [("KI67", 1.0)]), ("double", [("CD3", 0.0), ("CD8", 0.5)]), ("absent", [("NOT_MEASURED", 0.0)]), ("epithelial", [("PanCK", 0.25)])]
_used = ["KI67", "CD3", "CD8", "PanCK"]


@query("f2_row_rules", f"""
WITH z AS (SELECT sample_id, cell_id, {', '.join(f'("{m}" - avg("{m}") OVER w) / stddev_pop("{m}") OVER w AS z_{m}' for m in _used)} FROM pw WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, cell_id, CASE WHEN z_KI67 > 1.0 THEN 'proliferating' WHEN z_CD3 > 0.0 AND z_CD8 > 0.5 THEN 'double' WHEN z_PanCK > 0.25 THEN 'epithelial' ELSE 'Other' END AS rule FROM z""")
def _(t):
    return sc.decide_by_zscore(t.pw, ["sample_id"], RULES, out="rule").select("sample_id", "cell_id", "rule")


@query("f3_custom_aggregate", """
WITH m AS (SELECT *, avg(area) OVER (PARTITION BY sample_id) AS a FROM cells), s AS (SELECT sample_id, CAST(count(*) AS BIGINT) AS n, any_value(a) AS mean, avg(pow(area - a, 2)) AS variance, avg(pow(area - a, 3)) AS m3, avg(pow(area - a, 4)) AS m4 FROM m GROUP BY 1)
SELECT sample_id, n, mean, variance, m3 / pow(variance, 1.5) AS skewness, m4 / (variance * variance) - 3 AS kurtosis FROM s""", rnd="mean variance skewness kurtosis")
def _(t):
    tf.register(t.spark)
    t.cells.createOrReplaceTempView("cellweave_cells")
    states = "SELECT key, merge_moments(state) AS m FROM moments_partial(TABLE(SELECT sample_id AS key, CAST(area AS DOUBLE) AS value FROM cellweave_cells)) GROUP BY key"
    return t.spark.sql(f"SELECT key AS sample_id, m.* FROM ({states})")


@query("f5_per_sample_function", """
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cells, coalesce(sum(step), 0) AS length, coalesce(max(step), 0) AS largest_gap FROM (
  SELECT sample_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM cells WINDOW w AS (PARTITION BY sample_id ORDER BY x, y, cell_id)) GROUP BY 1""", rnd="length largest_gap", digits=4)
def _(t):
    tf.register(t.spark)
    t.cells.select("sample_id", "cell_id", c("x").cast("double").alias("x"), "y").createOrReplaceTempView("cellweave_places")
    return t.spark.sql("SELECT * FROM tissue_walk(TABLE(SELECT * FROM cellweave_places) PARTITION BY sample_id ORDER BY (x, y, cell_id))")


@query("f5_walk_by_dataframe", """
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_cells, coalesce(sum(step), 0) AS length, coalesce(max(step), 0) AS largest_gap FROM (
  SELECT sample_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM cells WINDOW w AS (PARTITION BY sample_id ORDER BY y, x, cell_id)) GROUP BY 1""", rnd="length largest_gap", digits=4)
def _(t):
    cells = t.cells.select("sample_id", "cell_id", F.col("x").cast("double").alias("x"), "y")
    return tf.walks(cells, ["y", "x", "cell_id"])
