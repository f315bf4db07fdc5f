"""Group tests and corrections on published result rows and small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import statistics as st
from cellweave.operators import windows as win
from cellweave.scale import exact_quantiles, row_numbers, tie_ranks

# Published sample metrics (sample, group, centrality) and the published two-group record.
CENTRALITY = [
    ("YP03A", "NR", 0.010063103165536576), ("YP03C", "NR", 0.0008382379858896727), ("YP04C", "NR", 0.0030714993381775347),
    ("YP12A", "R", 0.00753682145306851), ("YP12C", "R", 0.012313314169853536), ("YP15A", "R", 0.0072721965317464245),
    ("YP15C", "R", 0.009390641212800322),
]
RECORD = dict(mean1=0.009128243341867199, mean2=0.004657613496534594, welch_p=0.243798063540067, mwu_p=0.4, effect_size=1.2643458175871816, fold_change=1.9598541932813636)
LOO = dict(loo_welch_min=0.019431644933145416, loo_welch_max=0.594836068081191, loo_mwu_min=0.13333333333333333, loo_mwu_max=0.8)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("m", *r) for r in CENTRALITY], "metric string, id string, g string, value double")


def test_published_two_group_record(rows):
    r = st.with_dual_p(st.dual_test(rows, ["metric"], "g", "R", "NR")).first()
    for k, v in RECORD.items():
        assert r[k] == pytest.approx(v, rel=1e-9), k


def test_published_leave_one_out_range(rows):
    r = st.sensitivity_range(st.leave_one_out(rows, ["metric"], "g", "R", "NR", "id"), ["metric"]).first()
    for k, v in LOO.items():
        assert r[k] == pytest.approx(v, rel=1e-8), k


def test_interpretation_text(rows):
    r = st.full_battery(rows, ["metric"], "g", "R", "NR", "id", n_boot=20).first()
    assert r["interpretation"] == "Not significant (large effect)\nNote: VERY LIMITED POWER (n<10)"
    assert r["effect_size_lower"] <= r["effect_size"] <= r["effect_size_upper"]


def test_bh_is_monotone_and_keeps_missing(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.9, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    out = {r["i"]: r["q"] for r in win.adjust_p(df, [], "p", ["i"]).collect()}
    assert out[4] is None and out[6] is None
    assert [out[i] for i in (3, 0, 2, 1, 5)] == pytest.approx([0.025, 0.025, 0.05, 0.05, 0.9])
    ones = {r["i"]: r["q"] for r in win.adjust_p(df, [], "p", ["i"], nan_policy="one").collect()}
    assert ones[3] == pytest.approx(0.035) and ones[4] == 1.0
    holm = {r["i"]: r["q"] for r in win.adjust_p(df, [], "p", ["i"], "holm").collect()}
    assert holm[3] == pytest.approx(0.025) and holm[1] == pytest.approx(0.09)


def test_u_values_add_up(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("k", "a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.integers(0, 9, 200))], "k string, g string, value double")
    a = st.mann_whitney(df, ["k"], "g", "a", "b").first()
    b = st.mann_whitney(df, ["k"], "g", "b", "a").first()
    assert a["u_stat"] + b["u_stat"] == a["n1"] * a["n2"]


def test_exact_quantiles_beyond_the_sketch(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10007)).cast("double")).alias("v"))
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], {"a": ("v", 0.37), "b": ("v", 0.99), "c": ("v", 0.0)}, accuracy=500).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        for name, q in (("a", 0.37), ("b", 0.99), ("c", 0.0)):
            assert got[k][name] == pytest.approx(np.quantile(g["v"], q), rel=1e-12)


def test_ranks_with_one_hot_value(spark):
    df = spark.range(3000).select(F.lit("s").alias("k"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    ranks = {r["v"]: r["avg_rank"] for r in tie_ranks(df, ["k"], "v").collect()}
    assert ranks[0.0] == 500.5 and max(ranks.values()) == 3000
    rn = row_numbers(df.where("v > 0"), ["k"], ["v"]).agg(F.min("rn"), F.max("rn"), F.count_distinct("rn")).first()
    assert tuple(rn) == (1, 2000, 2000)


def test_progression_needs_samples(spark):
    df = spark.createDataFrame([("g", s, float(v)) for s, v in zip(["n", "n", "m", "m", "c", "c"], [1, 2, 3, 4, 5, 6])], "gene string, stage string, value double")
    r = st.progression(df, ["gene"], "stage", ["n", "m", "c"]).first()
    assert r["spearman_r"] == pytest.approx(0.956182887, abs=1e-8)
    assert math.isclose(r["h_stat"], 4.571428571428571)


def test_composed_p_values_have_closed_forms(spark):
    """With two or so degrees of freedom every tail is elementary."""
    rows = [("m", g, float(v), float(w)) for g, v, w in (("a", 1, 4), ("a", 2, 1), ("a", 4, 7), ("b", 3, 2), ("b", 7, 9), ("b", 5, 8), ("c", 6, 3), ("c", 9, 6), ("c", 8, 5))]
    df = spark.createDataFrame(rows, "metric string, g string, value double, other double")
    k = st.with_kruskal_p(st.kruskal(df, ["metric"], "g")).first()
    assert k.kruskal_p == pytest.approx(math.exp(-k.h_stat / 2), rel=1e-12)
    a = st.with_f_p(st.anova(df, ["metric"], "g")).first()
    assert a.f_p == pytest.approx((1 + 2 * a.f_stat / 6) ** -3, rel=1e-12)
    four = df.where("value <= 4")
    t2 = lambda t: 1 - abs(t) / math.sqrt(2 + t * t)  # noqa: E731  two-sided tail with two degrees of freedom
    r = st.with_correlation_p(st.guarded_correlation(four, ["metric"], "value", "other", min_n=3), "pearson_r", "p").first()
    assert r.n == 4 and r.p == pytest.approx(t2(r.pearson_r * math.sqrt(2 / (1 - r.pearson_r**2))), rel=1e-12)
    two = df.where("value in (1, 4, 3, 7)")
    s = st.with_t_p(st.student_columns(st.two_group_moments(two, ["metric"], "g", "a", "b")), out="p").first()
    assert s.dof == 2 and s.p == pytest.approx(t2(s.t_stat), rel=1e-12)
    cells = spark.createDataFrame([(x, y) for x, y, n in (("p", "u", 3), ("p", "v", 9), ("q", "u", 8), ("q", "v", 2), ("r", "u", 5), ("r", "v", 5)) for _ in range(n)], "x string, y string")
    c = st.with_chi2_p(st.chi_square(cells, "x", "y")).first()
    assert c.dof == 2 and c.chi2_p == pytest.approx(math.exp(-c.chi2 / 2), rel=1e-12)
    u = st.with_mwu_p(st.mann_whitney(df, ["metric"], "g", "a", "c")).first()
    assert u.u_stat == 0 and u.mwu_p == pytest.approx(2 / 20) and u.mwu_p_method == "exact"


def test_comparison_record_and_ratio_tests(spark):
    rows = [(f"s{i}", "R" if i % 2 else "NR", float(i), float(i * i % 7)) for i in range(12)]
    df = spark.createDataFrame(rows, "sample_id string, response string, a double, b double")
    out = {r.metric: r for r in st.compared_with_p(df, ["a", "b"], "response", ("R", "NR")).collect()}
    assert (out["a"].group1, out["a"].group2, out["a"].mean1, out["a"].mean2) == ("R", "NR", 6.0, 5.0)
    assert all(0 <= r.p_value <= 1 and r.std1 > 0 for r in out.values())
    ratios = spark.createDataFrame([("x", y, r[0], r[1], r[2] + k + 1) for r in rows for k, y in enumerate("yz")], "type_a string, type_b string, sample_id string, response string, ratio double")
    got = st.ratio_tests(ratios, "response", "R", "NR").collect()
    assert len(got) == 2 and all(r.welch_p <= r.welch_p_fdr <= 1 and r.mwu_p <= r.mwu_p_fdr <= 1 for r in got)


def test_rank_sum_of_more_cells_than_fit_the_product_of_longs(spark):
    n = 4_200_000
    cells = spark.range(n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("cell_type"))
    expr = spark.createDataFrame([("g", "a", 1.0), ("g", "a", 2.0), ("g", "b", 3.0)], "gene string, cell_type string, lognorm double")
    got = {r["group"]: r["z_score"] for r in st.rank_sum_de(expr, cells, "cell_type", ["a", "b"]).collect()}
    half, zeros = n / 2, n - 3
    rank_a = (zeros + 1) + (zeros + 2) + (half - 2) * (zeros + 1) / 2
    want = (rank_a - half * (n + 1) / 2) / math.sqrt(half * half * (n + 1) / 12)
    assert got["a"] == pytest.approx(want, rel=1e-6) and got["b"] == pytest.approx(-want, rel=1e-6)
