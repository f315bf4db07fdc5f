"""Registered queries against their SQL. All of them with CELLWEAVE_ALL=1, else a cross-section."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("CELLWEAVE_SF", "/root/testdata/sf0.001")
SOME = """a3_sample_qc_metrics a7_composition_per_sample a11_pseudobulk_sum c9_hierarchical_gate c19_sample_status j8_paired_pre_post_change
p3_filter_genes_by_cells t3_mann_whitney t5_dual_test t16_leave_one_out w7_adjusted_p_values w12_median_split_and_bins j10_pairs_within_distance
j11_nearest_in_plane g2_notable_pairs g3_local_density g11_structural_similarity g19_ligand_receptor m12_mutual_information x1_incremental_sample_qc
s2_wide_gzip_csv_roundtrip s3_protein_csv_roundtrip s5_vendor_csv_roundtrip s10_workbook_roundtrip a9_marker_mean_by_label a27_fixed_gene_lists c17_scores_to_shares
t10_fisher_exact_p t14_correlation_matrix f4_tail_functions_from_sql g5_hull_holds_all_points g13_pagerank g15_silhouette g19_interaction_summary""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CELLWEAVE_ALL") else SOME


def norm(v):
    if isinstance(v, float):
        return ("nan",) if v != v else (round(v, 4) + 0.0,)
    if isinstance(v, bool):
        return (str(v),)
    return (v,) if isinstance(v, int) else (str(v),)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, exp = table(df.columns, [tuple(r) for r in df.collect()]), table(want.columns, want.fetchall())
    assert len(got) == len(exp)
    for a, b in zip(got, exp):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x[0], float) and abs(x[0] - y[0]) <= 2e-4), (a, b)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
