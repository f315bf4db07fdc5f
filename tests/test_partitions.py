"""Tasks follow the rows."""

import pytest

from cellweave import scale
from cellweave.operators import embedding as em
from cellweave.plans import tables


def test_spread_follows_the_rows(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(50)
    assert scale.spread(df, ["id"]).rdd.getNumPartitions() == n
    assert scale.spread(df, ["id"], 3 * n * scale.TASK_ROWS).rdd.getNumPartitions() == 3 * n


def test_counts_of_many_rows_are_cut_by_cell(spark, tmp_path, monkeypatch):
    rows = [(i % 40, i, float(i)) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = sorted(map(tuple, tables.Tables(spark, str(tmp_path)).counts.collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    monkeypatch.setattr(scale, "TASK_ROWS", 10)
    cut = tables.Tables(spark, str(tmp_path)).counts
    assert cut.rdd.getNumPartitions() == 40 and sorted(map(tuple, cut.collect())) == whole


def test_vectors_of_the_cells_of_a_table(spark):
    v = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "b", 3.0), (3, "z", 1.0)], "cell_id long, gene string, lognorm double")
    of = spark.createDataFrame([(2, "x"), (2, "y"), (3, "x"), (4, "x")], "cell_id long, tag string")
    got = em.cell_vectors(v, ["cell_id"], ["a", "b"], of=of)
    assert sorted(map(tuple, got.collect())) == [(2, "x", [0.0, 3.0]), (2, "y", [0.0, 3.0])]
    assert sorted((r.cell_id, r.vec) for r in em.cell_vectors(v, ["cell_id"], ["a", "b"]).collect()) == [(1, [1.0, 2.0]), (2, [0.0, 3.0])]
    assert pytest.approx(1.0) == got.count() / 2
