"""Domain tables (counts, cells, protein, samples, genes) derived from the driver's star schema.

Each definition exists twice, as a DataFrame and as a SQL common table expression, and both read the whole
source tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.scale import TASK_ROWS, spread

# Protein panel, in panel order.
MARKERS = [
    "CD3", "CD4", "CD8", "CD11c", "CD20", "CD31", "CD45", "CD68", "FOXP3",
    "HLA-DR", "PD1", "PDL1", "KI67", "PanCK", "aSMA", "ATPase", "Isotype",
]

SYMBOL_PREFIXES = ["GENE", "LINC", "MIR", "SNORD", "SNHG", "MT-R", "MT-", "RNU", "AC00000", "NCP-", "NEAT", "RP1-"]

_STAGES = ["normal", "control", "metaplasia", "cancer"]

_marker_sql = ",\n    ".join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS "{m}"' for i, m in enumerate(MARKERS))
_prefix_sql = ", ".join(f"'{p}'" for p in SYMBOL_PREFIXES)
_unpivot_sql = " UNION ALL ".join(
    f"SELECT sample_id, cell_id, cell_type, '{m}' AS marker, \"{m}\" AS intensity FROM pw" for m in MARKERS
)

PRELUDE = f"""
samples AS (
  SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sample_id,
    'L' || CAST(n_nationkey % 4 + 1 AS VARCHAR) AS lane,
    'P' || lpad(CAST(n_nationkey // 2 AS VARCHAR), 2, '0') AS patient,
    CASE n_nationkey % 2 WHEN 0 THEN 'Pre' ELSE 'Post' END AS timepoint,
    CASE (n_nationkey // 2) % 2 WHEN 0 THEN 'R' ELSE 'NR' END AS response,
    CASE (n_nationkey // 4) % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'control' WHEN 2 THEN 'metaplasia' ELSE 'cancer' END AS stage,
    r_name AS tissue
  FROM nation JOIN region ON n_regionkey = r_regionkey),
cells AS (
  SELECT o_orderkey AS cell_id, 'S' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS sample_id,
    c_mktsegment AS cell_type, o_totalprice / 100 AS x,
    CAST(datediff('day', TIMESTAMP '1995-01-01', o_orderdate) AS DOUBLE) AS y,
    o_totalprice / 5000 AS area, o_orderstatus = 'P' AS admixed, o_orderpriority AS cluster
  FROM orders JOIN customer ON o_custkey = c_custkey),
counts AS (
  SELECT l_orderkey AS cell_id, 'G' || CAST(l_partkey % 300 AS VARCHAR) AS gene, sum(l_quantity) AS count
  FROM lineitem GROUP BY 1, 2),
scounts AS (
  SELECT sample_id, cell_type, cell_id, gene, count FROM counts JOIN cells USING (cell_id)),
pw AS (
  SELECT vec_id AS cell_id, 'S' || CAST(vec_id % 4 AS VARCHAR) AS sample_id, 'T' || CAST(label AS VARCHAR) AS cell_type,
    {_marker_sql},
    CAST(embedding[63] AS DOUBLE) * 100 AS x, CAST(embedding[64] AS DOUBLE) * 100 AS y
  FROM embeddings),
prot AS ({_unpivot_sql}),
genes AS (
  SELECT 'G' || CAST(p_partkey % 300 AS VARCHAR) AS gene,
    min(p_name) AS label, min(p_size) AS size, CAST(count(*) AS BIGINT) AS n_parts
  FROM part GROUP BY 1),
symbols AS (
  SELECT p_partkey, list_extract([{_prefix_sql}], CAST(p_partkey % {len(SYMBOL_PREFIXES)} AS INTEGER) + 1) || CAST(p_partkey AS VARCHAR) AS symbol,
    CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'control' ELSE 'targeting' END AS probe_type
  FROM part)
""".strip()


class Tables:
    """Lazy DataFrames over one driver directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        k = F.col("n_nationkey")
        half, quarter = (k / 2).cast("int"), (k / 4).cast("int")
        stage = F.element_at(F.array(*[F.lit(s) for s in _STAGES]), (quarter % 4 + 1).cast("int"))
        return self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            _sample_id(k).alias("sample_id"),
            F.concat(F.lit("L"), (k % 4 + 1).cast("string")).alias("lane"),
            F.concat(F.lit("P"), F.lpad(half.cast("string"), 2, "0")).alias("patient"),
            F.when(k % 2 == 0, "Pre").otherwise("Post").alias("timepoint"),
            F.when(half % 2 == 0, "R").otherwise("NR").alias("response"),
            stage.alias("stage"),
            F.col("r_name").alias("tissue"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        orders, customer = self.read("orders"), self.read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("cell_id"),
            _sample_id(F.col("c_nationkey")).alias("sample_id"),
            F.col("c_mktsegment").alias("cell_type"),
            (F.col("o_totalprice") / 100).alias("x"),
            F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("y"),
            (F.col("o_totalprice") / 5000).alias("area"),
            (F.col("o_orderstatus") == "P").alias("admixed"),
            F.col("o_orderpriority").alias("cluster"),
        )

    @cached_property
    def counts(self) -> DataFrame:
        gene = F.concat(F.lit("G"), (F.col("l_partkey") % 300).cast("string"))
        # one shuffle by cell serves the sum here and every later per-cell window; tasks are as many as the rows ask for
        rows = self.read("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        n = rows.count()
        by_cell = spread(rows, ["l_orderkey"], n) if n > TASK_ROWS * int(self.spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("l_orderkey")
        return (
            by_cell.groupBy(F.col("l_orderkey").alias("cell_id"), gene.alias("gene"))
            .agg(F.sum("l_quantity").alias("count"))
        )

    @cached_property
    def scounts(self) -> DataFrame:
        return self.counts.join(self.cells.select("cell_id", "sample_id", "cell_type"), "cell_id").select(
            "sample_id", "cell_type", "cell_id", "gene", "count"
        )

    @cached_property
    def pw(self) -> DataFrame:
        v = F.col("embedding")
        return self.read("embeddings").select(
            F.col("vec_id").alias("cell_id"),
            F.concat(F.lit("S"), (F.col("vec_id") % 4).cast("string")).alias("sample_id"),
            F.concat(F.lit("T"), F.col("label").cast("string")).alias("cell_type"),
            *[v[i].cast("double").alias(m) for i, m in enumerate(MARKERS)],
            (v[62].cast("double") * 100).alias("x"),
            (v[63].cast("double") * 100).alias("y"),
        )

    @cached_property
    def prot(self) -> DataFrame:
        return self.pw.unpivot(["sample_id", "cell_id", "cell_type"], MARKERS_Q, "marker", "intensity")

    @cached_property
    def genes(self) -> DataFrame:
        gene = F.concat(F.lit("G"), (F.col("p_partkey") % 300).cast("string"))
        return self.read("part").groupBy(gene.alias("gene")).agg(
            F.min("p_name").alias("label"), F.min("p_size").alias("size"), F.count(F.lit(1)).alias("n_parts")
        )

    @cached_property
    def symbols(self) -> DataFrame:
        k = F.col("p_partkey")
        prefix = F.element_at(F.array(*[F.lit(p) for p in SYMBOL_PREFIXES]), (k % len(SYMBOL_PREFIXES) + 1).cast("int"))
        five = F.col("p_size") % 5
        return self.read("part").select(
            k,
            F.concat(prefix, k.cast("string")).alias("symbol"),
            F.when(five == 0, F.lit(None)).when(five == 1, "control").otherwise("targeting").alias("probe_type"),
        )

    def literal(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small parameter table given by the caller (marker lists, pairs, networks)."""
        return self.spark.createDataFrame(rows, schema)


MARKERS_Q = [f"`{m}`" for m in MARKERS]


def _sample_id(key):
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 2, "0"))
