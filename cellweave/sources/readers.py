"""Readers: matrix triplets, wide CSV, protein and metadata tables, vendor tables, sample discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.scale import c

INTENSITY = "_intensity_mean"

CELL_METADATA_SCHEMA = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("cell_x", T.DoubleType()),
        T.StructField("cell_y", T.DoubleType()),
        T.StructField("nuclei_area", T.DoubleType()),
        T.StructField("n_genes_by_counts", T.LongType()),
        T.StructField("total_counts", T.DoubleType()),
    ]
)


def finite(col: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """First candidate the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def counts_from_triplets(triplets: DataFrame, cell: str, gene: str, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """Non-zero fact table from (cell, gene, value) triplets; duplicate entries are summed."""
    return (
        triplets.groupBy(*extra, c(cell).cast("string").alias("cell_id"), c(gene).alias("gene"))
        .agg(F.sum(finite(c(value).cast("double"))).alias("count"))
        .where("count <> 0")
    )


def melt_wide(df: DataFrame, ids: Sequence[str], variable: str, value: str, keep: Sequence[str] | None = None, drop_zero: bool = False) -> DataFrame:
    """Wide numeric columns to rows."""
    names = [n for n in (keep or df.columns) if n not in ids]
    cast = df.select(*[c(i) for i in ids], *[c(n).cast("double").alias(n) for n in names])
    long = cast.unpivot([c(i) for i in ids], [c(n) for n in names], variable, value)
    return long.where(c(value) != 0) if drop_zero else long


def read_transcripts_wide(spark: SparkSession, path: str, id_col: str = "label") -> DataFrame:
    """Wide (optionally gzipped) CSV, one column per gene, to the long fact table."""
    df = spark.read.option("header", True).csv(path)
    long = melt_wide(df, [id_col], "gene", "count").withColumn("count", finite(F.col("count")))
    return long.where("count <> 0").withColumnRenamed(id_col, "cell_id")


def protein_columns(names: Sequence[str]) -> list[str]:
    """Marker intensity columns; the two stain channels are not markers."""
    return [n for n in names if n.endswith(INTENSITY) and not n.startswith(("nuclearstain", "cytoplasmicstain"))]


def protein_long(df: DataFrame, id_col: str) -> DataFrame:
    keep = protein_columns(df.columns)
    long = melt_wide(df, [id_col], "marker", "intensity", keep=keep)
    return long.select(
        c(id_col).alias("cell_id"),
        F.regexp_replace("marker", f"{INTENSITY}$", "").alias("marker"),
        finite(F.col("intensity")).alias("intensity"),
    )


def read_protein_csv(spark: SparkSession, path: str, id_col: str = "label") -> DataFrame:
    return protein_long(spark.read.option("header", True).csv(path), id_col)


def read_cell_metadata(spark: SparkSession, path: str, schema: T.StructType = CELL_METADATA_SCHEMA) -> DataFrame:
    """Metadata CSV; columns are matched by header name and cast to the schema's types."""
    df = spark.read.option("header", True).csv(path)
    require_columns(df, schema.names)
    return df.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_vendor_table(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    return require_columns(spark.read.option("header", True).option("inferSchema", True).csv(path), required)


def discover_samples(spark: SparkSession, glob: str, pattern: str, fmt: str = "csv") -> DataFrame:
    """One multi-path scan; ``lane`` and ``sample_id`` come from the file path (two regex groups)."""
    df = spark.read.format(fmt).option("header", True).load(glob)
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, pattern, 1).alias("lane"), F.regexp_extract(path, pattern, 2).alias("sample_id"))


def load_manifest(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Cells and genes found per expected sample; a sample without rows is a recorded failure."""
    found = counts.groupBy("sample_id").agg(
        F.count_distinct("cell_id").alias("n_cells"), F.count_distinct("gene").alias("n_genes")
    )
    zero = F.lit(0).cast("long")
    return samples.select("sample_id").distinct().join(found, "sample_id", "left").select(
        "sample_id",
        F.coalesce("n_cells", zero).alias("n_cells"),
        F.coalesce("n_genes", zero).alias("n_genes"),
        F.when(F.col("n_cells").isNull(), "no data").alias("error"),
    )
