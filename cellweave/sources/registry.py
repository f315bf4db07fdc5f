"""Sample dimension and threshold registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.scale import sized

# QC limits per platform.
PLATFORM_THRESHOLDS = [
    # platform, min_genes, max_genes, min_counts, max_counts, max_pct_mt, min_cells_per_gene
    ("Visium", 200, 8000, 500, 50000, 25.0, 3),
    ("G4X", 50, 500, 100, 10000, 25.0, 3),
    ("VisiumHD", 100, 6000, 200, 30000, 25.0, 10),
]
THRESHOLD_SCHEMA = (
    "platform string, min_genes int, max_genes int, min_counts int, max_counts int, max_pct_mt double, "
    "min_cells_per_gene int"
)
DEFAULT_PLATFORM = "Visium"


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLATFORM_THRESHOLDS, THRESHOLD_SCHEMA)


def with_thresholds(df: DataFrame, registry: DataFrame, platform: str = "platform") -> DataFrame:
    """Limits of the row's platform; an unknown platform gets the default one's."""
    known = sized(registry.select(F.col("platform").alias("__known")))
    pick = (
        df.join(known, df[platform] == F.col("__known"), "left")
        .withColumn("__use", F.coalesce("__known", F.lit(DEFAULT_PLATFORM)))
        .drop("__known")
    )
    limits = sized(registry.withColumnRenamed("platform", "__use"))
    return pick.join(limits, "__use").withColumnRenamed("__use", "limits_from")


def pick_samples(samples: DataFrame, excluded: list[str] = (), **equal: str) -> DataFrame:
    """Samples by attribute values, without the excluded ones."""
    out = samples.where(~F.col("sample_id").isin(list(excluded))) if excluded else samples
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out
