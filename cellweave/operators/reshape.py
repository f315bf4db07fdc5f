"""Set operations and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.scale import c


def outer_concat(tables: Sequence[DataFrame], fill: float | None = None) -> DataFrame:
    """Rows of all tables; a column missing in one is NULL there, or ``fill``."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return out if fill is None else out.fillna(fill)


def inner_concat(counts: DataFrame, n_samples: int | None = None) -> DataFrame:
    """Long counts restricted to the genes every sample has."""
    per_gene = counts.groupBy("gene").agg(F.count_distinct("sample_id").alias("k"))
    if n_samples is None:
        total = counts.agg(F.count_distinct("sample_id").alias("k"))
        common = per_gene.join(F.broadcast(total), "k", "left_semi")
    else:
        common = per_gene.where(F.col("k") == n_samples)
    return counts.join(common.select("gene"), "gene", "left_semi")


def shared_and_unique(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of two sets marked shared, only_a or only_b."""
    return (
        a.intersect(b).withColumn("category", F.lit("shared"))
        .unionByName(a.subtract(b).withColumn("category", F.lit("only_a")))
        .unionByName(b.subtract(a).withColumn("category", F.lit("only_b")))
    )


def pivot_filled(df: DataFrame, keys: Sequence[str], label: str, values: Sequence[str], agg, fill: float = 0) -> DataFrame:
    """Pivot over a given value list; absent combinations are ``fill``."""
    out = df.groupBy(*keys).pivot(label, list(values)).agg(agg)
    return out.select(*[c(k) for k in keys], *[F.coalesce(c(v), F.lit(fill).cast(out.schema[v].dataType)).alias(v) for v in values])
