"""Filters, predicates and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.scale import attach, c, row_numbers, salted_top_n, with_group_stats

CONTROL_PREFIXES = ("NCP-", "NCS-")  # fixed values: control probe names

# Marker spellings and their canonical form.
MARKER_ALIASES = {
    "cd3": "CD3", "cd4": "CD4", "cd8": "CD8", "cd11c": "CD11c", "cd20": "CD20", "cd31": "CD31",
    "cd45": "CD45", "cd68": "CD68", "foxp3": "FOXP3", "hla-dr": "HLA-DR", "hladr": "HLA-DR",
    "pd1": "PD1", "pd-1": "PD1", "pdl1": "PDL1", "pd-l1": "PDL1", "ki67": "KI67", "panck": "PanCK",
    "pan-ck": "PanCK", "asma": "aSMA", "a-sma": "aSMA", "alpha-sma": "aSMA", "atpase": "ATPase",
    "isotype": "Isotype",
}


def keep_targets(genes: DataFrame, name: str = "gene", probe_type: str = "probe_type") -> DataFrame:
    """RNA targets: by probe type where known, else by name."""
    by_name = ~(c(name).startswith(CONTROL_PREFIXES[0]) | c(name).startswith(CONTROL_PREFIXES[1]))
    return genes.where(F.coalesce(c(probe_type) == "targeting", by_name))


def in_ranges(limits: Mapping[str, tuple[float | None, float | None]], columns: Sequence[str]) -> Column:
    """Conjunction of inclusive ranges; limits on absent columns are skipped."""
    test = F.lit(True)
    for name, (low, high) in limits.items():
        if name in columns:
            if low is not None:
                test = test & (c(name) >= low)
            if high is not None:
                test = test & (c(name) <= high)
    return test


def filter_cells(cells: DataFrame, limits: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    return cells.where(in_ranges(limits, cells.columns))


def filter_genes(counts: DataFrame, min_cells: int = 3) -> DataFrame:
    """Counts of genes expressed in at least ``min_cells`` cells."""
    kept = counts.where("count > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells)
    return counts.join(kept.select("gene"), "gene", "left_semi")


def removal_report(cells: DataFrame, keys: Sequence[str], reasons: Mapping[str, Column]) -> DataFrame:
    """Cells failing each rule (a cell may count in several) and cells left after all of them."""
    any_fail = F.lit(False)
    for r in reasons.values():
        any_fail = any_fail | F.coalesce(r, F.lit(False))
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_before"),
        *[F.count_if(r).alias(f"removed_{n}") for n, r in reasons.items()],
        F.count_if(~any_fail).alias("n_after"),
    )


def without(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(excluded.select(*keys).distinct(), list(keys), "left_anti")


def restrict_types(cells: DataFrame, mapping: DataFrame, drop_admixed: bool = False) -> DataFrame:
    """Cells of the mapped types, labelled with their group; ``mapping(cell_type, cell_group)``."""
    out = cells.join(mapping, "cell_type")
    return out.where(~F.coalesce(F.col("admixed"), F.lit(False))) if drop_admixed else out


def present_signatures(signatures: DataFrame, genes: DataFrame, min_present: int = 2) -> DataFrame:
    """Signature rows whose gene is measured, for signatures with enough such genes."""
    present = signatures.join(genes.select("gene").distinct(), "gene", "left_semi")
    enough = present.groupBy("name").agg(F.count_distinct("gene").alias("n_present")).where(F.col("n_present") >= min_present)
    return present.join(enough, "name")


def value_profile(df: DataFrame, keys: Sequence[str], value: str, n_cells_genes: Column | None = None) -> DataFrame:
    """Range, mean and integrality of a matrix, over all its rows."""
    v = c(value)
    return df.groupBy(*keys).agg(
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"),
        F.bool_and(v == F.round(v)).alias("all_integer"),
        F.count(v).alias("n_values"),
    )


def raw_and_normalised_flags(profile: DataFrame, raw_min_max: float = 1.0) -> DataFrame:
    """Does the matrix look like raw counts; does it look log-normalised."""
    raw = (F.col("min_value") >= 0) & F.col("all_integer") & (F.col("max_value") >= raw_min_max)
    normal = (F.col("max_value") < 20) & (F.col("min_value") >= 0) & ~(F.col("all_integer") & (F.col("max_value") > 10))
    return profile.withColumn("is_raw_counts", raw).withColumn("is_normalised", normal)


def validation_report(df: DataFrame, target: str, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Rows (check, target, status) from one pass; a check is (name, fails, warns)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("check"),
                F.when(fails, "FAIL").when(warns, "WARN").otherwise("PASS").alias("status"),
            )
            for n, fails, warns in checks
        ]
    )
    return df.select(c(target).alias("target"), F.explode(rows).alias("r")).select("target", "r.check", "r.status")


def seeded_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), c(id_col).cast("string")))


def subsample(df: DataFrame, keys: Sequence[str], n: int, id_col: str, seed: int = 42) -> DataFrame:
    """At most n rows per key, chosen by hash order, the same on every run."""
    keyed = df.withColumn("__h", seeded_key(seed, id_col))
    return salted_top_n(keyed, keys, [F.col("__h"), c(id_col)], n, id_col).drop("__h")


def unique_ids(df: DataFrame, sample: str, name: str, tie: str, out: str = "unique_id") -> DataFrame:
    """Sample-prefixed ids; repeats after the first get a numeric suffix in ``tie`` order."""
    keyed = df.withColumn("__id", F.concat_ws("_", c(sample), c(name)))
    numbered = row_numbers(keyed, ["__id"], [tie], "__k")
    suffix = F.concat_ws("-", F.col("__id"), (F.col("__k") - 1).cast("string"))
    return numbered.withColumn(out, F.when(F.col("__k") == 1, F.col("__id")).otherwise(suffix)).drop("__id", "__k")


def canonical_markers(df: DataFrame, name: str, out: str = "marker") -> DataFrame:
    """Canonical spelling of marker names; unknown names stay."""
    aliases = df.sparkSession.createDataFrame(list(MARKER_ALIASES.items()), "__key string, __canon string")
    key = F.regexp_replace(F.regexp_replace(F.lower(c(name)), "_", "-"), " ", "")
    return (
        df.withColumn("__key", key)
        .join(F.broadcast(aliases), "__key", "left")
        .withColumn(out, F.coalesce("__canon", c(name)))
        .drop("__key", "__canon")
    )


def finite_or_zero(col: Column) -> Column:
    return F.when(col.isNull() | F.isnan(col) | (F.abs(col) == float("inf")), 0.0).otherwise(col)


def mean_impute(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Missing, NaN and infinite values become the column mean of their group."""
    tidy = df.select(*[
        F.when(~F.isnan(c(n)) & (F.abs(c(n)) != float("inf")), c(n)).alias(n) if n in cols else c(n) for n in df.columns
    ])
    out = with_group_stats(tidy, keys, [F.avg(c(n)).alias(f"__m_{n}") for n in cols])
    return out.select(*[F.coalesce(c(n), c(f"__m_{n}")).alias(n) if n in cols else c(n) for n in df.columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in a given order."""
    w = Window.partitionBy(*[c(k) for k in keys]).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def keep_passing(cells: DataFrame, summary: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cells of samples that are in the manifest and whose QC status is not FAIL."""
    good = summary.where("status <> 'FAIL'").join(manifest.where("error is null").select("sample_id"), "sample_id")
    return attach(cells, good.select("sample_id", "status"), ["sample_id"], "inner")
