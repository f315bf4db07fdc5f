"""Table sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("sample_id",), compression: str | None = None) -> None:
    """Parquet, CSV or JSON; partitioned by sample where the table has that column."""
    parts = [p for p in partition_by if p in df.columns]
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if compression:
        writer = writer.option("compression", compression)
    (writer.partitionBy(*parts) if parts else writer).save(path)


def write_workbook(sheets: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """One dataset per sheet name."""
    for name, df in sheets.items():
        write_table(df, f"{folder}/{name}", fmt, partition_by=())
