"""Processing of newly arrived samples: a file stream, run until it is drained, appended to a summary table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.scalars import SAMPLE_LIMITS, sample_status
from cellweave.operators.aggregates import sample_qc

DONE_SCHEMA = "sample_id string, status string, batch long"


def finished_samples(spark: SparkSession, summary_path: str) -> DataFrame:
    """Samples whose recorded status is present and not ERROR; empty before the first run."""
    try:
        done = spark.read.schema(DONE_SCHEMA).parquet(summary_path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DONE_SCHEMA)
    return done.where("status is not null and status <> 'ERROR'")


def sample_summary(cells: DataFrame, limits=SAMPLE_LIMITS) -> DataFrame:
    return sample_status(sample_qc(cells), limits)


def process_new_samples(
    spark: SparkSession, source_path: str, schema: T.StructType, summary_path: str, checkpoint: str,
    summarise: Callable[[DataFrame], DataFrame] = sample_summary, fmt: str = "parquet",
) -> DataFrame:
    """Summarise the samples that arrived since the last call and return the whole summary.

    The stream's checkpoint remembers the files seen; samples already summarised are skipped even if their files
    come again. A batch writes its own partition, so a repeated batch replaces itself. A sample's files are
    expected to arrive together.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        done = finished_samples(spark, summary_path).where(F.col("batch") != number).select("sample_id").distinct()
        fresh = batch.join(done, "sample_id", "left_anti")
        summarise(fresh).write.mode("overwrite").parquet(f"{summary_path}/batch={number}")

    stream = spark.readStream.schema(schema).format(fmt).load(source_path)
    query = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", summary_path).parquet(summary_path)
