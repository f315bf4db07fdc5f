"""Session settings used by the tests, the bench and local work."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ARCHIVE = "cellweave_package.zip"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session; on a cluster the submitter's own session is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the pandas UDFs."""
    sc = spark.sparkContext
    if any(f.rsplit("/", 1)[-1] == _ARCHIVE for f in sc.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="cellweave-"), _ARCHIVE)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:  # sources only: the package folder may be read-only
        for source in sorted(pathlib.Path(root, "cellweave").rglob("*.py")):
            z.write(source, source.relative_to(root))
    sc.addPyFile(path)
