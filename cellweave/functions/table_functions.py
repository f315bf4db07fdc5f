"""A custom aggregate whose states merge, and a per-sample table function, both for DataFrames and for SQL.

``register(spark)`` makes them callable:

    SELECT key, merge_moments(state) FROM moments_partial(TABLE(SELECT sample_id AS key, area AS value FROM cells)) GROUP BY key
    SELECT * FROM tissue_walk(TABLE(SELECT ... FROM cells) PARTITION BY sample_id ORDER BY (x, y, cell_id))

The aggregate sees Arrow batches where the rows are and hands on one state a key and batch, so no task meets a group; the table
function reads a sample's rows in order and keeps a few numbers, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

from cellweave.scale import c

def _struct(**kinds: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


MOMENTS = _struct(n=LongType(), mean=DoubleType(), variance=DoubleType(), skewness=DoubleType(), kurtosis=DoubleType())
STATE = _struct(key=StringType(), state=BinaryType())
WALK = _struct(sample_id=StringType(), n_cells=LongType(), length=DoubleType(), largest_gap=DoubleType())


def moments_of(values: np.ndarray) -> np.ndarray:
    """(n, mean, and the sums of the second to fourth powers of the distances from it)."""
    mean = values.mean()
    d = values - mean
    return np.array([len(values), mean, (d**2).sum(), (d**3).sum(), (d**4).sum()])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of two parts together (Pebay, 2008)."""
    n, d = a[0] + b[0], b[1] - a[1]
    if not a[0] or not b[0]:
        return b if b[0] else a
    x, y = a[0], b[0]
    m2 = a[2] + b[2] + d * d * x * y / n
    m3 = a[3] + b[3] + d**3 * x * y * (x - y) / n**2 + 3 * d * (x * b[2] - y * a[2]) / n
    m4 = a[4] + b[4] + d**4 * x * y * (x * x - x * y + y * y) / n**3 + 6 * d * d * (x * x * b[2] + y * y * a[2]) / n**2 + 4 * d * (x * b[3] - y * a[3]) / n
    return np.array([n, a[1] + d * y / n, m2, m3, m4])


class MomentsPartial:
    """Rows (key, value) to one state a key and batch; null and non-finite values are left out."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        value = batch.column("value").to_numpy(zero_copy_only=False).astype(np.float64)
        key = batch.column("key").dictionary_encode(null_encoding="encode")
        at, keep = key.indices.to_numpy(), np.isfinite(value)
        order = np.argsort(at[keep], kind="stable")
        at, value = at[keep][order], value[keep][order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        states = [moments_of(v).tobytes() for v in np.split(value, first[1:])] if len(at) else []
        yield pa.table({"key": key.dictionary.take(pa.array(at[first])), "state": pa.array(states, pa.binary())})


moments_partial = F.arrow_udtf(MomentsPartial, returnType=STATE)


@F.arrow_udf(MOMENTS)
def merge_moments(states: pa.Array) -> dict:
    """n, mean, population variance, skewness and excess kurtosis of merged states."""
    total = np.zeros(5)
    for s in states:
        total = merged(total, np.frombuffer(s.as_py()))
    n, mean, m2, m3, m4 = total.tolist()
    if not n:
        return {"n": 0, "mean": None, "variance": None, "skewness": None, "kurtosis": None}
    v = m2 / n
    shape = (m3 / n / v**1.5, m4 / n / (v * v) - 3) if v > 0 else (None, None)
    return {"n": int(n), "mean": mean, "variance": v, "skewness": shape[0], "kurtosis": shape[1]}


class TissueWalk:
    """Cells of a sample in the caller's order: how many, how long the way past them is, and its largest step."""

    def __init__(self):
        self.sample, self.n, self.length, self.gap, self.last = None, 0, 0.0, 0.0, None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if batch.num_rows:
            self.sample = batch.column("sample_id")[0].as_py()
            xy = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("x", "y")])
            way = xy if self.last is None else np.vstack([self.last, xy])
            steps = np.sqrt((np.diff(way, axis=0) ** 2).sum(1))
            self.n, self.length, self.gap, self.last = self.n + len(xy), self.length + float(steps.sum()), max(self.gap, float(steps.max(initial=0.0))), xy[-1]
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.n:
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
            names = ("sample_id", "n_cells", "length", "largest_gap")
            yield pa.table({k: pa.array([v], t) for k, v, t in zip(names, (self.sample, self.n, self.length, self.gap), kinds)})


tissue_walk = F.arrow_udtf(TissueWalk, returnType=WALK)


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL."""
    spark.udtf.register("moments_partial", moments_partial)
    spark.udf.register("merge_moments", merge_moments)
    spark.udtf.register("tissue_walk", tissue_walk)


def moments_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, variance, skewness, kurtosis) of a column by one key, as text."""
    rows = df.select(c(key).cast("string").alias("key"), c(value).cast("double").alias("value"))
    states = moments_partial(rows.asTable())
    return states.groupBy("key").agg(merge_moments("state").alias("m")).select(F.col("key").alias(key), "m.*")


def walks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The walk past every sample's cells, in the given order."""
    rows = df.select(c("sample_id").cast("string").alias("sample_id"), *[c(k) for k in dict.fromkeys(["x", "y", *order]) if k != "sample_id"])
    return tissue_walk(rows.asTable().partitionBy("sample_id").orderBy(*order))
