"""Only newly arrived samples are processed, and a repeated delivery changes nothing."""

import tempfile

import numpy as np
import pandas as pd

from cellweave.streaming.incremental import process_new_samples, sample_summary


def delivery(spark, samples, seed):
    rng = np.random.default_rng(seed)
    n = 30
    parts = [pd.DataFrame({"sample_id": s, "cell_id": range(n), "area": rng.uniform(1, 2, n), "n_counts": rng.uniform(50, 90, n), "n_genes": rng.integers(20, 40, n)}) for s in samples]
    return spark.createDataFrame(pd.concat(parts))


def test_resume(spark):
    root = tempfile.mkdtemp(prefix="cellweave-test-")
    first = delivery(spark, ["A", "B"], 1)
    run = lambda: process_new_samples(spark, f"{root}/in", first.schema, f"{root}/out", f"{root}/chk", sample_summary)
    first.write.mode("append").parquet(f"{root}/in")
    one = {r["sample_id"]: r["mean_counts"] for r in run().collect()}
    assert set(one) == {"A", "B"}
    delivery(spark, ["B", "C"], 2).write.mode("append").parquet(f"{root}/in")
    two = run().collect()
    assert sorted(r["sample_id"] for r in two) == ["A", "B", "C"]
    assert {r["sample_id"]: r["mean_counts"] for r in two}["B"] == one["B"]
    assert run().count() == 3
