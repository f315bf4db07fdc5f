"""Connected components of links between documents, without a task or driver that sees a whole component."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize


def local_stars(n: int, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Root (smallest index) of each of ``n`` items; ``linked(rows, others)`` is the boolean matrix of links.

    Breadth first over the items not yet reached, so a group of mutual copies costs a row or two, not its square.
    """
    root, todo = np.arange(n), np.arange(n)
    while len(todo):
        first, todo, front = todo[0], todo[1:], todo[:1]
        while len(front) and len(todo):
            hit = np.zeros(len(todo), bool)
            for k in range(0, len(front), 256):
                open_ = np.flatnonzero(~hit)
                hit[open_] |= linked(front[k : k + 256], todo[open_]).any(axis=0)
            front, todo = todo[hit], todo[~hit]
            root[front] = first
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by the integer ``keys``, cut so that no group is split: each table holds whole groups only."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for col in columns:
            change[1:] |= col[1:] != col[:-1]
        if kept:
            change[0] = any(kept[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        at = np.flatnonzero(change)
        if not len(at):
            kept.append(batch)
            continue
        last = int(at[-1])
        done = [*kept, batch.slice(0, last)]
        if sum(b.num_rows for b in done):
            yield pa.Table.from_batches(done)
        kept = [batch.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


def group_bounds(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """(start, end) of each group of a table that is sorted by the integer ``keys``."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        col = table.column(k).to_numpy()
        change[1:] |= col[1:] != col[:-1]
    at = np.flatnonzero(change)
    return list(zip(at.tolist(), np.append(at[1:], table.num_rows).tolist()))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of the component of every node that has an edge; ``edges`` has long u, v.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a grouped minimum, which combines on the map
    side, and a join, which adaptive execution splits at hubs. Rounds are stored tables; it ends when nothing changes.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("m")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("low"))
        large = both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        joined = large.join(least, "v")
        small = joined.where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        now = materialize(small.unionByName(least.select("v", F.col("low").alias("m"))).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if seen == mark:
            stars = now.select(F.col("v").alias("node"), F.col("m").alias("label"))
            return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
