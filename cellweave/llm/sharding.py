"""Uniform shuffle into shards by a hypergeometric communication matrix.

Documents lie in source partitions (a hash of the document, so a rerun finds the same ones). How many rows of each
partition go to each shard is drawn exactly as a uniform shuffle would deal them: row by row of a matrix whose margins are
the partition sizes and the shard sizes, each cell a hypergeometric draw given the cells before it. A partition is permuted
locally, its rows go to the shards in runs of those lengths, and every shard is permuted again. The law is ``rows``: shard
sizes are exact, at most one row apart.

The rows are handled by DataFrame functions only. The driver sees one count per partition (of about a million rows each).

Defined results: null text has 0 bytes; null ids and repeated rows are documents like any other; texts of any length are read
whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.llm.common import materialize, ranked, seeded

LEAST_PARTITIONS = 64
PARTITION_ROWS = 1 << 20


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw of the number of good items among ``draws`` taken without replacement.

    Inverts the distribution outwards from its mode. Weights follow from one another by ratios, so no factorials of the
    population are needed; 40 standard deviations to either side hold all of the mass that a double can show.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    n = good + bad
    spread = math.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1))) + 1
    reach = int(40 * spread) + 10
    up = lambda k: (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))  # noqa: E731  weight of k + 1 over weight of k
    weights, k, w = [(mode, 1.0)], mode, 1.0
    while k < min(high, mode + reach) and w > 1e-18:
        w *= up(k)
        k += 1
        weights.append((k, w))
    k, w = mode, 1.0
    while k > max(low, mode - reach) and w > 1e-18:
        k -= 1
        w /= up(k)
        weights.append((k, w))
    u = rng.random() * math.fsum(w for _, w in weights)
    for k, w in weights:
        u -= w
        if u < 0:
            return k
    return mode


def communication_matrix(sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows to send from each partition to each shard, as in a uniform shuffle; both margins hold exactly."""
    rng, free, out = random.Random(seed), list(shard_sizes), []
    for size in sizes:
        row, left, pool = [], size, sum(free)
        for s, room in enumerate(free):
            got = hypergeometric(rng, room, pool - room, left)
            row.append(got)
            left, pool = left - got, pool - room
        free = [a - b for a, b in zip(free, row)]
        out.append(row)
    return out


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 11, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0), grown_shard (null under this law)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    total = rows.count()
    parts = max(LEAST_PARTITIONS, -(-total // partition_rows))
    document = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    part = F.pmod(F.xxhash64(F.lit(seed), *document), F.lit(parts)).cast("int")
    rows = rows.select("*", part.alias("part"), seeded(seed + 1, *document).alias("h1"), seeded(seed + 2, *document).alias("h2"))
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    shard_sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in sizes], shard_sizes, seed)
    ends, plan = lambda row: [sum(row[: s + 1]) for s in range(shards)], []
    for (p, _), row in zip(sizes, matrix):
        plan.append((p, ends(row)))
    runs = spark.createDataFrame(plan, "part int, ends array<bigint>")
    permuted = rows.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("h1", "doc_id")) - 1)
    dealt = permuted.join(runs, "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
    exchanged = materialize(dealt.select("doc_id", "size", "text_crc32", "shard", "h2"))
    placed = ranked(exchanged, ["shard"], "h2", ["doc_id"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
