"""Building blocks that keep an operator distributed when one key owns a large part of the rows.

The rule followed by the whole package: a window may only be partitioned by a key whose group size is
bounded by the domain (genes of one cell, tests of one contrast, bins of one grid). Everything that spans
"all cells of a sample" goes through the functions below, which pre-aggregate on the map side and split
ordered work by range, so no task and no driver ever holds a whole sample.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 200_000


def c(name: str) -> Column:
    """Column by literal name, safe for names such as ``HLA-DR``."""
    return F.col(f"`{name}`")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellweave-"))
        folder = sc.getCheckpointDir()
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back, which cuts its lineage.

    Unlike a checkpoint the table is computed once, is columnar, and its size on disk informs later joins.
    """
    path = f"{shared_folder(df.sparkSession)}/cellweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


TASK_ROWS = 500_000


def spread(df: DataFrame, keys: Sequence[str], rows: int = 0) -> DataFrame:
    """Hash-partition by ``keys`` into the session's full number of shuffle partitions, or more where ``rows`` (all of them) ask for it.

    For steps whose work per byte is high: scans and adaptive execution size partitions by bytes and would merge
    them into too few tasks. With ``rows`` a task holds about ``TASK_ROWS`` of them, however many there are.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(n, *[c(k) for k in keys])


BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a table expected to be small; hint a broadcast only when its rows and bytes prove small.

    Beyond the bounds the table is returned without a hint and joins shuffle (adaptive skew join splits
    hot keys).
    """
    done = materialize(df)
    size = sum((F.coalesce(F.octet_length(c(k).cast("string")), F.lit(0)) for k in done.columns), F.lit(0))
    rows, width = done.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(done) if rows <= max_rows and (width or 0) <= max_bytes else done


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-group table back to the rows: no shuffle of the rows while the table is small."""
    return df.join(sized(small), list(keys), how)


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Add group aggregates to every row without sending a group to one task.

    Equivalent to aggregates over ``Window.partitionBy(keys)``, but aggregated with map-side combine and
    joined back.
    """
    if keys:
        return attach(df, df.groupBy(*keys).agg(*aggs), keys)
    stats = df.agg(*aggs).withColumn("__all", F.lit(0))
    return attach(df.withColumn("__all", F.lit(0)), stats, ["__all"]).drop("__all")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: one row per group, one column per entry.

    ``wanted`` maps an output name to ``(column, probability)``. Pass one brackets each quantile with a
    bounded sketch whose rank error is at most n/accuracy. Pass two counts the rows below the bracket and
    the distinct values inside it (both combine on the map side), so the final ordering sees only a sliver
    of each group. The answer is exact: rows on the wrong side of a bracket edge are still counted at their
    proper place, because the wanted position lies strictly inside the bracket.
    """
    keys = list(keys)
    work_keys = keys or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(0))
    slack = 3.0 / accuracy
    items = [(name, col, q) for name, (col, q) in wanted.items()]
    clean = {col: F.when(~F.isnan(c(col).cast("double")), c(col).cast("double")) for _, col, _ in items}
    base = base.select(*[c(k) for k in work_keys], *[v.alias(f"__v_{k}") for k, v in clean.items()])
    sketch = []
    for i, (_, col, q) in enumerate(items):
        low, high = max(q - slack, 0.0), min(q + slack, 1.0)
        v = F.col(f"`__v_{col}`")
        sketch.append(F.percentile_approx(v, F.array(F.lit(low), F.lit(high)), F.lit(accuracy)).alias(f"__b{i}"))
        sketch.append(F.count(v).alias(f"__n{i}"))
    brackets = base.groupBy(*work_keys).agg(*sketch)
    joined = attach(base, brackets, work_keys)
    parts = []
    for i, (_, col, q) in enumerate(items):
        # up to `accuracy` rows a group is ordered whole; beyond, three sketch errors are at least three ranks
        large = F.col(f"__n{i}") > accuracy
        lo = F.when(large & F.lit(q - slack > 0), F.col(f"__b{i}")[0]).otherwise(float("-inf"))
        hi = F.when(large & F.lit(q + slack < 1), F.col(f"__b{i}")[1]).otherwise(float("inf"))
        parts.append(
            F.struct(
                F.lit(i).alias("i"),
                F.col(f"`__v_{col}`").alias("v"),
                lo.alias("lo"),
                hi.alias("hi"),
                F.col(f"__n{i}").alias("n"),
                F.lit(q).alias("q"),
            )
        )
    long = joined.select(*[c(k) for k in work_keys], F.explode(F.array(*parts)).alias("s")).select(*[c(k) for k in work_keys], "s.*")
    counted = (
        long.where("v is not null and v <= hi")
        .withColumn("v", F.when(F.col("v") >= F.col("lo"), F.col("v")))
        .groupBy(*work_keys, "i", "n", "q", "v")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    w = Window.partitionBy(*[c(k) for k in work_keys], F.col("i")).orderBy(F.col("v").asc_nulls_first())
    pos = (F.col("n") - 1) * F.col("q")
    placed = (
        counted.withColumn("end", F.sum("m").over(w))
        .withColumn("start", F.col("end") - F.col("m"))
        .withColumn("pos", pos)
    )
    inside = lambda p: (F.col("start") <= p) & (p < F.col("end"))
    picked = placed.groupBy(*work_keys, "i").agg(
        F.max(F.when(inside(F.floor("pos")), F.col("v"))).alias("a"),
        F.max(F.when(inside(F.ceil("pos")), F.col("v"))).alias("b"),
        F.first("pos").alias("pos"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))
    out = picked.groupBy(*work_keys).agg(
        *[F.max(F.when(F.col("i") == i, value)).alias(name) for i, (name, _, _) in enumerate(items)]
    )
    return out if keys else out.drop("__all")


def with_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """Rows plus the exact quantiles of their group."""
    if keys:
        return attach(df, exact_quantiles(df, keys, wanted), keys)
    q = exact_quantiles(df, [], wanted).withColumn("__all", F.lit(0))
    return attach(df.withColumn("__all", F.lit(0)), q, ["__all"]).drop("__all")


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, str]
) -> DataFrame:
    """Inclusive running sums per key without a per-key task.

    Rows are range-partitioned by key and order; the partition number is stored with the rows (so it cannot
    change on a retry); partition sums give each slice its starting offset. ``order`` must be unique within
    a key, which callers reach by pre-aggregating ties.
    """
    keys = list(keys)
    cut = materialize(
        df.repartitionByRange(*[c(k) for k in keys], *[c(o) for o in order]).withColumn("__slice", F.spark_partition_id())
    )
    sums = cut.groupBy(*keys, "__slice").agg(*[F.sum(c(src)).alias(f"__t_{out}") for out, src in totals.items()])
    before = Window.partitionBy(*[c(k) for k in keys]).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "__slice",
        *[F.coalesce(F.sum(f"__t_{out}").over(before), F.lit(0)).alias(f"__o_{out}") for out in totals],
    )
    inside = (
        Window.partitionBy(*[c(k) for k in keys], F.col("__slice"))
        .orderBy(*[c(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = attach(cut, offsets, [*keys, "__slice"])
    for out, src in totals.items():
        joined = joined.withColumn(out, F.sum(c(src)).over(inside) + F.col(f"__o_{out}"))
    return joined.drop("__slice", *[f"__o_{out}" for out in totals])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """``row_number`` per key, range-split (``order`` unique within a key)."""
    return running_totals(df.withColumn("__one", F.lit(1).cast("long")), keys, order, {name: "__one"}).drop("__one")


def tie_ranks(df: DataFrame, keys: Sequence[str], value: str, weights: Sequence[Column] = ()) -> DataFrame:
    """One row per distinct value of a key: ``cnt`` rows share it, ``avg_rank`` is their average rank.

    ``weights`` are extra aggregates carried along, such as the count per arm of a two-group test. Hot values
    (zeros, mostly) collapse before anything is ordered.
    """
    counted = (
        df.where(c(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"), *weights)
    )
    ranked = running_totals(counted, keys, [value], {"__end": "cnt"})
    return ranked.withColumn("avg_rank", F.col("__end") - (F.col("cnt") - 1) / 2.0).drop("__end")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Top n rows per key. Spark limits each map task to n rows per key before the shuffle."""
    w = Window.partitionBy(*[c(k) for k in keys]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def salted_top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, id_col: str, salts: int = 64
) -> DataFrame:
    """Top n per key for large n: first within hash slices of a key, then over the survivors."""
    sliced = df.withColumn("__salt", F.pmod(F.xxhash64(c(id_col)), F.lit(salts)))
    first = top_n(sliced, [*keys, "__salt"], order, n, "__rn").drop("__rn", "__salt")
    return top_n(first, keys, order, n, "__rn").drop("__rn")


def zscored(df: DataFrame, keys: Sequence[str], cols: Sequence[str], ddof: int = 0, floor: float = 1e-9, eps: float = 0.0, suffix: str = "_z") -> DataFrame:
    """z-scores per group; a spread under ``floor`` gives 0 (``eps`` is added to the spread)."""
    spread = F.stddev_samp if ddof else F.stddev_pop
    aggs = []
    for m in cols:
        aggs += [F.avg(c(m)).alias(f"__m_{m}"), spread(c(m)).alias(f"__s_{m}")]
    out = with_group_stats(df, keys, aggs)
    for m in cols:
        sd = c(f"__s_{m}")
        z = (c(m) - c(f"__m_{m}")) / (sd + F.lit(eps))
        out = out.withColumn(f"{m}{suffix}", F.when(sd < floor, F.lit(0.0)).otherwise(z) if floor else z)
    return out.drop(*[f"__m_{m}" for m in cols], *[f"__s_{m}" for m in cols])
