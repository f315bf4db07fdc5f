"""Embeddings: component analysis, modality fusion, batch correction, mixing measures, gene selection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.operators.aggregates import n_rows
from cellweave.operators.neighbors import _rows, nearest_in_embedding
from cellweave.scale import attach, c, materialize, spread, top_n, with_group_stats

MAX_FEATURES = 5_000  # a features x features matrix is held by the driver


def _cols(names: Sequence[str]) -> list[Column]:
    return [c(n) for n in names]


def cell_vectors(values: DataFrame, cell: Sequence[str], features: Sequence[str], feature: str = "gene", value: str = "lognorm", out: str = "vec", of: DataFrame | None = None) -> DataFrame:
    """One dense array per cell over a given feature list, zeros where nothing is stored; the rows of ``of`` with it, where given.

    Stored once, because decompositions pass over it several times. Cells meet ``of`` by their stored entries, not by the
    dense arrays, and tasks are as many as the entries ask for.
    """
    n = len(features)
    at = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    index = values.sparkSession.range(1).select(F.explode(at).alias(feature, "__i"))

    @F.pandas_udf("array<double>")
    def dense(i: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros((len(i), n))
        if len(i):
            out[np.repeat(np.arange(len(i)), i.str.len()), np.concatenate(i.to_numpy())] = np.concatenate(v.to_numpy())
        return pd.Series(list(out))

    kept = values.select(*_cols(cell), c(feature), c(value).cast("double").alias("__x")).join(F.broadcast(index), feature)
    kept = materialize(kept)
    packed = spread(kept, cell, kept.count()).groupBy(*_cols(cell)).agg(F.collect_list(F.struct("__i", "__x")).alias("e"))
    rows = packed if of is None else of.join(packed, list(cell))
    return materialize(rows.select(*(_cols(cell) if of is None else [c(n_) for n_ in of.columns]), dense(F.col("e.__i"), F.col("e.__x")).alias(out)))


def column_vectors(df: DataFrame, cell: Sequence[str], cols: Sequence[str], out: str = "vec") -> DataFrame:
    return df.select(*_cols(cell), F.array(*[c(n).cast("double") for n in cols]).alias(out))


def scaled(df: DataFrame, vec: str = "vec", clip: float | None = None) -> DataFrame:
    """Arrays with every component centred and divided by its population spread (0 where constant)."""
    row = df.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(c(vec))).alias("s")).select("s.*").first()
    n = row["count"]
    mean = np.array(row["mean"])
    sd = np.sqrt(np.array(row["variance"]) * (n - 1) / max(n, 1))
    inv = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
    lit = lambda a: F.array(*[F.lit(float(v)) for v in a])
    z = F.zip_with(F.zip_with(c(vec), lit(mean), lambda a, b: a - b), lit(inv), lambda a, b: a * b)
    if clip is not None:
        z = F.transform(z, lambda v: F.least(F.lit(clip), F.greatest(F.lit(-clip), v)))
    return df.withColumn(vec, z)


def pca(df: DataFrame, vec: str = "vec", k: int = 50, features: Sequence[str] | None = None, out: str = "pcs") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores (array column), explained variance (pc, ratio, cumulative) and loadings (feature, pc, loading).

    The covariance is one distributed pass; each component's sign makes its largest loading positive.
    """
    data = df.withColumn("__v", array_to_vector(c(vec)))
    row = data.select(Summarizer.metrics("mean", "count").summary(F.col("__v")).alias("s")).select("s.*").first()
    mean = np.array(row["mean"])
    if len(mean) > MAX_FEATURES:
        raise ValueError(f"{len(mean)} features; select at most {MAX_FEATURES} first")
    k = int(min(k, len(mean), max(row["count"] - 1, 1)))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(data)
    pc = model.pc.toArray()
    sign = np.where(pc[np.abs(pc).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    shift = (mean @ pc) * sign
    lit = lambda a: F.array(*[F.lit(float(v)) for v in a])
    score = F.zip_with(F.zip_with(vector_to_array(F.col("__p")), lit(sign), lambda a, b: a * b), lit(shift), lambda a, b: a - b)
    scores = model.transform(data).withColumn(out, score).drop("__v", "__p")
    ratio = np.array(model.explainedVariance)
    spark = df.sparkSession
    variance = spark.createDataFrame([(i + 1, float(r), float(s)) for i, (r, s) in enumerate(zip(ratio, ratio.cumsum()))], "pc int, ratio double, cumulative double")
    names = list(features or [str(i) for i in range(len(mean))])
    rows = [(names[i], j + 1, float(pc[i, j] * sign[j])) for i in range(len(names)) for j in range(k)]
    return scores, variance, spark.createDataFrame(rows, "feature string, pc int, loading double")


def top_loadings(loadings: DataFrame, n: int = 20) -> DataFrame:
    """The n strongest positive and negative loadings per component."""
    up = top_n(loadings, ["pc"], [F.col("loading").desc(), F.col("feature")], n).withColumn("side", F.lit("positive"))
    down = top_n(loadings, ["pc"], [F.col("loading").asc(), F.col("feature")], n).withColumn("side", F.lit("negative"))
    return up.unionByName(down)


def concatenated(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str, out: str = "vec") -> DataFrame:
    return a.join(b, list(keys)).withColumn(out, F.concat(c(left), c(right)))


def total_variance(df: DataFrame, vec: str) -> float:
    row = df.select(Summarizer.metrics("variance", "count").summary(array_to_vector(c(vec))).alias("s")).select("s.*").first()
    return float(np.array(row["variance"]).sum() * (row["count"] - 1) / row["count"])


def weighted_modalities(df: DataFrame, rna: str, protein: str, mode: str = "inverse", out: str = "wnn") -> DataFrame:
    """Scaled components of both modalities times the root of their weight.

    ``inverse`` gives a modality the other's share of the variance, ``direct`` its own.
    """
    vr, vp = total_variance(df, rna), total_variance(df, protein)
    wr, wp = (vp, vr) if mode == "inverse" else (vr, vp)
    wr, wp = wr / (vr + vp + 1e-10), wp / (vr + vp + 1e-10)
    t = scaled(scaled(df.withColumn("__r", c(rna)).withColumn("__p", c(protein)), "__r"), "__p")
    times = lambda col, w: F.transform(col, lambda v: v * math.sqrt(w))
    joint = F.concat(times(F.col("__r"), wr), times(F.col("__p"), wp))
    return t.withColumn(out, joint).withColumn("rna_weight", F.lit(wr)).withColumn("protein_weight", F.lit(wp)).drop("__r", "__p")


def _far(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def shared_neighbour_width(near: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(id, width): mean distance of a cell to the ``k`` cells whose neighbour lists overlap least with its own, but do overlap.

    ``near`` is (src, dst, dist), ``vectors`` (id, v). Only cells that share a neighbour meet, by a join of the lists on the shared
    cell; overlap is the Jaccard index, ties go by id. A cell that shares with none has the distance of its last neighbour.
    """
    sizes = near.groupBy("src").agg(n_rows().alias("n"), F.max("dist").alias("last"))
    a, b = near.select(F.col("src").alias("i"), "dst"), near.select(F.col("src").alias("j"), "dst")
    common = a.join(b, "dst").where("i <> j").groupBy("i", "j").agg(n_rows().alias("m"))
    sized_ = lambda v: sizes.select(F.col("src").alias(v), F.col("n").alias(f"n_{v}"))
    overlap = F.col("m") / (F.col("n_i") + F.col("n_j") - F.col("m"))
    least = top_n(common.join(sized_("i"), "i").join(sized_("j"), "j").select("i", "j", overlap.alias("overlap")), ["i"], [F.col("overlap"), F.col("j")], k)
    side = lambda v: vectors.select(F.col("id").alias(v), F.col("v").alias(f"v_{v}"))
    mean = least.join(side("i"), "i").join(side("j"), "j").groupBy(F.col("i").alias("id")).agg(F.avg(_far(F.col("v_i"), F.col("v_j"))).alias("mean"))
    return sizes.select(F.col("src").alias("id"), "last").join(mean, "id", "left").select("id", F.coalesce("mean", "last").alias("width"))


def fused_neighbours(df: DataFrame, id_col: str, a: str, b: str, k: int = 20, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per-cell modality weights and the k nearest cells under the weighted kernel of both embeddings (Hao et al., 2021).

    A modality weighs more in a cell whose vector its own neighbours predict better than the other's do. A kernel falls with the
    distance beyond the nearest neighbour, by a width that comes from shared neighbours, so it does not depend on how densely
    the cell itself is surrounded. The lists of a modality are exact. The published method chooses from the two lists of a cell;
    with ``every`` all cells are compared, and none that is near in both, but in neither list, is missed.
    """
    base = materialize(df.select(c(id_col).alias("id"), c(a).alias("va"), c(b).alias("vb")))
    near = {m: _distinct_lists(base.select("id", F.col(f"v{m}").alias("v")), k) for m in "ab"}
    own = base
    for m in "ab":
        width = shared_neighbour_width(near[m], base.select("id", F.col(f"v{m}").alias("v")), k)
        first = near[m].groupBy(F.col("src").alias("id")).agg(F.min("dist").alias(f"n{m}"))
        own = own.join(width.withColumnRenamed("width", f"s{m}"), "id").join(first, "id")
    for by in "ab":  # mean vector of the neighbours found in modality `by`, in both modalities
        j = near[by].join(base.withColumnRenamed("id", "dst"), "dst")
        mean = j.groupBy(F.col("src").alias("id")).agg(*[vector_to_array(Summarizer.mean(array_to_vector(F.col(f"v{m}")))).alias(f"p{m}{by}") for m in "ab"])
        own = own.join(mean, "id")
    reach = lambda m: F.greatest(F.col(f"s{m}") - F.col(f"n{m}"), F.lit(1e-12))
    kernel = lambda m, d: F.exp(-F.greatest(F.lit(0.0), d - F.col(f"n{m}")) / reach(m))
    fit = lambda m, by: kernel(m, _far(F.col(f"v{m}"), F.col(f"p{m}{by}")))
    ra, rb = fit("a", "a") / (fit("a", "b") + 1e-4), fit("b", "b") / (fit("b", "a") + 1e-4)
    weights = materialize(own.withColumn("weight_a", 1 / (1 + F.exp(rb - ra))).select("id", "va", "vb", "sa", "sb", "na", "nb", "weight_a"))
    pairs = near["a"].select("src", "dst").union(near["b"].select("src", "dst")).distinct()
    j = pairs.join(weights.withColumnRenamed("id", "src"), "src").join(base.select(F.col("id").alias("dst"), F.col("va").alias("wa"), F.col("vb").alias("wb")), "dst")
    sim = F.col("weight_a") * kernel("a", _far(F.col("va"), F.col("wa"))) + (1 - F.col("weight_a")) * kernel("b", _far(F.col("vb"), F.col("wb")))
    edges = top_n(j.select("src", "dst", sim.alias("similarity")), ["src"], [F.col("similarity").desc(), F.col("dst")], k)
    if every:
        # as many cells of the lists are known to be at least this near
        bound = edges.groupBy(F.col("src").alias("id")).agg(F.min("similarity").alias("least"), n_rows().alias("n"))
        again = base.groupBy("id").agg(n_rows().alias("rows"))
        rows = weights.join(again, "id").join(bound, "id", "left").withColumn("least", F.when(F.col("n") >= k, F.col("least")).otherwise(0.0)).withColumn("again", (F.col("rows") > 1).cast("double")).drop("n", "rows")
        edges = top_n(_most_similar(materialize(rows), base, k), ["src"], [F.col("similarity").desc(), F.col("dst")], k)
    return weights.select(F.col("id").alias(id_col), "weight_a", (1 - F.col("weight_a")).alias("weight_b")), edges


def _distinct_lists(vectors: DataFrame, k: int) -> DataFrame:
    """(src, dst, dist): the k nearest cells of each cell (id, v), each once; a cell whose row is repeated lists itself."""
    rows = materialize(vectors.where("id is not null and v is not null").groupBy("id", "v").agg(n_rows().alias("n")))
    near = materialize(nearest_in_embedding(rows, [], k, "id", "v").select("src", "dst", "dist"))
    again = rows.where("n > 1").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    if again.isEmpty():
        return near
    return materialize(top_n(near.unionByName(again).distinct(), ["src"], [F.col("dist"), F.col("dst")], k).drop("rank"))


def _most_similar(rows: DataFrame, cells: DataFrame, k: int, held_rows: int = 65_536) -> DataFrame:
    """(src, dst, similarity): for each of ``rows`` the k most similar of all ``cells`` (id, va, vb) with another id; ties go by id.

    ``rows`` (id, va, vb, sa, sb, na, nb, weight_a, least, again) name a similarity that k cells are known to reach; where ``again`` is
    not 0 the id is repeated and meets its own rows, too. A task holds some
    rows and at most k cells for each, and all cells stream past it, compared by matrix products: the work is all pairs, in
    memory that does not grow.
    """
    session, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    n = rows.count()
    groups = max(-(-n // held_rows), min(2 * session.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    own = ["sa", "sb", "na", "nb", "weight_a", "least", "again"]
    asked = rows.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp"), F.lit(0).alias("kind"), "id", "va", "vb", *own)
    past = cells.where("id is not null and va is not null and vb is not null").select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("kind"), "id", "va", "vb", *[F.lit(None).cast("double").alias(x) for x in own])
    met = spread(asked.unionByName(past), ["grp"]).sortWithinPartitions("grp", "kind")

    def names(ids: pa.Array) -> np.ndarray:
        return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=str)

    def dense(vs: pa.ListArray) -> np.ndarray:
        return vs.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vs), -1)

    def top(i: np.ndarray, s: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -s, i))
        order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
        return i[order], s[order], ids[order]

    class Held:
        """Rows of one group and the best cells so far."""

        def __init__(self, parts: list[pa.RecordBatch]):
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            self.ids = names(t.column("id"))
            self.v = {m: dense(t.column(f"v{m}")) for m in "ab"}
            col = {x: t.column(x).to_numpy(zero_copy_only=False) for x in own}
            self.first, self.reach = {m: col[f"n{m}"] for m in "ab"}, {m: np.maximum(col[f"s{m}"] - col[f"n{m}"], 1e-12) for m in "ab"}
            self.weight = {"a": col["weight_a"], "b": 1 - col["weight_a"]}
            self.again = col["again"] != 0
            self.least = col["least"] * (1 - 1e-9)
            self.best = np.zeros(0, np.int64), np.zeros(0), self.ids[:0]

        def meet(self, ids: np.ndarray, v: dict[str, np.ndarray]) -> None:
            mid = {m: v[m].mean(0) for m in "ab"}
            off = {m: v[m] - mid[m] for m in "ab"}
            square = {m: (off[m] * off[m]).sum(1) for m in "ab"}
            found = [self.best]
            for lo in range(0, len(self.ids), 256):
                part = slice(lo, lo + 256)
                upper = 0.0
                for m in "ab":
                    q = self.v[m][part] - mid[m]
                    qq = (q * q).sum(1)
                    # less than the distance by what rounding can add: no cell is left out that belongs in
                    slack = 8e-16 * (q.shape[1] + 8) * (qq + square[m].max())
                    d = np.sqrt(np.maximum(qq[:, None] - 2 * (q @ off[m].T) + square[m] - 2 * slack[:, None], 0.0))
                    upper = upper + self.weight[m][part, None] * np.exp(-np.maximum(0.0, d - self.first[m][part, None]) / self.reach[m][part, None])
                i, j = np.nonzero(upper * (1 + 1e-9) >= self.least[part, None])
                i = i + lo
                other = self.again[i] | (self.ids[i] != ids[j])
                i, j = i[other], j[other]
                s = np.zeros(len(i))
                for m in "ab":
                    d = np.sqrt(((v[m][j] - self.v[m][i]) ** 2).sum(1))
                    s += self.weight[m][i] * np.exp(-np.maximum(0.0, d - self.first[m][i]) / self.reach[m][i])
                found.append(top(i, s, ids[j]))
            i, s, ids = self.best = top(*map(np.concatenate, zip(*found)))
            full = np.flatnonzero(np.bincount(i, minlength=len(self.ids)) >= k)
            last = np.searchsorted(i, full, "right") - 1
            self.least[full] = np.maximum(self.least[full], s[last] * (1 - 1e-9))

        def rows(self, id_type: pa.DataType) -> pa.RecordBatch:
            i, s, ids = self.best
            return pa.RecordBatch.from_arrays([pa.array(self.ids[i], id_type), pa.array(ids, id_type), pa.array(s)], names=["src", "dst", "similarity"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None
        for batch in batches:
            grp, of = (batch.column(x).to_numpy() for x in ("grp", "kind"))
            cuts = np.flatnonzero(np.append(True, (np.diff(grp) != 0) | (np.diff(of) != 0))) if len(grp) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(grp)]):
                part, id_type = batch.slice(lo, hi - lo), batch.column("id").type
                if grp[lo] != now:
                    if held is not None:
                        yield held.rows(id_type)
                    now, waiting, held = grp[lo], [], None
                if of[lo] == 0:
                    waiting.append(part)
                    continue
                if held is None and waiting:
                    held, waiting = Held(waiting), []
                if held is not None:  # a group without rows asks for nothing
                    for at in range(0, part.num_rows, 4096):
                        some = part.slice(at, 4096)
                        held.meet(names(some.column("id")), {m: dense(some.column(f"v{m}")) for m in "ab"})
        if held is not None:
            yield held.rows(id_type)

    return met.mapInArrow(search, f"src {kind}, dst {kind}, similarity double")


# ---------------------------------------------------------------------------------------------- batch correction


def _tree_sum(df: DataFrame, fn, size: int, fan: int = 32) -> np.ndarray:
    """Sum of one fixed-size float array per task, added up by ``fan`` tasks before the driver adds the rest."""

    def partial(batches):
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += fn(pdf)
        yield pd.DataFrame({"b": [int(abs(hash(total.tobytes())) % fan)], "m": [total.tobytes()]})

    def add(pdf):
        return pd.DataFrame({"m": [sum(np.frombuffer(m) for m in pdf["m"]).tobytes()]})

    rows = df.mapInPandas(partial, "b int, m binary").groupBy("b").applyInPandas(add, "m binary").collect()
    return sum((np.frombuffer(bytes(r["m"])) for r in rows), np.zeros(size))


def corrected_for_batch(df: DataFrame, id_col: str, vec: str, batch: str, n_clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 10, inner: int = 8, damping: float = 0.25, tol: float = 1e-4, inner_tol: float = 1e-3, out: str = "corrected", seed: int = 42) -> DataFrame:
    """Soft-cluster cells so that batches mix within clusters, then remove each cluster's batch offset (Harmony).

    Tasks see batches of cells and the small cluster state; only cluster x batch x component sums are added up. The objective of
    the published method (distance to the centres, entropy of the memberships, and their divergence from even batches) is added up
    in the same passes. The clusters of a round are at rest when it changes by less than ``inner_tol`` of itself, the rounds end
    when a round improves it by less than ``tol``; column ``converged`` is false if ``rounds`` came first.
    """
    batches = [r[0] for r in df.select(batch).distinct().orderBy(batch).limit(10_001).collect()]
    if len(batches) > 10_000:
        raise ValueError("more than 10000 batches")
    at = {b: i for i, b in enumerate(batches)}
    base = materialize(df.select(c(id_col).alias("id"), c(batch).alias("batch"), c(vec).cast("array<double>").alias("z")).withColumn("zc", F.col("z")))
    n, d = base.count(), len(base.first()["z"])
    k = n_clusters or max(2, min(100, n // 30))
    unit = F.transform("z", lambda v: v / F.sqrt(F.aggregate("z", F.lit(1e-12), lambda s, w: s + w * w)))
    km = KMeans(k=k, seed=seed, maxIter=10, featuresCol="f").fit(base.select(array_to_vector(unit).alias("f")))
    centres = np.array(km.clusterCenters())
    k = len(centres)
    nb = len(batches)

    def normed(m):
        return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)

    def members(pdf, state):
        zc, b = _rows(pdf["zc"]), pdf["batch"].map(at).to_numpy()
        far = 2 * (1 - normed(zc) @ normed(state["y"]).T)
        r = np.exp(-far / sigma) * state["penalty"][:, b].T
        return r / (r.sum(1, keepdims=True) + 1e-300), b, far

    size = k * nb * (2 * d + 1) + 1

    def sums(state):
        def fn(pdf):
            r, b, far = members(pdf, state)
            zn, z = normed(_rows(pdf["zc"])), _rows(pdf["z"])
            o, sc, sz = np.zeros((k, nb)), np.zeros((k, nb, d)), np.zeros((k, nb, d))
            for j in np.unique(b):
                m = b == j
                o[:, j], sc[:, j], sz[:, j] = r[m].sum(0), r[m].T @ zn[m], r[m].T @ z[m]
            cost = (r * far).sum() + sigma * (r * np.log(r + 1e-300)).sum()
            return np.concatenate([o.ravel(), sc.ravel(), sz.ravel(), [cost]])

        flat = _tree_sum(base, fn, size)
        o = flat[: k * nb].reshape(k, nb)
        even = o.sum(1, keepdims=True) * (o.sum(0, keepdims=True) / o.sum())
        goal = flat[-1] + sigma * theta * (o * np.log((o + 1) / (even + 1))).sum()
        return o, flat[k * nb : k * nb * (1 + d)].reshape(k, nb, d), flat[k * nb * (1 + d) : -1].reshape(k, nb, d), float(goal)

    state = {"y": centres, "penalty": np.ones((k, nb))}
    last, mixed, converged = None, None, False
    for _ in range(rounds):
        before = None
        for _ in range(inner):
            o, sc, sz, goal = sums(state)
            if before is not None and abs(before - goal) <= inner_tol * abs(before):
                break
            before = goal
            # all cells move at once: the running mean keeps the batches from trading places
            mixed = o if mixed is None else (1 - damping) * mixed + damping * o
            expected = mixed.sum(1, keepdims=True) * (mixed.sum(0, keepdims=True) / mixed.sum())
            state = {"y": normed(sc.sum(1)), "penalty": ((expected + 1) / (mixed + 1)) ** theta}
        else:
            o, sc, sz, goal = sums(state)
        if last is not None and last - goal < tol * abs(last):
            converged = True
            break
        last = goal
        shift = np.zeros((k, nb, d))
        for j in range(k):  # ridge regression on intercept and batch indicators, weighted by membership
            g = np.zeros((nb + 1, nb + 1))
            g[0, 0] = o[j].sum()
            g[0, 1:] = g[1:, 0] = o[j]
            g[1:, 1:] = np.diag(o[j] + ridge)
            shift[j] = np.linalg.solve(g + 1e-12 * np.eye(nb + 1), np.vstack([sz[j].sum(0), sz[j]]))[1:]

        def apply(parts, state=state, shift=shift):
            for pdf in parts:
                if len(pdf):
                    r, b, _ = members(pdf, state)
                    z = _rows(pdf["z"]) - np.einsum("ik,ikd->id", r, shift[:, b].transpose(1, 0, 2))
                    pdf = pdf.assign(zc=list(z))
                yield pdf

        base = materialize(base.mapInPandas(apply, base.schema))
    return df.join(base.select(F.col("id").alias(id_col), F.col("zc").alias(out), F.lit(converged).alias("converged")), id_col)


# ---------------------------------------------------------------------------------------------- mixing measures


def lisi(edges: DataFrame, cells: DataFrame, batch: str, id_col: str = "cell_id") -> DataFrame:
    """Inverse Simpson index of the batch labels among a cell's neighbours."""
    tag = cells.select(c(id_col).alias("dst"), c(batch).alias("b"))
    n = edges.select("src", "dst").join(tag, "dst").groupBy("src", "b").agg(n_rows().alias("n"))
    total, sq = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return n.groupBy(F.col("src").alias(id_col)).agg((total * total / sq).cast("double").alias("lisi"))


def silhouette(df: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """Silhouette of every row by squared Euclidean distance; a label of one row gives 0.

    The mean squared distance to a label's rows needs only their number, mean and mean squared norm, so one aggregation
    serves all rows and no pairs are formed.
    """
    rows = df.select(c(id_col).alias("id"), c(vec).cast("array<double>").alias("v"), c(label).cast("string").alias("l")).where("v is not null and l is not null")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = rows.groupBy("l").agg(n_rows().cast("double").alias("n"), vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"), F.avg(norm).alias("q"))
    packed = stats.agg(F.collect_list(F.struct("l", "n", "m", "q")).alias("ls")).withColumn("__all", F.lit(0))
    held = attach(rows.withColumn("__all", F.lit(0)), packed, ["__all"]).withColumn("w", norm)
    dot = lambda m: F.aggregate(F.zip_with(m, "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    far = F.transform("ls", lambda e: F.struct(e["l"].alias("l"), e["n"].alias("n"), F.greatest(F.lit(0.0), F.col("w") - 2 * dot(e["m"]) + e["q"]).alias("d")))
    t = held.withColumn("far", far).select(
        "id", "l", F.filter("far", lambda e: e["l"] == F.col("l"))[0].alias("own"), F.array_min(F.transform(F.filter("far", lambda e: e["l"] != F.col("l")), lambda e: e["d"])).alias("b"))
    a = F.col("own.d") * F.col("own.n") / (F.col("own.n") - 1)
    score = F.when(F.col("own.n") <= 1, 0.0).otherwise((F.col("b") - a) / F.greatest(a, F.col("b"), F.lit(1e-300)))
    return t.select(F.col("id").alias(id_col), F.col("l").alias(label), score.alias("silhouette"))


def batch_report(lisi_rows: DataFrame, sil_rows: DataFrame, min_lisi: float = 3.0, max_sil: float = 0.3) -> DataFrame:
    """Mean LISI, mean silhouette and whether both pass."""
    a = lisi_rows.agg(F.avg("lisi").alias("mean_lisi")).withColumn("__all", F.lit(0))
    b = sil_rows.agg(F.avg("silhouette").alias("mean_silhouette")).withColumn("__all", F.lit(0))
    return a.join(b, "__all").drop("__all").withColumn("passes", (F.col("mean_lisi") >= min_lisi) & (F.col("mean_silhouette") < max_sil))


# ------------------------------------------------------------------------------------------------- gene selection


def variable_genes(values: DataFrame, n_cells: DataFrame, n: int = 200, n_bins: int = 20, value: str = "lognorm") -> DataFrame:
    """Genes by dispersion normalised within bins of mean expression; zeros count in mean and variance.

    The window spans the gene panel only.
    """
    x = F.expm1(c(value))
    s = values.groupBy("gene").agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss")).withColumn("__all", F.lit(0))
    m = attach(s, n_cells.withColumn("__all", F.lit(0)), ["__all"]).drop("__all")
    nn = F.col("n_cells")
    m = m.withColumn("mean", F.col("s") / nn).withColumn("var", (F.col("ss") - F.col("s") * F.col("s") / nn) / (nn - 1))
    m = m.withColumn("dispersion", F.when((F.col("mean") > 0) & (F.col("var") > 0), F.log(F.col("var") / F.col("mean"))))
    lim = with_group_stats(m.withColumn("lm", F.log1p("mean")), [], [F.min("lm").alias("lo"), F.max("lm").alias("hi")])
    bin_ = F.least(F.floor((F.col("lm") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins), F.lit(n_bins - 1).cast("long"))
    b = lim.withColumn("bin", bin_)
    w = Window.partitionBy("bin")
    sd, mu = F.stddev_samp("dispersion").over(w), F.avg("dispersion").over(w)
    norm = F.when(sd > 0, (F.col("dispersion") - mu) / sd).otherwise(F.lit(1.0))
    ranked = b.withColumn("dispersion_norm", norm).select("gene", "mean", "dispersion", "bin", "dispersion_norm")
    order = Window.orderBy(F.col("dispersion_norm").desc_nulls_last(), "gene")
    return ranked.withColumn("highly_variable", F.row_number().over(order) <= n)


def kmeans_labels(df: DataFrame, vec: str, k: int = 12, seed: int = 42, out: str = "cluster") -> DataFrame:
    """K-means on standardised arrays."""
    data = df.withColumn("__v", array_to_vector(c(vec)))
    z = StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True).fit(data).transform(data)
    return KMeans(k=k, seed=seed, featuresCol="__z", predictionCol=out).fit(z).transform(z).drop("__v", "__z")


def mutual_information(values: DataFrame, cells: DataFrame, label: str, n_bins: int = 10, id_col: str = "cell_id", value: str = "lognorm") -> DataFrame:
    """Mutual information (nats) of binned expression and a label, per gene; stored rows are binned, zeros counted."""
    sizes = cells.groupBy(c(label).alias("l")).agg(n_rows().alias("nl"))
    hi = values.groupBy("gene").agg(F.max(c(value)).alias("hi"))
    tagged = values.where(c(value) > 0).select(c(id_col), "gene", c(value).alias("v")).join(cells.select(c(id_col), c(label).alias("l")), id_col)
    bin_ = F.least(F.floor(F.col("v") / F.col("hi") * n_bins), F.lit(n_bins - 1).cast("long"))
    stored = attach(tagged, hi, ["gene"]).withColumn("bin", bin_).groupBy("gene", "l", "bin").agg(n_rows().alias("m"))
    genes = stored.select("gene").distinct().withColumn("__all", F.lit(0))
    grid = genes.join(sizes.withColumn("__all", F.lit(0)), "__all").drop("__all")
    zero = grid.join(stored.groupBy("gene", "l").agg(F.sum("m").alias("nz")), ["gene", "l"], "left").select(
        "gene", "l", F.lit(0).cast("long").alias("bin"), (F.col("nl") - F.coalesce("nz", F.lit(0))).alias("m"))
    joint = stored.unionByName(zero).groupBy("gene", "l", "bin").agg(F.sum("m").alias("m")).where("m > 0")
    by_gene, by_bin, by_label = Window.partitionBy("gene"), Window.partitionBy("gene", "bin"), Window.partitionBy("gene", "l")
    p = F.col("m") / F.sum("m").over(by_gene)
    term = p * F.log(F.col("m") * F.sum("m").over(by_gene) / (F.sum("m").over(by_bin) * F.sum("m").over(by_label)))
    return joint.withColumn("t", term).groupBy("gene").agg(F.sum("t").alias("mutual_information"))


def mutual_information_units(units: DataFrame, label: str, k: int = 2, value: str = "value") -> DataFrame:
    """Nearest-neighbour estimate of the information between a value and a label, per gene, over sample-level rows.

    One array of values per gene and label; its length is the number of samples.
    """
    per = units.groupBy("gene", c(label).alias("l")).agg(F.sort_array(F.collect_list(c(value))).alias("vs"))
    full = units.groupBy("gene").agg(F.sort_array(F.collect_list(c(value))).alias("every"))
    j = per.where(F.size("vs") > 1).join(full, "gene").withColumn("kk", F.least(F.lit(k), F.size("vs") - 1)).select("*", F.explode("vs").alias("v"))
    d = F.expr("element_at(sort_array(transform(vs, u -> abs(u - v))), kk + 1)")
    j = j.withColumn("d", d).withColumn("near", F.expr("size(filter(every, u -> abs(u - v) < d or (d = 0 and u = v)))"))
    psi = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.lit(-0.5772156649015329), lambda s, i: s + F.when(i < n, 1.0 / i).otherwise(0.0))
    kept = n_rows()
    s = j.groupBy("gene").agg(
        kept.cast("int").alias("n"), F.avg(psi(F.col("kk"))).alias("pk"), F.avg(psi(F.size("vs"))).alias("pn"), F.avg(psi(F.greatest(F.col("near"), F.lit(1)))).alias("pm"))
    return s.select("gene", F.greatest(F.lit(0.0), psi(F.col("n")) + F.col("pk") - F.col("pn") - F.col("pm")).alias("mutual_information"))
