"""Work on cell positions and on neighbour edges ``(keys, src, dst, dist)``."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.functions import dist as tails
from cellweave.operators.aggregates import grid_bins, grid_means, n_rows
from cellweave.operators.neighbors import PairsWithin
from cellweave.operators.permutations import matrix, moved_codes, numbered_groups, pair_counts, pair_counts_within, permuted_codes, with_group
from cellweave.operators.statistics import guarded_correlation, with_correlation_p
from cellweave.scale import attach, c, materialize, row_numbers, sized, spread, with_group_stats


def _cols(names: Sequence[str]) -> list[Column]:
    return [c(n) for n in names]


def edge_counts(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges and mean distance per group."""
    return edges.groupBy(*_cols(keys)).agg(n_rows().alias("n_edges"), F.avg("dist").alias("mean_dist"))


# --------------------------------------------------------------------------------- label permutations, enrichment


def neighbourhood_enrichment(edges: DataFrame | PairsWithin, cells: DataFrame, keys: Sequence[str], label: str, n_perm: int = 100, seed: int = 42, min_cells: int = 0, id_col: str = "cell_id") -> DataFrame:
    """Observed label pairs on edges against label permutations: (keys, a, b, observed, expected, std, z).

    The permuted labels travel as one short binary per cell, so the edges are joined once, and pairs are counted inside the
    tasks: what is shuffled is permutations x pairs. Pairs within a distance need not be edges yet. Labels with at most ``min_cells`` cells of a group are left out of its pairs.
    """
    keys = list(keys)
    permuted = permuted_codes(cells, keys, id_col, label, n_perm, seed)
    counts = pair_counts_within(edges, permuted) if isinstance(edges, PairsWithin) else pair_counts(edges, permuted, keys)
    real = F.col("perm") == 0
    s = counts.groupBy("g", "a", "b").agg(
        F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0.0)).alias("observed"),
        (F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0.0)) / n_perm).alias("expected"),
        (F.coalesce(F.sum(F.when(~real, F.col("n") * F.col("n"))), F.lit(0.0)) / n_perm).alias("__sq"),
    )
    s = s.join(sized(permuted.groups), "g").select(*_cols(keys), permuted.label(F.col("a")).alias("a"), permuted.label(F.col("b")).alias("b"), "observed", "expected", "__sq")
    if min_cells:
        big = cells.groupBy(*_cols(keys), c(label).alias("a")).agg(n_rows().alias("m")).where(F.col("m") > min_cells).drop("m")
        for side in ("a", "b"):
            s = attach(s, big.withColumnRenamed("a", side), [*keys, side], "left_semi")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("__sq") - F.col("expected") * F.col("expected")))
    return s.withColumn("std", spread).drop("__sq").withColumn("z", (F.col("observed") - F.col("expected")) / (F.col("std") + 1e-10))


def mean_enrichment(z: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean z of a label pair over the samples (of a group) that have it."""
    return z.groupBy(*_cols(groups), "a", "b").agg(F.avg("z").alias("mean_z"), n_rows().alias("n_samples"))


def notable_pairs(z: DataFrame, cut: float = 2.0) -> DataFrame:
    """Pairs beyond the cut, tagged and sorted by strength."""
    kind = F.when(F.col("z") > 0, "enriched").otherwise("depleted")
    return z.where(F.abs("z") > cut).withColumn("interaction", kind).orderBy(F.abs(F.col("z")).desc(), "a", "b")


# ------------------------------------------------------------------------------------------- per-cell surroundings


def neighbourhood_consistency(edges: DataFrame, cells: DataFrame, keys: Sequence[str], label: str, id_col: str = "cell_id") -> DataFrame:
    """Share of a cell's neighbours with its own label."""
    tag = lambda side: cells.select(*_cols(keys), c(id_col).alias(side), c(label).alias(f"l_{side}"))
    j = edges.join(tag("src"), [*keys, "src"]).join(tag("dst"), [*keys, "dst"])
    same = F.avg((F.col("l_src") == F.col("l_dst")).cast("double"))
    return j.groupBy(*_cols(keys), F.col("src").alias(id_col)).agg(same.alias("neighborhood_consistency"))


def nearest_distance_stats(nearest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population spread of the distance to the nearest neighbour (rank 1 edges)."""
    return nearest.where("rank = 1").groupBy(*_cols(keys)).agg(F.avg("dist").alias("mean_nn_distance"), F.stddev_pop("dist").alias("std_nn_distance"))


def smoothed(edges: DataFrame, values: DataFrame, keys: Sequence[str], feature: str, value: str, id_col: str = "cell_id") -> DataFrame:
    """Inverse-distance weighted mean of a feature over a cell and its neighbours; absent values are zeros."""
    keys = list(keys)
    ends = edges.select(*_cols(keys), "src", "dst", "dist")
    v = values.select(*_cols(keys), c(id_col).alias("id"), c(feature).alias("f"), c(value).alias("v"))
    packed = materialize(packed_values(v, keys, "f"))
    own = packed.select(*_cols(keys), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    far = packed.select(*_cols(keys), F.col("id").alias("dst"), F.arrays_zip("fs", "vs").alias("e"))
    # the lists move twice, with the edge's ends; from there on everything of a cell is in one place
    met = spread(ends.unionByName(own).join(far, [*keys, "dst"], "left").select(*_cols(keys), "src", (1.0 / (F.col("dist") + 1e-6)).alias("w"), "e"), [*keys, "src"])
    whole = F.struct(F.lit(True).alias("whole"), F.lit(None).cast(v.schema["f"].dataType).alias("f"), F.lit(1.0).alias("v"))
    each = F.transform("e", lambda x: F.struct(F.lit(False).alias("whole"), x["fs"].alias("f"), x["vs"].cast("double").alias("v")))
    flat = met.select(*_cols(keys), "src", "w", F.explode(F.concat(F.array(whole), F.coalesce(each, F.array()))).alias("z"))
    s = flat.groupBy(*_cols(keys), "src", "z.whole", F.col("z.f").alias(feature)).agg(F.sum(F.col("w") * F.col("z.v")).alias("__s"))
    total = F.max(F.when(F.col("whole"), F.col("__s"))).over(Window.partitionBy(*_cols(keys), F.col("src")))  # the features around one cell
    return s.withColumn("tw", total).where("not whole").select(*_cols(keys), F.col("src").alias(id_col), c(feature), (F.col("__s") / F.col("tw")).alias(value))


def cells_of(values: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    return values.select(*_cols(keys), c(id_col).alias("id")).distinct()


# ---------------------------------------------------------------------------------------------------- convex hull


def _hull(xy: np.ndarray) -> np.ndarray:
    """Hull vertices, counter-clockwise from the lowest x (monotone chain)."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows):
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(pts), chain(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


def hull_edges(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Edges (x1, y1, x2, y2) of each group's convex hull, in order.

    Every task reduces its rows to one hull per group while it streams them; only those hull points are grouped.
    """
    keys = list(keys)
    p = points.select(*_cols(keys), c(x).cast("double").alias("x"), c(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    schema = p.schema

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            for g, part in pdf.groupby(keys, sort=False):
                xy = part[["x", "y"]].to_numpy()
                held[g] = _hull(xy if g not in held else np.vstack([held[g], xy]))
        for g, xy in held.items():
            out = pd.DataFrame({n: v for n, v in zip(keys, g)}, index=range(len(xy)))
            out["x"], out["y"] = xy[:, 0], xy[:, 1]
            yield out

    def final(g, pdf):
        h = _hull(pdf[["x", "y"]].to_numpy())
        nxt = np.roll(h, -1, axis=0)
        out = pd.DataFrame({n: v for n, v in zip(keys, g)}, index=range(len(h)))
        out["edge"], out["x1"], out["y1"], out["x2"], out["y2"] = range(len(h)), h[:, 0], h[:, 1], nxt[:, 0], nxt[:, 1]
        return out

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in keys)
    return p.mapInPandas(partial, schema).groupBy(*_cols(keys)).applyInPandas(final, f"{types}, edge int, x1 double, y1 double, x2 double, y2 double")


def boundary_distance(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Rows with their smallest distance to the lines through the hull's edges; infinite where the points span no area."""
    e = F.array_sort(F.collect_list(F.struct("edge", "x1", "y1", "x2", "y2")))
    hull = hull_edges(points, keys, x, y).groupBy(*_cols(keys)).agg(e.alias("__hull"))
    d = (
        f"abs((e.y2 - e.y1) * `{x}` - (e.x2 - e.x1) * `{y}` + e.x2 * e.y1 - e.y2 * e.x1)"
        " / (sqrt(pow(e.y2 - e.y1, 2) + pow(e.x2 - e.x1, 2)) + 1e-10D)"
    )
    near = F.when(F.size("__hull") >= 3, F.expr(f"array_min(transform(__hull, e -> {d}))")).otherwise(float("inf"))
    return attach(points, hull, keys).withColumn("boundary_distance", near).drop("__hull")


def hull_faults(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Per group: points outside the hull's edges, and hull corners that are no points. Both are 0 for a right hull."""
    keys = list(keys)
    edges = materialize(hull_edges(points, keys, x, y))
    packed = edges.groupBy(*_cols(keys)).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("__hull"))
    left = f"(e.x2 - e.x1) * (`{y}` - e.y1) - (e.y2 - e.y1) * (`{x}` - e.x1)"
    size = "abs(e.x2 - e.x1) + abs(e.y2 - e.y1) + 1"
    outside = F.expr(f"exists(__hull, e -> {left} < -1e-9 * ({size}))")
    far = attach(points, packed, keys).groupBy(*_cols(keys)).agg(F.count_if(outside).alias("n_outside"))
    corners = edges.join(points.select(*_cols(keys), c(x).cast("double").alias("x1"), c(y).cast("double").alias("y1")), [*keys, "x1", "y1"], "left_anti")
    foreign = corners.groupBy(*_cols(keys)).agg(n_rows().alias("n_foreign"))
    return far.join(foreign, keys, "left").na.fill(0, ["n_foreign"])


def tissue_shape(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Hull area, perimeter and row density per group."""
    area = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2
    around = F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)))
    h = hull_edges(points, keys, x, y).groupBy(*_cols(keys)).agg(area.alias("tissue_area"), around.alias("tissue_perimeter"))
    n = points.groupBy(*_cols(keys)).agg(n_rows().alias("n_cells"))
    return n.join(h, list(keys)).withColumn("spot_density", F.when(F.col("tissue_area") > 0, F.col("n_cells") / F.col("tissue_area")))


# -------------------------------------------------------------------------------------------- autocorrelation


def edge_weights(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-normalised weights: 1 / out-degree. The edges are stored first, since they are read twice."""
    edges = materialize(edges.select(*_cols(keys), "src", "dst"))
    deg = edges.groupBy(*_cols(keys), "src").agg(n_rows().alias("__deg"))
    return edges.join(deg, [*keys, "src"]).select(*_cols(keys), "src", "dst", (1.0 / F.col("__deg")).alias("w"))


def _graph_sums(w: DataFrame, margins: DataFrame, n: DataFrame, keys: Sequence[str]) -> DataFrame:
    """s0, s1, s2 of a weight matrix and the group's number of cells."""
    back = w.select(*_cols(keys), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w2"))
    s01 = w.join(back, [*keys, "src", "dst"], "left").groupBy(*_cols(keys)).agg(
        F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("w") + F.col("w") * F.coalesce("w2", F.lit(0.0))).alias("s1")
    )
    s2 = margins.groupBy(*_cols(keys)).agg(F.sum(F.pow(F.col("r") + F.col("k"), 2)).alias("s2"))
    return s01.join(s2, list(keys)).join(n, list(keys))


def _margins(w: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row and column sums of the weights per cell."""
    rows = w.select(*_cols(keys), F.col("src").alias("id"), F.col("w").alias("r"), F.lit(0.0).alias("k"))
    cols = w.select(*_cols(keys), F.col("dst").alias("id"), F.lit(0.0).alias("r"), F.col("w").alias("k"))
    return rows.unionByName(cols).groupBy(*_cols(keys), "id").agg(F.sum("r").alias("r"), F.sum("k").alias("k"))


def packed_values(values: DataFrame, keys: Sequence[str], feature: str) -> DataFrame:
    """(keys, id, fs, vs): the features of a cell in order, and their values; a list is bounded by the features of one cell."""
    e = F.array_sort(F.collect_list(F.struct(c(feature).alias("f"), "v")))
    return values.groupBy(*_cols(keys), "id").agg(e.alias("e")).select(*_cols(keys), "id", F.col("e.f").alias("fs"), F.col("e.v").alias("vs"))


def _cross_products(w: DataFrame, packed: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(keys, extra, gene, xx): sums over the edges (keys, extra, src, dst, w) of w times the values of a gene at both ends.

    An edge meets the packed lists of its ends and is never multiplied by its genes: the lists are merged and added up inside the task.
    """
    kinds = {f.name: f.dataType for f in w.schema}
    ends = packed.select(*_cols(keys), F.col("id").alias("src"), F.col("fs").alias("fa"), F.col("vs").alias("va"))
    far = packed.select(*_cols(keys), F.col("id").alias("dst"), F.col("fs").alias("fb"), F.col("vs").alias("vb"))
    j = w.join(ends, [*keys, "src"]).join(far, [*keys, "dst"]).where(F.arrays_overlap("fa", "fb"))
    both = [*keys, *extra]
    group = F.struct(*_cols(both)).alias("g") if both else F.lit(0).alias("g")
    met = j.select(group, "w", "fa", "va", "fb", "vb")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            side = {}
            genes = pc.dictionary_encode(pa.concat_arrays([batch.column("fa").flatten(), batch.column("fb").flatten()]))
            code, names, n = genes.indices.to_numpy(), genes.dictionary, len(genes.dictionary)
            m = len(batch.column("fa").flatten())
            for end, part in (("a", code[:m]), ("b", code[m:])):
                length = batch.column(f"f{end}").value_lengths().to_numpy(zero_copy_only=False)
                side[end] = np.repeat(np.arange(batch.num_rows, dtype=np.int64), length) * n + part, batch.column(f"v{end}").flatten().to_numpy(zero_copy_only=False)
            (ka, va), (kb, vb) = side["a"], side["b"]
            order = np.argsort(kb, kind="stable")
            kb, vb = kb[order], vb[order]
            # a feature may stand more than once in a list: every pair counts
            many = np.searchsorted(kb, ka, "right") - (first := np.searchsorted(kb, ka, "left"))
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            row, gene = np.divmod(np.repeat(ka, many), n)
            x = batch.column("w").to_numpy(zero_copy_only=False)[row] * np.repeat(va, many) * vb[at]
            groups = pc.dictionary_encode(_row_names(batch.column("g")))
            unit = groups.indices.to_numpy()[row].astype(np.int64) * n + gene
            found, back = np.unique(unit, return_inverse=True)
            one = np.zeros(len(groups.dictionary), np.int64)
            one[groups.indices.to_numpy()[::-1]] = np.arange(batch.num_rows)[::-1]
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(one[found // n])), names.take(pa.array(found % n)), pa.array(np.bincount(back, x, len(found)))], names=["g", "gene", "xx"])

    types = ", ".join(f"`{k}`: {kinds[k].simpleString()}" for k in both)
    gene_type = packed.schema["fs"].dataType.elementType.simpleString()
    sums = met.mapInArrow(add, f"g struct<{types}>, gene {gene_type}, xx double" if both else f"g int, gene {gene_type}, xx double")
    return sums.select(*[F.col("g")[k].alias(k) for k in both], "gene", "xx").groupBy(*_cols(both), "gene").agg(F.sum("xx").alias("xx"))


def _row_names(group: pa.Array) -> pa.Array:
    """One text for each row of a struct of keys, the same for the same keys."""
    if not pa.types.is_struct(group.type):
        return group
    return pc.binary_join_element_wise(*[pc.cast(f, pa.string()) for f in group.flatten()], "\x1f", null_handling="replace", null_replacement="\x00")


def _statistic(xx: DataFrame, margins: DataFrame, values: DataFrame, stats: DataFrame, keys: Sequence[str], extra: Sequence[str], mode: str) -> DataFrame:
    """Moran's I or Geary's C per (keys, extra, gene) from non-zero values; ``extra`` are keys of the sums such as perm."""
    both = [*keys, *extra]
    m = margins.join(values, [*keys, "id"]).groupBy(*_cols(both), "gene").agg(
        F.sum(F.col("v") * (F.col("r") + F.col("k"))).alias("xm"), F.sum(F.col("v") * F.col("v") * (F.col("r") + F.col("k"))).alias("x2m")
    )
    return _from_sums(m, xx, stats, keys, extra, mode)


def _from_sums(m: DataFrame, xx: DataFrame, stats: DataFrame, keys: Sequence[str], extra: Sequence[str], mode: str) -> DataFrame:
    both = [*keys, *extra]
    j = m.join(xx, [*both, "gene"], "left").join(stats, [*keys, "gene"]).withColumn("xx", F.coalesce("xx", F.lit(0.0)))
    mean, ss = F.col("s") / F.col("n"), F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    if mode == "moran":
        top = F.col("xx") - mean * F.col("xm") + mean * mean * F.col("s0")
        stat = F.col("n") / F.col("s0") * top / ss
    else:
        stat = (F.col("n") - 1) / (2 * F.col("s0")) * (F.col("x2m") - 2 * F.col("xx")) / ss
    return j.select(*_cols(both), "gene", "n", "s0", "s1", "s2", F.when(ss > 0, stat).alias("stat"))


def autocorrelation(edges: DataFrame, cells: DataFrame, values: DataFrame, keys: Sequence[str], mode: str = "moran", n_perm: int = 0, seed: int = 42, id_col: str = "cell_id", value: str = "count") -> DataFrame:
    """Moran's I or Geary's C per group and gene with its variance and z under normality.

    ``values`` holds non-zero rows (keys, id, gene, value); zeros enter through the sums. With ``n_perm`` also the
    share of permutations at least as extreme.
    """
    keys = list(keys)
    w = materialize(edge_weights(edges, keys))
    v = values.select(*_cols(keys), c(id_col).alias("id"), "gene", c(value).cast("double").alias("v")).where("v <> 0")
    packed = materialize(packed_values(v.where("gene is not null and v is not null").withColumnRenamed("gene", "f"), keys, "f"))
    v = packed.select(*_cols(keys), "id", F.explode(F.arrays_zip("fs", "vs")).alias("z")).select(*_cols(keys), "id", F.col("z.fs").alias("gene"), F.col("z.vs").alias("v"))
    n = cells.groupBy(*_cols(keys)).agg(n_rows().cast("double").alias("n"))
    sums = v.groupBy(*_cols(keys), "gene").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    margins = materialize(_margins(w, keys))
    stats = materialize(attach(sums, _graph_sums(w, margins, n, keys), keys))
    out = _statistic(_cross_products(w, packed, keys), margins, v, stats, keys, [], mode)
    nn, s0, s1, s2 = F.col("n"), F.col("s0"), F.col("s1"), F.col("s2")
    if mode == "moran":
        mu = -1 / (nn - 1)
        var = (nn * nn * s1 - nn * s2 + 3 * s0 * s0) / ((nn - 1) * (nn + 1) * s0 * s0) - 1 / ((nn - 1) * (nn - 1))
    else:
        mu = F.lit(1.0)
        var = ((2 * s1 + s2) * (nn - 1) - 4 * s0 * s0) / (2 * (nn + 1) * s0 * s0)
    out = out.withColumn("var_norm", var).withColumn("z_norm", (F.col("stat") - mu) / F.sqrt("var_norm")).drop("s0", "s1", "s2", "n")
    if not n_perm:
        return out
    moved = materialize(_permuted_sums(w, cells, packed, keys, id_col, n_perm, seed))
    sim = _from_sums(moved.drop("xx"), moved.select(*_cols(keys), "perm", "gene", "xx"), stats, keys, ["perm"], mode).select(*_cols(keys), "perm", "gene", F.col("stat").alias("sim"))
    extreme = F.round("sim", 12) >= F.round("stat", 12)  # a tie counts, whatever the order of its sums
    larger = sim.join(out.select(*_cols(keys), "gene", "stat"), [*keys, "gene"]).groupBy(*_cols(keys), "gene").agg(F.count_if(extreme).alias("__g"))
    low = F.least(F.col("__g"), n_perm - F.col("__g"))
    return out.join(larger, [*keys, "gene"], "left").withColumn("p_sim", (F.coalesce(low, F.lit(0)) + 1) / (n_perm + 1)).drop("__g")


BLOCK = 4096  # cells
CHUNK = 10  # permutations


def _blocks(cells: DataFrame, base: DataFrame, groups: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """(g, id, node, copies, block): a number for each id of the stored ``base`` (g, id, rn), its rows, and a block of ``BLOCK`` rows that lie near each other if the cells have positions."""
    if not {"x", "y"} <= set(cells.columns):
        cut = base.withColumn("zr", F.col("rn"))
    else:
        own = with_group(cells.select(*_cols(keys), c(id_col).alias("id"), *[F.coalesce(F.nanvl(c(v).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(v) for v in "xy"]), groups, keys)
        box = own.groupBy("g").agg(*[f(v).alias(f"{v}{i}") for v in "xy" for i, f in enumerate((F.min, F.max))])
        step = lambda v: F.least(F.lit(4095), F.coalesce(F.floor((F.col(v) - F.col(f"{v}0")) / F.nullif(F.col(f"{v}1") - F.col(f"{v}0"), F.lit(0.0)) * 4096), F.lit(0))).cast("int")
        own = own.join(sized(box), "g").select("g", "id", step("x").alias("ix"), step("y").alias("iy"))
        bits = [F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), 2 * b + i) for b in range(12) for i, v in enumerate(("ix", "iy"))]
        cut = row_numbers(own.select("g", "id", reduce(lambda a, b: a + b, bits).alias("z")), ["g"], ["z", "id"], "zr")
    first = cut.groupBy("g", "id").agg(F.min(F.floor((F.col("zr") - 1) / BLOCK)).alias("block"))
    return materialize(base.groupBy("g", "id").agg(F.min("rn").alias("node"), n_rows().cast("double").alias("copies")).join(first, ["g", "id"]))


WHOLE_CELLS, WHOLE_ROWS = 1_000_000, 8_000_000  # of a group that one task holds: its cells, and its edges or values


def _permuted_sums(w: DataFrame, cells: DataFrame, packed: DataFrame, keys: Sequence[str], id_col: str, n_perm: int, seed: int, most: tuple[int, int] = (WHOLE_CELLS, WHOLE_ROWS)) -> DataFrame:
    """(keys, perm, gene, xm, x2m, xx): the sums of ``_statistic`` after every permutation of the cells' contents within their group.

    A group within the bounds ``most`` is sent whole, as packed arrays, to a task for some of the permutations: what is shuffled
    does not grow with their number. Larger groups go block by block.
    """
    groups = numbered_groups(cells, keys)
    own = with_group(cells.select(*_cols(keys), c(id_col).alias("id")), groups, keys).select("g", "id")
    links = with_group(w, groups, keys).select("g", "src", "dst", "w")
    lists = with_group(packed, groups, keys).select("g", "id", "fs", "vs")
    if own.schema["id"].dataType.simpleString() not in ("string", "bigint", "int"):
        return _permuted_by_blocks(w, cells, packed, groups, keys, id_col, n_perm, seed)
    sizes = own.select("g", F.lit(1).alias("n"), F.lit(0).alias("m"), F.lit(0).alias("v")).unionByName(links.select("g", F.lit(0).alias("n"), F.lit(1).alias("m"), F.lit(0).alias("v")))
    sizes = sizes.unionByName(lists.select("g", F.lit(0).alias("n"), F.lit(0).alias("m"), F.size("fs").alias("v"))).groupBy("g").agg(*[F.sum(x).alias(x) for x in ("n", "m", "v")])
    fits = (F.col("n") <= most[0]) & (F.greatest("m", "v") <= most[1])
    sizes = materialize(groups.join(sizes, "g").withColumn("whole", fits).drop("n", "m", "v"))
    whole, parts = sizes.where("whole").drop("whole"), []
    if n := whole.count():
        fit = sized(whole.select("g"))
        parts.append(_permuted_whole(own.join(fit, "g", "left_semi"), links.join(fit, "g", "left_semi"), lists.join(fit, "g", "left_semi"), whole, keys, n, n_perm, seed))
    if n == 0 or not sizes.where("not whole").isEmpty():
        parts.append(_permuted_by_blocks(w, cells, packed, materialize(sizes.where("not whole").drop("whole")), keys, id_col, n_perm, seed))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _permuted_whole(own: DataFrame, links: DataFrame, lists: DataFrame, groups: DataFrame, keys: Sequence[str], n_groups: int, n_perm: int, seed: int) -> DataFrame:
    """``_permuted_sums`` of groups that a task can hold: cells (g, id), edges (g, src, dst, w) and contents (g, id, fs, vs) travel packed."""
    id_type, gene_type = own.schema["id"].dataType.simpleString(), lists.schema["fs"].dataType.elementType.simpleString()
    fields = {"a": f"array<{id_type}>", "b": f"array<{id_type}>", "n": "array<int>", "names": f"array<{gene_type}>", "code": "array<int>", "v": "array<double>"}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of some batches as one row for each group, every column a list."""

        def packed_rows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.take(pc.sort_indices(rows.column("g"))).combine_chunks()
            g = rows.column("g").to_numpy()
            cuts = np.flatnonzero(np.append(True, np.diff(g) != 0))
            for lo, hi in zip(cuts, [*cuts[1:], len(g)]):
                part, one = rows.slice(lo, hi - lo), {}
                if "src" in part.column_names:
                    one = {"a": part["src"], "b": part["dst"], "v": part["w"]}
                elif "fs" in part.column_names:
                    genes = pc.dictionary_encode(pc.list_flatten(part["fs"]).combine_chunks())
                    one = {"a": part["id"], "n": pc.list_value_length(part["fs"]), "names": genes.dictionary, "code": genes.indices, "v": pc.list_flatten(part["vs"])}
                else:
                    one = {"a": part["id"]}
                columns = [pa.array([g[lo]], pa.int64())]
                for x, t in kinds.items():
                    values = one.get(x)
                    values = pa.array([], t) if values is None else (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).cast(t)
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
                yield pa.RecordBatch.from_arrays(columns, names=["g", *kinds])

        held, n = [], 0
        arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
        gene = arrow.get(gene_type, pa.string())
        kinds = {"a": arrow[id_type], "b": arrow[id_type], "n": pa.int32(), "names": gene, "code": pa.int32(), "v": pa.float64()}
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 16:
                yield from packed_rows(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from packed_rows(pa.Table.from_batches(held))

    def sums(table: pa.Table) -> pa.Table:
        chunk, kind = table["chunk"][0].as_py(), table["kind"].to_numpy()
        of = lambda k: table.filter(pa.array(kind == k))
        flat = lambda t, x: pc.list_flatten(t[x]).combine_chunks()
        ids = flat(of(0), "a")
        ids = ids.take(pc.sort_indices(ids, null_placement="at_start"))
        n = len(ids)
        texts = [v if v is None else str(v).encode() for v in ids.to_pylist()]
        # places of the id order; nodes are the ids, each with its places
        new = np.array([a is None or a != b for a, b in zip(texts[1:], texts)], bool)
        node_at = np.cumsum(np.append(0, new)) if n else np.zeros(0, int)
        first = np.flatnonzero(np.append(True, new)) if n else np.zeros(0, int)
        named, m = ids.take(pa.array(first)), len(first)
        copies = np.bincount(node_at, minlength=m).astype(float)

        def node(values: pa.Array) -> np.ndarray:
            at = pc.index_in(values, value_set=named).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            return np.where(values.is_valid().to_numpy(zero_copy_only=False), at, -1)

        edges = of(2)
        s, d, w_ = node(flat(edges, "a")), node(flat(edges, "b")), flat(edges, "v").to_numpy(zero_copy_only=False)
        there = (s >= 0) & (d >= 0)
        s, d, w_ = s[there], d[there], w_[there]
        margin = np.bincount(s, w_ * copies[d], m) + np.bincount(d, w_ * copies[s], m)
        linked = np.zeros(m, bool)
        linked[s] = linked[d] = True
        order = np.argsort(s, kind="stable")
        d, w_, degree = d[order].astype(np.int32), w_[order], np.bincount(s, minlength=m)
        start = np.cumsum(degree) - degree

        lists_ = of(1)
        genes = pc.dictionary_encode(flat(lists_, "names"))
        number = genes.indices.to_numpy(zero_copy_only=False)
        width = pc.list_value_length(lists_["names"]).to_numpy()
        many = pc.list_value_length(lists_["code"]).to_numpy()
        gene = number[np.repeat(np.cumsum(width) - width, many) + flat(lists_, "code").to_numpy(zero_copy_only=False)] if len(number) else np.zeros(0, int)
        holder = np.repeat(node(flat(lists_, "a")), flat(lists_, "n").to_numpy(zero_copy_only=False))
        v = flat(lists_, "v").to_numpy(zero_copy_only=False)
        keep = holder >= 0
        gene, holder, v = gene[keep], holder[keep], v[keep]
        # what a node holds is at each of its places
        again = copies[holder].astype(np.int64)
        place = np.repeat(first[holder] - (np.cumsum(again) - again), again) + np.arange(again.sum())
        gene, v = np.repeat(gene, again), np.repeat(v, again)
        order = np.argsort(gene, kind="stable")
        gene, place, v = gene[order], place[order], v[order]
        ends, total = np.searchsorted(gene, np.arange(len(genes.dictionary) + 1)), len(genes.dictionary)
        some = max(1, (1 << 19) // max(1, m))
        x = np.zeros(some * max(1, m))
        out: list[tuple[np.ndarray, ...]] = []
        for perm in range(1 + chunk, n_perm + 1, chunks):
            prefix = f"{seed}|{perm}|".encode()
            h = np.frombuffer(b"".join([hashlib.md5(prefix[:-1] if i is None else prefix + i).digest()[:8] for i in texts]), ">u8").astype(np.uint64)
            to = np.empty(n, np.int64)
            to[np.argsort(h, kind="stable")] = np.arange(n)
            at = node_at[to][place] if n else place
            by, weight = margin[at], linked[at]
            xm, x2m = np.bincount(gene, v * by, total), np.bincount(gene, v * v * by, total)
            xx = np.zeros(total)
            for lo in range(0, total, some):
                part = slice(ends[lo], ends[min(lo + some, total)])
                key, node_, val, own_ = (gene[part] - lo) * m, at[part], v[part], gene[part] - lo
                np.add.at(x, key + node_, val) if repeated else x.__setitem__(key + node_, val)
                deg = degree[node_]
                e = np.repeat(start[node_] - (np.cumsum(deg) - deg), deg) + np.arange(deg.sum())
                far = x[np.repeat(key, deg) + d[e]]
                xx[lo : lo + some] = np.bincount(np.repeat(own_, deg), np.repeat(val, deg) * w_[e] * far, min(some, total - lo))
                x[key + node_] = 0.0
            seen = np.flatnonzero(np.bincount(gene, weight, total) > 0)
            out.append((np.full(len(seen), perm), seen, xm[seen], x2m[seen], xx[seen]))
        perms, seen, *rest = (np.concatenate(u) for u in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), *[np.zeros(0)] * 3)
        g = table["g"][0].as_py()
        return pa.table({"g": pa.array(np.full(len(seen), g), pa.int64()), "perm": pa.array(perms, pa.int64()), "gene": genes.dictionary.take(pa.array(seen, pa.int64())), **{k: pa.array(u) for k, u in zip(("xm", "x2m", "xx"), rest)}})

    chunks = max(1, min(n_perm, -(-2 * own.sparkSession.sparkContext.defaultParallelism // n_groups)))
    schema = ", ".join(["g long", *[f"{x} {t}" for x, t in fields.items()]])
    sent = reduce(lambda a, b: a.unionByName(b), [df.mapInArrow(pack, schema).withColumn("kind", F.lit(k)) for k, df in enumerate((own, lists, links))])
    # a feature that stands twice in a list, or a cell that does, adds up
    repeated = not own.groupBy("g", "id").agg(n_rows().alias("n")).where("n > 1").isEmpty() or not lists.where(F.size("fs") > F.size(F.array_distinct("fs"))).isEmpty()
    sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = spread(sent, ["g", "chunk"]).groupBy("g", "chunk").applyInArrow(sums, f"g long, perm long, gene {gene_type}, xm double, x2m double, xx double")
    return found.join(sized(groups), "g").select(*_cols(keys), "perm", "gene", "xm", "x2m", "xx")


def _permuted_by_blocks(w: DataFrame, cells: DataFrame, packed: DataFrame, groups: DataFrame, keys: Sequence[str], id_col: str, n_perm: int, seed: int) -> DataFrame:
    """``_permuted_sums`` of groups of any size.

    The edges of a block of cells meet in one task what ``CHUNK`` permutations move to their ends, so a list travels once for each
    block that needs it and not along every edge; products and margins leave the task added up by permutation and gene.
    """
    own = with_group(cells.select(*_cols(keys), c(id_col).alias("id")), groups, keys).select("g", "id")
    base = materialize(row_numbers(own, ["g"], ["id"], "rn").withColumn("code", F.col("rn") - 1))
    at = _blocks(cells, base, groups, keys, id_col)
    end = lambda side, *more: at.select("g", F.col("id").alias(side), F.col("node").alias(side[0]), F.col("copies").alias(f"c{side[0]}"), *more)
    edges = with_group(w, groups, keys).select("g", "src", "dst", "w").join(end("src", "block"), ["g", "src"]).join(end("dst"), ["g", "dst"])
    edges = materialize(edges.select("g", "block", "s", "d", "w", "cs", "cd"))
    need = edges.select("g", "block", F.explode(F.array("s", "d")).alias("node")).distinct()

    genes = materialize(packed.select(F.explode("fs").alias("gene")).distinct().withColumn("number", F.monotonically_increasing_id()))
    each = with_group(packed, groups, keys).select("g", "id", F.explode(F.arrays_zip("fs", "vs")).alias("z"))
    each = each.select("g", "id", F.col("z.fs").alias("gene"), F.col("z.vs").alias("v")).join(sized(genes), "gene").groupBy("g", "id").agg(F.collect_list(F.struct("number", "v")).alias("e"))
    content = materialize(base.join(each, ["g", "id"]).select("g", F.col("code").alias("other"), F.col("e.number").alias("gs"), F.col("e.v").alias("vs")))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_ in range(0, batch.num_rows, 1000):
                part = batch.slice(at_, 1000)
                other = matrix(part.column("moved"), "<u4", n_perm).astype(np.int64)
                again = [np.repeat(part.column(k).to_numpy(), n_perm) for k in ("g", "block", "node")]
                perm = np.tile(np.arange(1, n_perm + 1), part.num_rows)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (*again, perm, perm // CHUNK, other.ravel()))), names=["g", "block", "node", "perm", "chunk", "other"])

    def met(rows: pa.Table, near: pa.Table) -> pa.Table:
        kinds = [("g", pa.int64()), ("perm", pa.int64()), ("number", pa.int64()), ("xm", pa.float64()), ("x2m", pa.float64()), ("xx", pa.float64())]
        if rows.num_rows == 0 or near.num_rows == 0:
            return pa.schema(kinds).empty_table()
        many = pc.list_value_length(rows.column("gs")).to_numpy()
        number, v = pc.list_flatten(rows.column("gs")).to_numpy(), pc.list_flatten(rows.column("vs")).to_numpy()
        numbers, gene = np.unique(number, return_inverse=True)
        perms, perm = np.unique(rows.column("perm").to_numpy(), return_inverse=True)
        nodes, node = np.unique(rows.column("node").to_numpy(), return_inverse=True)
        width = len(perms) * len(numbers)
        key = np.repeat(node * width + perm * len(numbers), many) + gene
        order = np.argsort(key, kind="stable")
        key, v = key[order], v[order]
        node, unit = np.divmod(key, width)
        ends = {}
        for k in "sd":
            x = near.column(k).to_numpy()
            i = np.minimum(np.searchsorted(nodes, x), len(nodes) - 1)
            ends[k] = i, nodes[i] == x
        (src, has_src), (dst, has_dst) = ends["s"], ends["d"]
        we, cs, cd = (near.column(k).to_numpy() for k in ("w", "cs", "cd"))
        margin = np.bincount(src[has_src], (we * cd)[has_src], len(nodes)) + np.bincount(dst[has_dst], (we * cs)[has_dst], len(nodes))
        xm, x2m = np.bincount(unit, v * margin[node], width), np.bincount(unit, v * v * margin[node], width)
        xx, first = np.zeros(width), np.searchsorted(node, np.arange(len(nodes) + 1))
        both = np.flatnonzero(has_src & has_dst)
        src, dst, we, n = src[both], dst[both], we[both], np.diff(first)
        step = np.cumsum(n[src]) // 2_000_000
        for part in np.split(np.arange(len(src)), np.flatnonzero(np.diff(step)) + 1):
            n_s = n[src[part]]
            edge = np.repeat(part, n_s)
            a = np.repeat(first[src[part]] - (np.cumsum(n_s) - n_s), n_s) + np.arange(n_s.sum())
            wanted = dst[edge] * width + unit[a]
            low = np.searchsorted(key, wanted, "left")
            found = np.searchsorted(key, wanted, "right") - low  # a gene may stand more than once in a list: every pair counts
            b = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())
            xx += np.bincount(np.repeat(unit[a], found), np.repeat(we[edge] * v[a], found) * v[b], width)
        seen = np.unique(unit)
        p, g = np.divmod(seen, len(numbers))
        return pa.table([np.full(len(seen), rows.column("g")[0].as_py()), perms[p], numbers[g], xm[seen], x2m[seen], xx[seen]], schema=pa.schema(kinds))

    asked = base.join(moved_codes(base, "<u4", n_perm, seed), ["g", "rn"]).join(at.select("g", "id", "node"), ["g", "id"]).join(need, ["g", "node"])
    rows = asked.select("g", "block", "node", "moved").mapInArrow(unpacked, "g long, block long, node long, perm long, chunk long, other long")
    rows = rows.join(content, ["g", "other"]).select("g", "block", "chunk", "node", "perm", "gs", "vs")
    near = edges.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_perm // CHUNK).cast("long"))))
    unit = ["g", "block", "chunk"]
    sums = rows.groupBy(*unit).cogroup(near.groupBy(*unit)).applyInArrow(met, "g long, perm long, number long, xm double, x2m double, xx double")
    sums = sums.groupBy("g", "perm", "number").agg(*[F.sum(k).alias(k) for k in ("xm", "x2m", "xx")])
    return sums.join(sized(groups), "g").join(sized(genes), "number").select(*_cols(keys), "perm", "gene", "xm", "x2m", "xx")


def with_norm_p(auto: DataFrame, out: str = "p_norm") -> DataFrame:
    """One-sided p of the analytic z, in the direction of the deviation."""
    return auto.withColumn(out, tails.call("normal_p", F.col("z_norm")) / 2)


def spatially_variable(auto: DataFrame, cut: float = 0.05, top: int = 50, ascending: bool = False) -> DataFrame:
    """Genes below the p cut when p is present, else the ``top`` strongest."""
    order = F.col("stat").asc() if ascending else F.col("stat").desc()
    if "p_norm" in auto.columns:
        return auto.where(F.col("p_norm") < cut).orderBy(order, "gene")
    return auto.orderBy(order, "gene").limit(top)


# ------------------------------------------------------------------------------------------- grids and filters


def gaussian_kernel(spark, n: int, sigma: float, truncate: float = 4.0) -> DataFrame:
    """(o, s, k): weight of grid line s in the filtered line o, mirrored at the edges."""
    r = int(truncate * sigma + 0.5)
    total = sum(math.exp(-0.5 * (t / sigma) ** 2) for t in range(-r, r + 1))
    base = spark.range(n).select(F.col("id").cast("int").alias("o"), F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("t"))
    at = F.pmod(F.col("o") + F.col("t"), F.lit(2 * n))
    s = F.when(at < n, at).otherwise(2 * n - 1 - at)
    k = F.exp(-0.5 * F.pow(F.col("t") / F.lit(float(sigma)), 2)) / total
    return base.select("o", s.cast("int").alias("s"), k.alias("k")).groupBy("o", "s").agg(F.sum("k").alias("k"))


def gaussian_filtered(grid: DataFrame, keys: Sequence[str], cols: Sequence[str], n: int, sigma: float) -> DataFrame:
    """Separable Gaussian filter of dense n x n grids: one small join and sum per axis."""
    kernel = sized(gaussian_kernel(grid.sparkSession, n, sigma))
    out = grid
    for axis, other in (("gx", "gy"), ("gy", "gx")):
        j = out.join(kernel.withColumnRenamed("s", axis), axis)
        out = j.groupBy(*_cols(keys), "o", other).agg(*[F.sum(F.col("k") * c(m)).alias(m) for m in cols]).withColumnRenamed("o", axis)
    return out


def structural_similarity(grid: DataFrame, keys: Sequence[str], a: str, b: str, n: int, window: int = 7, k1: float = 0.01, k2: float = 0.03) -> DataFrame:
    """Mean structural similarity of two columns of dense n x n grids."""
    lim = with_group_stats(grid, keys, [F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1")])
    unit = lambda v, lo, hi: (c(v) - F.col(lo)) / (F.col(hi) - F.col(lo) + 1e-9)
    g = lim.select(*_cols(keys), "gx", "gy", unit(a, "a0", "a1").alias("m1"), unit(b, "b0", "b1").alias("m2"))
    g = g.withColumn("q1", F.col("m1") * F.col("m1")).withColumn("q2", F.col("m2") * F.col("m2")).withColumn("q12", F.col("m1") * F.col("m2"))
    f = gaussian_filtered(g, keys, ["m1", "m2", "q1", "q2", "q12"], n, window / 6.0)
    c1, c2 = k1 * k1, k2 * k2
    m1, m2 = F.col("m1"), F.col("m2")
    v1, v2, v12 = F.col("q1") - m1 * m1, F.col("q2") - m2 * m2, F.col("q12") - m1 * m2
    s = ((2 * m1 * m2 + c1) * (2 * v12 + c2)) / ((m1 * m1 + m2 * m2 + c1) * (v1 + v2 + c2))
    return f.groupBy(*_cols(keys)).agg(F.avg(s).alias("ssim"))


def density_map(cells: DataFrame, keys: Sequence[str], n: int = 50, sigma: float = 1.5) -> DataFrame:
    """Smoothed histogram of positions."""
    g = grid_means(cells, keys, [], n).withColumn("density", F.col("n").cast("double"))
    return gaussian_filtered(g, keys, ["density"], n, sigma)


def rna_protein_concordance(cells: DataFrame, counts: DataFrame, protein: DataFrame, pairs: DataFrame, keys: Sequence[str], n_bins: int = 50, min_cells: int = 100) -> DataFrame:
    """Per (sample, protein, gene): cell and grid correlations and grid similarity, or the reason there is none.

    ``protein`` has one row per cell and marker; a gene without a row in a cell counts as zero there.
    """
    keys = list(keys)
    unit = [*keys, "protein", "gene"]
    measured = counts.select(*_cols(keys), "gene").distinct().withColumn("__measured", F.lit(True))
    sizes = cells.groupBy(*_cols(keys)).agg(n_rows().alias("n_cells"))
    wanted = attach(sizes.withColumn("__all", F.lit(0)), pairs.withColumn("__all", F.lit(0)), ["__all"]).drop("__all").join(measured, [*keys, "gene"], "left")
    panel = protein.select(F.col("marker").alias("protein")).distinct().withColumn("__panel", F.lit(True))
    error = F.when(F.col("n_cells") < min_cells, "insufficient_cells").when(F.col("__panel").isNull(), "protein_column_missing").when(F.col("__measured").isNull(), "gene_not_found")
    plan = materialize(wanted.join(panel, "protein", "left").withColumn("error", error).select(*unit, "n_cells", "error"))
    good = plan.where("error is null").select(*unit)
    binned = grid_bins(cells.select(*_cols(keys), "cell_id", "x", "y"), keys, n_bins)
    both = attach(protein.select(*_cols(keys), "cell_id", F.col("marker").alias("protein"), "intensity"), good, [*keys, "protein"], "inner")
    both = both.join(counts.select(*_cols(keys), "cell_id", "gene", F.col("count").cast("double").alias("rna")), [*keys, "cell_id", "gene"], "left")
    both = materialize(both.withColumn("rna", F.coalesce("rna", F.lit(0.0))).join(binned, [*keys, "cell_id"]))
    cell = guarded_correlation(both, unit, "intensity", "rna").select(
        *unit, F.col("pearson_r").alias("cell_pearson_r"), F.col("spearman_r").alias("cell_spearman_r"), "note")
    means = both.groupBy(*_cols(unit)).agg(
        F.avg("intensity").alias("protein_mean"), F.stddev_pop("intensity").alias("protein_std"), F.avg("rna").alias("rna_mean"), F.stddev_pop("rna").alias("rna_std"))
    filled = both.groupBy(*_cols(unit), "gx", "gy").agg(F.avg("intensity").alias("p"), F.avg("rna").alias("r"))
    axis = F.sequence(F.lit(0), F.lit(n_bins - 1))
    full = good.select("*", F.explode(axis).alias("gx")).select("*", F.explode(axis).alias("gy")).join(filled, [*unit, "gx", "gy"], "left")
    grid = materialize(full.select(*unit, "gx", "gy", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("r", F.lit(0.0)).alias("r")))
    flat = guarded_correlation(grid, unit, "p", "r").select(
        *unit, F.col("pearson_r").alias("grid_pearson_r"), F.col("spearman_r").alias("grid_spearman_r"), F.col("slope").alias("grid_slope"), F.col("intercept").alias("grid_intercept"))
    z = with_group_stats(grid, unit, [s(v).alias(f"__{n}{v}") for v in ("p", "r") for n, s in (("m", F.avg), ("s", F.stddev_pop))])
    for v in ("p", "r"):
        z = z.withColumn(v, F.when(F.col(f"__s{v}") < 1e-9, 0.0).otherwise((F.col(v) - F.col(f"__m{v}")) / F.col(f"__s{v}")))
    sim = structural_similarity(z.select(*unit, "gx", "gy", "p", "r"), unit, "p", "r", n_bins)
    out = plan.withColumn("__grid", F.lit(n_bins * n_bins))
    for t in (means, cell, flat, sim):
        out = out.join(t, unit, "left")
    for side, n in (("cell", "n_cells"), ("grid", "__grid")):
        for r in ("pearson", "spearman"):
            out = with_correlation_p(out, f"{side}_{r}_r", f"{side}_{r}_p", n)
    return out.drop("__grid")


def zero_variance_cases(concordance: DataFrame) -> DataFrame:
    return concordance.where(F.col("note") == "zero_variance")

