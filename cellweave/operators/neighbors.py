"""Neighbour joins: pairs within a distance, k nearest in the plane, k nearest in an embedding.

No join here forms all pairs of a sample. The plane is cut into square tiles of at most ``cap`` distinct
positions (crowded squares are divided further, so a dense spot never becomes one task), exact copies of a
position are folded into one site, and only tiles that can hold a nearer neighbour are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.operators.descent import _starts
from cellweave.scale import attach, c, materialize, sized, spread

DEPTH = 24  # levels of halving kept in the integer coordinates
_GROUPS = (range(0, 7), range(7, 13), range(13, 19), range(19, DEPTH + 1))  # levels tried together


def _cols(names: Sequence[str]) -> list[Column]:
    return [c(n) for n in names]


def positions(points: DataFrame, keys: Sequence[str], id_col: str, x: str, y: str) -> DataFrame:
    """Rows with a usable position, under fixed names."""
    ok = points.select(*_cols(keys), c(id_col).alias("id"), c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    return ok.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


# ------------------------------------------------------------------------------------------ within a distance


def _bucketed(df: DataFrame, r: float, spread: bool) -> DataFrame:
    bx, by = F.floor(F.col("x") / r), F.floor(F.col("y") / r)
    if not spread:
        return df.withColumn("__bx", bx).withColumn("__by", by)
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return df.withColumn("__dx", F.explode(step)).withColumn("__dy", F.explode(step)).withColumn("__bx", bx + F.col("__dx")).withColumn(
        "__by", by + F.col("__dy")
    ).drop("__dx", "__dy")


TILE_ROWS = 32_768


def within_distance(points: DataFrame, keys: Sequence[str], r: float, id_col: str = "cell_id", x: str = "x", y: str = "y", cap: int = TILE_ROWS) -> DataFrame:
    """Directed pairs (src, dst, dist) at most ``r`` apart, self excluded.

    Rows are shuffled once, to tiles of up to eight by eight squares of side ``r`` and to the tiles that the squares beside
    their own lie in; a tile has about ``cap`` rows. Inside the task a square meets the three by three around it, so the rows
    compared are about three times the rows returned. Crowded tiles are cut by hash, and their pieces meet two by two.
    """
    keys = list(keys)
    p = positions(points, keys, id_col, x, y).dropna(subset=[*keys, "id"])
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    schema = ", ".join([*[f"`{x}` {kinds[x]}" for x in keys], f"src {kinds['id']}", f"dst {kinds['id']}", "dist double"])
    return _tiled(p, keys, float(r), cap).mapInArrow(_tile_by_tile(keys, _tile_pairs(float(r))), schema)


def _tiled(p: DataFrame, keys: Sequence[str], r: float, cap: int) -> DataFrame:
    """Rows (unit, id, x, y, __bx, __by, __one, __two), a unit's after each other: every pair of the rows (keys, id, x, y) of ``p``
    at most ``r`` apart is in one unit, with its first as ``__one`` and its second as ``__two``.

    A unit is a tile of squares of side ``r`` with the squares beside it, or a pair of pieces of a crowded one.
    """
    keys, k = list(keys), _cols(keys)
    p = p.withColumn("__bx", F.floor(F.col("x") / r)).withColumn("__by", F.floor(F.col("y") / r))
    place = lambda m: [F.floor(F.col(v) / m).alias(t) for v, t in (("__bx", "__tx"), ("__by", "__ty"))]
    squares = p.groupBy(*k, "__bx", "__by").agg(F.count(F.lit(1)).alias("m"))
    tiles = squares.withColumn("__m", F.explode(F.array(*[F.lit(m) for m in (8, 4, 2, 1)])))
    tiles = materialize(tiles.groupBy("__m", *k, *place(F.col("__m"))).agg(F.sum("m").alias("m")))
    sizes = {e["__m"]: e for e in tiles.groupBy("__m").agg(F.sum("m").alias("n"), (F.sum(F.col("m").cast("double") * F.col("m")) / F.sum("m")).alias("of")).collect()}
    wide = max((m for m, e in sizes.items() if e["of"] <= cap), default=1)  # what a row's tile has on average
    total = math.ceil(sizes[wide]["n"] * (1 + 2 / wide) ** 2) if sizes else 0
    beside = lambda v: F.explode(F.array_distinct(F.array(*[F.floor((F.col(v) + d) / wide) for d in (-1, 0, 1)])))
    tile = [*keys, "__tx", "__ty"]
    near = p.withColumn("__tx", beside("__bx")).withColumn("__ty", beside("__by"))
    own = (F.col("__tx") == F.floor(F.col("__bx") / wide)) & (F.col("__ty") == F.floor(F.col("__by") / wide))
    crowded = tiles.where((F.col("__m") == wide) & (F.col("m") > cap)).select(*_cols(tile), F.ceil(F.col("m") / cap).cast("int").alias("__n"))
    unit = tile
    near = near.withColumns({"__one": own, "__two": F.lit(True)})
    if not crowded.isEmpty():
        unit = [*tile, "__i", "__j"]
        near = attach(near, crowded, tile).withColumn("__n", F.coalesce("__n", F.lit(1))).withColumnRenamed("__one", "__own")
        at, every = F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"), F.sequence(F.lit(0), F.col("__n") - 1)
        meets = lambda i, j, one, two: F.struct(i.alias("__i"), j.alias("__j"), one.alias("__one"), two.alias("__two"))
        as_one = F.when(F.col("__own"), F.transform(every, lambda e: meets(at, e, F.lit(True), e == at))).otherwise(F.array().cast("array<struct<__i:int,__j:int,__one:boolean,__two:boolean>>"))
        # a row meets the piece it lies in once, as both
        as_two = F.transform(F.filter(every, lambda e: ~F.col("__own") | (e != at)), lambda e: meets(e, at, F.lit(False), F.lit(True)))
        near = near.withColumn("__e", F.explode(F.concat(as_one, as_two))).select(*p.columns, "__tx", "__ty", "__e.*")
    met = spread(near, unit, total).sortWithinPartitions(*_cols(unit))
    return met.select(F.struct(*_cols(unit)).alias("unit"), "id", "x", "y", "__bx", "__by", "__one", "__two")


def _tile_by_tile(keys: Sequence[str], found, rows: int = 1 << 16):
    """``found`` of each tile, parts of (src, dst, distances), with the tile's keys, some ``rows`` at a time."""

    def batch_of(key: list[pa.Scalar], some: list) -> pa.RecordBatch:
        src, dst, d = zip(*some)
        d = np.concatenate(d)
        return pa.RecordBatch.from_arrays([*[pa.repeat(v, len(d)) for v in key], pa.concat_arrays(src), pa.concat_arrays(dst), pa.array(d)], names=[*keys, "src", "dst", "dist"])

    def meet(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = tile.column("unit").combine_chunks()
        key = [pc.struct_field(unit[0], x) for x in keys]
        waiting, n = [], 0
        for part in found(tile):
            waiting.append(part)
            n += len(part[2])
            if n >= rows:
                yield batch_of(key, waiting)
                waiting, n = [], 0
        if waiting:
            yield batch_of(key, waiting)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the tile that is still arriving
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if len(held) > 1 and held[0].column("unit")[0] == held[-1].column("unit")[batch.num_rows - 1]:
                continue
            table = pa.concat_tables(held)
            starts = _starts(table.column("unit").combine_chunks())
            for lo, hi in zip(starts, starts[1:]):
                yield from meet(table.slice(lo, hi - lo))
            held = [table.slice(starts[-1])]
        if held:
            yield from meet(pa.concat_tables(held))

    return tiles


def _tile_pairs(r: float, most: int = 1 << 20):
    """(src, dst, distances) of a tile: rows ``__one`` with rows ``__two`` at most ``r`` away, about ``most`` compared at a time."""

    def found(tile: pa.Table) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        x, y, bx, by = (tile.column(v).to_numpy() for v in ("x", "y", "__bx", "__by"))
        ids = tile.column("id").combine_chunks()
        name = _ranks(ids)
        one, two = (np.flatnonzero(tile.column(v).to_numpy(zero_copy_only=False)) for v in ("__one", "__two"))

        def compared(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
            xb, yb, nb = x[b], y[b], name[b]
            step = max(1, most // 8 // max(1, len(b)))
            for at in range(0, len(a), step):
                part = a[at : at + step]
                d2 = x[part, None] - xb
                d2 *= d2
                dy = y[part, None] - yb
                dy *= dy
                d2 += dy
                i, j = np.nonzero(d2 <= r * r)
                other = name[part][i] != nb[j]
                i, j = i[other], j[other]
                if len(i):
                    yield ids.take(pa.array(part[i])), ids.take(pa.array(b[j])), np.sqrt(d2[i, j])

        if len(one) * len(two) <= most:
            yield from compared(one, two)
            return
        one, two = (v[np.lexsort((by[v], bx[v]))] for v in (one, two))
        # squares in order of their places, so the three beside each other in a column are one slice
        wide = by.max() - by.min() + 3
        place = lambda v: (bx[v] - bx.min()) * wide + by[v] - by.min() + 1
        at, of = place(two), place(one)
        for lo, hi in zip(s := np.flatnonzero(np.append(True, np.diff(of) != 0)), [*s[1:], len(of)]):
            around = [slice(*np.searchsorted(at, [of[lo] + column * wide - 1, of[lo] + column * wide + 2])) for column in (-1, 0, 1)]
            yield from compared(one[lo:hi], np.concatenate([two[v] for v in around]))

    return found


def count_within(points: DataFrame, keys: Sequence[str], r: float, id_col: str = "cell_id", x: str = "x", y: str = "y", cap: int = 1024) -> DataFrame:
    """Number of rows within ``r`` of each row, itself included; copies of a position are counted, not paired.

    Blocks of positions meet in a task and leave a count for each position: no pair becomes a row.
    """
    keys = list(keys)
    p = positions(points, keys, id_col, x, y)
    sites = p.dropna(subset=keys).groupBy(*_cols(keys), "x", "y").agg(F.count(F.lit(1)).alias("m")) if keys else p.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m"))
    met = near_blocks(sites.withColumn("id", F.xxhash64("x", "y")), keys, float(r), ["m"], cap)
    kinds = {f.name: f.dataType.simpleString() for f in sites.schema}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, same = block_columns(batch, "one", row), batch.column("same")[row].as_py()
                two = one if same else block_columns(batch, "two", row)
                dx, dy = one["x"][:, None] - two["x"], one["y"][:, None] - two["y"]
                near = dx * dx + dy * dy <= r * r
                for pts, n in ((one, (near * two["m"]).sum(1)),) if same else ((one, (near * two["m"]).sum(1)), (two, (near.T * one["m"]).sum(1))):
                    some = n > 0
                    group = [pa.array([batch.column(k)[row].as_py()] * int(some.sum()), batch.column(k).type) for k in keys]
                    yield pa.RecordBatch.from_arrays([*group, pa.array(pts["x"][some]), pa.array(pts["y"][some]), pa.array(n[some])], names=[*keys, "x", "y", "n"])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "x double", "y double", "n long"])
    n = met.mapInArrow(count, schema).groupBy(*_cols(keys), "x", "y").agg(F.sum("n").alias("n_within"))
    return p.join(n, [*keys, "x", "y"]).select(*_cols(keys), F.col("id").alias(id_col), "n_within")


# ------------------------------------------------------------------------------- within a distance, block by block


@dataclass(frozen=True)
class PairsWithin:
    """The directed pairs of ``within_distance``, named but not formed, for steps that reduce them block by block."""

    points: DataFrame
    keys: Sequence[str]
    r: float
    id_col: str = "cell_id"
    x: str = "x"
    y: str = "y"

    def rows(self) -> DataFrame:
        """(keys, id, x, y) of the rows that can be in a pair."""
        p = positions(self.points, self.keys, self.id_col, self.x, self.y)
        return p.dropna(subset=[*self.keys, "id"])


def near_blocks(rows: DataFrame, keys: Sequence[str], r: float, carry: Sequence[str] = (), cap: int = 1024) -> DataFrame:
    """(keys, same, one, two): pairs of blocks of about ``cap`` rows at most, as arrays of (id, x, y, carry).

    Every unordered pair of rows at most ``r`` apart is in exactly one of them, in ``one`` alone where ``same``. Blocks are squares of
    side ``r`` or, in sparse tables, a multiple of it; crowded squares are cut by hash. What is shuffled is every block once for each
    block beside it, however many pairs they hold.
    """
    keys, k = list(keys), _cols(keys)
    full = rows.groupBy(*k, F.floor(F.col("x") / r), F.floor(F.col("y") / r)).agg(F.count(F.lit(1)).alias("m")).agg(F.avg("m")).first()[0] or 1.0
    side = r * max(1, min(64, int(math.sqrt(cap / 4 / full))))
    p = _bucketed(rows, side, False)
    square, block = [*keys, "__bx", "__by"], [*keys, "__bx", "__by", "__chunk"]
    crowded = p.groupBy(*_cols(square)).agg(F.ceil(F.count(F.lit(1)) / cap).cast("long").alias("__chunks")).where("__chunks > 1")
    p = attach(p, crowded, square).withColumn("__chunk", F.coalesce(F.pmod(F.xxhash64("id"), F.col("__chunks")), F.lit(0).cast("long")))
    blocks = materialize(p.groupBy(*_cols(block)).agg(F.collect_list(F.struct("id", "x", "y", *_cols(carry))).alias("pts")))
    beside = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    one = blocks.select(*_cols(block), F.col("pts").alias("one"), F.explode(beside).alias("__s")).select(
        *k, (F.col("__bx") + F.col("__s.a")).alias("__bx"), (F.col("__by") + F.col("__s.b")).alias("__by"),
        ((F.col("__s.a") == 0) & (F.col("__s.b") == 0)).alias("__here"), F.col("__chunk").alias("__first"), "one")
    one = one.join(sized(blocks.select(*block)), square).where("not __here or __first <= __chunk")
    # both sides by the second block, into all partitions: the work is in the rows, not in their bytes
    met = spread(one, block).join(spread(blocks.select(*_cols(block), F.col("pts").alias("two")), block), block)
    return met.select(*k, (F.col("__here") & (F.col("__first") == F.col("__chunk"))).alias("same"), "one", "two")


def block_columns(batch: pa.RecordBatch, name: str, i: int) -> dict[str, np.ndarray]:
    """The columns of one row's block."""
    pts = batch.column(name)[i].values
    return {f.name: pts.field(j).to_numpy(zero_copy_only=False) for j, f in enumerate(pts.type)}


def _near_squares(x: np.ndarray, y: np.ndarray, com: np.ndarray, side: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): each pair of points once that lies in one square of side ``side`` or in squares beside each other, and may differ in ``com``; about ``most`` at a time."""
    bx, by = np.floor((x - x.min()) / side).astype(np.int64), np.floor((y - y.min()) / side).astype(np.int64)
    wide = int(by.max()) + 3
    key = bx * wide + by + 1
    order = np.argsort(key, kind="stable")
    squares, first = np.unique(key[order], return_index=True)
    last = np.append(first[1:], len(key))
    low, high = np.minimum.reduceat(com[order], first), np.maximum.reduceat(com[order], first)
    rows, starts, ends = [], [], []
    for step in (0, 1, wide - 1, wide, wide + 1):
        other = np.minimum(np.searchsorted(squares, squares + step), len(squares) - 1)
        # squares whose points are all of one part have nothing to join
        a = np.flatnonzero((squares[other] == squares + step) & (np.minimum(low, low[other]) != np.maximum(high, high[other])))
        b = other[a]
        many = last[a] - first[a]
        row = np.repeat(first[a] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        rows.append(row)
        starts.append(row + 1 if step == 0 else np.repeat(first[b], many))
        ends.append(np.repeat(last[b], many))
    row, start, end = np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)
    total = np.cumsum(end - start)
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(total // most)) + 1):
        many = end[part] - start[part]
        j = np.repeat(start[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        yield order[np.repeat(row[part], many)], order[j]


def _local_forest(ids: np.ndarray, x: np.ndarray, y: np.ndarray, r: float, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): a minimum spanning forest of the pairs at most ``r`` apart; ties by the smaller, then the larger id.

    Copies of a position hang on the smallest id. Then pairs are taken by distance, up to twice as far each time: what is joined by
    then counts as one part, only squares with several parts are looked at, and of two parts only the shortest pair counts. The
    work is a few pairs a point, however many lie within ``r``.
    """
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none, np.zeros(0)
    order = np.lexsort((ids, y, x))
    new = np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))
    site = order[new]
    out = [(site[np.cumsum(new) - 1][~new], order[~new], np.zeros(int((~new).sum())))]
    px, py, name, m = x[site], y[site], ids[site], len(site)
    com, reach = np.arange(m), float(r)
    while reach > r * 2.0**-30:  # until squares hold few points
        _, many = np.unique(np.stack([np.floor((px - px.min()) / reach), np.floor((py - py.min()) / reach)]), axis=1, return_counts=True)
        if (many * many).sum() <= 8 * m:
            break
        reach /= 2

    def shortest(edges: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """For every two parts the first of the edges (part, part, d, smaller id, larger id, i, j) between them."""
        e = [np.concatenate(v) for v in zip(*edges)]
        by = np.lexsort((e[4], e[3], e[2], e[1], e[0]))
        e = [v[by] for v in e]
        keep = np.append(True, (np.diff(e[0]) != 0) | (np.diff(e[1]) != 0))[: len(by)]
        return tuple(v[keep] for v in e)

    while True:
        edges: list[tuple[np.ndarray, ...]] = []
        for i, j in _near_squares(px, py, com, reach * (1 + 1e-9), most):
            d2 = (px[i] - px[j]) * (px[i] - px[j]) + (py[i] - py[j]) * (py[i] - py[j])
            keep = (com[i] != com[j]) & (d2 <= reach * reach)
            i, j, a, b = i[keep], j[keep], com[i[keep]], com[j[keep]]
            edges.append((np.minimum(a, b), np.maximum(a, b), np.sqrt(d2[keep]), np.minimum(name[i], name[j]), np.maximum(name[i], name[j]), i, j))
            if len(edges) > 1:
                edges = [shortest(edges)]
        if edges and len(edges[0][0]):
            e = shortest(edges)
            by = np.lexsort((e[4], e[3], e[2]))
            u, v, _, _, _, i, j = (w[by] for w in e)
            d, rank = e[2][by], np.arange(len(by))
            while len(u):
                best = np.full(m, len(by))
                np.minimum.at(best, u, rank)
                np.minimum.at(best, v, rank)
                part = np.flatnonzero(best < len(by))
                pick = best[part]
                at = np.searchsorted(rank, pick)
                top = np.arange(m)
                top[part] = np.where(u[at] == part, v[at], u[at])
                both = part[(top[top[part]] == part) & (part < top[part])]  # two that chose each other
                top[both] = both
                while (top[top] != top).any():
                    top = top[top]
                pick = np.unique(pick)
                out.append((site[i[pick]], site[j[pick]], d[pick]))
                com, u, v = top[com], top[u], top[v]
                keep = u != v
                u, v, rank = u[keep], v[keep], rank[keep]
        if reach >= r:
            return tuple(np.concatenate(w) for w in zip(*out))
        reach = min(float(r), reach * 2)


def forest_pairs(pairs: PairsWithin, cap: int = TILE_ROWS) -> DataFrame:
    """(keys, src, dst, dist): those of the pairs that can be edges of a minimum spanning forest, each once at least, in one direction.

    An edge that is not in the forest of a tile and what is beside it closes a cycle of shorter edges there, so it is in no forest
    of the whole either: each tile leaves fewer edges than rows, and no others become rows.
    """
    keys, r = list(pairs.keys), float(pairs.r)
    rows = pairs.rows()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def found(tile: pa.Table) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        ids, one = tile.column("id").combine_chunks(), tile.column("__one").to_numpy(zero_copy_only=False)
        i, j, d = _local_forest(_ranks(ids), tile.column("x").to_numpy(), tile.column("y").to_numpy(), r)
        keep = one[i] | one[j]  # edges beside the tile come with their own
        yield ids.take(pa.array(i[keep])), ids.take(pa.array(j[keep])), d[keep]

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"src {kinds['id']}", f"dst {kinds['id']}", "dist double"])
    return _tiled(rows, keys, r, cap).mapInArrow(_tile_by_tile(keys, found), schema).where("src <> dst")


# --------------------------------------------------------------------------------------- k nearest in the plane


def _sites(p: DataFrame, keys: Sequence[str], place: Sequence[str], k: int) -> DataFrame:
    """Distinct places with their k + 1 smallest ids.

    Ties at equal distance are broken by id, so no other copy of a place can be among anyone's k nearest.
    """
    first = Window.partitionBy(*_cols(keys), *_cols(place)).orderBy("id")
    few = p.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= k + 1)
    return few.groupBy(*_cols(keys), *_cols(place)).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _square(level: str | int) -> list[Column]:
    return [F.expr(f"shiftright(ix, {DEPTH} - ({level}))").alias("cx"), F.expr(f"shiftright(iy, {DEPTH} - ({level}))").alias("cy")]


def _assign_tiles(sites: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Give every site the largest square (l, cx, cy) that holds at most ``cap`` sites."""
    todo, done = sites, []
    for g, levels in enumerate(_GROUPS):
        spread = todo.withColumn("l", F.explode(F.array(*[F.lit(v) for v in levels]))).select("*", *_square("l"))
        counted = materialize(spread.groupBy(*_cols(keys), "l", "cx", "cy").agg(F.count(F.lit(1)).alias("m")))
        heavy = counted.where(F.col("m") > cap)
        parent = [*_cols(keys), (F.col("l") + 1).alias("l"), F.col("cx").alias("px"), F.col("cy").alias("py")]
        light = counted.where(F.col("m") <= cap).withColumn("px", F.shiftright("cx", 1)).withColumn("py", F.shiftright("cy", 1))
        first = light.where(F.col("l") == levels[0])
        later = light.join(heavy.select(*parent), [*keys, "l", "px", "py"], "left_semi")
        leaves = first.unionByName(later.select(first.columns)).select(*_cols(keys), "l", "cx", "cy")
        done.append(spread.join(sized(leaves), [*keys, "l", "cx", "cy"]).withColumn("chunk", F.lit(0).cast("long")).withColumn("chunks", F.lit(1).cast("long")))
        last = heavy.where(F.col("l") == levels[-1])
        if last.limit(1).count() == 0:
            break
        at_last = todo.withColumn("l", F.lit(levels[-1])).select("*", *_square(levels[-1]))
        if g + 1 < len(_GROUPS):
            todo = materialize(at_last.join(sized(last.drop("m")), [*keys, "l", "cx", "cy"], "left_semi").drop("l", "cx", "cy"))
        else:  # closer than the coordinates resolve: cut by hash, all pieces share the square
            rest = at_last.join(sized(last), [*keys, "l", "cx", "cy"]).withColumn("chunks", F.ceil(F.col("m") * 2 / cap).cast("long"))
            done.append(rest.withColumn("chunk", F.pmod(F.xxhash64("x", "y"), F.col("chunks"))).drop("m"))
    return reduce(lambda a, b: a.unionByName(b), done)


def _tile_search(n: int, id_type: str, tile: str):
    """For every site of a tile (tile, x, y, ids) its n nearest (d, id) within the tile: (tile, x, y, near), a batch for some tiles at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pts, kind = part.column("pts").flatten(), part.column("pts").type.value_type.field("ids").type.value_type
                sizes = part.column("pts").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                xs, ys = (pts.field(c_).to_numpy(zero_copy_only=False) for c_ in ("x", "y"))
                lists = pts.field("ids")
                ids, length = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                start, rank = np.cumsum(length) - length, _ranks(ids)
                tiles, far, named, counts, lo = [], [], [], [], 0
                for size in sizes:
                    x, y = xs[lo : lo + size], ys[lo : lo + size]
                    dx, dy = x[:, None] - x[None, :], y[:, None] - y[None, :]
                    d = np.sqrt(dx * dx + dy * dy)
                    few = min(n, size)
                    i, j = np.nonzero(d <= np.partition(d, few - 1, axis=1)[:, few - 1 : few])
                    # one entry an id: those of a site stand together
                    m = length[lo + j]
                    i, e = np.repeat(i, m), np.repeat(d[i, j], m)
                    v = np.repeat(start[lo + j] - (np.cumsum(m) - m), m) + np.arange(len(i))
                    order = np.lexsort((rank[v], e, i))
                    i, e, v = i[order], e[order], v[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < n
                    far.append(e[keep])
                    named.append(v[keep])
                    counts.append(np.bincount(i[keep], minlength=size))
                    lo += size
                ends = pa.array(np.append(0, np.cumsum(np.concatenate(counts))), pa.int32())
                near = pa.StructArray.from_arrays([pa.array(np.concatenate(far)), ids.take(pa.array(np.concatenate(named), pa.int64()))], names=["d", "id"])
                own = part.column("tile").take(pa.array(np.repeat(np.arange(part.num_rows), sizes), pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array(xs), pa.array(ys), pa.ListArray.from_arrays(ends, near)], names=["tile", "x", "y", "near"])

    return search, f"tile {tile}, x double, y double, near array<struct<d:double,id:{id_type}>>"


def _ranks(ids: pa.Array) -> np.ndarray:
    """Positions of the ids in their order; the same for the same id."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    return np.unique(np.array(ids.to_pylist(), dtype=object), return_inverse=True)[1]


def nearest_in_plane(points: DataFrame, keys: Sequence[str], k: int, id_col: str = "cell_id", x: str = "x", y: str = "y", cap: int = 64) -> DataFrame:
    """Exact k nearest rows of every row within its group: (src, dst, dist, rank), self excluded.

    Own tile first, which bounds the distance of the k-th neighbour; then only the tiles that reach into that
    circle. Ties are ordered by id.
    """
    keys = list(keys)
    p = positions(points, keys, id_col, x, y)
    frame = p.groupBy(*_cols(keys)).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side")
    ).withColumn("side", F.when(F.col("side") > 0, F.col("side") * 1.000001).otherwise(1.0))
    at = lambda v, v0: F.greatest(F.lit(0).cast("long"), F.least(F.lit(2**DEPTH - 1).cast("long"), F.floor((v - F.col(v0)) / F.col("side") * 2.0**DEPTH)))
    sites = attach(_sites(p, keys, ["x", "y"], k), frame, keys).withColumn("ix", at(F.col("x"), "x0")).withColumn("iy", at(F.col("y"), "y0"))
    tile_key = [*keys, "l", "cx", "cy", "chunk"]
    tiles = materialize(
        _assign_tiles(materialize(sites), keys, cap).groupBy(*_cols(tile_key), "chunks", "x0", "y0", "side").agg(
            F.collect_list(F.struct("x", "y", "ids")).alias("pts"),
            F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"),
        )
    )
    tile = F.struct(*_cols(tile_key), "chunks", "x0", "y0", "side").alias("tile")
    numbered = spread(tiles, tile_key).select(tile, "pts")
    search, found_schema = _tile_search(k + 1, p.schema["id"].dataType.simpleString(), numbered.schema["tile"].dataType.simpleString())
    own = numbered.mapInArrow(search, found_schema).select("tile.*", F.struct("x", "y").alias("__q"), "near")
    h = F.col("side") / F.pow(F.lit(2.0), F.col("l"))
    left, low = F.col("x0") + F.col("cx") * h, F.col("y0") + F.col("cy") * h
    margin = F.least(F.col("__q.x") - left, left + h - F.col("__q.x"), F.col("__q.y") - low, low + h - F.col("__q.y"))
    found = F.when(F.size("near") > k, F.element_at("near", k + 1)["d"])
    # the parent square holds more than `cap` sites, so its diagonal bounds the distance as well
    reach = F.least(found, F.when(F.col("l") > 0, 2 * math.sqrt(2) * h)) * (1 + 1e-9)
    local = materialize(
        own.withColumn("reach", reach)
        .withColumn("open", (F.col("l") > 0) & ((F.col("chunks") > 1) | (F.col("reach") * (1 + 1e-9) >= margin)))
        .drop("chunks")
    )
    wanted = local.where("open").drop("near", "open")
    # squares at a level at least twice as wide as the circle: at most two by two cover it
    fit = F.floor(F.log2(F.col("side") / (2 * F.col("reach")))).cast("int")
    lq = F.when(F.col("reach") > 0, F.greatest(F.lit(0), F.least(F.lit(DEPTH), fit))).otherwise(F.lit(DEPTH))
    edge = lambda v, v0, sign: at(F.col(v) + sign * F.col("reach"), v0)
    wanted = wanted.withColumn("lq", lq)
    for name, v, v0 in (("cxs", "__q.x", "x0"), ("cys", "__q.y", "y0")):
        a, b = edge(v, v0, -1), edge(v, v0, 1)
        wanted = wanted.withColumn("__a", a).withColumn("__b", b).withColumn(
            name, F.expr(f"sequence(shiftright(__a, {DEPTH} - lq), shiftright(__b, {DEPTH} - lq))")
        ).drop("__a", "__b")
    coarsest = tiles.groupBy(*_cols(keys)).agg(F.min("l").alias("l_min"))
    wanted = attach(wanted, coarsest, keys)
    # below: tiles inside the covering squares; above: tiles that contain them
    covering = "flatten(transform(cxs, a -> transform(cys, b -> named_struct('up', false, 'l', lq, 'cx', a, 'cy', b))))"
    levels = f"filter(sequence(0, {DEPTH}), v -> v < lq and v >= l_min)"
    above = (
        f"array_distinct(flatten(transform({levels}, v -> flatten(transform(cxs, a -> transform(cys, b -> "
        "named_struct('up', true, 'l', v, 'cx', shiftright(a, lq - v), 'cy', shiftright(b, lq - v))))))))"
    )
    look = wanted.select(
        *_cols(keys), "__q", "reach", F.struct("l", "cx", "cy", "chunk").alias("mine"), F.explode(F.expr(f"concat({covering}, {above})")).alias("__s")
    ).select(*_cols(keys), "__q", "reach", "mine", "__s.*")
    box = ["bx0", "bx1", "by0", "by1"]
    directory = tiles.select(*_cols(tile_key), *box, F.explode(F.expr(
        "concat(array(named_struct('up', true, 'v', l)), transform(sequence(0, l), v -> named_struct('up', false, 'v', v)))"
    )).alias("e")).select(
        *_cols(keys), F.struct("l", "cx", "cy", "chunk").alias("tile"), *box, F.col("e.up").alias("up"),
        F.expr("shiftright(cx, l - e.v)").alias("cx"), F.expr("shiftright(cy, l - e.v)").alias("cy"), F.col("e.v").alias("l"),
    )
    gap = lambda v, a, b: F.greatest(F.col(a) - F.col(v), F.col(v) - F.col(b), F.lit(0.0))
    hit = F.pow(gap("__q.x", "bx0", "bx1"), 2) + F.pow(gap("__q.y", "by0", "by1"), 2) <= F.pow(F.col("reach"), 2)
    pairs = look.join(directory, [*keys, "up", "l", "cx", "cy"]).where(hit & (F.col("tile") != F.col("mine"))).select(
        *_cols(keys), "__q", "reach", "tile.l", "tile.cx", "tile.cy", "tile.chunk"
    )
    # rows outside the circle are dropped in the stage that forms them; ids stay folded per site
    site = pairs.join(tiles.select(*_cols(tile_key), "pts"), tile_key).select(
        *_cols(keys), F.col("__q.x").alias("x"), F.col("__q.y").alias("y"), "reach", F.explode("pts").alias("__s")
    ).withColumn("d2", F.pow(F.col("__s.x") - F.col("x"), 2) + F.pow(F.col("__s.y") - F.col("y"), 2))
    inside = site.where(F.col("d2") <= F.pow(F.col("reach"), 2)).select(*_cols(keys), "x", "y", F.sqrt("d2").alias("d"), F.explode("__s.ids").alias("id"))
    more = inside.groupBy(*_cols(keys), "x", "y").agg(F.collect_list(F.struct("d", "id")).alias("more"))
    best = local.select(*_cols(keys), F.col("__q.x").alias("x"), F.col("__q.y").alias("y"), "near").join(more, [*keys, "x", "y"], "left").select(
        *_cols(keys), "x", "y", F.when(F.col("more").isNull(), F.col("near")).otherwise(F.expr(f"slice(sort_array(concat(near, more)), 1, {k + 1})")).alias("near")
    )
    return _ranked(p.join(best, [*keys, "x", "y"]), keys, k)


def _ranked(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """One row per neighbour from the k + 1 nearest of a place, the row itself left out."""
    # the row's own entry, when present, moves the later ones up by one
    own = F.expr("array_position(transform(near, e -> e.id), id)")
    one = found.select(*_cols(keys), F.col("id").alias("src"), own.alias("own"), F.posexplode("near").alias("pos", "e"))
    rank = F.when((F.col("own") > 0) & (F.col("pos") + 1 > F.col("own")), F.col("pos")).otherwise(F.col("pos") + 1)
    return one.where(F.col("pos") + 1 != F.col("own")).select(
        *_cols(keys), "src", F.col("e.id").alias("dst"), F.col("e.d").alias("dist"), rank.cast("int").alias("rank")
    ).where(F.col("rank") <= k)


# ----------------------------------------------------------------------------------- k nearest in an embedding


def _rows(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in col]) if len(col) else np.zeros((0, 0))


def _pick_nearest(q: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``m``, exact distance) of the n nearest rows and of every row as near as the n-th.

    The product form of the distance only makes a shortlist: both sides are centred, and all rows within the rounding error
    of the n-th are measured exactly, so neither large norms nor ties lose a neighbour.
    """
    middle = m.mean(0)
    a, b = q - middle, m - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    rough = aa[:, None] - 2 * (a @ b.T) + bb[None, :]
    cut = np.partition(rough, min(n, len(m)) - 1, axis=1)[:, min(n, len(m)) - 1]
    slack = 8e-16 * (q.shape[1] + 8) * (aa + bb.max())
    i, j = np.nonzero(rough <= (cut + 2 * slack)[:, None])
    d = np.sqrt(((m[j] - q[i]) ** 2).sum(1))
    order = np.lexsort((d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.searchsorted(i, np.arange(len(q)))
    last = np.minimum(first + min(n, len(m)) - 1, np.append(first[1:], len(i)) - 1)
    keep = d <= d[last][i]
    return i[keep], j[keep], d[keep]


def _near_udf(id_type: str, n: int):
    @F.pandas_udf(f"array<array<struct<d:double,id:{id_type}>>>")
    def near(queries: pd.Series, blocks: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for qs, ms, id_lists in zip(queries, blocks, ids):
            q, m = _rows(qs), _rows(ms)
            found: list[list] = [[] for _ in range(len(q))]
            for s in range(0, len(q), 512):
                for i, j, d in zip(*(x.tolist() for x in _pick_nearest(q[s : s + 512], m, n))):
                    found[s + i].extend((d, x) for x in id_lists[j])
            out.append([[{"d": d, "id": x} for d, x in sorted(e)[:n]] for e in found])
        return pd.Series(out)

    return near


MAX_PIVOT_ROWS = 20_000


def _to_closest_pivot(sites: DataFrame, pivots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Column ``a`` (pivot, d): the closest pivot of the row's group.

    A small pivot table goes to the tasks as one array per group; a larger one is joined and compared by expression.
    """
    rows = pivots.limit(MAX_PIVOT_ROWS + 1).collect()
    if len(rows) > MAX_PIVOT_ROWS:
        packed = pivots.groupBy(*_cols(keys)).agg(F.collect_list(F.struct("pivot", "pv")).alias("ps"))
        far = "sqrt(aggregate(zip_with(e.pv, v, (a, b) -> pow(a - b, 2)), 0D, (s, t) -> s + t))"
        best = F.expr(f"array_min(transform(ps, e -> named_struct('d', {far}, 'pivot', e.pivot)))")
        return sites.join(packed, list(keys)).withColumn("a", best).drop("ps")
    table: dict = {}
    for r in rows:
        table.setdefault("\x1f".join(str(r[k]) for k in keys), []).append((r["pivot"], r["pv"]))
    packed_np = {g: (np.array([e[0] for e in es]), np.array([e[1] for e in es], float)) for g, es in table.items()}

    @F.pandas_udf("struct<pivot:int,d:double>")
    def closest(group: pd.Series, v: pd.Series) -> pd.DataFrame:
        pivot, dist = np.zeros(len(v), np.int32), np.zeros(len(v))
        for g, at in group.groupby(group, sort=False).indices.items():
            number, m = packed_np[g]
            i, j, d = _pick_nearest(_rows(v.iloc[at]), m, 1)
            one = np.searchsorted(i, np.arange(len(at)))
            pivot[at], dist[at] = number[j[one]], d[one]
        return pd.DataFrame({"pivot": pivot, "d": dist})

    return sites.withColumn("a", closest(F.concat_ws("\x1f", *[c(k).cast("string") for k in keys]), F.col("v")))


def nearest_in_embedding(points: DataFrame, keys: Sequence[str], k: int, id_col: str = "cell_id", vec: str = "embedding", n_pivots: int | None = None, probes: int | None = None, cap: int = 512, seed: int = 0) -> DataFrame:
    """k nearest rows by Euclidean distance of an array column: (src, dst, dist, rank), self excluded, ties by id.

    Rows go to the nearest of ``n_pivots`` hash-chosen pivots of their group (the square root of its size, unless given) and
    are packed into blocks of about ``cap`` rows. A block is compared with the blocks that the triangle inequality cannot
    rule out, which is exact; block pairs are chosen before any vector moves. ``probes`` limits the comparison to the blocks
    of the nearest pivots: the usual approximate search, and the one to use for large tables of high dimension, in which
    little can be ruled out. Keys of any type, null included, make groups.
    """
    keys = list(keys)
    id_type = points.schema[id_col].dataType.simpleString()
    row = [c(id_col).alias("id"), c(vec).cast("array<double>").alias("v")]
    if keys:
        groups = materialize(points.select(*_cols(keys)).distinct().withColumn("__g", F.monotonically_increasing_id()))
        named = groups.select("__g", *[c(x).alias(f"__k_{x}") for x in keys])
        on = [c(x).eqNullSafe(c(f"__k_{x}")) for x in keys]
        p = points.select(*_cols(keys), *row).join(sized(named), reduce(lambda a, b: a & b, on)).select("__g", "id", "v")
    else:
        p = points.select(F.lit(0).cast("long").alias("__g"), *row)
    found = _nearest_of_groups(p.where("v is not null"), k, id_type, n_pivots, probes, cap, seed)
    if not keys:
        return found.drop("__g")
    return found.join(sized(groups), "__g").select(*_cols(keys), "src", "dst", "dist", "rank")


GROUP_BLOCKS = 64


def _across_blocks(local: DataFrame, pairs: DataFrame, k: int, id_type: str, per_group: int = GROUP_BLOCKS) -> DataFrame:
    """(__g, v, near): for every row its nearest in the other blocks that ``pairs`` names; a row at most for each row of ``local``.

    About ``per_group`` blocks of queries are held by one task, and every block that one of them asks for is sent there once and
    streamed past: neither queries nor candidates are shuffled for each pair of blocks. A row keeps what is as near as its k + 1st.
    """
    block_key = ["__g", "pivot", "chunk"]
    groups = max(math.ceil(local.count() / per_group), local.sparkSession.sparkContext.defaultParallelism)
    group = F.pmod(F.xxhash64(*block_key), F.lit(groups)).alias("grp")
    kth = F.expr(f"transform(near, e -> if(size(e) > {k}, element_at(e, {k + 1}).d, double('Infinity')))")
    wants, ids = "array<struct<pivot:int,chunk:bigint>>", f"array<array<{id_type}>>"
    queries = local.select(group, F.lit(0).alias("kind"), *block_key, F.col("pts.v").alias("v"), kth.alias("kth"), F.lit(None).cast(ids).alias("ids"), F.lit(None).cast(wants).alias("wants"))
    asked = pairs.groupBy(group, "__g", "to", "to_chunk").agg(F.collect_list(F.struct("pivot", "chunk")).cast(wants).alias("wants"))
    asked = asked.withColumnsRenamed({"to": "pivot", "to_chunk": "chunk"}).join(local.select(*block_key, "pts"), block_key)
    blocks = asked.select("grp", F.lit(1).alias("kind"), *block_key, F.col("pts.v").alias("v"), F.lit(None).cast("array<double>").alias("kth"), F.col("pts.ids").alias("ids"), "wants")
    met = spread(queries.unionByName(blocks), ["grp"]).sortWithinPartitions("grp", "kind")

    def dense(vs: pa.ListArray) -> np.ndarray:
        return vs.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vs), -1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        now, kind = None, None

        def done() -> Iterator[pa.RecordBatch]:
            for (g, _, _), (vs, _, _, found) in held.items():
                rows = [i for i, e in enumerate(found) if e]
                near = [[{"d": d, "id": x} for d, x in sorted(found[i])[: k + 1]] for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(rows), pa.int64()), vs.take(pa.array(rows, pa.int64())), pa.array(near, pa.list_(pa.struct([("d", pa.float64()), ("id", kind)])))], names=["__g", "v", "near"])

        for batch in batches:
            kind = batch.column("ids").type.value_type.value_type
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                if one["grp"].as_py() != now:
                    yield from done()
                    held, now = {}, one["grp"].as_py()
                g, vs = one["__g"].as_py(), one["v"].values
                if one["kind"].as_py() == 0:
                    far = one["kth"].values.to_numpy(zero_copy_only=False).copy()
                    held[g, one["pivot"].as_py(), one["chunk"].as_py()] = (vs, dense(vs), far, [[] for _ in range(len(vs))])
                    continue
                m, ids = dense(vs), one["ids"].as_py()
                middle = m.mean(0)
                b = m - middle
                bb = (b * b).sum(1)
                for w in one["wants"].as_py():
                    _, q, far, found = held[g, w["pivot"], w["chunk"]]
                    for at in range(0, len(q), 512):
                        part = q[at : at + 512]
                        a = part - middle
                        aa = (a * a).sum(1)
                        slack = 8e-16 * (q.shape[1] + 8) * (aa + bb.max())
                        limit = far[at : at + 512]
                        i, j = np.nonzero(aa[:, None] - 2 * (a @ b.T) + bb[None, :] <= (limit * limit * (1 + 1e-12) + 2 * slack)[:, None])
                        d = np.sqrt(((m[j] - part[i]) ** 2).sum(1))
                        keep = d <= limit[i]
                        for x, y, e in zip((i[keep] + at).tolist(), j[keep].tolist(), d[keep].tolist()):
                            if e > far[x]:  # lowered since
                                continue
                            found[x].extend((e, v) for v in ids[y])
                            if len(found[x]) > 4 * (k + 1):
                                found[x] = sorted(found[x])[: k + 1]
                                far[x] = min(far[x], found[x][-1][0])
        yield from done()

    return met.select("grp", "kind", *block_key, "v", "kth", "ids", "wants").mapInArrow(search, f"__g long, v array<double>, near array<struct<d:double,id:{id_type}>>")


def _nearest_of_groups(p: DataFrame, k: int, id_type: str, n_pivots: int | None, probes: int | None, cap: int, seed: int) -> DataFrame:
    """The search over rows (__g, id, v)."""
    keys = ["__g"]
    sites = materialize(_sites(p, keys, ["v"], k))
    wanted = sites.groupBy("__g").agg((F.lit(n_pivots) if n_pivots else F.ceil(F.sqrt(F.count(F.lit(1))))).cast("int").alias("wanted"))
    # about the wanted number by a hash threshold, so that no group is ordered whole; the smallest hash is always there
    h = F.pmod(F.xxhash64(F.lit(seed), F.col("v")), F.lit(1 << 40))
    hashed = sites.select("__g", "v", h.alias("h"))
    n = hashed.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    share = F.least(F.lit(1.0), 2.0 * F.col("wanted") / F.col("n")) * float(1 << 40)
    near_least = attach(attach(hashed, wanted, keys), n, keys).where((F.col("h") <= share) | (F.col("h") == F.col("least")))
    pivot_rank = Window.partitionBy("__g").orderBy("h", "v")
    chosen = near_least.withColumn("pivot", F.row_number().over(pivot_rank)).where(F.col("pivot") <= F.col("wanted"))
    pivots = materialize(chosen.select("__g", "pivot", F.col("v").alias("pv")))
    placed = materialize(_to_closest_pivot(sites, pivots, keys).select("__g", "v", "ids", "a.pivot", F.col("a.d").alias("pd")))
    sizes = placed.groupBy("__g", "pivot").agg(F.ceil(F.count(F.lit(1)) / cap).cast("long").alias("chunks"))
    block_key = ["__g", "pivot", "chunk"]
    blocks = materialize(
        attach(placed, sizes, ["__g", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64(F.col("v")), F.col("chunks")))
        .groupBy(*block_key).agg(
            F.collect_list(F.struct("v", "ids")).alias("pts"), F.min("pd").alias("r_min"), F.max("pd").alias("r_max")
        )
    )
    near = _near_udf(id_type, k + 1)
    local = materialize(
        spread(blocks, block_key).select(*block_key, "r_min", "r_max", "pts", near(F.col("pts.v"), F.col("pts.v"), F.col("pts.ids")).alias("near"))
        .withColumn("reach", F.expr(f"array_max(transform(near, e -> if(size(e) > {k}, element_at(e, {k + 1}).d, double('Infinity'))))"))
    )
    gap = pivots.select("__g", "pivot", "pv")
    far = F.expr("sqrt(aggregate(zip_with(pv, qv, (a, b) -> pow(a - b, 2)), 0D, (s, e) -> s + e))")
    other = gap.select("__g", F.col("pivot").alias("to"), F.col("pv").alias("qv"))
    steps = gap.join(other, keys).select("__g", "pivot", "to", far.alias("gap"))
    if probes is not None:
        steps = steps.withColumn("__rn", F.row_number().over(Window.partitionBy("__g", "pivot").orderBy("gap", "to"))).where(F.col("__rn") <= probes).drop("__rn")
    one = local.select(*block_key, "r_max", "reach")
    two = local.select("__g", F.col("pivot").alias("to"), F.col("chunk").alias("to_chunk"), "r_min", F.col("r_max").alias("to_max"))
    lower = F.greatest(F.col("gap") - F.col("r_max") - F.col("to_max"), F.col("r_min") - F.col("gap") - F.col("r_max"))
    slack = 1e-9 * (F.col("gap") + F.col("r_max") + F.col("to_max"))
    same = (F.col("pivot") == F.col("to")) & (F.col("chunk") == F.col("to_chunk"))
    pairs = one.join(steps, ["__g", "pivot"]).join(two, ["__g", "to"]).where((lower <= F.col("reach") + slack) & ~same)
    pairs = materialize(pairs.select(*block_key, "to", "to_chunk"))
    more = _across_blocks(local, pairs, k, id_type)
    mine = local.select("__g", F.explode(F.arrays_zip(F.col("pts.v").alias("v"), "near")).alias("z")).select("__g", "z.v", "z.near")
    best = mine.unionByName(more).groupBy("__g", "v").agg(F.expr(f"slice(sort_array(flatten(collect_list(near))), 1, {k + 1})").alias("near"))
    return _ranked(p.join(best, ["__g", "v"]), keys, k)


def symmetric(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Undirected closure: both directions of every edge, once each. The edges are stored first, since they are read twice."""
    edges = materialize(edges.select(*_cols(keys), "src", "dst", "dist"))
    back = edges.select(*_cols(keys), F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return edges.select(*_cols(keys), "src", "dst", "dist").unionByName(back).groupBy(*_cols(keys), "src", "dst").agg(F.min("dist").alias("dist"))

