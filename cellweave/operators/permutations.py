"""Label permutations of every group, carried as one short binary a cell.

A permutation is the order of a hash of (seed, permutation, id) within the group, as in the SQL form: the cell at rank r of the id
order gets the label of the cell at rank r of the hash order. Labels are small integers; what is shuffled once is a hash prefix
and a label for each cell and permutation. Ranks are cut into hash ranges of bounded size, so no task holds a group, and the
permutations of a range of cells are put side by side in one task of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.operators.neighbors import PairsWithin, block_columns, near_blocks
from cellweave.scale import c, materialize, row_numbers, sized, spread

RANGE = 4096  # cells
DENSE_LABELS = 64
MAX_LABELS = 60_000


@dataclass(frozen=True)
class Permuted:
    """``rows``: g, id, codes (one code for each permutation, 0 the real one); ``groups``: g and the keys; ``labels`` by code."""

    rows: DataFrame
    groups: DataFrame
    labels: list
    n_perm: int

    @property
    def kind(self) -> str:
        return "<u1" if len(self.labels) <= 256 else "<u2"

    def label(self, code: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in self.labels]), code.cast("int") + 1)


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows x permutations of codes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def numbered_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, g): a number for each group, stored."""
    return materialize(df.select(*[c(k) for k in keys]).distinct().withColumn("g", F.monotonically_increasing_id()))


def with_group(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = groups.select("g", *[c(k).alias(f"__k_{k}") for k in keys])
    return df.join(sized(named), reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"__k_{k}")) for k in keys])).drop(*[f"__k_{k}" for k in keys])


def permuted_codes(cells: DataFrame, keys: Sequence[str], id_col: str, label: str, n_perm: int, seed: int) -> Permuted:
    """Cells with a label and their labels under the permutations; ids are unique within a group."""
    keys = list(keys)
    names = [r[0] for r in cells.select(c(label).alias("l")).where("l is not null").distinct().orderBy("l").limit(MAX_LABELS + 1).collect()]
    if len(names) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    groups = numbered_groups(cells, keys)
    codes = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else F.lit(None).cast("map<string,int>")
    own = with_group(cells.select(*[c(k) for k in keys], c(id_col).alias("id"), c(label).alias("l")), groups, keys)
    base = materialize(row_numbers(own.select("g", "id", codes[F.col("l")].alias("code")).where("code is not null"), ["g"], ["id"], "rn"))
    kind = "<u1" if len(names) <= 256 else "<u2"
    real = F.unhex(F.lpad(F.hex("code"), 2, "0")) if kind == "<u1" else F.unhex(F.concat(F.lpad(F.hex(F.col("code") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("code") / 256)), 2, "0")))
    joined = base.join(moved_codes(base, kind, n_perm, seed), ["g", "rn"], "left") if n_perm else base.withColumn("moved", F.lit(b""))
    return Permuted(materialize(joined.select("g", "id", F.concat(real, F.coalesce("moved", F.lit(b""))).alias("codes"))), groups, names, n_perm)


def moved_codes(base: DataFrame, kind: str, n_perm: int, seed: int) -> DataFrame:
    """(g, rn, moved): for the cells (g, id, rn, code) of stored groups, the codes that the permutations move to place ``rn``, side by side."""
    sizes = base.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / RANGE).cast("long").alias("ranges"))

    wide = np.dtype(kind).itemsize

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes and codes of some cells at a time, side by side for every permutation and range, at most 512 to a row."""
        perms = [f"{seed}|{p}|".encode() for p in range(1, n_perm + 1)]
        held: list[pa.RecordBatch] = []
        step = max(1000, 4_000_000 // max(1, n_perm))

        def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = [v if v is None else v.encode() for v in rows.column("text").to_pylist()]
            g, ranges, code = (rows.column(c_).to_numpy() for c_ in ("g", "ranges", "code"))
            code = code.astype(kind)
            for at in range(0, len(perms), 16):
                some = perms[at : at + 16]
                h = np.frombuffer(b"".join([hashlib.md5(p[:-1] if i is None else p + i).digest()[:8] for p in some for i in ids]), ">u8").astype(np.uint64).reshape(len(some), -1)
                bucket = np.minimum((h.astype(np.float64) / 2.0**64 * ranges).astype(np.int64), ranges - 1)
                columns: tuple[list, ...] = ([], [], [], [], [])
                for p in range(len(some)):
                    order = np.lexsort((bucket[p], g))
                    first = np.flatnonzero((np.arange(len(order)) % 512 == 0) | np.append(True, (np.diff(g[order]) != 0) | (np.diff(bucket[p][order]) != 0)))
                    last = np.append(first[1:], len(order))
                    hs, cs = h[p][order].astype(">u8").tobytes(), code[order].tobytes()
                    columns[0].extend(g[order][first].tolist())
                    columns[1].extend([at + p + 1] * len(first))
                    columns[2].extend(bucket[p][order][first].tolist())
                    columns[3].extend(hs[8 * i : 8 * j] for i, j in zip(first, last))
                    columns[4].extend(cs[wide * i : wide * j] for i, j in zip(first, last))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["g", "perm", "bucket", "h", "code"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= step:
                yield from packed(pa.Table.from_batches(held))
                held = []
        if held and sum(b.num_rows for b in held):
            yield from packed(pa.Table.from_batches(held))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The codes of each range in the order of their hashes; the parts of a range follow each other."""
        now, hs, cs = None, [], []

        def done() -> pa.RecordBatch:
            h, code = np.frombuffer(b"".join(hs), ">u8"), np.frombuffer(b"".join(cs), kind)
            codes = code[np.lexsort((code, h))]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([now[2]], pa.int64()), pa.array([len(codes)], pa.int64()), pa.array([codes.tobytes()], pa.binary())], names=["g", "perm", "bucket", "n", "codes"])

        for batch in batches:
            for g, p, b, h, code in zip(*(batch.column(c_).to_pylist() for c_ in ("g", "perm", "bucket", "h", "code"))):
                if (g, p, b) != now:
                    if now is not None:
                        yield done()
                    now, hs, cs = (g, p, b), [], []
                hs.append(h)
                cs.append(code)
        if now is not None:
            yield done()

    asked = base.join(sized(sizes), "g").select("g", F.col("id").cast("string").alias("text"), "code", "ranges")
    rows = asked.mapInArrow(hashed, "g long, perm int, bucket long, h binary, code binary")
    # about RANGE entries a list
    lists = spread(rows, ["g", "perm", "bucket"]).sortWithinPartitions("g", "perm", "bucket").mapInArrow(ordered, "g long, perm int, bucket long, n long, codes binary")
    lists = materialize(lists)
    before = Window.partitionBy("g", "perm").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    placed = lists.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    end = F.col("start") + F.col("n")
    blocks = F.sequence(F.floor(F.col("start") / RANGE), F.floor((end - 1) / RANGE))
    first = lambda b: F.greatest(F.col("start"), b * RANGE)
    last = lambda b: F.least(end, (b + 1) * RANGE)
    piece = lambda b: F.struct(b.alias("block"), first(b).alias("first"), F.substring("codes", ((first(b) - F.col("start")) * wide + 1).cast("int"), ((last(b) - first(b)) * wide).cast("int")).alias("codes"))
    pieces = placed.select("g", "perm", F.explode(F.transform(blocks, piece)).alias("p")).select("g", "perm", "p.block", "p.first", "p.codes")

    def beside(table: pa.Table) -> pa.Table:
        block, perm, start = table.column("block")[0].as_py(), table.column("perm").to_numpy(), table.column("first").to_numpy()
        held = [np.frombuffer(v, kind) for v in table.column("codes").to_pylist()]
        m = int(max(s + len(v) for s, v in zip(start, held))) - block * RANGE
        out = np.zeros((m, n_perm), kind)
        for p, s, v in zip(perm, start - block * RANGE, held):
            out[s : s + len(v), p - 1] = v
        n = pa.array(np.full(m, table.column("g")[0].as_py()))
        return pa.table({"g": n, "rn": pa.array(block * RANGE + np.arange(1, m + 1)), "moved": pa.array([r.tobytes() for r in out], pa.binary())})

    return pieces.groupBy("g", "block").applyInArrow(beside, "g long, rn long, moved binary")


def pair_counts(edges: DataFrame, p: Permuted, keys: Sequence[str]) -> DataFrame:
    """(g, perm, a, b, n): edges by the codes of their ends, under every permutation; counted in the task, one row an edge."""
    size, width, kind = len(p.labels), p.n_perm + 1, p.kind
    side = lambda k: p.rows.select("g", F.col("id").alias(k), F.col("codes").alias(f"c_{k}"))
    j = with_group(edges.select(*[c(k) for k in keys], "src", "dst"), p.groups, keys).select("g", "src", "dst").join(side("src"), ["g", "src"]).join(side("dst"), ["g", "dst"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 4_000_000 // width)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                g, a, b = part.column(0).to_numpy(), matrix(part.column(1), kind, width).astype(np.int64), matrix(part.column(2), kind, width)
                groups, g = np.unique(g, return_inverse=True)
                key = ((g[:, None] * width + np.arange(width)[None, :]) * size + a) * size + b
                found, n = np.unique(key.ravel(), return_counts=True)
                rest, y = np.divmod(found, size)
                rest, x = np.divmod(rest, size)
                gi, perm = np.divmod(rest, width)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, (groups[gi], perm, x, y, n))), names=["g", "perm", "a", "b", "n"])

    return j.select("g", "c_src", "c_dst").mapInArrow(count, "g long, perm long, a long, b long, n long").groupBy("g", "perm", "a", "b").agg(F.sum("n").cast("double").alias("n"))


def _label_pairs(near: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """width x size x size: pairs of ``near`` (rows x rows) by the codes (rows x width) of their ends, as products of indicators."""
    width, out = a.shape[1], np.zeros((a.shape[1], size, size))
    codes, step = np.arange(size), max(1, 8_000_000 // (size * max(a.shape[0], b.shape[0])))
    kind = np.float32 if near.size < 1 << 24 else np.float64  # exact counts
    near = near.astype(kind)
    for p in range(0, width, step):
        q = min(width, p + step)
        left, right = ((m[:, p:q, None] == codes).astype(kind) for m in (a, b))
        met = (near @ right.reshape(len(b), -1)).reshape(len(a), q - p, size)
        out[p:q] = np.matmul(left.transpose(1, 2, 0), met.transpose(1, 0, 2))
    return out


def pair_counts_within(pairs: PairsWithin, p: Permuted) -> DataFrame:
    """``pair_counts`` of the pairs within a distance, which never become rows: two blocks of cells meet in a task and leave counts."""
    keys, r = list(pairs.keys), float(pairs.r)
    size, width, kind = len(p.labels), p.n_perm + 1, p.kind
    own = with_group(pairs.rows(), p.groups, keys).select("g", "id", "x", "y").join(p.rows, ["g", "id"])
    met = near_blocks(own, ["g"], r, ["codes"])

    def codes(block: dict[str, np.ndarray]) -> np.ndarray:
        return np.frombuffer(b"".join(block["codes"]), kind).reshape(len(block["id"]), width)

    def sparse(g, counts: np.ndarray) -> pa.RecordBatch:
        perm, x, y = np.nonzero(counts)
        columns = (np.full(len(perm), g), perm, x, y, counts[perm, x, y].astype(np.int64))
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["g", "perm", "a", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                g, same, one = batch.column("g")[row].as_py(), batch.column("same")[row].as_py(), block_columns(batch, "one", row)
                two = one if same else block_columns(batch, "two", row)
                ca, cb = codes(one), codes(two)
                for at in range(0, len(ca), 2048):
                    part = slice(at, at + 2048)
                    dx, dy = one["x"][part, None] - two["x"], one["y"][part, None] - two["y"]
                    near = (dx * dx + dy * dy <= r * r) & (one["id"][part, None] != two["id"])
                    if not near.any():
                        continue
                    if size <= DENSE_LABELS:
                        n = _label_pairs(near, ca[part], cb, size)
                        if g not in held and len(held) * width * size * size > 4_000_000:
                            yield from (sparse(*e) for e in held.items())
                            held = {}
                        held[g] = held.get(g, 0) + (n if same else n + n.transpose(0, 2, 1))
                        continue
                    i, j = np.nonzero(near)
                    for perm in range(width):
                        x, y = ca[part][i, perm].astype(np.int64), cb[j, perm].astype(np.int64)
                        found, m = np.unique(x * size + y if same else np.concatenate([x * size + y, y * size + x]), return_counts=True)
                        columns = (np.full(len(m), g), np.full(len(m), perm), found // size, found % size, m)
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["g", "perm", "a", "b", "n"])
        yield from (sparse(*e) for e in held.items())

    return met.mapInArrow(count, "g long, perm long, a long, b long, n long").groupBy("g", "perm", "a", "b").agg(F.sum("n").cast("double").alias("n"))


def sums_by_label(values: DataFrame, p: Permuted, keys: Sequence[str], feature: str = "gene") -> DataFrame:
    """(g, feature, perm, t, s): sums of (keys, id, feature, v) by feature and code, under every permutation, added up in the task."""
    size, width, kind = len(p.labels), p.n_perm + 1, p.kind
    j = with_group(values.select(*[c(k) for k in keys], "id", c(feature).alias("f"), F.col("v").cast("double").alias("v")), p.groups, keys).join(p.rows, ["g", "id"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 4_000_000 // width)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                pair = part.select(["g", "f"]).to_pandas()
                unit, names = pair.groupby(["g", "f"], sort=False).ngroup().to_numpy(), pair.drop_duplicates(ignore_index=True)
                key = (unit[:, None] * width + np.arange(width)[None, :]) * size + matrix(part.column("codes"), kind, width)
                found, at_ = np.unique(key.ravel(), return_inverse=True)
                s = np.bincount(at_, np.repeat(part.column("v").to_numpy(), width), len(found))
                rest, t = np.divmod(found, size)
                u, perm = np.divmod(rest, width)
                columns = [pa.array(names["g"].to_numpy()[u]), pa.array(names["f"].to_numpy()[u], pa.string()), pa.array(perm), pa.array(t), pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "f", "perm", "t", "s"])

    found = j.select("g", "f", "v", "codes").mapInArrow(add, "g long, f string, perm long, t long, s double")
    return found.groupBy("g", "f", "perm", "t").agg(F.sum("s").alias("s")).withColumnRenamed("f", feature)
