"""Sums over neighbours for iterative work on graphs: edges and values travel as arrays of a block of nodes.

A node belongs to a block of its graph by hash; a block has about ``BLOCK_EDGES`` edges, so no task holds a graph. Edges between two
blocks are a tile, two arrays of places. A round moves every tile, every block's values and one sum for each node that a tile
reaches; no edge becomes a row after the tiles are made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.scale import c, materialize, sized

BLOCK_EDGES = 1 << 19


@dataclass(frozen=True)
class Adjacency:
    """``groups``: (keys, g). ``blocks``: (g, b, ids, deg), a row for each block. ``tiles``: (g, b, to, src, dst), places in b and in to."""

    groups: DataFrame
    blocks: DataFrame
    tiles: DataFrame


def adjacency(edges: DataFrame, keys: Sequence[str], block_edges: int = BLOCK_EDGES) -> Adjacency:
    """Blocks and tiles of the directed edges (keys, src, dst), repeats counted; nodes are the sources, with all their edges as degree.

    Edges to what is no source count in the degree and lead nowhere, as do nulls; edges from null are left out.
    """
    keys = list(keys)
    base = edges.select(*[c(x) for x in keys], "src", "dst") if keys else edges.select(F.lit(0).alias("__all"), "src", "dst")
    own = keys or ["__all"]
    base = base.where("src is not null")
    cut = F.ceil(F.count(F.lit(1)) / block_edges).cast("long").alias("__n")
    groups = materialize(base.groupBy(*[c(x) for x in own]).agg(cut).withColumn("g", F.monotonically_increasing_id()))
    named = groups.select("g", "__n", *[c(x).alias(f"__k_{x}") for x in own])
    on = reduce(lambda a, b: a & b, [c(x).eqNullSafe(c(f"__k_{x}")) for x in own])
    block = lambda v: F.pmod(F.xxhash64(v), F.col("__n")).cast("int")
    links = base.join(sized(named), on).select("g", block("src").alias("b"), block("dst").alias("to"), "src", "dst")
    kind = edges.schema["src"].dataType.simpleString()

    def cut_up(table: pa.Table) -> pa.Table:
        """One row with the block's nodes in order and their degrees, and one for each block its edges lead to."""
        g, b = table["g"][0].as_py(), table["b"][0].as_py()
        counted = pc.value_counts(table["src"].combine_chunks())
        order = pc.sort_indices(counted.field("values"))
        ids, deg = counted.field("values").take(order), counted.field("counts").take(order)
        src = pc.index_in(table["src"].combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int32)
        to, far = table["to"].to_numpy(), table["dst"].combine_chunks()
        by = np.argsort(to, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(to[by]) != 0])
        ends = np.r_[at, len(by)]
        none = pa.nulls(len(at), pa.binary())
        rows = pa.table({
            "g": pa.array([g] * len(at), pa.int64()), "b": pa.array([b] * len(at), pa.int32()), "to": pa.array(to[by][at], pa.int32()),
            "src": pa.array([src[by[i:j]].tobytes() for i, j in zip(ends, ends[1:])], pa.binary()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), far.take(pa.array(by))), "deg": none})
        block = pa.table({
            "g": pa.array([g], pa.int64()), "b": pa.array([b], pa.int32()), "to": pa.nulls(1, pa.int32()), "src": pa.nulls(1, pa.binary()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "deg": pa.array([deg.to_numpy().astype(np.float64).tobytes()], pa.binary())})
        return pa.concat_tables([block, rows])

    pieces = materialize(links.groupBy("g", "b").applyInArrow(cut_up, f"g long, b int, to int, src binary, ids array<{kind}>, deg binary"))
    blocks = pieces.where("to is null").select("g", "b", "ids", "deg")

    def placed(tiles: pa.Table, nodes: pa.Table) -> pa.Table:
        """The tiles that lead to a block, with places for names, in the order of the places they lead to."""
        empty = pa.table({"g": pa.array([], pa.int64()), "b": pa.array([], pa.int32()), "to": pa.array([], pa.int32()), "src": pa.array([], pa.binary()), "dst": pa.array([], pa.binary())})
        if not nodes.num_rows:
            return empty
        ids, out = nodes["ids"].combine_chunks().flatten(), []
        far = pc.index_in(tiles["ids"].combine_chunks().flatten(), value_set=ids)
        far, known, lo = far.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32), far.is_valid().to_numpy(zero_copy_only=False), 0
        for i in range(tiles.num_rows):
            src = np.frombuffer(tiles["src"][i].as_py(), np.int32)
            dst, there = far[lo : lo + len(src)], known[lo : lo + len(src)]
            lo += len(src)
            src, dst = src[there], dst[there]
            order = np.argsort(dst, kind="stable")
            if len(order):
                out.append((tiles["g"][i].as_py(), tiles["b"][i].as_py(), tiles["to"][i].as_py(), src[order].tobytes(), dst[order].tobytes()))
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), empty.schema.types)], schema=empty.schema) if out else empty

    led = pieces.where("to is not null").select("g", "b", "to", "src", "ids")
    tiles = materialize(led.groupBy("g", "to").cogroup(blocks.groupBy("g", "b")).applyInArrow(placed, "g long, b int, to int, src binary, dst binary"))
    return Adjacency(groups.drop("__n"), blocks, tiles)


def neighbour_round(graph: Adjacency, state: DataFrame, values: Callable[[pa.Table], np.ndarray], update: Callable[[pa.Table, np.ndarray], dict[str, object]], schema: str) -> DataFrame:
    """(g, b, schema) of every block: ``update`` of its row of ``state`` and the sums that its nodes get, nodes x columns.

    ``values`` gives what the nodes of a block send along their edges, nodes x columns, from its row of ``state`` (g, b, ...).
    """

    def send(tiles: pa.Table, own: pa.Table) -> pa.Table:
        x, to, at, sums = values(own) if tiles.num_rows else None, [], [], []
        for i in range(tiles.num_rows):
            src, dst = (np.frombuffer(tiles[v][i].as_py(), np.int32) for v in ("src", "dst"))
            starts = np.flatnonzero(np.r_[True, np.diff(dst) != 0])
            to.append(tiles["to"][i].as_py())
            at.append(dst[starts].tobytes())
            sums.append(np.add.reduceat(x[src], starts, axis=0).tobytes())
        g = own["g"][0].as_py() if own.num_rows else 0
        return pa.table({"g": pa.array([g] * len(to), pa.int64()), "b": pa.array(to, pa.int32()), "at": pa.array(at, pa.binary()), "s": pa.array(sums, pa.binary())})

    def receive(sent: pa.Table, own: pa.Table) -> pa.Table:
        x = values(own)
        got = np.zeros_like(x)
        for i in range(sent.num_rows):
            at = np.frombuffer(sent["at"][i].as_py(), np.int32)
            got[at] += np.frombuffer(sent["s"][i].as_py(), np.float64).reshape(len(at), *x.shape[1:])
        new = update(own, got)
        return pa.table({"g": own["g"], "b": own["b"], **{k: pa.array([v.tobytes() if isinstance(v, np.ndarray) else v]) for k, v in new.items()}})

    sent = graph.tiles.groupBy("g", "b").cogroup(state.groupBy("g", "b")).applyInArrow(send, "g long, b int, at binary, s binary")
    return materialize(sent.groupBy("g", "b").cogroup(state.groupBy("g", "b")).applyInArrow(receive, f"g long, b int, {schema}"))


def doubles(table: pa.Table, name: str) -> np.ndarray:
    """The doubles that a column of a block's row holds, as bytes or as a list."""
    if pa.types.is_list(table.schema.field(name).type):
        return table[name].combine_chunks().flatten().to_numpy()
    return np.frombuffer(table[name][0].as_py(), np.float64)


def node_rows(state: DataFrame, columns: dict[str, int], id_type: str) -> DataFrame:
    """(g, node, columns): a row for each node from rows (g, b, ids, columns) of blocks; a width above 1 gives arrays."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                out = [pa.array(np.full(len(ids), batch.column("g")[i].as_py()), pa.int64()), ids]
                for name, width in columns.items():
                    x = pa.array(np.frombuffer(batch.column(name)[i].as_py(), np.float64))
                    out.append(x if width == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * width, pa.int32()), x))
                yield pa.RecordBatch.from_arrays(out, names=["g", "node", *columns])

    kinds = ", ".join(f"{name} {'double' if width == 1 else 'array<double>'}" for name, width in columns.items())
    return state.mapInArrow(rows, f"g long, node {id_type}, {kinds}")
