"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Equal vectors are one class and are compared once. Spherical k-means cells are fitted on a bounded seeded sample; every class is
indexed in the cell of its nearest centroid (its home) and, as a guest, in each cell whose centroid is so little farther that
a link may be waiting there. For centroids a and b and unit vectors u and v at most r apart, (u - v).(a - b) <= r |a - b|. If
a is nearest to v and b to u, then v is at most r |a - b| / 2 closer to a than to b, or u is to b than to a: so v is a guest in
u's home or u in v's. The index loses no link, whatever the sample was.

The homes of a cell are compared with all that is present there, in blocks, one task per pair of blocks, by double-precision
matrix products; a task returns link counts and a spanning star of each local component, never all pairs. A pair that meets
in both homes is counted by each side in its own, a pair that meets in one home only is counted there for both.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing and is kept;
vectors of different lengths do not link; repeated rows count as vectors of their own; null ids link but are no component
ids; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, release_memory, seeded
from cellweave.llm.components import components, group_bounds, local_stars, whole_groups


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows ``x`` under cosine similarity."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        centers = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], centers)
    return np.unique(centers, axis=0)


def cells_of(x: np.ndarray, centers: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell) of each presence of unit rows, by row and cell, and the home cell of each row."""
    reach = math.sqrt(2 - 2 * cosine) / 2
    s = x @ centers.T
    home = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (centers @ centers.T)))[home]
    within = s.max(axis=1)[:, None] - s <= reach * (1 + 1e-9) * apart + 1e-9
    within[np.arange(len(x)), home] = True
    return *np.nonzero(within), home


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def near_duplicates(rows: DataFrame, cosine: float = 0.95, cell_rows: int = 512, sample_rows: int = 16_384, block_rows: int = 2048, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row (vec_id, embedding)."""
    v = F.col("embedding")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "float" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(f"array<{kind}>").alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))
    classes = materialize(
        given.where("usable").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v"))
    )
    links = []
    for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():  # vector lengths in use
        links.append(_links(classes.where(F.col("dim") == r["dim"]), r["n"], kind, cosine, cell_rows, sample_rows, block_rows, seed))
    if links:
        found = links[0]
        for other in links[1:]:
            found = found.unionByName(other)
        found = materialize(found)
        counts = found.where("u = w").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("n"))
        labels = components(found.where("u <> w").select("u", F.col("w").alias("v")))
        named = classes.drop("v", "dim").join(counts, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        named = materialize(named.select("cid", "first_id", (F.coalesce("n", "copies") - 1).alias("n_links"), F.coalesce("label", "cid").alias("label")))
        least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
        result = named.join(least, "label").select("cid", "n_links", "component_id")
        by_vector = classes.select("cid", "v").join(result, "cid")
    else:
        by_vector = classes.select("cid", "v", F.lit(0).cast("long").alias("n_links"), F.col("first_id").alias("component_id"))
    joined = given.where("usable").join(by_vector, "v").select("vec_id", "n_links", "component_id")
    alone = given.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, total: int, kind: str, cosine: float, cell_rows: int, sample_rows: int, block_rows: int, seed: int) -> DataFrame:
    """Rows (u, w, n): for u = w vectors linked with class u, itself included, to be summed; else an edge of a star."""
    chosen = classes.orderBy(seeded(seed, F.col("v")), "cid").limit(sample_rows).select("v").toArrow()
    sample = unit_rows(_matrix(chosen.column("v")))
    centers = spherical_kmeans(sample, max(1, min(math.ceil(total / cell_rows), len(sample) // 16)), seed)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                at, cell, home = cells_of(unit_rows(_matrix(part.column(2))), centers, cosine)
                at_home = cell == home[at]
                # a row at home knows all cells it is present in
                sizes = np.bincount(at, minlength=part.num_rows)
                ends = np.cumsum(np.where(at_home, sizes[at], 0))  # presences come row by row, one of each at home
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(cell))
                taken = part.take(pa.array(at))
                columns = [pa.array(cell), pa.array(at_home), taken.column(0), taken.column(1), pa.array(home[at]), lists, taken.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "home", "cid", "copies", "own", "cells", "v"])
            release_memory()

    schema = f"cell long, home boolean, cid long, copies long, own long, cells array<long>, v array<{kind}>"
    placed = materialize(classes.select("cid", "copies", "v").mapInArrow(index, schema))
    sizes = placed.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("present"))
    sized = placed.join(sizes, "cell").where("homes > 0")
    hb, pb = F.ceil(F.col("homes") / block_rows), F.ceil(F.col("present") / block_rows)
    rest = ["cid", "copies", "own"]
    one = sized.where("home").select("cell", F.pmod(F.xxhash64("cid"), hb).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), pb - 1)).alias("j"), F.lit(0).alias("side"), *rest, "cells", "v")
    two = sized.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), hb - 1)).alias("i"), F.pmod(F.xxhash64("cid"), pb).alias("j"), F.lit(1).alias("side"), *rest, F.array().cast("array<long>").alias("cells"), "v")
    keys = ["cell", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            for a, b in group_bounds(table, keys):
                part = table.slice(a, b - a).combine_chunks()
                side, cid, copies, own = (part.column(k).to_numpy() for k in ("side", "cid", "copies", "own"))
                x = unit_rows(_matrix(part.column("v")))
                h, p = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if not len(h) or not len(p):
                    continue
                near = np.concatenate([x[h[k : k + 256]] @ x[p].T >= cosine for k in range(0, len(h), 256)])
                near |= cid[h][:, None] == cid[p]  # a class is linked with itself, whatever the rounding of its product
                # guests whose home does not know the row at home: the pair is counted here for both
                homes, of = np.unique(own[p], return_inverse=True)
                cells = part.column("cells").combine_chunks().take(pa.array(h))
                knows = np.zeros((len(h), len(homes)), bool)
                row = np.repeat(np.arange(len(h)), cells.value_lengths().to_numpy())
                where = cells.flatten().to_numpy()
                at = np.minimum(np.searchsorted(homes, where), len(homes) - 1)
                knows[row[homes[at] == where], at[homes[at] == where]] = True
                alone = near & ~knows[:, of]
                ids, back = np.unique(np.concatenate([cid[h], cid[p]]), return_inverse=True)
                m = np.zeros((len(ids), len(ids)), bool)
                m[np.ix_(back[: len(h)], back[len(h) :])] = near
                m |= m.T
                root = local_stars(len(ids), lambda r, o: m[np.ix_(r, o)])
                far = np.flatnonzero(root != np.arange(len(ids)))
                guests = np.flatnonzero(alone.any(axis=0))
                u = np.concatenate([cid[h], cid[p][guests], ids[root[far]]])
                w = np.concatenate([cid[h], cid[p][guests], ids[far]])
                n = np.concatenate([near @ copies[p], copies[h] @ alone[:, guests], np.zeros(len(far), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(n)], names=["u", "w", "n"])

    tasks = one.unionByName(two).repartition(*keys).sortWithinPartitions(*keys)
    return tasks.mapInArrow(compare, "u long, w long, n long")


#: The same over all pairs, in SQL, for embeddings with unique ids as a view.
SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0 AS ok FROM embeddings),
link AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT reach.u, link.w FROM reach JOIN link ON reach.w = link.u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT u AS vec_id, min(w) AS component_id FROM reach GROUP BY 1) LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM link GROUP BY 1) USING (vec_id)
"""
