"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits. Two fingerprints that differ in at most ``distance`` bits agree on ``blocks - distance`` of
``blocks`` bit blocks at least, so they share the key made of those blocks in one of the tables. Distinct fingerprints are
joined on these keys, and Hamming distances are verified inside each key. A key with many fingerprints is cut into chunks
and every pair of chunks becomes a task of its own; a task reports a spanning star of each local component instead of all
pairs. Copies of a text share one fingerprint and are never compared.

Defined results: null text, and text without words, has fingerprint zero, which links like any other; repeated rows are
documents of one component; null ids take part but are no component ids; texts of any length are read whole; an empty table
gives an empty result; further columns are ignored by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.llm.common import boxed, join_null_safe, materialize, slices, unboxed
from cellweave.llm.components import components, group_bounds, local_stars, whole_groups

SEED = 42


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    tokens = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)))) if len(tokens) >= words else iter([b" ".join(tokens)])
    total, ones = max(1, len(tokens) - words + 1), np.zeros(64, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, total)
    for at in range(0, total, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), t (a hash of the text, which tells rows of one id apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["doc_id", "fp", "t"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, fp long, t long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """A bit mask, as a signed long, for each choice of ``blocks - distance`` blocks of a fingerprint."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, distance: int = 3, blocks: int = 5, chunk_rows: int = 4096) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` just as all pairs within ``distance`` do."""
    tables = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(block_masks(distance, blocks))]
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("t")).select("fp", "t.k", "t.part")
    shared = keyed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(shared, ["k", "part"])
    chunks = F.ceil(F.col("n") / chunk_rows)
    own = F.pmod(F.xxhash64("fp", "k"), chunks)
    paired = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    tasks = paired.select("fp", "k", "part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    keys = ["k", "part", "a", "b"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            fp, us, vs = table.column("fp").to_numpy(), [], []
            for a, b in group_bounds(table, keys):
                own = np.sort(fp[a:b])
                bits = own.view(np.uint64)
                root = local_stars(len(own), lambda i, j: np.bitwise_count(bits[i][:, None] ^ bits[j]) <= distance)
                far = np.flatnonzero(root != np.arange(len(own)))
                us.append(own[root[far]])
                vs.append(own[far])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    placed = tasks.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(verify, "u long, v long").distinct()


def labelled(prints: DataFrame, distance: int = 3, blocks: int = 5) -> DataFrame:
    """(fp, first) of the distinct fingerprints of stored rows (doc_id, fp, t): the component's first row, by id (null last)."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    fps = materialize(prints.groupBy("fp").agg(F.min(row).alias("first")))
    labels = components(links(fps.select("fp"), distance, blocks))
    named = fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = materialize(named)
    return named.drop("first").join(named.groupBy("label").agg(F.min("first").alias("first")), "label").select("fp", "first")


def near_duplicates(docs: DataFrame, distance: int = 3, blocks: int = 5, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    prints = materialize(fingerprints(docs, words))
    joined = prints.join(labelled(prints, distance, blocks), "fp")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return joined.select("doc_id", digits.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, distance: int = 3, blocks: int = 5, words: int = 3) -> DataFrame:
    """One document of every component, the one with the smallest id, with all its columns."""
    prints = materialize(fingerprints(docs, words))
    first = labelled(prints, distance, blocks).select("first.doc_id", "first.t").distinct()
    rows = boxed(docs, doc_id=F.col("doc_id").cast("long"), t=F.xxhash64("text"))
    kept = join_null_safe(rows, first, ["doc_id", "t"])
    once = F.row_number().over(Window.partitionBy("doc_id", "t").orderBy("t"))
    return unboxed(kept.withColumn("once", once).where("once = 1"), docs.columns)
