"""Mixing sources to target weights: subset-sum budget fitting.

Every source gets a budget of words. Whole passes over the source come first; what is left of the budget is less than the
source. It is filled by choosing, for every exact document length, how many documents of that length to take: a share in
proportion to the length counts, then bounded-knapsack dynamic programming for the last words. The documents of a length
are then chosen in a seeded order. Only length counts (a few thousand rows a source) meet in one task.

Defined results: null text has size 0; a null source is a source of its own and comes last; repeated rows are separate
documents; texts of any length are read whole; an empty table gives an empty result; documents of size 0 take part in whole
passes only; further columns are ignored by ``decisions`` and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweave.llm.common import boxed, join_null_safe, materialize, ranked, seeded, unboxed, word_count
from cellweave.scale import row_numbers

MAX_PASSES = 3


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is as near below ``budget`` as bounded subset sums allow.

    Lengths are positive and distinct. A count of copies is split into chunks of 1, 2, 4, ... copies; bit s of ``reach`` says
    that sum s can be made, and ``via[s]`` the chunk that made it first, so that walking back uses each chunk once.
    """
    reach, via, chunks, full = 1, np.full(budget + 1, -1, np.int64), [], (1 << (budget + 1)) - 1
    for i in np.argsort(lengths, kind="stable"):
        left, size = min(int(counts[i]), budget // int(lengths[i])), 1
        while left and not reach >> budget:
            size = min(size, left)
            new = (reach << (size * int(lengths[i]))) & full & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                via[np.flatnonzero(bits)] = len(chunks)
            reach |= new
            chunks.append((i, size))
            left, size = left - size, size * 2
        if reach >> budget:
            break
    take, s = np.zeros(len(lengths), np.int64), reach.bit_length() - 1
    while s:
        i, size = chunks[via[s]]
        take[i] += size
        s -= size * int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, last_words: int = 1 << 14) -> np.ndarray:
    """Documents to take of each length for a budget below the sum of all.

    Each length first gives its proportional share; the largest fractions are rounded up while they fit, until about
    ``last_words`` of the budget are left. These are the knapsack's.
    """
    take, live = np.zeros(len(lengths), np.int64), lengths > 0
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    share = counts * (budget / total)
    take[live] = np.minimum(np.floor(share[live]).astype(np.int64), counts[live])
    left = budget - int((take * lengths).sum())
    for i in np.lexsort((lengths, take - share)):
        if left <= last_words:
            break
        if live[i] and take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    spare = live & (counts > take) & (lengths <= left)
    if left > 0 and spare.any():
        take[spare] += knapsack(lengths[spare], (counts - take)[spare], left)
    return take


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = min(int(target // size), MAX_PASSES) if size else 0
    rest = int(round(target - passes * size)) if passes < MAX_PASSES else 0
    extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), min(rest, size))
    return pdf.assign(passes=passes, extra=extra)


def targets(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn. A target stops at three times its source's size and the
    excess goes to the others by weight, until none is above: the level rises round by round, one small job each.
    """
    numbered = row_numbers(sizes.withColumn("__last", F.col("source").isNull()), [], ["__last", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    src = materialize(numbered.select("source", "source_size", weight.alias("w"), (F.lit(float(MAX_PASSES)) * F.col("source_size")).alias("most")))
    total, level, capped = None, 0.0, None
    while True:
        above = F.col("most") < level * F.col("w")
        got = src.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(above, F.col("most"))).alias("held"),
            F.sum(F.when(~above, F.col("w"))).alias("free"), F.count(F.when(above, 1)).alias("capped"),
        ).first()
        total = float(got["total"] or 0)
        if got["capped"] == capped or not got["free"]:
            break
        capped, level = got["capped"], (total - (got["held"] or 0.0)) / got["free"]
    return src.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("w")).alias("target"))


def decisions(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 7) -> DataFrame:
    """One row per document: doc_id, row_key, source, size, source_size, target, copies (0 to 3), taken (words)."""
    size = word_count(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"), row_key(seed).alias("row_key"))
    rows = materialize(rows)
    lengths = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights)
    planned = join_null_safe(lengths, goal, ["source"]).groupBy("source").applyInPandas(
        _plan_source, "source string, size long, n long, source_size long, target double, passes long, extra long"
    )
    planned = materialize(planned)
    # lengths taken whole or not at all need no order within the length
    done = join_null_safe(rows, planned, ["source", "size"])
    partly = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    whole = done.where(~partly).withColumn("chosen", (F.col("extra") > 0).cast("long"))
    ordered = ranked(materialize(done.where(partly)), ["source", "size"], "row_key", ["doc_id"], "rank")
    some = ordered.withColumn("chosen", (F.col("rank") < F.col("extra")).cast("long")).drop("rank")
    copies = F.col("passes") + F.col("chosen")
    return whole.unionByName(some).select(
        "doc_id", "row_key", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def row_key(seed: int):
    """Seeded number of a document, by its id and text; orders the documents of a length."""
    return seeded(seed, F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit(""))), F.col("source"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 7) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``.

    Rows that repeat one document exactly share a key; the first of them, in any order, get what the mix takes more.
    """
    took = decisions(docs, weights, seed).groupBy("doc_id", "row_key").agg(
        F.min("copies").alias("low"), (F.sum("copies") - F.count(F.lit(1)) * F.min("copies")).alias("more")
    )
    rows = join_null_safe(boxed(docs, doc_id=F.col("doc_id"), row_key=row_key(seed)), took, ["doc_id", "row_key"])
    turn = F.row_number().over(Window.partitionBy("doc_id", "row_key").orderBy("low"))
    times = F.col("low") + F.when(turn <= F.col("more"), 1).otherwise(0)
    out = rows.withColumn("times", times.cast("int")).withColumn("copy", F.explode(F.expr("array_repeat(1, times)")))
    return unboxed(out, docs.columns)
