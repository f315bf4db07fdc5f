"""Importance resampling towards a target distribution.

Features are the runs of 1 to ``runs`` consecutive words of a text, hashed into ``BUCKETS`` buckets. Both corpora are counted by
bucket; a bucket's gain is the log ratio of its smoothed shares, and a document's weight is the sum of the gains of its features.
A Gumbel variable fixed by the document's id is added, and the highest scores are drawn: sampling without replacement by weight.

In a task, the features of a batch are interned in an open-addressed NumPy table: XXH64 keys, linear probing, bytes compared
where keys are equal. A slot stores the feature's bucket (its CRC32 is computed once a slot, not once an occurrence) and its
count; every occurrence keeps its slot id, through which the gains are gathered. The driver holds two counts for each bucket.

Defined results: null text has no words; a document without features weighs 0; a null id is the empty string in the draw and
comes last among ties; repeated rows are documents like any other; with an empty table or target all shares are the smoothing
alone; texts of any length are read whole; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, slices
from cellweave.scale import row_numbers

BUCKETS = 10_000
LEAST_WORDS = 20
#: Bytes that separate words, and the lower case of A-Z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def features_of(words: Sequence[bytes], runs: int) -> list[bytes]:
    """All runs of 1 to ``runs`` consecutive words, joined by one space."""
    longer = (map(b" ".join, zip(*(words[i:] for i in range(n)))) for n in range(2, runs + 1))
    return list(chain(words, *longer))


class FeatureTable:
    """Open-addressed table of a batch's features: ``slots`` interns occurrences, ``bucket`` and ``count`` are by slot."""

    def __init__(self, most: int):
        size = 1 << max(4, (2 * most - 1).bit_length())  # at most half full
        self.mask = np.uint64(size - 1)
        self.key, self.used = np.zeros(size, np.uint64), np.zeros(size, bool)
        self.text = np.empty(size, object)
        self.bucket, self.count = np.zeros(size, np.int32), np.zeros(size, np.int64)

    def slots(self, features: list[bytes], keys: np.ndarray | None = None) -> np.ndarray:
        """The slot of every occurrence; new features are put in, counts are raised."""
        if keys is None:
            keys = np.fromiter(map(xxhash.xxh64_intdigest, features), np.uint64, len(features))
        text = np.empty(len(features), object)
        text[:] = features
        out = (keys & self.mask).astype(np.int64)
        open_, owner = np.arange(len(features)), np.empty(len(self.key), np.int64)
        while len(open_):
            at = out[open_]
            free = open_[~self.used[at]]
            if len(free):
                # of several that meet at a free slot, one gets it; the others then compare with it
                owner[out[free]] = free
                new = free[owner[out[free]] == free]
                slot = out[new]
                self.used[slot], self.key[slot], self.text[slot] = True, keys[new], text[new]
                self.bucket[slot] = [zlib.crc32(x) % BUCKETS for x in text[new]]
            same = self.key[at] == keys[open_]
            same[same] = self.text[at[same]] == text[open_[same]]
            open_ = open_[~same]
            out[open_] = (out[open_] + 1) & np.int64(self.mask)
        self.count += np.bincount(out, minlength=len(self.count))
        return out


def interned(column: pa.Array, runs: int) -> tuple[FeatureTable, np.ndarray, np.ndarray, np.ndarray]:
    """(table, slot of each occurrence, features of each text, words of each text) of a batch of texts."""
    words = [words_of(t.as_py()) for t in column]
    features = [features_of(w, runs) for w in words]
    sizes = np.array([len(f) for f in features], np.int64)
    table = FeatureTable(int(sizes.sum()))
    return table, table.slots(list(chain.from_iterable(features))), sizes, np.array([len(w) for w in words], np.int64)


def counts(docs: DataFrame, runs: int) -> np.ndarray:
    """Features by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, 0, 1 << 20):
            table = interned(batch.column(0), runs)[0]
            np.add.at(total, table.bucket[table.used], table.count[table.used])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down."""
    s_all, t_all = int(source.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (s_all + BUCKETS)) / float((s + 1) * (t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: str = "2024") -> int:
    """The id's Gumbel variable in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: np.ndarray, runs: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            table, slot, sizes, n_words = interned(batch.column(1), runs)
            by_slot = gains[table.bucket]
            so_far = np.append(0, np.cumsum(by_slot[slot]))
            ends = np.cumsum(sizes)
            weight = so_far[ends] - so_far[ends - sizes]
            score = weight + np.array([gumbel(d) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, sizes, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1 for the highest score drawn; null for the rest)."""
    gains = gains_of(counts(docs, runs), counts(target, runs))
    rows = materialize(weighed(docs, gains, runs))
    eligible = rows.where(F.col("n_words") >= LEAST_WORDS).count()
    order = {"late": F.col("n_words") < LEAST_WORDS, "falling": -F.col("score"), "no_id": F.col("doc_id").isNull()}
    placed = row_numbers(rows.withColumns(order), [], [*order, "doc_id", "n_features", "weight"], "place")
    drawn = ~F.col("late") & (F.col("place") <= percent * eligible // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))


_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) FROM range(256) q(b))"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same in SQL over the views documents and benchmark, for runs of one word.
SQL = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
d_words AS (SELECT r, unnest(w) AS x FROM docs),
b_words AS (SELECT unnest({_WORDS}) AS x FROM benchmark),
hexed AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM d_words UNION SELECT x FROM b_words)),
buckets AS (SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % {BUCKETS} AS k FROM hexed, crc),
s AS (SELECT k, count(*) AS s FROM d_words JOIN buckets USING (x) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b_words JOIN buckets USING (x) GROUP BY k),
gains AS (SELECT k, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (S_ALL + {BUCKETS}) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (T_ALL + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (k), (SELECT CAST(coalesce(sum(s), 0) AS BIGINT) AS S_ALL FROM s), (SELECT CAST(coalesce(sum(t), 0) AS BIGINT) AS T_ALL FROM t)),
weights AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM d_words JOIN buckets USING (x) JOIN gains USING (k) GROUP BY r),
scores AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT *, n_features >= {LEAST_WORDS} AS eligible, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 10 * count(*) FILTER (eligible) OVER () // 100 THEN place END AS rank FROM placed
"""
