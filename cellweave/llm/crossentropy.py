"""Language-model scoring by cross-entropy difference.

Two word-pair models are counted: one on the target documents, one on all documents. They share one vocabulary, every word of the
corpus, and one smoothing: a pair's count plus ``prior`` times the word's own add-one probability. A document's score is the mean
over its words of its loss under the target model less its loss under the background model; low scores are like the target.

No word and no pair is left out, so what is counted grows with the corpus and stays distributed. Texts are dealt by hash into slices
of about ``SLICE`` bytes, target documents apart from the others. A slice sends each of its distinct words and pairs once, with its
count, to the range of hashes it falls into; a range adds up what the slices sent and answers each slice with the totals of what it
asked, in the same order. Hashes and counts travel as sorted byte planes, one row for each slice and range, so a pair costs a few
bytes each way and the answer names neither pair nor document; however frequent a word or a pair is, a slice sends it once. The
slice meets its answers beside its texts and adds up the losses of every document. Words that make up at least one in ``HOT`` of
the corpus, at most ``HOT`` by that very rule, are counted first and go to the tasks instead.

A loss is -log(n(c, w) + prior p(w)) + log(n(c) + prior); the first part belongs to the pair, the second to the context.

Words are told apart by XXH64, pairs by a 64-bit mix of both words' hashes: in a corpus of a billion distinct pairs, one collision
of two pairs is to be expected in about forty such corpora.

Defined results: null text has no words; a document without words has null losses; null ids are scored but are never target
documents; repeated rows count as often as they occur; without any target document the target model is the prior; texts of any
length are read whole; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, release_memory, slices
from cellweave.scale import TASK_ROWS, sized, spread

HOT = 100_000
SLICE = 8 << 20  # bytes of text
RANGE = 8 << 20  # bytes of text whose words and pairs a range of hashes receives
#: The context of a text's first word; no word is empty.
START = np.uint64(xxhash.xxh64_intdigest(b""))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit number fixed by two."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers as eight planes of bytes: what sorted or small numbers share lies together, and compresses."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def numbers(blobs: list[bytes], kind: type = np.int64) -> np.ndarray:
    """The numbers of some planes, one after the other."""
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel() for b in blobs]
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


@dataclass(frozen=True)
class Words:
    """Words of some texts: ``id`` of each distinct word and, last, of the start; ``word`` and ``context`` index it."""

    id: np.ndarray
    word: np.ndarray
    context: np.ndarray
    text: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        split = pc.ascii_split_whitespace(texts.fill_null(b"").view(pa.string()))
        tokens = split.flatten().dictionary_encode()
        known = tokens.dictionary.view(pa.binary()).to_pylist()
        ids = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        code, text = tokens.indices.to_numpy(), np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(split).to_numpy())
        real = np.array([len(k) > 0 for k in known], bool)[code]  # white space at an end leaves empty pieces
        code, text = code[real], text[real]
        sizes = np.bincount(text, minlength=len(texts))
        context = np.empty_like(code)
        context[1:] = code[:-1]
        context[(np.cumsum(sizes) - sizes)[sizes > 0]] = len(ids)
        return cls(np.append(ids, START), code, context, text, sizes)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each id is a word, and how much more often than a context: mostly 0."""
        words = np.bincount(self.word, minlength=len(self.id))
        return words, words - np.bincount(self.context, minlength=len(self.id))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs by context and word, their ids, and the pair of every word."""
        key, at = np.unique(self.context.astype(np.int64) * len(self.id) + self.word, return_inverse=True)
        context, word = np.divmod(key, len(self.id))
        return context, word, mixed(self.id[context], self.id[word]), at


def in_ranges(ids: np.ndarray, counts: list[np.ndarray], ranges: int) -> dict[int, list[bytes]]:
    """Distinct ids in order and their added counts, as planes by range."""
    distinct, at = np.unique(ids, return_inverse=True)
    added = [np.bincount(at, n, len(distinct)).astype(np.int64) for n in counts]
    r = (distinct // np.uint64(2**64 // ranges + 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    return {int(r[a]): [planes(x[a:b]) for x in (distinct, *added)] for a, b in zip(first, np.append(first[1:], len(r)))}


def added_up(sent: pa.Table, name: str, good: np.ndarray, counts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct ids that a range received, the place of each received one, counts in target documents and in all, and how many each row had."""
    sizes = pc.divide(pc.binary_length(sent.column(name)), 8).to_numpy()
    distinct, at = np.unique(numbers(sent.column(name).to_pylist(), np.uint64), return_inverse=True)
    target, out = np.repeat(good, sizes), []
    for k in counts:
        n = numbers(sent.column(k).to_pylist())
        for of in (n * target, n):
            out.append(np.bincount(at, of, len(distinct)).astype(np.int64))
    return distinct, at, out, sizes


def word_counts(rows: DataFrame, ranges: int) -> DataFrame:
    """w, t, r (as a word in target documents and in all), et, er (those less the same as a context); the start is a context only."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE):
            target = batch.column(1).to_numpy(zero_copy_only=False) == 1
            for good in (0, 1):
                own = Words.of(batch.column(0).filter(pa.array(target == bool(good))))
                r, er = own.counts()
                seen = (r > 0) | (er < 0)
                for part, (w, n, m) in in_ranges(own.id[seen], [r[seen], er[seen]], ranges).items():
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((part, pa.int64()), (good, pa.int64()), (w, pa.binary()), (n, pa.binary()), (m, pa.binary()))], names=["part", "good", "w", "n", "m"])

    def add(sent: pa.Table) -> pa.Table:
        release_memory()
        w, _, counts, _ = added_up(sent, "w", sent.column("good").to_numpy(), ["n", "m"])
        return pa.table([w.view(np.int64), *counts], names=["w", "t", "r", "et", "er"])

    sent = rows.select("text", "good").mapInArrow(send, "part long, good long, w binary, n binary, m binary")
    return materialize(spread(sent, ["part"], TASK_ROWS * ranges // 16).groupBy("part").applyInArrow(add, "w long, t long, r long, et long, er long"))


class HotWords:
    """Words that are frequent, by id, with their counts, and the start."""

    def __init__(self, table: pa.Table):
        ids = table.column("w").to_numpy().view(np.uint64)
        order = np.argsort(ids)
        self.id = ids[order]
        self.counts = np.stack([table.column(k).to_numpy()[order] for k in ("t", "r", "et", "er")])

    def find(self, ids: np.ndarray) -> np.ndarray:
        """The index of each id, -1 for a word that is not hot."""
        if not len(self.id):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.id, ids), len(self.id) - 1)
        return np.where(self.id[at] == ids, at, -1)


ASKED = ["q", "qn", "w", "wn", "wm"]
TOTALS = ["qt", "qr", "wt", "wr", "wet", "wer"]


def answers(rows: DataFrame, hot, ranges: int) -> DataFrame:
    """For each slice and range, the totals of the slice's pairs and of its words that are not hot, in the order of their ids."""

    def send(rows: pa.Table) -> pa.Table:
        release_memory()
        own = Words.of(rows.column("text").combine_chunks())
        _, _, pair, at = own.pairs()
        words, cold = own.counts(), hot.value.find(own.id) < 0
        cold[-1] = False  # the start
        q = in_ranges(pair, [np.bincount(at, minlength=len(pair))], ranges)
        w = in_ranges(own.id[cold], [n[cold] for n in words], ranges)
        parts = sorted(q.keys() | w.keys())
        found = [[*q.get(p, [b""] * 2), *w.get(p, [b""] * 3)] for p in parts]
        columns = [pa.array([x[i] for x in found], pa.binary()) for i in range(len(ASKED))]
        return pa.table([pa.array([rows.column("slice")[0].as_py()] * len(parts), pa.int64()), pa.array(parts, pa.int64()), *columns], names=["slice", "part", *ASKED])

    def add(sent: pa.Table) -> pa.Table:
        release_memory()
        whose = sent.column("slice").to_numpy()
        columns = []
        for name, counts in (("q", ["qn"]), ("w", ["wn", "wm"])):
            _, at, totals, sizes = added_up(sent, name, whose % 2, counts)
            ends = np.cumsum(sizes)
            columns += [[planes(n[at[e - s : e]]) for s, e in zip(sizes, ends)] for n in totals]
        return pa.table([sent.column("slice"), sent.column("part"), *[pa.array(x, pa.binary()) for x in columns]], names=["slice", "part", *TOTALS])

    sent = rows.groupBy("slice").applyInArrow(send, "slice long, part long, " + ", ".join(f"{k} binary" for k in ASKED))
    return spread(sent, ["part"], TASK_ROWS * ranges // 16).groupBy("part").applyInArrow(add, "slice long, part long, " + ", ".join(f"{k} binary" for k in TOTALS))


def scored(docs: DataFrame, target: DataFrame, prior: float = 50.0) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background, score (their difference, per word) of every document."""
    sc = docs.sparkSession.sparkContext
    ids = sized(target.select(F.col("doc_id").cast("long").alias("target")).where("target is not null").distinct())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(32, -(-size // RANGE))
    rows = keyed.join(ids, F.col("doc_id") == F.col("target"), "left").select("doc_id", "text", F.col("target").isNotNull().cast("int").alias("good"))
    words = word_counts(rows, ranges)
    v, n_t, n_r = (int(x or 0) for x in words.agg(F.count_if(F.col("r") > 0), F.sum("t"), F.sum("r")).first())
    hot = sc.broadcast(HotWords(words.where((F.col("r") * HOT >= n_r) | (F.col("w") == int(START.view(np.int64)))).toArrow()))
    # even slices hold no target document, odd ones nothing else
    n = max(1, -(-size // SLICE))
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) * 2 + F.col("good")
    dealt = spread(rows.select("doc_id", "text", number.alias("slice")), ["slice"], TASK_ROWS * n // 4)  # about four slices a task

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        release_memory()
        own = Words.of(rows.column("text").combine_chunks())
        found = found.sort_by("part")
        qt, qr, *cold = (numbers(found.column(k).to_pylist()) for k in TOTALS)
        at = hot.value.find(own.id)
        t, r, et, er = counts = np.zeros((4, len(own.id)), np.int64)
        counts[:, at >= 0] = hot.value.counts[:, at[at >= 0]]
        asked = np.flatnonzero(at[:-1] < 0)
        counts[:, asked] = np.stack(cold)[:, np.unique(own.id[asked], return_inverse=True)[1]]
        context, word, pair, of = own.pairs()
        place, losses = np.unique(pair, return_inverse=True)[1], []
        for total, n, w, c in ((n_t, qt, t, t - et), (n_r, qr, r, r - er)):
            loss = np.log(c[context] + prior) - np.log(n[place] + prior * (w[word] + 1) / (total + v))
            sums = np.bincount(own.text, loss[of], len(own.sizes))
            losses.append(np.divide(sums, own.sizes, out=np.zeros(len(sums)), where=own.sizes > 0))
        none = own.sizes == 0
        return pa.table([rows.column("doc_id"), own.sizes, *[pa.array(x, mask=none) for x in (*losses, losses[0] - losses[1])]], names=["doc_id", "n_words", "loss_target", "loss_background", "score"])

    beside = answers(dealt, hot, ranges).groupBy("slice")
    return dealt.groupBy("slice").cogroup(beside).applyInArrow(score, "doc_id long, n_words long, loss_target double, loss_background double, score double")


#: The same in SQL, for documents and labels as views; {prior} is the parameter.
SQL = r"""
WITH target AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL),
docs AS (SELECT row_number() OVER () AS r, d.doc_id, t.doc_id IS NOT NULL AS good,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents d LEFT JOIN target t ON d.doc_id = t.doc_id),
tokens AS (SELECT r, good, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
pairs AS (SELECT r, good, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), ' ') AS c FROM tokens),
pair_n AS (SELECT c, w, count(*) FILTER (good) AS t, count(*) AS r FROM pairs GROUP BY c, w),
context_n AS (SELECT c, sum(t) AS t, sum(r) AS r FROM pair_n GROUP BY c),
word_n AS (SELECT w, sum(t) AS t, sum(r) AS r FROM pair_n GROUP BY w),
total AS (SELECT sum(t) AS t, sum(r) AS r, count(*) AS v FROM word_n),
loss AS (SELECT c, w,
    -ln((p.t + {prior} * (s.t + 1) / (total.t + total.v)) / (x.t + {prior})) AS a,
    -ln((p.r + {prior} * (s.r + 1) / (total.r + total.v)) / (x.r + {prior})) AS b
  FROM pair_n p JOIN context_n x USING (c) JOIN word_n s USING (w), total),
means AS (SELECT r, avg(a) AS a, avg(b) AS b FROM pairs JOIN loss USING (c, w) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, round(a, 6) AS loss_target, round(b, 6) AS loss_background, round(a - b, 6) AS score
FROM docs LEFT JOIN means USING (r)
"""
