"""Exact repeated passages by enhanced suffix arrays, scanned as common-prefix interval trees.

Two equal passages of ``least`` bytes need not be compared at every position. Of the ``GRAM``-byte strings of each passage the
one with the smallest hash is its anchor; equal passages have equal anchors at equal offsets. So:

1. ``anchors``: every document gives its anchors, each with the hash of its context (all passages around it). Anchors meet by
   hash. One whose whole context occurs earlier is covered; those whose anchor occurs once only are done.
2. ``suffixes``: what is left, one context for each anchor and context string, is gathered by anchor. Every bucket gets an
   enhanced suffix array (suffixes, common prefix lengths, preceding bytes), a stack scan yields its prefix intervals, and
   the intervals whose occurrences have different preceding bytes are the maximal repeat groups, with all occurrences.
3. Passages that start again at a later place (greater id, or same document and later start) are covered; the covered bytes
   of each document are removed.

An anchor with more than ``hot`` different contexts is not gathered: its passages are sent one by one under their own
128-bit hashes, of which a batch of documents sends each once, so no task meets all documents that share a line.

``repeat_groups`` deals the groups themselves, copies of whole contexts and hot passages included.

Defined results: null text is empty; documents are ordered by id, null last, and rows of one id by a hash of their text; rows
that repeat id and text are one document and get the same result; texts of any length are read whole; an empty table gives an
empty result; ``removed`` ignores further columns and ``deduplicated`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import boxed, c, join_null_safe, materialize, release_memory, slices, text_bytes, unboxed
from cellweave.llm.components import whole_groups
from cellweave.scale import row_numbers

LEAST = 100
GRAM = 32
SPREAD = LEAST - GRAM  # a passage's anchor starts up to so far behind the passage's start
CHUNK = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_OTHER = np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[size] = tuple(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]).cumprod() for b in (_BASE, inverse))
    up, down = _powers[size]
    return up[:n], down[:n]


class Rolling:
    """Hashes of any byte ranges of ``data`` from prefix sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _VALUES):
        self.up, down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(values[data] * down[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(U))

    def all(self, first: int, last: int, length: int) -> np.ndarray:
        """Hashes of the strings of one length that start at ``first`` to ``last - 1``."""
        return _mixed((self.sums[first + length : last + length] - self.sums[first:last]) * self.up[first:last])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position in data, gram hash, context hash) of the anchors of documents lying one after another in data.

    A gram is an anchor if it has the smallest hash of some passage. Its context is the bytes of all passages that hold it:
    ``SPREAD`` before its start to ``LEAST`` after, within the document.
    """
    width, found = SPREAD + 1, []
    n = int(ends[-1]) if len(ends) else 0
    for first in range(int(starts[0]) if len(starts) else 0, n - LEAST + 1, CHUNK):
        last = min(first + CHUNK, n - LEAST + 1)
        low, high = max(0, first - SPREAD), min(n, last + SPREAD + LEAST)
        rolling = Rolling(data[low:high])
        grams = rolling.all(first - low, last - low + SPREAD, GRAM) | U(1)
        doc = np.searchsorted(ends, np.array([first, last - 1]), "right")
        own = slice(int(doc[0]), int(doc[1]) + 1)
        lengths = np.minimum(ends[own], last) - np.maximum(starts[own], first)
        end_of = np.repeat(ends[own], np.maximum(lengths, 0))
        inside = np.arange(first, last) + LEAST <= end_of
        least = np.where(inside, _sliding(grams, width, np.minimum), U(0))
        pad = np.zeros(SPREAD, U)
        chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == grams)
        found.append((chosen + first, grams[chosen]))
        at = chosen + first
        d = np.searchsorted(ends, at, "right")
        a, b = np.maximum(at - SPREAD, starts[d]), np.minimum(at + LEAST, ends[d])
        found[-1] += (d, _mixed(rolling.ranges(a - low, b - low) + (at - a).astype(U)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U), none.astype(U)
    at, gram, doc, context = (np.concatenate(x) for x in zip(*found))
    _, once = np.unique(at, return_index=True)
    return doc[once], at[once], gram[once], context[once]


def _later(order: np.ndarray, groups: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in ``order`` (sorted by groups, doc, pos): first of its group, and later than that first row."""
    change = np.zeros(len(order), bool)
    change[:1] = True
    for g in groups:
        s = g[order]
        change[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(change)[np.cumsum(change) - 1] if len(order) else np.zeros(0, np.int64)
    d, p = doc[order], pos[order]
    return change, (d != d[first]) | (p != p[first])


COVER, CANDIDATE, HOT = 0, 1, 2


def _pack(doc: np.ndarray, pos: np.ndarray, gram: np.ndarray, context: np.ndarray) -> bytes:
    """Anchors of one bucket, ordered by document: run lengths of documents, then the other columns."""
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    runs = np.diff(np.append(cut, len(doc)))
    head = np.array([len(cut), len(doc)], np.int64)
    short = np.frombuffer(gram.astype("<u8").tobytes(), np.uint8).reshape(-1, 8)[:, 2:]  # 48 bits find; contexts decide
    return b"".join(x.tobytes() for x in (head, doc[cut].astype(np.int64), runs.astype(np.int32), pos.astype(np.int32), short, context.astype("<u8")))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k, n = np.frombuffer(blob, np.int64, 2)
    at = 16
    docs = np.frombuffer(blob, np.int64, k, at)
    runs = np.frombuffer(blob, np.int32, k, at + 8 * k)
    at += 12 * k
    pos = np.frombuffer(blob, np.int32, n, at)
    short = np.frombuffer(blob, np.uint8, 6 * n, at + 4 * n).reshape(-1, 6)
    gram = np.zeros((n, 8), np.uint8)
    gram[:, 2:] = short
    context = np.frombuffer(blob, "<u8", n, at + 10 * n)
    return np.repeat(docs, runs), pos.astype(np.int64), gram.reshape(-1).view("<u8"), context


#: Bytes of text for each partition in which anchors meet.
PART_BYTES = 16 << 20


def partitions_for(docs: DataFrame) -> int:
    """As many partitions as the texts' bytes ask for, at least the session's number: what one task holds does not grow with the corpus."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


def marked(docs: DataFrame, hot: int, batch_hot: int, parts: int) -> DataFrame:
    """(dk, code): code is 4 * position + COVER, CANDIDATE or HOT for the anchors that occur more than once."""
    buckets = 4 * parts
    no_bytes = pa.array([None], pa.binary())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 8 << 20):
            ids = batch.column(0).to_numpy()
            data, starts, ends = text_bytes(batch.column(1))
            doc, at, gram, context = anchors(data, starts, ends)
            dk, pos = ids[doc], at - starts[doc]
            order = np.lexsort((pos, dk, context, gram))
            first, later = _later(order, [gram, context], dk, pos)
            alone = order[first]  # one row for each gram and context of the batch, still sorted by gram
            g = gram[alone]
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(cut, len(g)))
            crowded = np.repeat(sizes > batch_hot, sizes)
            direct = [(dk[order[later]], 4 * pos[order[later]] + COVER), (dk[alone[crowded]], 4 * pos[alone[crowded]] + HOT)]
            for d, code in direct:
                if len(d):
                    spread = pa.array(d % buckets)
                    yield pa.RecordBatch.from_arrays([spread, pa.array(d), pa.array(code), no_bytes.take(pa.array(np.zeros(len(d), np.int64)))], names=["bucket", "dk", "code", "anchors"])
            # of a crowded gram one row goes on, so that its rows elsewhere are found; context 0 says what it is
            stone = np.zeros(len(alone), bool)
            stone[cut[sizes > batch_hot]] = True
            send = alone[~crowded | stone]
            shown = np.where(stone[~crowded | stone], U(0), context[send] | U(1))
            bucket = (gram[send] % U(buckets)).astype(np.int64)
            by = np.lexsort((pos[send], dk[send], bucket))
            send, shown, bucket = send[by], shown[by], bucket[by]
            ends_of = np.flatnonzero(np.concatenate([bucket[1:] != bucket[:-1], [True]])) + 1 if len(bucket) else []
            names, blobs, a = [], [], 0
            for b in ends_of:
                names.append(bucket[a])
                blobs.append(_pack(dk[send[a:b]], pos[send[a:b]], gram[send[a:b]], shown[a:b]))
                a = b
            if names:
                none = pa.nulls(len(names), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), none, none, pa.array(blobs, pa.binary())], names=["bucket", "dk", "code", "anchors"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket"]):
            given = table.filter(table.column("anchors").is_null())
            for b in given.select(["dk", "code"]).to_batches():
                yield b
            blobs = [x.as_py() for x in table.column("anchors") if x.is_valid]
            if not blobs:
                continue
            dk, pos, gram, context = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
            order = np.lexsort((pos, dk, context, gram))
            first, later = _later(order, [gram, context], dk, pos)
            stone = context[order] == 0
            later &= ~stone
            alone = order[first]
            g = gram[alone]
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sizes = np.diff(np.append(cut, len(g)))
            has_stone = context[alone[cut]] == 0  # context 0 sorts first
            repeated = np.repeat((sizes > 1) & ~has_stone & (sizes <= hot), sizes)
            crowded = np.repeat(has_stone | (sizes > hot), sizes) & (context[alone] != 0)
            d = np.concatenate([dk[order[later]], dk[alone[repeated]], dk[alone[crowded]]])
            code = 4 * np.concatenate([pos[order[later]], pos[alone[repeated]], pos[alone[crowded]]])
            code += np.repeat([COVER, CANDIDATE, HOT], [int(later.sum()), int(repeated.sum()), int(crowded.sum())])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(code)], names=["dk", "code"])

    sent = docs.select("dk", F.col("text").cast("binary")).mapInArrow(emit, "bucket long, dk long, code long, anchors binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "dk long, code long")


def suffixes(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (key, other, dk, start, lo, hi, bytes) of the candidates' contexts; see ``scanned`` for their meaning."""
    wanted = marks.where(F.col("code") % 4 != COVER).groupBy("dk").agg(F.collect_list("code").alias("codes"))
    joined = docs.select("dk", F.col("text").cast("binary").alias("text")).join(wanted, "dk")
    names = ["key", "other", "dk", "start", "lo", "hi", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            yield from contexts(batch)

    def contexts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, starts, ends = text_bytes(batch.column(1))
        lists, ids = batch.column(2), batch.column(0).to_numpy()
        code = lists.flatten().to_numpy()
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        at, kind = starts[doc] + code // 4, code % 4
        # whole contexts, by gram
        pick = np.flatnonzero(kind == CANDIDATE)
        a, b = np.maximum(at[pick] - SPREAD - 1, starts[doc[pick]]), np.minimum(at[pick] + LEAST, ends[doc[pick]])
        low = np.maximum(at[pick] - SPREAD, starts[doc[pick]])
        high = np.minimum(at[pick], b - LEAST)
        base = int(starts[0]) if len(starts) else 0
        raw = data.tobytes() if base == 0 and len(data) == int(ends[-1]) else data[base : int(ends[-1])].tobytes()
        strings = [raw[x - base : y - base] for x, y in zip(a.tolist(), b.tolist())]
        grams = _grams(data, at[pick])
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip((grams.view(np.int64), np.zeros(len(pick), np.int64), ids[doc[pick]], a - starts[doc[pick]], low - a, high - a + 1, strings), kinds)], names=names
        )
        # single passages of hot anchors, by hash, each string once in a batch; later ones are covered at once
        pick = np.flatnonzero(kind == HOT)
        if len(pick):
            s = (at[pick][:, None] - np.arange(SPREAD + 1)).ravel()
            d = np.repeat(doc[pick], SPREAD + 1)
            fine = (s >= starts[d]) & (s + LEAST <= ends[d])
            s, one = np.unique(s[fine], return_index=True)
            d = d[fine][one]
            h1, h2 = _windows(data, s, _VALUES), _windows(data, s, _OTHER)
            dk, pos = ids[d], s - starts[d]
            order = np.lexsort((pos, dk, h2, h1))
            first, later = _later(order, [h1, h2], dk, pos)
            for rows, cover in ((order[first], False), (order[later], True)):
                n = len(rows)
                key = dk[rows] if cover else h1[rows].view(np.int64)
                fill = (key, h2[rows].view(np.int64), dk[rows], pos[rows], np.full(n, LEAST if cover else -1), np.full(n, -1), [None] * n)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(fill, kinds)], names=names)

    return joined.select("dk", "text", "codes").mapInArrow(run, "key long, other long, dk long, start long, lo int, hi int, bytes binary")


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return Rolling(data[at[:, None] + np.arange(GRAM)].ravel()).ranges(np.arange(len(at)) * GRAM, (np.arange(len(at)) + 1) * GRAM) if len(at) else np.zeros(0, U)


def _windows(data: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of the passages at sorted places."""
    out = np.zeros(len(at), U)
    for k in range(0, len(at), 4096):
        s = at[k : k + 4096]
        grid = data[s[:, None] + np.arange(LEAST)].ravel()
        out[k : k + 4096] = Rolling(grid, values).ranges(np.arange(len(s)) * LEAST, (np.arange(len(s)) + 1) * LEAST)
    return out


class SuffixArray:
    """Enhanced suffix array of the suffixes, at least ``LEAST`` long, of gathered contexts.

    Suffixes that do not share their first ``LEAST`` bytes with another one, or whose sharers are all preceded by one same
    byte (then the group one byte to the left says more), are left out. The others are ordered so that equal beginnings are
    neighbours; ``lcp[i]`` is what suffix i shares with suffix i - 1 (0 between different first ``LEAST`` bytes).
    """

    def __init__(self, strings: list[bytes], low: np.ndarray, high: np.ndarray, dk: np.ndarray, start: np.ndarray):
        data = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        begin = ends - np.fromiter(map(len, strings), np.int64, len(strings))
        count = np.maximum(high - low, 0)
        of = np.repeat(np.arange(len(strings)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[of] + low[of] + nth
        # the byte before, 256 at the start of a document; the lowest suffix of a context is open to the left
        before = np.where(nth + low[of] > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 256)
        open_left = nth == 0
        hashes = Rolling(data).ranges(at, at + LEAST)
        doc, pos = dk[of], start[of] + low[of] + nth
        order = np.lexsort((at - ends[of], pos, doc, hashes))  # of one place the context that reaches furthest comes first
        same = np.zeros(len(order), bool)
        h, d, p = hashes[order], doc[order], pos[order]
        same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1]) & (p[1:] == p[:-1])
        order = order[~same]  # a passage may be in the contexts of several anchors
        h = hashes[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if len(cut):
            sizes = np.diff(np.append(cut, len(h)))
            b = before[order]
            diverse = (np.minimum.reduceat(b, cut) != np.maximum.reduceat(b, cut)) | np.logical_or.reduceat(open_left[order], cut)
            order = order[np.repeat((sizes > 1) & diverse, sizes)]
        tails = [bytes(data[a + LEAST : e]) for a, e in zip(at[order].tolist(), ends[of[order]].tolist())]
        ranks = sorted(range(len(order)), key=lambda i: (hashes[order[i]], tails[i])) if len(order) else []
        order = order[ranks] if len(order) else order
        self.doc, self.pos, self.before, self.open_left = doc[order], pos[order], before[order], open_left[order]
        h, tails = hashes[order], [tails[i] for i in ranks]
        self.lcp = np.zeros(len(order) + 1, np.int64)
        for i in range(1, len(order)):
            if h[i] == h[i - 1] and bytes(data[at[order[i]] : at[order[i]] + LEAST]) == bytes(data[at[order[i - 1]] : at[order[i - 1]] + LEAST]):
                x, y = tails[i - 1], tails[i]
                n = min(len(x), len(y))
                k = 0
                while k < n and x[k] == y[k]:
                    k += 1
                self.lcp[i] = LEAST + k

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, end) of the common-prefix intervals, children before parents, by a stack scan."""
        stack: list[tuple[int, int]] = []
        for i in range(1, len(self.lcp)):
            k, left = int(self.lcp[i]), i - 1
            while stack and stack[-1][0] > k:
                length, left = stack.pop()
                yield length, left, i
            if k and (not stack or stack[-1][0] < k):
                stack.append((k, left))

    def maximal(self, a: int, b: int) -> bool:
        """Left extension: the occurrences are preceded by different bytes, or by bytes outside the context."""
        return bool(self.open_left[a:b].any() or (self.before[a:b] != self.before[a]).any())

    def groups(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, documents, starts) of the maximal repeats, all occurrences of each."""
        for length, a, b in self.intervals():
            if self.maximal(a, b):
                yield length, self.doc[a:b], self.pos[a:b]

    def later(self) -> Iterator[tuple[int, int, int]]:
        """(document, start, length) to cover: each suffix once, in the longest maximal repeat it is not the first of.

        An interval hands only its first occurrence on to its parent, since the others are covered further already.
        """
        left = {}  # start of an interval -> (end, its first occurrence) that is still to be judged above
        for length, a, b in self.intervals():
            if not self.maximal(a, b):
                continue
            alive, i = [], a
            while i < b:
                if i in left:
                    end, best = left.pop(i)
                    alive.append(best)
                    i = end
                else:
                    alive.append(i)
                    i += 1
            best = min(alive, key=lambda j: (self.doc[j], self.pos[j]))
            for j in alive:
                if j != best:
                    yield int(self.doc[j]), int(self.pos[j]), length
            left[a] = (b, best)


def _arrays(table: pa.Table) -> tuple[SuffixArray, pa.Table]:
    whole = table.filter(table.column("bytes").is_valid())
    get = lambda k: whole.column(k).to_numpy()
    return SuffixArray(whole.column("bytes").to_pylist(), get("lo").astype(np.int64), get("hi").astype(np.int64), get("dk"), get("start")), table.filter(table.column("bytes").is_null())


def _gathered(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "key").sortWithinPartitions("key")


def scanned(rows: DataFrame, parts: int) -> DataFrame:
    """(dk, a, b): bytes covered by passages that start earlier elsewhere.

    Rows with bytes are contexts: suffixes start at lo to hi - 1 of the bytes, which begin at ``start`` of the document. Rows
    without are hot passages under their hashes (lo -1), or covered bytes already (lo is their length).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(whole_groups(batches, ["key"])):
            release_memory()
            array, single = _arrays(table)
            found = list(array.later())
            dk, a, n = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
            get = lambda k: single.column(k).to_numpy()
            done = get("lo") >= 0
            d, s, key, other = get("dk"), get("start"), get("key"), get("other")
            open_ = np.flatnonzero(~done)
            order = open_[np.lexsort((s[open_], d[open_], other[open_], key[open_]))]
            _, later = _later(order, [key, other], d, s)
            more = np.concatenate([np.flatnonzero(done), order[later]])
            dk, a, n = np.concatenate([dk, d[more]]), np.concatenate([a, s[more]]), np.concatenate([n, np.full(len(more), LEAST)])
            yield pa.RecordBatch.from_arrays([pa.array(dk), pa.array(a), pa.array(a + n)], names=["dk", "a", "b"])

    return _gathered(rows, parts).mapInArrow(scan, "dk long, a long, b long")


def _blocks(tables: Iterator[pa.Table], rows: int = 8_000) -> Iterator[pa.Table]:
    """Tables of whole groups in blocks of bounded size: one group, or about ``rows`` rows."""
    for table in tables:
        key = table.column("key").to_numpy()
        at = 0
        while at < len(key):
            end = len(key) if at + rows >= len(key) else int(np.searchsorted(key, key[at + rows - 1], "right"))
            yield table.slice(at, end - at)
            at = end


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with dk, a long that orders and tells apart documents: the id where ids are unique, else a stored rank."""
    ids = docs.select(F.col("doc_id").cast("long").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 or i is null or i < 0").isEmpty():
        return docs.withColumn("dk", F.col("doc_id").cast("long"))
    keyed = boxed(docs, doc_id=F.col("doc_id"), t=F.xxhash64("text"))
    distinct = keyed.select("doc_id", "t").distinct().withColumn("no_id", F.col("doc_id").isNull())
    ranks = row_numbers(distinct, [], ["no_id", "doc_id", "t"], "dk").select("doc_id", "t", "dk")
    return unboxed(join_null_safe(keyed, materialize(ranks), ["doc_id", "t"]), docs.columns, "dk")


def covers(docs: DataFrame, hot: int = 4096, batch_hot: int = 256) -> DataFrame:
    """(dk, spans) of numbered documents: each span is (first + 128) * 2^32 + end, not yet clipped to the document."""
    parts = partitions_for(docs)
    marks = materialize(marked(docs, hot, batch_hot, parts))
    found = scanned(suffixes(docs, marks), parts)
    pos = F.expr("code div 4")
    whole = marks.where(F.col("code") % 4 == COVER).select("dk", (pos - SPREAD).alias("a"), (pos + LEAST).alias("b"))
    spans = whole.unionByName(found).select("dk", (F.shiftleft(F.col("a") + 128, 32) + F.col("b")).alias("span"))
    return materialize(spans).groupBy("dk").agg(F.collect_list("span").alias("spans"))


def merged(spans: list[int] | np.ndarray | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, clipped to the document."""
    if spans is None or not len(spans):
        return []
    s = np.unique(np.asarray(spans, np.int64))
    a, b = np.maximum((s >> 32) - 128, 0), np.minimum(s & 0xFFFFFFFF, size)
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return list(zip(a[first].tolist(), reach[np.append(first[1:] - 1, len(a) - 1)].tolist()))


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts)


def removed(docs: DataFrame, hot: int = 4096, batch_hot: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = numbered(docs.select("doc_id", "text"))
    joined = rows.join(covers(rows, hot, batch_hot), "dk", "left").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: tuple[list, ...] = ([], [], [], [])
            for text, spans in zip(batch.column(1), batch.column(2)):
                text = text.as_py() or b""
                runs = merged(spans.values.to_numpy() if spans.is_valid else None, len(text))
                values = (len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(text, runs)).hexdigest())
                for column, value in zip(out, values):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, hot: int = 4096, batch_hot: int = 256) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; a character cut in two goes with them."""
    clash = {k: f"__own_{k}" for k in docs.columns if k in ("dk", "spans")}
    rows = numbered(docs.withColumnsRenamed(clash))
    names = [clash.get(k, k) for k in docs.columns]
    joined = rows.join(covers(rows.select("dk", "text"), hot, batch_hot), "dk", "left").select(*[c(k) for k in names], "spans")
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = []
            for text, spans in zip(batch.column(at), batch.column(len(names))):
                if spans.is_valid and text.is_valid:
                    raw = text.as_py().encode()
                    texts.append(_kept(raw, merged(spans.values.to_numpy(), len(raw))).decode("utf-8", "ignore"))
                else:
                    texts.append(text.as_py())
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(cut, joined.drop("spans").schema)
    return out.withColumnsRenamed({v: k for k, v in clash.items()})


def _owned(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, low, high): the passages whose anchor is the gram at ``at`` start at low to high - 1 (the leftmost of equal grams counts).

    ``first`` and ``last`` are the bounds of the anchors' documents. What a passage's anchor is depends on its bytes alone.
    """
    gram, low, high = np.zeros(len(at), U), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(0, len(at), 4096):
        t, f, e = at[k : k + 4096], first[k : k + 4096], last[k : k + 4096]
        place = t[:, None] + np.arange(-SPREAD, SPREAD + 1)
        fine = (place >= f[:, None]) & (place + GRAM <= e[:, None])
        flat = np.where(fine, place, t[:, None])
        grams = _mixed_grams(data, flat)
        own = grams[:, SPREAD : SPREAD + 1]
        before = np.where((fine & (grams <= own))[:, :SPREAD], np.arange(SPREAD) + 1, 0).max(axis=1)
        after = np.where((fine & (grams < own))[:, SPREAD + 1 :], np.arange(SPREAD) + 1, SPREAD + 1).min(axis=1)
        gram[k : k + 4096] = own[:, 0]
        low[k : k + 4096] = np.maximum(t - SPREAD + before, f)
        high[k : k + 4096] = np.minimum(t + after - SPREAD, e - LEAST + 1)
    return gram, low, high


def _mixed_grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the grams at a table of places, as ``anchors`` compares them."""
    lowest = int(at.min())
    rolling = Rolling(data[lowest : int(at.max()) + GRAM])
    return rolling.all(0, len(rolling.sums) - GRAM, GRAM)[at - lowest] | U(1)


def _contexts(docs: DataFrame) -> DataFrame:
    """(key, dk, start, n_starts, bytes) of the anchors whose gram occurs more than once: each passage belongs to one of them.

    Passages start at the first ``n_starts`` bytes of the context, which begins at ``start`` of the document.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            ids = batch.column(0).to_numpy()
            data, starts, ends = text_bytes(batch.column(1))
            doc, at, gram, _ = anchors(data, starts, ends)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(ids[doc]), pa.array(at - starts[doc])], names=["key", "dk", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            data, starts, ends = text_bytes(batch.column(1))
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = starts[doc] + lists.flatten().to_numpy()
            gram, low, high = _owned(data, at, starts[doc], ends[doc])
            pick = np.flatnonzero(high > low)
            low, high, doc = low[pick], high[pick], doc[pick]
            b = np.minimum(at[pick] + LEAST, ends[doc])
            strings = [data[x:y].tobytes() for x, y in zip(low.tolist(), b.tolist())]
            columns = (gram[pick].view(np.int64), ids[doc], low - starts[doc], high - low, strings)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=["key", "dk", "start", "n_starts", "bytes"])

    texts = docs.select("dk", F.col("text").cast("binary").alias("text"))
    found = materialize(texts.mapInArrow(emit, "key long, dk long, at long").distinct())
    shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    wanted = found.join(shared, "key").groupBy("dk").agg(F.collect_list("at").alias("ats"))
    rows = texts.join(wanted, "dk").mapInArrow(cut, "key long, dk long, start long, n_starts long, bytes binary")
    return rows.dropDuplicates(["dk", "start"])


def _array_groups(classes: DataFrame, parts: int) -> DataFrame:
    """(repeat, length, first, offset) from a suffix array of the contexts of each gram; of a class two contexts at most."""
    twice = F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(2).cast("long")))
    rows = classes.select("key", F.col("first.dk").alias("dk"), F.col("first.start").alias("start"), "n_starts", "bytes", F.explode(twice).alias("copy"))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(whole_groups(batches, ["key"])):
            release_memory()
            dk, start, n = (table.column(k).to_numpy() for k in ("dk", "start", "n_starts"))
            none = np.zeros(len(dk), np.int64)
            array = SuffixArray(table.column("bytes").to_pylist(), none, n, np.arange(len(dk)), none)
            for length, row, offset in array.groups():
                first = np.lexsort((start[row] + offset, dk[row]))[0]
                name = f"{dk[row][first]}:{start[row][first] + offset[first]}:{length}"
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(row)), pa.array(np.full(len(row), length)), pa.array(dk[row]), pa.array(start[row]), pa.array(offset)], names=["repeat", "length", "dk", "start", "offset"])

    found = _gathered(rows, parts).mapInArrow(groups, "repeat string, length long, dk long, start long, offset long").distinct()
    return found.select("repeat", "length", F.struct("dk", "start").alias("first"), "offset")


def _hashed_groups(classes: DataFrame) -> DataFrame:
    """The same for grams with too many classes for one task: every extension of a repeated passage is counted by its bytes."""
    at = lambda first, size: F.substring("bytes", F.col(first).cast("int") + 1, size)
    starts = classes.select("first", "n", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_starts") - 1)).alias("offset"))
    passages = starts.withColumn("passage", at("offset", F.lit(LEAST)))
    repeated = passages.groupBy("passage").agg(F.sum("n").alias("m")).where("m > 1").select("passage")
    kept = materialize(passages.join(repeated, "passage").drop("passage"))
    longer = kept.withColumn("length", F.explode(F.sequence(F.lit(LEAST).cast("long"), F.octet_length("bytes") - F.col("offset"))))
    longer = longer.withColumn("end", F.col("offset") + F.col("length")).withColumn("string", at("offset", F.col("length").cast("int")))
    # at a bound of the context the bytes outside are not known: the group is open there
    left = F.when(F.col("offset") > 0, F.substring("bytes", F.col("offset").cast("int"), F.lit(1)))
    right = F.when(F.col("end") < F.octet_length("bytes"), at("end", F.lit(1)))
    longer = longer.select("first", "n", "offset", "length", "string", left.alias("left"), right.alias("right"))
    place = F.struct(F.col("first.dk").alias("dk"), (F.col("first.start") + F.col("offset")).alias("start"))
    differ = lambda k: F.expr(f"count(*) > count({k}) or min({k}) <> max({k})")
    groups = longer.groupBy("string").agg(F.sum("n").alias("m"), F.min(place).alias("p"), differ("left").alias("l"), differ("right").alias("r")).where("m > 1 and l and r")
    named = groups.select("string", F.concat_ws(":", "p.dk", "p.start", F.octet_length("string")).alias("repeat"))
    return longer.join(named, "string").select("repeat", "length", "first", "offset")


def repeat_groups(docs: DataFrame, hot: int = 4096) -> DataFrame:
    """(repeat, length, dk, start): maximal repeat groups of numbered documents, with all their occurrences.

    Groups are maximal within the context of an anchor; a longer passage is a chain of groups. One context stands for each
    class of equal ones and its groups are dealt to all members. A gram with more than ``hot`` classes goes to no single task.
    """
    contexts = materialize(_contexts(docs))
    same = ["key", "n_starts", "bytes"]
    classes = contexts.groupBy(*same).agg(F.min(F.struct("dk", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("members")).where("members > 1")
    classes = materialize(classes.join(sizes, "key"))
    found = _array_groups(classes.where(F.col("classes") <= hot), partitions_for(docs)).unionByName(_hashed_groups(classes.where(F.col("classes") > hot)))
    members = contexts.join(classes.select(*same, "first"), same).select("first", "dk", "start")
    return materialize(found).join(members, "first").select("repeat", "length", "dk", (F.col("start") + F.col("offset")).alias("start"))


#: What ``removed`` returns, in SQL, for documents with unique ids as a view.
SQL = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, len(hex(coalesce(text, ''))) // 2 AS n FROM documents),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
f AS (SELECT m, min((doc_id, i)) AS one FROM k GROUP BY m HAVING count(*) > 1),
later AS (SELECT k.doc_id, k.i FROM k JOIN f USING (m) WHERE (k.doc_id, k.i) <> one),
parted AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM parted),
spans AS (SELECT doc_id, s, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY 1, 2),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, n) - x)), '' ORDER BY x) AS h FROM pieces JOIN d USING (doc_id) GROUP BY 1),
totals AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
