"""Packing token sequences by bin completion (branch and bound).

Documents become token ids, cut into pieces of at most ``capacity``. How to fill sequences depends on the piece lengths
alone, so the search works on the count of pieces of each length: at most ``capacity`` numbers whatever the corpus. A plan is
a list of fillings with multiplicities. Each piece then finds its sequence and place from its rank among the pieces of its
length, in parallel.

Defined results: null text is empty; an empty document is the closing id alone; repeated rows are packed as often as they
occur; texts of any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, ranked, seeded, slices

CLOSING_ID = 1


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a character: itself where it is printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(maxsize=100_000)
def ends_in_letter(character: str) -> bool:
    """Whether the character is still a letter at its end once it is composed and in lower case."""
    return unicodedata.normalize("NFC", character).lower()[-1:].isalpha()


class WordIds(dict):
    """Word to token ids, as little-endian bytes; a word not seen before is encoded and remembered.

    The vocabulary's rules never look across a space, so a text's ids are the ids of its parts between spaces, one after
    another. A word of Latin letters only is one token run in lower case and goes to the merges at once. A comma or full
    stop behind a letter is a run of its own, so such variants share their encoding. Two generations of about ``keep`` words
    bound the memory.
    """

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.keep, self.old = Tokenizer.from_file(path), keep, {}
        self.merge, self.characters = self.tokenizer.model.tokenize, byte_characters()
        self.number = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.tails = {x: self.encoded(x) for x in ",."}

    def encoded(self, word: str) -> bytes:
        return b"".join([self.number[k] for k in self.tokenizer.encode(word, add_special_tokens=False).ids])

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        for text in texts:
            yield b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            last = word[-1]
            if last in self.tails and ends_in_letter(word[-2:-1]):
                ids = self[word[:-1]] + self.tails[last]
            else:
                low = word.lower()
                if not low.isalpha() or not low.isascii() and max(low) >= "\u0250":
                    ids = self.encoded(word)
                elif low != word:
                    ids = self[low]
                else:
                    run = low if low.isascii() else low.encode().decode("latin-1").translate(self.characters)
                    ids = b"".join([self.number[t.id] for t in self.merge(run)])
        self[word] = ids
        return ids


_IDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids as bytes) of every document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _IDS.setdefault(tokenizer, WordIds(tokenizer)) if tokenizer not in _IDS else _IDS[tokenizer]
        step = 4 * capacity
        for part in slices(batches, 1, 1 << 20):
            ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, body in zip(ids, words.texts(texts)):
                body += CLOSING_ID.to_bytes(4, "little")
                for k, b in enumerate(range(0, len(body), step)):
                    piece = body[b : b + step]
                    for column, value in zip(out, (doc, k, b // 4, len(piece) // 4, zlib.crc32(piece), piece)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)][: len(names)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


Plan = list[tuple[int, dict[int, int]]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Fillings (times, {length: how many}) by largest first, each gap taking the longest piece that fits."""
    left, out = dict(counts), []
    order = sorted((x for x in left if left[x]), reverse=True)
    while order:
        room, filling, i = capacity, {}, 0
        while i < len(order) and room:
            n = min(left[order[i]], room // order[i])
            if n:
                filling[order[i]] = n
                room -= n * order[i]
            i += 1
        times = min(left[x] // n for x, n in filling.items())
        for x, n in filling.items():
            left[x] -= times * n
        out.append((times, filling))
        order = [x for x in order if left[x]]
    return out


def lower_bound(counts: dict[int, int], capacity: int, most: int = 64) -> int:
    """Sequences that any plan needs: the best of the sum of lengths and two families of dual feasible functions.

    A piece longer than ``capacity - e`` counts as a whole sequence and one shorter than ``e`` as nothing, for every e up to half
    of ``capacity`` (Martello and Toth, 1990); in between it counts as its share, or as the share rounded to ``floor((k + 1) x) / k``
    for k up to ``most`` (Fekete and Schepers, 2001), which knows that three pieces over a third never meet.
    """
    size = np.array(sorted(x for x in counts if counts[x]), np.int64)
    if not len(size):
        return 0
    n = np.array([counts[int(x)] for x in size], np.int64)
    e = np.append(size[2 * size <= capacity], 0)
    first, last = np.searchsorted(size, e), np.searchsorted(size, capacity - e, "right")
    whole = np.append(0, np.cumsum(n))
    best = 0
    for k in range(most + 1):
        exact = np.ones(len(size), bool) if k == 0 else (k + 1) * size % capacity == 0
        share = np.append(0, np.cumsum(np.where(exact, n * size, 0)))
        steps = np.append(0, np.cumsum(np.where(exact, 0, n * ((k + 1) * size // capacity))))
        k = max(k, 1)
        top = k * (share[last] - share[first]) + capacity * (steps[last] - steps[first])  # times 1 / (k capacity)
        best = max(best, int((-(-top // (k * capacity)) + whole[-1] - whole[last]).max()))
    return best


class Stock:
    """Pieces left, by length from the longest; ``fillings`` looks for sequences around the longest one left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.size = np.array(sorted((x for x in counts if counts[x]), reverse=True), np.int64)
        self.left = np.array([counts[int(x)] for x in self.size], np.int64)
        self.capacity = capacity

    def move(self, filling: dict[int, int], times: int) -> None:
        """Take the filling's pieces away ``times`` times; a negative number puts them back."""
        for i, n in filling.items():
            self.left[i] -= times * n

    def longest(self, start: int) -> int:
        """The index of the longest piece left, from ``start`` on; the number of lengths if none is left."""
        some = self.left[start:] > 0
        return start + int(some.argmax()) if some.any() else len(self.size)

    def fillings(self, start: int, most_waste: int, steps: int, width: int) -> list[tuple[int, dict[int, int]]]:
        """At most ``width`` undominated fillings around the longest piece: (waste, {index: how many}), least waste first.

        A filling is dominated, and skipped, if a left-out piece would still fit, or could replace a shorter chosen one within
        the gap. Branches whose gap can't come down to the waste still allowed are cut, a gap that one piece closes is closed at
        once, and the search ends with ``width`` fillings without waste or after ``steps`` branchings.
        """
        room = self.capacity - int(self.size[start])
        low = int(np.searchsorted(-self.size, -room))
        stock = self.left.copy()
        stock[start] -= 1
        live = low + np.flatnonzero(stock[low:])
        sizes, counts = self.size[live].tolist(), stock[live].tolist()
        reach = np.append(np.cumsum((self.size[live] * stock[live])[::-1])[::-1], 0).tolist()
        at = {x: i for i, x in enumerate(sizes)}
        rising = [-x for x in sizes]
        found: list[tuple[int, dict[int, int]]] = []
        seen: set[tuple] = set()
        best, budget = most_waste, steps

        def spare(i: int, chosen: dict[int, int]) -> bool:
            return counts[i] > chosen.get(i, 0)

        def undominated(gap: int, chosen: dict[int, int]) -> bool:
            for i in range(len(sizes) - 1, -1, -1):
                if spare(i, chosen):
                    if sizes[i] <= gap:
                        return False
                    break
            for i, x in enumerate(sizes[: max(chosen, default=-1) + 1]):
                j = i - 1
                while i in chosen and j >= 0 and sizes[j] <= x + gap:
                    if spare(j, chosen):
                        return False
                    j -= 1
            return True

        def keep(gap: int, chosen: dict[int, int]) -> None:
            nonlocal best
            mark = tuple(sorted(chosen.items()))
            if gap <= best and mark not in seen and (not gap or undominated(gap, chosen)):
                seen.add(mark)
                found.append((gap, dict(chosen)))
                best = min(best, gap) if len(found) >= width else best

        def search(i: int, gap: int, chosen: dict[int, int]) -> bool:
            """True when the search is over."""
            nonlocal budget
            budget -= 1
            closing = at.get(gap)
            if closing is not None and closing >= i and spare(closing, chosen):
                keep(0, chosen | {closing: chosen.get(closing, 0) + 1})
            else:
                i = max(i, bisect_left(rising, -gap))
                if i == len(sizes) or not gap:
                    keep(gap, chosen)
                elif gap - reach[i] <= best:
                    for n in range(min(counts[i], gap // sizes[i]), -1, -1):
                        if search(i + 1, gap - n * sizes[i], chosen | {i: n} if n else chosen):
                            return True
            return budget <= 0 or (best == 0 and len(found) >= width)

        search(0, room, {})
        out = []
        for waste, chosen in sorted(found, key=lambda f: f[0])[:width]:
            filling = {int(live[i]): n for i, n in chosen.items()}
            filling[start] = filling.get(start, 0) + 1
            out.append((waste, filling))
        return out


class Branching:
    """One sequence of the plan in the making: the fillings to try there and the one in place."""

    __slots__ = ("start", "waste", "options", "tried", "placed", "wide")

    def __init__(self, start: int, waste: int, options: list):
        self.start, self.waste, self.options, self.tried, self.placed, self.wide = start, waste, options, 0, None, False


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 2000, steps: int = 300, width: int = 4) -> Plan:
    """Fillings that use every piece, in as few sequences as found within ``nodes`` branchings after the first plan.

    Best-fit decreasing is the first incumbent. If it needs more sequences than ``lower_bound``, the search goes down sequence by
    sequence, around the longest piece left, by the filling of least waste, used as often as the counts let it; then it
    backtracks over the other undominated fillings and over using a filling once. A branch ends when its waste exceeds what one
    sequence fewer than the incumbent's would allow. The search holds one set of counts, taken from and put back, and one entry
    for each filling on the way: memory grows with the number of lengths, not with the branchings.
    """
    incumbent = best_fit(counts, capacity)
    least, total = lower_bound(counts, capacity), sum(x * n for x, n in counts.items())
    most = sum(t for t, _ in incumbent)
    if most <= least:
        return incumbent
    stock = Stock(counts, capacity)
    sizes, used = stock.size.tolist(), 0
    allowed = (most - 1) * capacity - total

    def branching(start: int, waste: int) -> Branching:
        return Branching(start, waste, stock.fillings(start, min(capacity, allowed - waste), steps, 1))

    way, first = [branching(0, 0)], True
    while way and most > least:
        here = way[-1]
        if here.placed:
            _, filling, times = here.placed
            stock.move(filling, -times)
            used, here.placed, first = used - times, None, False
        if here.tried == len(here.options) and not here.wide:
            here.wide = True
            here.options = here.options[:1] + [f for f in stock.fillings(here.start, min(capacity, allowed - here.waste), steps, width) if f not in here.options[:1]]
            once = [(gap, filling, 1) for gap, filling, *_ in here.options if min(stock.left[i] // n for i, n in filling.items()) > 1]
            here.options = [*here.options, *once]
        if here.tried == len(here.options):
            way.pop()
            continue
        if not first:
            nodes -= 1
            if nodes < 0:
                break
        gap, filling, *once = here.options[here.tried]
        here.tried += 1
        times = once[0] if once else int(min(stock.left[i] // n for i, n in filling.items()))
        stock.move(filling, times)
        here.placed, used = (gap, filling, times), used + times
        start = stock.longest(here.start)
        if start == len(sizes):
            if used < most:
                incumbent = [(b.placed[2], {sizes[i]: n for i, n in b.placed[1].items()}) for b in way]
                most, allowed = used, (used - 1) * capacity - total
        elif here.waste + gap * times <= allowed and used + 1 < most:
            way.append(branching(start, here.waste + gap * times))
    return incumbent


def places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many in each sequence, offset there), by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in plan:
        offset = 0
        for x in sorted(filling, reverse=True):
            rows.append((x, used.get(x, 0), sequence, filling[x], offset))
            used[x] = used.get(x, 0) + times * filling[x]
            offset += x * filling[x]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, seed: int = 5) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece and its place."""
    key = seeded(seed, F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))
    cut = materialize(pieces(docs, tokenizer, capacity).withColumn("key", key))
    # at most `capacity` lengths
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(bin_completion(counts, capacity))
    span = 1 << 44
    starts = table[:, 0] * span + table[:, 1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            row = table[np.searchsorted(starts, length * span + rank, "right") - 1]
            inside = rank - row[:, 1]
            sequence, offset = row[:, 2] + inside // row[:, 3], row[:, 4] + inside % row[:, 3] * length
            columns = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(cut, ["length"], "key", ["doc_id", "piece"], "rank").mapInArrow(put, schema)
