import itertools
import random
import resource
import zlib

import numpy as np
import pytest

from cellweave.llm import packing
from cellweave.llm.queries import tokenizer

TEXTS = [
    "Plain words, with punctuation! It's 3 o'clock.", "ÀÉ combining é and i̇ İstanbul ΣΑΣ", "tabs\tand\nnew\n\nlines\r\n x y z", "", " ", None,
    "<|endoftext|> in a text <|startoftext|>", "emoji 😀😀 and 中文字 ١٢٣", "don't we'll 'tis 's 're", "\x1c\x1f odd \x00 bytes", "a" * 3000 + " " + "b c " * 3000,
]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer()).encode(text or "", add_special_tokens=False).ids + [1]


def test_word_by_word_ids_are_the_ids_of_the_text():
    ids = packing.WordIds(tokenizer(), keep=3)
    for text, body in zip(TEXTS, ids.texts([t or "" for t in TEXTS])):
        assert np.frombuffer(body, "<u4").tolist() + [1] == whole(text), text
    rng = random.Random(3)
    letters = "ab 'sété\n\t.,İΣς́  中9"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text, body in zip(texts, packing.WordIds(tokenizer()).texts(texts)):
        assert np.frombuffer(body, "<u4").tolist() + [1] == whole(text), repr(text)


def used(plan):
    out = {}
    for times, filling in plan:
        for x, n in filling.items():
            out[x] = out.get(x, 0) + times * n
    return out


def optimum(lengths, capacity):
    """Fewest sequences by trying every assignment."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(lengths):
            return
        if i == len(lengths):
            best = min(best, len(rooms))
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= lengths[i]:
                go(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_bin_completion_finds_the_optimum_of_small_cases():
    rng, better = random.Random(8), 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 100])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(capacity // 5, capacity // 2) for _ in range(rng.randint(1, 11))]
        counts = {x: lengths.count(x) for x in lengths}
        plan = packing.bin_completion(counts, capacity)
        assert used(plan) == counts
        assert all(sum(x * n for x, n in f.items()) <= capacity for _, f in plan)
        n = sum(t for t, _ in plan)
        assert n == optimum(lengths, capacity)
        better += n < sum(t for t, _ in packing.best_fit(counts, capacity))
    assert better > 0


def test_fillings_are_undominated():
    left = {7: 1, 5: 1, 4: 1, 3: 1, 2: 2}
    stock = packing.Stock(left, 12)
    found = [(waste, {int(stock.size[i]): n for i, n in f.items()}) for waste, f in stock.fillings(0, 12, 10_000, 100)]
    every = []
    for k in range(5):
        for some in itertools.combinations([5, 4, 3, 2, 2], k):
            if sum(some) <= 5:
                every.append(tuple(sorted(some)))
    best = max(map(sum, every))
    assert found[0][0] == 5 - best
    assert len({tuple(sorted(f.items())) for _, f in found}) == len(found)
    for waste, filling in found:
        rest = {x: left[x] - filling.get(x, 0) for x in left}
        assert waste == 12 - sum(x * n for x, n in filling.items())
        assert not any(n and x <= waste for x, n in rest.items())
        assert not any(n and x < y <= x + waste for x in filling for y, n in rest.items() if x != 7)


def test_the_lower_bound_never_exceeds_the_optimum():
    rng, tight, beyond_sum = random.Random(4), 0, 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 100])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(capacity // 4, capacity // 2) for _ in range(rng.randint(1, 9))]
        bound, best = packing.lower_bound({x: lengths.count(x) for x in lengths}, capacity), optimum(lengths, capacity)
        assert -(-sum(lengths) // capacity) <= bound <= best
        tight += bound == best
        beyond_sum += bound > -(-sum(lengths) // capacity)
    assert tight > 250 and beyond_sum > 10
    assert packing.lower_bound({1400: 300}, 4096) == 150  # pieces over a third: two a sequence
    assert packing.lower_bound({}, 10) == 0


def test_a_gap_that_best_fit_leaves_on_thousands_of_lengths_is_closed():
    lengths = np.clip(np.random.default_rng(0).lognormal(6.0, 1.0, 280_000).astype(int) + 1, 1, 4096)
    counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    plan = packing.bin_completion(counts, 4096)
    most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before  # in units of 1,024 bytes
    n = sum(t for t, _ in plan)
    assert most < 100 << 10
    assert used(plan) == counts and len(counts) > 3000
    assert n == packing.lower_bound(counts, 4096) < sum(t for t, _ in packing.best_fit(counts, 4096))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(d, " ".join(rng.choice(["tok", "en", "isation", "é", "xyz"]) for _ in range(rng.choice([1, 5, 30, 200, 900]))), "x", 1) for d in range(80)]
    rows += [(100 + i, t, "x", 1) for i, t in enumerate(TEXTS)] + [rows[3], rows[3], (None, "no id", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, piece int").repartition(4)


def test_pieces_and_places(docs):
    capacity = 512
    rows = packing.packed(docs, tokenizer(), capacity).collect()
    want = []
    for r in docs.collect():
        ids = whole(r.text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(r.length for r in rows) // capacity) + 1


def test_empty_table(docs):
    assert packing.packed(docs.where("false"), tokenizer()).collect() == []
