import itertools
import random

import numpy as np
import pytest

from cellweave.llm import mixing


def test_knapsack_reaches_the_best_sum():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 4))))
        counts = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(0, 80)
        sums = {sum(n * x for n, x in zip(take, lengths)) for take in itertools.product(*(range(c + 1) for c in counts))}
        take = mixing.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_stays_within_budget_and_counts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.unique(rng.integers(0, 3000, 200))
        counts = rng.integers(1, 20, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert budget - int((take * lengths).sum()) in range(0, 2)


def goals(sizes, weights):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        level = rest / sum(w[s] for s in free) if free else 0
        above = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= above


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = []
    for d in range(900):
        source = rng.choices(["b", "é", "a", None, "big", "Z"], [1, 4, 3, 5, 30, 1])[0]
        rows.append((d, " ".join(["w"] * rng.choice([0, 1, 3, 7, 7, 7, 40, rng.randint(1, 90)])), source, "x", 1.5))
    rows += [(5000, None, "b", "x", 1.0), (5001, "", "nothing", "x", 1.0), (5002, " \n", "nothing", "x", 1.0), (1, "two words", "b", "x", 0.0), (1, "two words", "b", "x", 0.0), (None, "three words here", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, passes double").repartition(7)


def test_sources_come_near_their_targets(docs):
    rows = mixing.decisions(docs).collect()
    assert len(rows) == docs.count()
    size, taken, target = {}, {}, {}
    for r in rows:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = goals(size, (5, 2, 1))
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 1, (s, taken[s], target[s])
    assert {r.source_size for r in rows if r.source == "b"} == {size["b"]}


def test_reruns_agree_whatever_the_partitions(docs):
    once = sorted(mixing.decisions(docs).collect(), key=repr)
    assert once == sorted(mixing.decisions(docs.repartition(3, "text")).collect(), key=repr)


def test_mix_repeats_documents_and_keeps_columns(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = {}
    for r in mixing.decisions(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty_table(docs):
    none = docs.where("false")
    assert mixing.decisions(none).collect() == [] and mixing.mix(none).collect() == []


def test_mix_keeps_columns_of_any_name(spark):
    names = ["__key", "__low", "__times", "row", "row_key", "low", "more", "times", "copy"]
    rows = [(i, "word " * (1 + i % 7), "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in range(40)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = list(map(tuple, out.collect()))
    assert set(got) <= set(rows) and len(got) == sum(r.copies for r in mixing.decisions(df).collect())


def test_very_long_texts_count_whole(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w " * 300_000, "b"), (3, "x", "b")], "doc_id long, text string, source string")
    assert {r.doc_id: r.size for r in mixing.decisions(df).collect()} == {1: 300_000, 2: 300_000, 3: 1}
