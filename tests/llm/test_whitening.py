import math
import random

import numpy as np
import pytest

from cellweave.llm import whitening


def residual(a, value, x):
    return max(np.abs(a @ x - x * value).max() / np.abs(a).max(), np.abs(x.T @ x - np.eye(len(a))).max())


@pytest.mark.parametrize("kind", ["spread", "pairs", "close", "equal", "low rank", "geometric", "one"])
def test_eigenvectors_are_exact_to_double(kind):
    rng, d = np.random.default_rng(5), 1 if kind == "one" else 40
    value = {
        "spread": np.arange(1.0, d + 1), "pairs": np.repeat(np.arange(1.0, d // 2 + 1), 2), "close": 1 + 1e-9 * np.arange(d), "equal": np.ones(d), "one": np.array([3.0]),
        "low rank": np.where(np.arange(d) < 5, np.arange(d) + 1.0, 0.0), "geometric": 10.0 ** -np.linspace(0, 12, d),
    }[kind]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * value) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.symmetric_eigen(a)
    assert got == pytest.approx(np.sort(value)[::-1], abs=1e-14 * value.max() * d)
    assert (np.diff(got) <= 1e-15 * d).all()
    assert residual(a, got, x) < 1e-14 * d
    if kind == "close":  # the float32 start cannot tell these apart
        want = np.linalg.eigh(a)[1][:, ::-1]
        assert np.abs(np.abs(np.sum(want * x, axis=0)) - 1).max() < 1e-9


def fixture(rng, n, d):
    basis = [[rng.gauss(0, 1) / (j + 1) for _ in range(d)] for j in range(d)]
    return [[sum(z * b[k] for z, b in zip([rng.gauss(0, 1) for _ in range(d)], basis)) for k in range(d)] for _ in range(n)]


def brute(rows, d, most):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[c - t / n for c, t in zip(x, s)] for x in fit])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    out = {}
    for i, x in kept:
        w = (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)
        out.setdefault((i, sum((n * c - t) ** 2 for c, t in zip(x, s))), []).append(w)
    return n, e / np.trace(v), out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    some = fixture(rng, 300, 20)
    bad = [None, [], [None] * 20, [1.0] * 19, [float("nan")] * 20, [0.5] * 19 + [float("inf")], [0.5] * 19 + [None]]
    return list(enumerate(some)) + [(1000 + i, some[0]) for i in range(400)] + [(None, some[1]), (None, None), (5, some[5])] + [(2000 + i, v) for i, v in enumerate(bad)]


def test_whitening_matches_brute_force(spark, rows):
    df = spark.createDataFrame([(i, v, 1, b"x") for i, v in rows], "vec_id long, embedding array<double>, n int, x binary").repartition(6)
    got = whitening.whitened(df).collect()
    n, explained, want = brute(rows, 20, 16)
    assert {r.n for r in got} == {n} and len(got) == 16 * sum(map(len, want.values()))
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
    assert found.keys() == want.keys()
    sign = np.array([np.sign(np.dot([found[k][c][0] for k in want], [w[0][c - 1] for w in want.values()])) for c in range(1, 17)])
    for k, all_ in want.items():
        for c in range(1, 17):
            assert sign[c - 1] * np.array(found[k][c]) == pytest.approx([w[c - 1] for w in all_], abs=1e-8)


def test_too_few_vectors_large_entries_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0]), (3, [2.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = whitening.whitened(df).collect()
    assert len(got) == 9 and {r.n for r in got} == {2}
    assert [round(abs(r.whitened), 9) if r.component == 1 else r.whitened for r in got] == [1.0, None, None] * 3
    assert whitening.whitened(df.where("vec_id > 1")).where("whitened is null and explained = 0").count() == 6
    assert whitening.whitened(df.where("false")).collect() == []
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e6, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.deviation) for r in whitening.whitened(huge).collect()} == {(1, None), (2, None), (3, 128_000_000**2 + 192**2)}


def test_deviations_are_exact():
    y, sums = np.array([[3, -4], [1 << 20, 5]]), [10, -7]
    for n in (7, 1 << 40):
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in y.tolist()]
        assert whitening.deviations(y, n, sums) == [v if v < 1 << 63 else None for v in exact]


def test_encoding_is_canonical():
    for x in ([0, -1, 5], [127, -128], [128], [-129], [1 << 40, 3], [-(1 << 61)]):
        a = np.array(x, np.int64)
        import pyarrow as pa

        assert whitening.decoded(pa.array([whitening.encoded(a)]), len(x)).tolist() == [x]
