import math

import numpy as np
import pytest

from cellweave.llm import vectors


def rows(seed=0, dim=12):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(25):
        center = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, 25))):
            out.append((center + rng.standard_normal(dim) * rng.choice([0.01, 0.25, 0.35])).astype(np.float32).tolist())
    out += [out[3], out[3], [2 * x for x in out[3]], [1e-30 * x for x in out[4]]]
    out += [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1), [], [1.0, 0.0], [1.0, 0.01]]
    return [(i * 3 % 1009, v, "x") for i, v in enumerate(out)]


def brute(data, cosine=0.95):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, float) / np.abs(v).max() / np.linalg.norm(np.array(v, float) / np.abs(v).max()) if ok(v) else None for _, v, *_ in data]
    link = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= cosine
    near = [[j for j in range(len(data)) if j != i and link(unit[i], unit[j])] for i in range(len(data))]
    out, seen = [None] * len(data), set()
    for i in range(len(data)):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            j = todo.pop()
            if j not in group:
                group.add(j)
                todo += near[j]
        seen |= group
        first = min((data[j][0] for j in group if data[j][0] is not None), default=None)
        for j in group:
            out[j] = (data[j][0], len(near[j]), first, data[j][0] == first)
    return out


@pytest.mark.parametrize("cell_rows, sample, block", [(1024, 16384, 2048), (20, 16384, 2048), (10, 100, 7)])
def test_links_match_all_pairs(spark, cell_rows, sample, block):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, v string").repartition(5)
    got = [tuple(r) for r in vectors.near_duplicates(df, cell_rows=cell_rows, sample_rows=sample, block_rows=block).collect()]
    assert sorted(got) == sorted(brute(data))
    assert any(n > 3 for _, n, _, _ in got)


def test_null_ids_and_empty_table(spark):
    data = [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (7, [1.0, 0.02]), (7, [1.0, 0.02]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in vectors.near_duplicates(df).collect()), key=repr)
    want = [(7, 3, 7, True), (7, 3, 7, True), (None, 0, None, True), (None, 3, 7, False), (None, 3, 7, False)]
    assert got == sorted(want, key=repr)
    assert vectors.near_duplicates(df.where("false")).collect() == []


def test_every_close_pair_meets_in_a_home_cell():
    rng = np.random.default_rng(1)
    x = vectors.unit_rows(rng.standard_normal((400, 5)))
    centers = vectors.spherical_kmeans(x[:200], 25, 3)
    at, cell, home = vectors.cells_of(x, centers, 0.9)
    present = [set() for _ in x]
    for i, c in zip(at.tolist(), cell.tolist()):
        present[i].add(c)
    assert all(h in p for h, p in zip(home.tolist(), present)) and len(set(home.tolist())) > 10
    one_sided = 0
    for i, j in zip(*np.nonzero(x @ x.T >= 0.9)):
        assert home[i] in present[j] or home[j] in present[i]
        one_sided += (home[i] in present[j]) != (home[j] in present[i])
    assert one_sided > 0
