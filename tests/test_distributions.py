"""Tail probabilities against published table values."""

import math
from itertools import combinations

import numpy as np
import pytest

from cellweave.functions import dist


def test_t_table():
    # two-sided 5 % critical values
    for df, t in ((1, 12.7062), (5, 2.5706), (10, 2.2281), (30, 2.0423)):
        assert dist.t_two_sided([t], [df])[0] == pytest.approx(0.05, abs=1e-5)  # the table has four decimals


def test_chi2_and_f_tables():
    for k, x in ((1, 3.8415), (4, 9.4877), (10, 18.3070)):
        assert dist.chi2_upper([x], [k])[0] == pytest.approx(0.05, abs=2e-5)
    for d1, d2, f in ((2, 10, 4.1028), (5, 20, 2.7109)):
        assert dist.f_upper([f], [d1], [d2])[0] == pytest.approx(0.05, abs=2e-5)


def test_normal():
    assert dist.normal_two_sided(np.array([1.959964]))[0] == pytest.approx(0.05, abs=1e-6)


def test_exact_rank_sum_by_enumeration():
    n1, n2 = 3, 4
    us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(v >= top for v in us) / len(us))
        assert dist.mwu_two_sided([u], [n1], [n2], [0])[0] == pytest.approx(want)
    assert dist.mwu_two_sided([0], [4], [3], [0])[0] == pytest.approx(2 / 35)


def test_fisher_tea():
    assert dist.fisher_two_sided([3], [1], [1], [3])[0] == pytest.approx(34 / 70)


def test_rank_sum_with_ties_uses_normal():
    p = dist.mwu_two_sided([10.0], [5], [6], [6.0])[0]
    var = 30 / 12 * (12 - 6 / 110)
    assert p == pytest.approx(math.erfc((20 - 15 - 0.5) / math.sqrt(2 * var)))


def test_rank_sum_is_exact_whatever_the_larger_group():
    # the same U beside a small group, with no step where a table would have been given up
    a, b = dist.mwu_two_sided([10000.0, 10000.0], [4, 4], [49_999, 50_001], [0, 0])
    assert a == pytest.approx(b, rel=1e-3)
    # counted by recursion over the groups: f(u; m, n) = f(u - n; m - 1, n) + f(u; m, n - 1)
    def ways(u, m, n, seen={}):
        if u < 0 or m < 0 or n < 0:
            return 0
        if m == 0 or n == 0:
            return int(u == 0)
        if (u, m, n) not in seen:
            seen[u, m, n] = ways(u - n, m - 1, n) + ways(u, m, n - 1)
        return seen[u, m, n]

    for m, n in ((2, 9), (5, 7), (8, 12)):
        for u in range(0, m * n + 1, 3):
            want = sum(ways(v, m, n) for v in range(u + 1)) / math.comb(m + n, m)
            assert dist._u_at_most(u, m, n) == pytest.approx(want, rel=1e-12)
    assert dist._u_at_most(8 * 10**7 // 2, 8, 10**7) == pytest.approx(0.5, abs=1e-6)


def test_tails_settle_at_any_size():
    # at its mean a chi-square lies above one half by the skewness term 2 / (3 sqrt(pi k)) ... less than one half is above it
    for k in (1e4, 1e6, 1e7, 1e8):
        want = 0.5 - 1 / (3 * math.sqrt(math.pi * k))
        assert dist.chi2_upper([k], [k])[0] == pytest.approx(want, abs=1e-7)
    for a in (10.0, 1e4, 5e7):
        assert dist.beta_inc(a, a, 0.5) == pytest.approx(0.5, abs=1e-9)
    # I_x(a, 1) = x^a and P(chi2_2 > x) = exp(-x / 2)
    assert dist.beta_inc(30.5, 1.0, 0.9) == pytest.approx(0.9**30.5, rel=1e-13)
    assert dist.chi2_upper([40.0], [2])[0] == pytest.approx(math.exp(-20), rel=1e-13)
    # an odd number of degrees: P(chi2_1 > x) = erfc(sqrt(x / 2)); t with 1 degree is Cauchy
    assert dist.chi2_upper([7.3], [1])[0] == pytest.approx(math.erfc(math.sqrt(3.65)), rel=1e-13)
    assert dist.t_two_sided([3.0], [1])[0] == pytest.approx(1 - 2 * math.atan(3) / math.pi, rel=1e-12)


@pytest.mark.parametrize("df", [5.0, 295.0, 1e4, 1e6, 1e8])
def test_large_batches_settle_element_by_element(df):
    rng, n, limit = np.random.default_rng(1), 10_000, min(df, 1e6)
    t, f, x = 2 * rng.standard_normal(n), rng.f(3, limit, n), rng.chisquare(df, n)
    for values, tail in ((t, lambda v: dist.t_two_sided(v, df)), (f, lambda v: dist.f_upper(v, 3, df)), (x, lambda v: dist.chi2_upper(v, df))):
        whole, some = tail(values), range(0, n, 1000)
        assert np.isfinite(whole).all()
        assert whole[some] == pytest.approx([tail(values[i : i + 1])[0] for i in some], rel=1e-12)


def test_fisher_sums_around_the_mode_and_the_observed_count():
    assert dist.fisher_two_sided([40_000_000], [40_000_000], [40_000_000], [40_000_000])[0] == pytest.approx(1.0, abs=1e-3)
    assert dist.fisher_two_sided([9000], [1000], [1000], [9000])[0] == 0.0
    assert dist.fisher_two_sided([900], [1000], [1000], [900])[0] == pytest.approx(math.erfc(3.212 / math.sqrt(2)), rel=0.02)
