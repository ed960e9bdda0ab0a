import itertools
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cohort_audit.functions import special as S


def test_beta_closed_forms():
    # One success: 1 - (1 - p)^n; all but one: p^n + n p^(n-1) (1-p) as binomial tails.
    lo, _ = S.clopper_pearson(1, 20)
    assert 1 - (1 - lo) ** 20 == pytest.approx(0.025, abs=1e-9)
    _, hi = S.clopper_pearson(19, 20)
    assert hi**20 == pytest.approx(0.975, abs=1e-9)
    assert S.clopper_pearson(0, 0) == (0.0, 1.0)
    assert S.clopper_pearson(0, 10)[0] == 0 and S.clopper_pearson(10, 10)[1] == 1


@given(st.integers(1, 200), st.data())
def test_clopper_pearson_holds_the_estimate(n, data):
    s = data.draw(st.integers(0, n))
    lo, hi = S.clopper_pearson(s, n)
    assert 0 <= lo <= s / n <= hi <= 1


def test_chi_square_tails():
    assert S.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert S.chi2_sf(2 * math.log(20), 2) == pytest.approx(0.05, abs=1e-12)
    assert S.chi2_sf(0, 3) == 1


def test_fisher_by_enumeration():
    a, b, c, d = 8, 2, 1, 5
    n, r, k = a + b + c + d, a + b, a + c
    p = {x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r) for x in range(max(0, r + k - n), min(r, k) + 1)}
    assert S.fisher_exact(a, b, c, d) == pytest.approx(sum(v for v in p.values() if v <= p[a] + 1e-12))


@given(*[st.integers(0, 60)] * 4)
def test_fisher_of_any_small_table(a, b, c, d):
    r1, r2, k = a + b, c + d, a + c
    p = {x: math.comb(r1, x) * math.comb(r2, k - x) for x in range(max(0, k - r2), min(k, r1) + 1)}
    assert S.fisher_exact(a, b, c, d) == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)) / math.comb(r1 + r2, k), abs=1e-12, rel=1e-9)


def test_fisher_at_large_counts():
    """A thousand million rows an arm: the normal limit with its continuity correction, and no work by row."""
    n, k = 10**9, 300_000_000
    shift = 50_000
    z = (2 * shift - 1) / math.sqrt(2 * n * 0.3 * 0.7)
    assert S.fisher_exact(k + shift, n - k - shift, k - shift, n - k + shift) == pytest.approx(S.two_sided_p(z), rel=1e-3)
    assert S.fisher_exact(k, n - k, k, n - k) == pytest.approx(1.0) and S.fisher_exact(n, 0, 0, n) == 0.0
    small = S.fisher_exact(5_100, 4_900, 4_900, 5_100)
    assert small == pytest.approx(S.two_sided_p(199 / math.sqrt(20_000 / 4)), rel=5e-3)


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (3, 4), (5, 5), (2, 9), (7, 5), (6, 6)])
def test_ks_by_all_orders(n1, n2):
    orders = list(itertools.combinations(range(n1 + n2), n1))
    far = []
    for order in orders:
        i = np.cumsum(np.isin(np.arange(n1 + n2), order))
        far.append(int(np.abs(i * n2 - (np.arange(1, n1 + n2 + 1) - i) * n1).max()))
    for d in sorted(set(far)):
        assert S.ks_exact(d / (n1 * n2), n1, n2) == pytest.approx(np.mean([f >= d for f in far]), abs=1e-12)


def test_ks_small_and_large():
    """A distance of 1 has two orders; exact and asymptotic meet for large samples."""
    assert S.ks_p(1.0, 12, 12) == pytest.approx(2 / math.comb(24, 12), rel=1e-12)
    assert S.ks_p(1.0, 200, 300) == pytest.approx(2 / math.comb(500, 200), rel=1e-9)
    assert S.ks_exact(0.03, 3000, 3000) == pytest.approx(S.ks_asymptotic(0.03, 3000, 3000), rel=0.02)
    assert S.ks_p(0.01, 10**6, 10**6) == S.ks_asymptotic(0.01, 10**6, 10**6)
