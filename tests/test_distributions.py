import itertools
import math

import numpy as np
import pytest

from foldloom.functions import distributions as dist


def test_tails_against_known_values():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.0733880347707405, rel=1e-10)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert dist.chi2_sf(30.0, 4) == pytest.approx(math.exp(-15) * 16, rel=1e-10)
    assert dist.f_sf(4.0, 1, 10) == pytest.approx(dist.t_two_sided(2.0, 10), rel=1e-12)
    assert dist.f_sf(3.0, 2, 10) == pytest.approx((1 + 2 * 3 / 10) ** -5, rel=1e-12)
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_tails_against_the_jvms_library(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for d1, d2, x in ((2, 30, 0.5), (5, 120, 2.2), (1, 3, 40.0)):
        assert dist.f_sf(x, d1, d2) == pytest.approx(1 - jvm.FDistribution(float(d1), float(d2)).cumulativeProbability(x), abs=1e-9)
    for df, x in ((1, 0.1), (7, 12.0), (40, 60.0)):
        assert dist.chi2_sf(x, df) == pytest.approx(1 - jvm.ChiSquaredDistribution(float(df)).cumulativeProbability(x), abs=1e-9)


def test_shapiro_wilk():
    w, p = dist.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))  # a published example
    assert (round(w, 2), round(p, 3)) == (0.79, 0.007)
    normal = np.array([dist._NORMAL.inv_cdf((i + 0.5) / 60) for i in range(60)])
    assert dist.shapiro_wilk(normal)[1] > 0.9 and dist.shapiro_wilk(np.exp(2 * normal))[1] < 1e-6
    assert dist.shapiro_wilk(np.ones(9)) == (1.0, 1.0)


def test_exact_signed_rank_against_all_signs():
    n = 8
    sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
    for w in (0, 3, 9, 17, 18):
        assert dist.signed_rank_p(w, n, 0, False) == pytest.approx(min(1, 2 * np.mean([s <= w for s in sums])))
    assert math.isnan(dist.signed_rank_p(0, 0, 0, True))
