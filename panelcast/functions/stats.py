"""Small numeric helpers evaluated once per result row (not per input row).

They run inside Arrow-batched pandas UDFs on already-aggregated rows (one
row per series). The exact KS p-value takes n1 x n2 steps for a series and is
meant for monthly calendars.
"""

from __future__ import annotations

import math

import numpy as np

def ks_exact_pvalue(d: float, n1: int, n2: int) -> float:
    """Two-sided p-value P(D >= d) of the two-sample KS statistic: the
    lattice-path probability that a random interleaving of the two samples
    reaches the band |i/n1 - j/n2| >= d, on anti-diagonals with normalised
    path weights (no binomial overflow, no 1 - x cancellation)."""
    if n1 <= 0 or n2 <= 0 or d is None or math.isnan(d):
        return float("nan")
    return 1.0 if d <= 0 else _ks_exact(d, n1, n2)


def _ks_exact(d: float, m: int, n: int) -> float:
    # |i*n - j*m| >= h  <=>  |i/m - j/n| >= d, with h an integer.
    h = int(round(d * m * n))
    # O[i, j]: share of monotone paths (0,0)->(i,j) that have touched the band.
    # O = 1 on band cells; elsewhere O[i,j] = (i O[i-1,j] + j O[i,j-1]) / (i+j).
    prev = None  # values on anti-diagonal s-1, indexed by i
    for s in range(0, m + n + 1):
        i_lo, i_hi = max(0, s - n), min(m, s)
        i = np.arange(i_lo, i_hi + 1)
        j = s - i
        if s == 0:
            cur = np.zeros(1)
        else:
            p_lo = max(0, s - 1 - n)
            up = np.zeros(i.size)    # from (i-1, j)
            left = np.zeros(i.size)  # from (i, j-1)
            ok = i >= 1
            up[ok] = prev[i[ok] - 1 - p_lo]
            ok2 = j >= 1
            left[ok2] = prev[i[ok2] - p_lo]
            cur = (i * up + j * left) / s
        band = np.abs(i * n - j * m) >= h
        cur = np.where(band, 1.0, cur)
        prev = cur
    return float(min(1.0, max(0.0, prev[-1])))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


# MacKinnon (1994) response-surface coefficients for the ADF test with a
# constant and one variable (published table; fixed values).
ADF_C_TAU_MAX = 2.74
ADF_C_TAU_MIN = -18.83
ADF_C_TAU_STAR = -1.61
ADF_C_SMALLP = (2.1659, 1.4412, 0.038269)
ADF_C_LARGEP = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_pvalue(stat: float) -> float:
    """Approximate p-value of an ADF t statistic (regression with constant)."""
    if stat is None or math.isnan(stat):
        return float("nan")
    if stat > ADF_C_TAU_MAX:
        return 1.0
    if stat < ADF_C_TAU_MIN:
        return 0.0
    coef = ADF_C_SMALLP if stat <= ADF_C_TAU_STAR else ADF_C_LARGEP
    z = sum(c * stat ** p for p, c in enumerate(coef))
    return normal_cdf(z)


# MacKinnon (2010) critical values for the ADF test with a constant, one
# variable: tau(nobs) = b0 + b1/nobs + b2/nobs^2 + b3/nobs^3 (fixed values).
ADF_C_CRIT = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def adf_critical_values(nobs: int) -> dict[str, float]:
    return {k: b[0] + b[1] / nobs + b[2] / nobs ** 2 + b[3] / nobs ** 3
            for k, b in ADF_C_CRIT.items()}


def adf_default_maxlag(nobs: int) -> int:
    """ceil(12 (n/100)^(1/4)), capped so the regression keeps enough rows."""
    return max(0, min(nobs // 2 - 2, int(math.ceil(12.0 * (nobs / 100.0) ** 0.25))))


def ols_centered(c: np.ndarray, cols: list[int], yi: int):
    """OLS with an intercept from the centred cross-products ``c``. Returns
    (beta over ``cols``, ssr, inverse of their cross-product matrix)."""
    cxy = c[cols, yi]
    inv = np.linalg.pinv(c[np.ix_(cols, cols)], hermitian=True)
    beta = inv @ cxy
    return beta, max(float(c[yi, yi] - beta @ cxy), 0.0), inv


def nested_ssr(c: np.ndarray) -> np.ndarray:
    """Residual sums of the last variable on the first 1, 2, ... others, from
    centred cross-products: one Cholesky factor, whose last row holds what each
    further variable explains. One that depends on those before explains nothing."""
    k = len(c)
    low = np.zeros((k, k))
    for j in range(k - 1):
        d = c[j, j] - low[j, :j] @ low[j, :j]
        if d > 1e-12 * c[j, j]:
            low[j:, j] = (c[j:, j] - low[j:, :j] @ low[j, :j]) / math.sqrt(d)
    return np.maximum(c[-1, -1] - np.cumsum(low[-1, :-1] ** 2), 0.0)
