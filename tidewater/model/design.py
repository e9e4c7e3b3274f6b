"""The additive model's design matrix and MAP solve (numpy; runs inside Spark tasks).

Model (scaled units, from the published description of the forecasting library):
    y / y_scale = m + k t + sum_j delta_j max(t - s_j, 0)            piecewise-linear trend
                + sum Fourier terms (yearly, weekly, daily)            seasonality
                + sum_h beta_h [calendar date of ds is a promotion h day]
with t = (ds - ds_min) / (ds_max - ds_min). Priors: m, k ~ N(0, 5); delta ~ Laplace(0.05);
seasonal and promotion effects ~ N(0, 10); sigma ~ half-N(0, 0.5).

The fit only needs the Gram X'X, X'y, y'y and n, which add up over disjoint row blocks —
that is what lets Spark build them in parallel over any number of rows.
"""

from __future__ import annotations

import numpy as np

DAY_S = 86400.0
# Seasonal periods in days and the prior scales of the published model.
YEARLY_PERIOD_D, WEEKLY_PERIOD_D, DAILY_PERIOD_D = 365.25, 7.0, 1.0
TREND_PRIOR_SD = 5.0
CHANGEPOINT_PRIOR_SCALE = 0.05
SEASONALITY_PRIOR_SD = 10.0
HOLIDAYS_PRIOR_SD = 10.0
SIGMA_PRIOR_SD = 0.5
INTERVAL_Z = 1.2815515655446004  # two-sided 80 % interval


def n_features(n_cp: int, orders: tuple[int, int, int], n_hol: int) -> int:
    return 2 + n_cp + 2 * sum(orders) + n_hol


def design(ds_s: np.ndarray, t0_s: float, t_scale_s: float, cp_t: np.ndarray,
           orders: tuple[int, int, int], hol_names: list[str],
           hol_lists) -> np.ndarray:
    """Rows x features: [1, t, hinges..., yearly sin/cos..., weekly..., daily..., promos...]."""
    ds_s = np.asarray(ds_s, dtype=float)
    t = (ds_s - t0_s) / t_scale_s
    cols = [np.ones_like(t), t]
    cols += [np.maximum(t - s, 0.0) for s in cp_t]
    td = ds_s / DAY_S
    for period, order in zip((YEARLY_PERIOD_D, WEEKLY_PERIOD_D, DAILY_PERIOD_D), orders):
        for i in range(1, int(order) + 1):
            x = 2.0 * np.pi * i * td / period
            cols += [np.sin(x), np.cos(x)]
    hol = np.zeros((len(t), len(hol_names)))
    if len(hol_names):
        index = {n: j for j, n in enumerate(hol_names)}
        for r, names in enumerate(hol_lists):
            if names is None:
                continue
            for n in names:
                j = index.get(n)
                if j is not None:
                    hol[r, j] = 1.0
    return np.column_stack(cols + [hol]) if cols else hol


def prior_terms(n_cp: int, orders: tuple[int, int, int], n_hol: int):
    """Ridge precision per coefficient and L1 weight per coefficient."""
    k = n_features(n_cp, orders, n_hol)
    ridge = np.zeros(k)
    l1 = np.zeros(k)
    ridge[:2] = 1.0 / TREND_PRIOR_SD ** 2
    l1[2:2 + n_cp] = 1.0 / CHANGEPOINT_PRIOR_SCALE
    s0 = 2 + n_cp
    n_seas = 2 * sum(orders)
    ridge[s0:s0 + n_seas] = 1.0 / SEASONALITY_PRIOR_SD ** 2
    ridge[s0 + n_seas:] = 1.0 / HOLIDAYS_PRIOR_SD ** 2
    return ridge, l1


# A fit counts as certified when its duality gap, relative to the objective, and the relative
# change that one more step makes to the noise variance are below these.
GAP_TOL = 1e-9
SIGMA_TOL = 1e-9


def map_solve(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float, ridge: np.ndarray,
              l1: np.ndarray, max_iter: int = 1000):
    """MAP of coefficients and noise scale from the Gram only.

    For a fixed noise variance the coefficients are a ridge + lasso problem, solved exactly by
    ``_lasso`` with a duality gap; the variance for fixed coefficients has a closed form. The
    step from one variance to the next grows with it (more noise shrinks more, which leaves
    more residual), so the steps approach the fixed point from one side, and a secant through
    two of them is taken when it leaves a smaller step.

    Returns (coefficients, sigma, certified, residual, gap): ``gap`` is the duality gap
    relative to the objective at the returned sigma, ``residual`` the largest violation of the
    optimality conditions relative to the gradient of the data term at zero. ``certified`` is
    false when either tolerance was not met, whatever the reason.
    """
    if not len(xty):
        sigma2 = max(_sigma2_update(n, max(yty, 0.0)), 1e-12)
        return np.zeros(0), float(np.sqrt(sigma2)), True, 0.0, 0.0
    delta = np.zeros(int((l1 > 0).sum()))

    def step(sigma2: float):
        nonlocal delta
        beta, gap = _coefficients(xtx, xty, yty, sigma2, ridge, l1, delta)
        delta = beta[l1 > 0]
        rss = max(float(yty - 2.0 * beta @ xty + beta @ xtx @ beta), 0.0)
        # what rounding leaves of a difference of sums of squares
        noise = 1e-14 * yty / max(rss, 1e-300)
        return beta, gap, max(_sigma2_update(n, rss), 1e-12), noise

    sigma2 = max(yty / max(n, 1.0) * 0.1, 1e-6)
    certified = False
    for _ in range(max_iter):
        beta, gap, new, noise = step(sigma2)
        if abs(new - sigma2) <= max(SIGMA_TOL, noise) * sigma2:
            certified = gap <= GAP_TOL
            break
        after = step(new)[2]
        slope = (after - new) / (new - sigma2)
        far = new + (after - new) / (1.0 - slope) if slope < 1.0 else after
        if far > 0 and abs(step(far)[2] - far) < abs(after - new):
            sigma2 = far
        else:
            sigma2 = after
    return (beta, float(np.sqrt(sigma2)), bool(certified),
            _residual(xtx, xty, sigma2, ridge, l1, beta), gap)


def _coefficients(xtx, xty, yty, sigma2, ridge, l1, start):
    """Minimiser of RSS / (2 sigma2) + ridge b^2 / 2 + l1 |b|, and its relative duality gap. The
    coefficients without an L1 weight are eliminated, so the gap has to hold for the others
    only; the reduced problem keeps the columns' correlations."""
    a = xtx / sigma2 + np.diag(ridge)
    b = xty / sigma2
    hard, soft = np.flatnonzero(l1 > 0), np.flatnonzero(l1 == 0)
    if len(soft):
        out = np.linalg.solve(a[np.ix_(soft, soft)], np.column_stack([b[soft], a[np.ix_(soft, hard)]]))
    else:
        out = np.zeros((0, 1 + len(hard)))
    free, load = out[:, 0], out[:, 1:]
    cross = a[np.ix_(hard, soft)]
    gram = a[np.ix_(hard, hard)] - cross @ load
    gram = (gram + gram.T) / 2
    target = b[hard] - cross @ free
    delta = _lasso(gram, target, l1[hard], start)
    beta = np.zeros(len(b))
    beta[hard], beta[soft] = delta, free - load @ delta
    # residual of the reduced problem, scaled into the dual's feasible set
    grad = target - gram @ delta
    scale = min(1.0, float(np.min(l1[hard] / np.maximum(np.abs(grad), 1e-300), initial=1.0)))
    total = max(float(yty / sigma2 - b[soft] @ free), 0.0)
    left = max(total - 2.0 * float(target @ delta) + float(delta @ gram @ delta), 0.0)
    gap = (0.5 * (1.0 - scale) ** 2 * left + float(np.sum(l1[hard] * np.abs(delta)))
           - scale * float(grad @ delta))
    value = 0.5 * left + float(np.sum(l1[hard] * np.abs(delta))) + 0.5 * float(b[soft] @ free)
    return beta, max(gap, 0.0) / max(abs(value), 1.0)


def _lasso(gram: np.ndarray, target: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Minimiser of d'Gd / 2 - target'd + weight |d| by an active set: the coefficients with a
    sign solve a linear system; on the way to its solution the objective is compared where a
    sign changes, and the best point is kept; the most violated zero coefficient joins. Every
    round lowers the objective or ends, and there are finitely many sign patterns."""
    d = start.copy()
    if not len(d):
        return d
    value = lambda x: 0.5 * x @ gram @ x - target @ x + np.sum(weight * np.abs(x))
    tiny = 1e-11 * max(float(np.abs(target).max()), float(weight.max()))
    best = value(d)
    for _ in range(100 * len(d) + 100):
        grad = target - gram @ d
        on = d != 0
        fine = not on.any() or np.abs(grad - weight * np.sign(d))[on].max() <= tiny
        sign = np.sign(d)
        if fine:
            over = np.where(on, -np.inf, np.abs(grad) - weight)
            j = int(np.argmax(over))
            if over[j] <= tiny:
                return d
            sign[j] = np.sign(grad[j])
        act = np.flatnonzero(sign)
        goal = d.copy()
        goal[act] = np.linalg.lstsq(gram[np.ix_(act, act)], (target - weight * sign)[act],
                                    rcond=1e-14)[0]
        way = goal - d
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = -d / way
        stops = [1.0, *cross[(cross > 0) & (cross < 1)].tolist()]
        points = []
        for t in stops:
            x = d + t * way
            x[cross == t] = 0.0
            points.append((value(x), x))
        new, x = min(points, key=lambda v: v[0])
        if not new < best:  # rounding leaves no better point
            return d
        d, best = x, new
    return d


def _residual(xtx, xty, sigma2, ridge, l1, beta) -> float:
    """Violation of the optimality conditions of the coefficients for a fixed sigma: the smooth
    gradient is zero, or within the L1 weight for a zero coefficient."""
    if not len(beta):
        return 0.0
    grad = (xtx @ beta - xty) / sigma2 + ridge * beta
    off = np.where(beta == 0, np.maximum(np.abs(grad) - l1, 0.0),
                   np.abs(grad + l1 * np.sign(beta)))
    return float(off.max() / max(float(np.abs(xty).max()) / sigma2, 1e-300))


def _sigma2_update(n: float, rss: float) -> float:
    """argmin over s of n log s + RSS / (2 s^2) + s^2 / (2 * 0.5^2)."""
    c = 1.0 / SIGMA_PRIOR_SD ** 2  # coefficient of s^4 after multiplying through by s^2
    # c s^4 + n s^2 - rss = 0, in the form that does not subtract near-equal numbers
    return 2.0 * rss / max(n + np.sqrt(n * n + 4.0 * c * rss), 1e-300)
