"""Rate solvers: Arrow-batched NumPy over one array of flows per row.

A flow array has one entry per year or per day of a policy, never one per source record, so
its length is bounded by the calendar. Each solver works on all equally long rows of a batch
at once.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELLS = 4_000_000


def _nearest_zero_rates(flows):
    """IRR of each row of a matrix whose first and last columns hold no zero.

    The rates are the positive real roots g = 1 + r of the polynomial with the flows as
    coefficients: the real eigenvalues of its companion matrix. Where the curve only touches
    zero the eigenvalues come as a pair a rounding error off the real line; such a root counts
    if the value there is zero but for rounding. Of several roots the one with the smallest |r|
    counts. Matrices are made for a part of the rows at a time.
    """
    rows, periods = flows.shape
    if periods < 2:
        return np.full(rows, np.nan)
    most = max(1, _CELLS // periods**2)
    if rows > most:
        return np.concatenate([_nearest_zero_rates(flows[k:k + most])
                               for k in range(0, rows, most)])
    companion = np.zeros((rows, periods - 1, periods - 1))
    companion[:, 0, :] = -flows[:, 1:] / flows[:, :1]
    below = np.arange(periods - 2)
    companion[:, below + 1, below] = 1.0
    growth = np.linalg.eigvals(companion)
    real = np.real(growth)
    near = np.abs(np.imag(growth)) <= 1e-6 * np.abs(growth)
    usable = (real > 0) & near & ((np.imag(growth) == 0) | _touches_zero(flows, real))
    distance = np.where(usable, np.abs(np.real(growth) - 1), np.inf)
    best = distance.argmin(axis=1)
    root = np.where(usable.any(axis=1), np.real(growth)[np.arange(rows), best], np.nan)
    for _ in range(3):  # Newton steps remove the rounding of the eigenvalues
        value, slope = np.zeros(rows), np.zeros(rows)
        for column in flows.T:
            slope = slope * root + value
            value = value * root + column
        step = value / slope
        root = np.where(np.abs(step) < 1e-6 * root, root - step, root)
    return root - 1


def _touches_zero(flows, growth):
    """Whether the value at each growth is zero next to the sum of its terms' sizes."""
    value, size = np.zeros_like(growth), np.zeros_like(growth)
    for column in flows.T:
        value = value * growth + column[:, None]
        size = size * np.abs(growth) + np.abs(column)[:, None]
    return np.abs(value) <= 1e-11 * size


@F.pandas_udf(T.DoubleType())
def irr(flows: pd.Series) -> pd.Series:
    """Internal rate of return of evenly spaced flows; NULL without both signs."""
    out = np.full(len(flows), np.nan)
    spans = {}
    for position, row in enumerate(flows):
        if row is None or len(row) < 2:
            continue
        row = np.asarray(row, dtype=float)
        if not (row.min() < 0 < row.max()):
            continue
        used = np.flatnonzero(row)
        trimmed = row[used[0]:used[-1] + 1]
        spans.setdefault(len(trimmed), []).append((position, trimmed))
    with np.errstate(all="ignore"):
        for members in spans.values():
            positions = np.array([position for position, _ in members])
            flows = np.stack([row for _, row in members])
            single = sign_changes(flows) == 1
            if single.any():
                out[positions[single]] = _single_root_rates(flows[single])
            if (~single).any():
                out[positions[~single]] = _nearest_zero_rates(flows[~single])
    return pd.Series(np.where(np.isfinite(out), out, np.nan)).astype("Float64")


def sign_changes(flows):
    """Descartes' count: sign changes of each row's nonzero flows, a bound on its positive roots
    of equal parity; one change means exactly one root."""
    signs = np.sign(flows)
    carried = signs.copy()
    for column in range(1, signs.shape[1]):  # each zero takes the sign before it
        carried[:, column] = np.where(signs[:, column] == 0, carried[:, column - 1], signs[:, column])
    return (np.diff(carried, axis=1) * carried[:, :-1] < 0).sum(axis=1)


def _single_root_rates(flows, steps=64):
    """IRR of rows with one sign change: the one positive root of the flow polynomial, by
    bisection on log growth between 1 and the side whose sign differs, then Newton steps. The
    value is taken as the net present value above growth 1 and as the future value below it, so
    no power overflows; memory and time are linear in the length. Several sign changes (and
    roots where the curve only touches zero) go to ``_nearest_zero_rates``."""
    rows, periods = flows.shape
    k = np.arange(periods)

    def sign_at(t):
        g = np.exp(t)[:, None]
        power = np.where(g >= 1, -k[None, :], (periods - 1 - k)[None, :])
        return np.sign((flows * g ** power).sum(axis=1))

    at_one = sign_at(np.zeros(rows))
    above = at_one == np.sign(flows[:, -1])  # no change between growth 0 and 1
    low, high = np.where(above, 0.0, -744.0), np.where(above, 709.0, 0.0)
    low_sign = sign_at(low)
    for _ in range(steps):
        middle = (low + high) / 2
        same = sign_at(middle) == low_sign
        low, high = np.where(same, middle, low), np.where(same, high, middle)
    # 64 halvings of a span of at most 744 leave less than 1e-16 of log growth.
    root = np.where(at_one == 0, 1.0, np.exp((low + high) / 2))
    return root - 1


def xirr(flows, years, tolerance=1e-6, max_iterations=1000):
    """Rate of dated flows by Newton's method from 0.1.

    ``years`` holds the time of each flow in years of 365 days since the first one. The
    iteration ends at the tolerance, at a flat derivative or at the step limit; a rate that
    leaves the real numbers gives NULL, and so do arrays of different length.
    """

    @F.pandas_udf(T.DoubleType())
    def solve(amounts: pd.Series, times: pd.Series) -> pd.Series:
        out = np.full(len(amounts), np.nan)
        lengths = {}
        for position, (amount, time) in enumerate(zip(amounts, times)):
            if amount is not None and time is not None and len(amount) == len(time) > 0:
                lengths.setdefault(len(amount), []).append(position)
        with np.errstate(all="ignore"):
            for positions in lengths.values():
                cash = np.stack([np.asarray(amounts.iloc[p], dtype=float) for p in positions])
                time = np.stack([np.asarray(times.iloc[p], dtype=float) for p in positions])
                out[positions] = _newton(cash, time)
        return pd.Series(np.where(np.isfinite(out), out, np.nan)).astype("Float64")

    def _newton(cash, time):
        guess = np.full(len(cash), 0.1)
        open_rows = np.arange(len(cash))
        for _ in range(max_iterations):
            base = 1 + guess[open_rows, None]
            flow, when = cash[open_rows], time[open_rows]
            value = (flow / base ** when).sum(axis=1)
            slope = -(flow * when / base ** (when + 1)).sum(axis=1)
            flat = np.abs(slope) < 1e-10
            step = np.where(flat, 0.0, -value / slope)
            guess[open_rows] += step
            done = flat | (np.abs(step) < tolerance) | ~np.isfinite(step)
            open_rows = open_rows[~done]
            if not len(open_rows):
                break
        return guess

    return solve(flows, years)
