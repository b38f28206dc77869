"""Marginal families of the Gaussian copula: moment fits and quantile tables.

A family is fitted to four numbers per column (mean, population std, min, max).  Its quantile function
is tabulated on the driver over the normal score z: x(z) = Q(Phi(z)) for ``POINTS`` equally spaced z,
found by bisection of the incomplete beta and gamma functions, so a table's size does not depend on
the data.  Rows look their value up between two neighbours; in z the curve is smooth.
"""

from __future__ import annotations

import math

import numpy as np

#: Normal scores of a table: from -SPAN to SPAN.
SPAN, POINTS = 8.0, 4097


def _normal_tails(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper tail of the standard normal, each exact where it is small."""
    half = math.sqrt(0.5)
    return np.array([0.5 * math.erfc(-v * half) for v in z]), np.array([0.5 * math.erfc(v * half) for v in z])


def gamma_tails(a: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised incomplete gamma functions P(a, x) and Q(a, x): the power series below a + 1, the
    continued fraction above."""
    x = np.maximum(np.asarray(x, float), 1e-300)
    scale = np.exp(np.clip(a * np.log(x) - x - math.lgamma(a), -745, 700))
    term = total = np.full(x.shape, 1.0 / a)
    for n in range(1, 2000):
        term = term * np.where(x < a + 1, x, 0.0) / (a + n)
        total = total + term
        if not (term > total * 1e-16).any():
            break
    low = scale * total
    b = x + 1 - a
    c, d = np.full(x.shape, 1e300), 1.0 / np.where(b == 0, 1e-300, b)
    h = d
    for n in range(1, 2000):
        an, b = -n * (n - a), b + 2
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15)[x >= a + 1].all():
            break
    high = scale * h
    below = x < a + 1
    return np.where(below, low, 1 - high), np.where(below, 1 - low, high)


def beta_tails(a: float, b: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regularised incomplete beta functions I_x(a, b) and 1 - I_x(a, b), by the continued fraction of
    the side that converges."""
    x = np.clip(np.asarray(x, float), 1e-300, 1 - 1e-16)
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

    def fraction(p, q, y):
        tiny = 1e-300
        c, d = np.ones(y.shape), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d
        for m in range(1, 1000):
            step = 1.0
            for an in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + an * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + an / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = d * c
                h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        return np.exp(np.clip(front + p * np.log(y) + q * np.log1p(-y), -745, 700)) * h / p

    left = x < (a + 1) / (a + b + 2)
    one = fraction(a, b, np.where(left, x, 0.5 * (a + 1) / (a + b + 2)))
    two = fraction(b, a, np.where(left, 0.5 * (b + 1) / (a + b + 2), np.maximum(1 - x, 1e-300)))
    return np.where(left, one, 1 - two), np.where(left, 1 - one, two)


def _inverted(tails, z: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """x in [lo, hi] with the lower (z < 0) or upper tail of the normal score, by bisection."""
    want_low, want_high = _normal_tails(z)
    a, b = np.full(z.shape, lo), np.full(z.shape, hi)
    for _ in range(100):
        x = (a + b) / 2
        low, high = tails(x)
        less = np.where(z < 0, low < want_low, high > want_high)
        a, b = np.where(less, x, a), np.where(less, b, x)
    return (a + b) / 2


def _cut_normal(mean: float, std: float, lo: float, hi: float) -> tuple[float, float]:
    """Location and scale of a normal cut to [lo, hi] whose cut mean and std are the given ones
    (nearly: a std beyond that of the uniform is taken as that)."""
    phi = lambda t: math.exp(-0.5 * t * t) / math.sqrt(2 * math.pi)
    cdf = lambda t: 0.5 * math.erfc(-t / math.sqrt(2))
    want = np.array([mean, min(std, 0.99 * (hi - lo) / math.sqrt(12))])

    def moments(v):
        m, s = v[0], math.exp(v[1])
        a, b = (lo - m) / s, (hi - m) / s
        mass = max(cdf(b) - cdf(a) if a < 0 else cdf(-a) - cdf(-b), 1e-300)
        first = (phi(a) - phi(b)) / mass
        second = 1 + (a * phi(a) - b * phi(b)) / mass - first * first
        return np.array([m + s * first, s * math.sqrt(max(second, 1e-12))])

    v = np.array([mean, math.log(max(want[1], 1e-12 * max(hi - lo, 1e-300)))])
    size = max(hi - lo, 1e-300)
    for _ in range(200):  # damped Newton steps on the two moments
        f = (moments(v) - want) / size
        if np.abs(f).max() < 1e-10:
            break
        h = np.array([1e-5 * size, 1e-5])
        J = np.column_stack([((moments(v + np.eye(2)[i] * h[i]) - want) / size - f) / h[i] for i in range(2)])
        move, step = np.linalg.lstsq(J, -f, rcond=None)[0], 1.0
        move = np.clip(move, [-size, -1.0], [size, 1.0])
        while step > 1e-4 and np.abs((moments(v + step * move) - want) / size).max() >= np.abs(f).max():
            step /= 2
        v = v + step * move
        v[1] = min(v[1], math.log(20 * size))  # wider is as good as uniform
    return float(v[0]), float(math.exp(v[1]))


def quantile_table(family: str, mean: float, std: float, lo: float, hi: float) -> list[float]:
    """Values at ``POINTS`` normal scores from -SPAN to SPAN.  A constant column gives its value."""
    z = np.linspace(-SPAN, SPAN, POINTS)
    if not std or hi <= lo:
        return [float(mean)] * POINTS
    if family == "beta":  # on [lo, hi]
        m, v = (mean - lo) / (hi - lo), (std / (hi - lo)) ** 2
        n = max(m * (1 - m) / v - 1, 1e-3)
        a, b = max(m * n, 1e-3), max((1 - m) * n, 1e-3)
        return (lo + (hi - lo) * _inverted(lambda x: beta_tails(a, b, x), z, 0.0, 1.0)).tolist()
    if family == "gamma":  # from lo on
        shape, scale = max(((mean - lo) / std) ** 2, 1e-3), std * std / max(mean - lo, 1e-300)
        top = shape + 60 * math.sqrt(shape) + 200
        return (lo + scale * _inverted(lambda x: gamma_tails(shape, x), z, 0.0, top)).tolist()
    if family == "truncnorm":
        m, s = _cut_normal(mean, std, lo, hi)
        a, b = (lo - m) / s, (hi - m) / s
        la, ha = (float(t[0]) for t in _normal_tails(np.array([a])))
        lb, hb = (float(t[0]) for t in _normal_tails(np.array([b])))
        mass = lb - la if a < 0 else ha - hb

        def tails(x):
            low, high = _normal_tails(x)
            from_a = np.where(x < 0, low - la, ha - high) if a < 0 else ha - high
            to_b = np.where(x > 0, high - hb, lb - low) if b > 0 else lb - low
            return from_a / mass, to_b / mass
        return (m + s * _inverted(tails, z, a, b)).tolist()
    raise ValueError(f"no quantile table for {family!r}")
