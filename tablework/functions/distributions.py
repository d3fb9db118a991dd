"""Tail probabilities of the distributions that test statistics follow. They run on one row a test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(numerator, denominator, most: int = 100_000) -> float:
    """The continued fraction n(1) / (d(1) + n(2) / (d(2) + ...)), from its first terms on until it no longer changes."""
    tiny = 1e-300
    value, c, d = tiny, tiny, 0.0
    for j in range(1, most):
        d = 1 / (denominator(j) + numerator(j) * d or tiny)
        c = denominator(j) + numerator(j) / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)

    def term(j: int) -> float:
        m = (j - 1) // 2
        if j == 1:
            return 1.0
        if j % 2:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    log = a * math.log(x) + b * math.log1p(-x) - math.log(a) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(log) * _fraction(term, lambda j: 1.0)


def gamma_tail(s: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    return front * _fraction(lambda j: 1.0 if j == 1 else (j - 1) * (s - j + 1), lambda j: x + 2 * j - 1 - s)


def normal(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def student(t: float, df: float) -> float:
    """Two-sided."""
    return beta_share(df / (df + t * t), df / 2, 0.5)


def fisher_f(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi_square(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def kolmogorov(x: float) -> float:
    """The limit distribution's tail."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: all tables with the same margins that are no likelier than the one observed."""
    row, column, n = a + b, a + c, a + b + c + d
    choose = lambda p, q: math.lgamma(p + 1) - math.lgamma(q + 1) - math.lgamma(p - q + 1)
    log = lambda i: choose(row, i) + choose(n - row, column - i) - choose(n, column)
    own = log(a)
    each = (log(i) for i in range(max(0, row + column - n), min(row, column) + 1))
    return min(1.0, sum(math.exp(x) for x in each if x <= own + 1e-7))


def p_value(tail, *figures: Column) -> Column:
    """tail of one row's figures; null or infinite figures give null."""

    def one(*x: float | None) -> float | None:
        return None if any(v is None or not math.isfinite(v) for v in x) else float(tail(*x))

    return F.udf(one, "double")(*(f.cast("double") for f in figures))


def student_quantile(p: float, df: float) -> float:
    """The t that Student's distribution stays below with chance p, by bisection."""
    if p == 0.5:
        return 0.0
    tail, high = 2 * min(p, 1 - p), 1.0
    while student(high, df) > tail:
        high *= 2
    low = 0.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if student(middle, df) > tail else (low, middle)
    return math.copysign((low + high) / 2, p - 0.5)


#: Distance and number of the points at which the complementary error function is summed; the error is about 1e-17.
STEP, POINTS = 0.5, 13


def _points(x: Column) -> Column:
    """erfc(x) exp(x^2) for x >= 0 without the part that only counts at small x: a trapezoid sum of positive terms."""
    at = [((k + 0.5) * STEP) ** 2 for k in range(POINTS)]
    total = sum((F.lit(math.exp(-t)) / (x * x + F.lit(t)) for t in at), F.lit(0.0))
    return F.lit(2 * STEP / math.pi) * x * total


def erfc(x: Column) -> Column:
    """The complementary error function, as plain arithmetic on columns."""
    a = F.abs(x)
    near = F.when(a < 6, 2 / (F.exp(F.lit(2 * math.pi / STEP) * a) + 1)).otherwise(0.0)
    up = F.exp(-a * a) * _points(a) + near
    return F.when(x >= 0, up).otherwise(2 - up)


def log_normal_tail(z: Column) -> Column:
    """Logarithm of the normal distribution's upper tail at z, also where the tail itself is too small for a number."""
    x = z / F.lit(math.sqrt(2))
    return F.when(x > 6, F.ln(_points(x) / 2) - x * x).when(x >= 0, F.ln(erfc(x) / 2)).otherwise(F.log1p(-erfc(-x) / 2))


def normal_p(z: Column) -> Column:
    """Two-sided tail of the normal distribution."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2)))


#: The largest product of two sample sizes for which ranks are counted out exactly.
RANK_SUMS = 1_000_000
#: The largest sample for which two distribution functions are compared by counting paths, and pairs by signed ranks.
PATHS, SIGNED = 10_000, 50


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact tail of Mann and Whitney's U without ties: all ways to deal out the ranks are equally likely.

    Their numbers are the coefficients of a Gaussian binomial: the product of (1 - q^(n2 + i)) / (1 - q^i) for i up to n1.
    """
    n1, n2 = sorted((n1, n2))
    most = n1 * n2
    ways = [1] + [0] * most
    for i in range(1, n1 + 1):
        for k in range(most, n2 + i - 1, -1):
            ways[k] -= ways[k - n2 - i]
        for k in range(i, most + 1):
            ways[k] += ways[k - i]
    at = math.ceil(max(u, most - u))
    return min(1.0, 2 * sum(ways[at:]) / math.comb(n1 + n2, n1))


def signed_rank_exact(t: float, n: int) -> float:
    """Two-sided exact tail of Wilcoxon's smaller signed-rank sum without ties or zeros: each rank has either sign."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for k in range(len(ways) - 1, r - 1, -1):
            ways[k] += ways[k - r]
    return min(1.0, 2 * sum(ways[: math.floor(t) + 1]) / 2**n)


def kendall_exact(discordant: int, n: int) -> float:
    """Two-sided exact tail of Kendall's statistic without ties: permutations by their number of inversions."""
    pairs = n * (n - 1) // 2
    few = min(discordant, pairs - discordant)
    if few <= 1:  # one order, and one for each pair of neighbours
        return min(1.0, 2 * math.exp(math.log(1 + few * (n - 1)) - math.lgamma(n + 1)))
    ways = [1] + [0] * few
    for m in range(2, n + 1):
        total, new = 0, []
        for k in range(few + 1):
            total += ways[k] - (ways[k - m] if k >= m else 0)
            new.append(total)
        ways = new
    return min(1.0, 2 * sum(ways) / math.factorial(n))


def kolmogorov_exact(d: float, n1: int, n2: int) -> float:
    """Exact tail of the largest difference d of two distribution functions: the share of lattice paths that ever differ so much.

    A path goes a step right for each value of the first sample and up for each of the second; those that stay closer than d
    are counted row by row, scaled to stay within range.
    """
    import numpy as np

    n1, n2 = max(n1, n2), min(n1, n2)
    step = math.gcd(n1, n2)
    reach = round(d * n1 * n2 / step)  # differences are multiples of step / (n1 n2)
    if reach == 0:
        return 1.0
    a, b = n1 // step, n2 // step
    at = np.arange(n2 + 1)
    row, scale = (a * at < reach).astype(float), 0.0
    for i in range(1, n1 + 1):
        low, high = max(0, (b * i - reach) // a + 1), min(n2, -((-b * i - reach) // a) - 1)
        new = np.zeros(n2 + 1)
        if low <= high:
            new[low : high + 1] = np.cumsum(row[low : high + 1])
        top = new.max(initial=0.0)
        if top == 0:
            return 1.0
        if top > 1e200:
            new, scale = new / top, scale + math.log(top)
        row = new
    if row[n2] == 0:
        return 1.0
    every = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    return min(1.0, max(0.0, -math.expm1(math.log(row[n2]) + scale - every)))


#: Rows up to which one distribution function is held against a given one exactly.
ONE_SAMPLE = 1000


def kolmogorov_one(d: float, n: int) -> float:
    """Tail of the largest difference d of n values' distribution function from the true one.

    Exact up to ONE_SAMPLE values, by the power of a matrix that carries the chances of staying within d from value to value;
    beyond, the limit distribution with a correction for n.
    """
    import numpy as np

    if n > ONE_SAMPLE:
        return kolmogorov((math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d)
    if d <= 0.5 / n:
        return 1.0
    if d >= 1:
        return 0.0
    k = math.floor(n * d) + 1
    h, m = k - n * d, 2 * k - 1
    step = np.tri(m, m, 1)
    for i in range(m):
        step[i, 0] -= h ** (i + 1)
        step[m - 1, i] -= h ** (m - i)
    step[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    gap = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    step = step * np.exp([[-math.lgamma(g + 1) if g > 0 else 0.0 for g in row] for row in gap.tolist()])
    # the power, scaled so that it stays within range
    power, base, scale, shift, left = np.eye(m), step, 0.0, 0.0, n
    while left:
        if left & 1:
            power, scale = power @ base, scale + shift
        base, shift = base @ base, 2 * shift
        top = base.max()
        base, shift = base / top, shift + math.log(top)
        left >>= 1
    inside = power[k - 1, k - 1]
    return 1.0 if inside <= 0 else min(1.0, max(0.0, -math.expm1(math.log(inside) + scale + math.lgamma(n + 1) - n * math.log(n))))


def normal_cdf(z: Column) -> Column:
    return erfc(-z / F.lit(math.sqrt(2))) / 2
