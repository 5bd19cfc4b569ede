"""Statistics as column expressions: aggregates over groups, and functions of sorted arrays for frames that aggregates can't have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(c: Column | str, p: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(c, F.lit(p))


def between(low, high, share):
    """low * (1 - share) + high * share of columns or of numpy arrays, with the first product exact and one rounding of the sum. Interpolated values that should be equal, as a quantile of a train and one of
    its spans between the same two intervals, then compare as they do in SQL (DuckDB fuses that product and sum)."""
    rest, last = 1 - share, high * share
    halves = lambda v: (a := 134217729.0 * v - (134217729.0 * v - v), v - a)
    (a, b), (c, d) = halves(low), halves(rest)
    first = low * rest
    lost = ((a * c - first) + a * d + b * c) + b * d
    total = first + last
    seen = total - first
    return total + (((first - (total - seen)) + (last - seen)) + lost)


def array_quantiles(s: Column, shares: list[float]) -> Column:
    """Quantiles, by between(), of an array that is sorted and has no nulls; nulls if it is empty."""
    h = lambda p: (F.size(s) - 1) * p
    low, high = (lambda p: F.get(s, F.floor(h(p)).cast("int"))), (lambda p: F.get(s, F.ceil(h(p)).cast("int")))
    return F.transform(F.array(*[F.lit(p) for p in shares]), lambda p: F.when(low(p) == high(p), low(p)).otherwise(between(low(p), high(p), h(p) - F.floor(h(p)))))


def cv(c: Column | str) -> Column:
    """Coefficient of variation; null under two values."""
    return F.stddev_samp(c) / F.avg(c)


def mm(c: Column | str) -> Column:
    return F.max(c) / F.avg(c)


def lv_pair(a: Column, b: Column) -> Column:
    """Local variation of two intervals in turn; its mean over a train is LV."""
    return 3 * F.pow(a - b, F.lit(2.0)) / F.pow(a + b, F.lit(2.0))


def cv2_pair(a: Column, b: Column) -> Column:
    return 2 * F.abs(a - b) / (a + b)


def lvr_pair(a: Column, b: Column, refractory: float = 0.005) -> Column:
    """Local variation with the refractory period taken into account."""
    return 3 * (1 - 4 * a * b / F.pow(a + b, F.lit(2.0))) * (1 + 4 * F.lit(refractory) / (a + b))


def sample_skewness(c: Column | str) -> Column:
    """Third moment standardised by the sample deviation."""
    n = F.count(c)
    return F.skewness(c) * F.pow((n - 1) / n, F.lit(1.5))


def sample_kurtosis(c: Column | str) -> Column:
    """Excess, standardised by the sample deviation."""
    n = F.count(c)
    return (F.kurtosis(c) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3


def array_quantile(values: Column, p: float | Column) -> Column:
    """Quantile with linear interpolation of an array's non-null values; null if there are none. For frames, where percentile isn't allowed."""
    return sorted_quantile(F.array_sort(F.filter(values, lambda x: x.isNotNull())), p)


def sorted_quantile(s: Column, p: float | Column) -> Column:
    """array_quantile() of an array that is sorted and has no nulls."""
    p = F.lit(p) if isinstance(p, float) else p
    h = (F.size(s) - 1) * p
    low = F.get(s, F.floor(h).cast("int"))
    return F.when(F.size(s) > 0, low + (h - F.floor(h)) * (F.get(s, F.ceil(h).cast("int")) - low))


def array_median(values: Column) -> Column:
    return array_quantile(values, 0.5)


def array_mean(values: Column) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n)


def array_sd(values: Column) -> Column:
    """Sample deviation; null under two values."""
    n, m = F.size(values), array_mean(values)
    return F.when(n > 1, F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (n - 1)))


def array_pair_mean(values: Column, pair) -> Column:
    """Mean of pair(a, b) over neighbours in an array; null under two values."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), pair)
    return F.when(n > 1, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / (n - 1))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the score interval of a share k / n; null if n is 0."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))), F.when(n > 0, F.least(mid + half, F.lit(1.0)))


def entropy(p: Column) -> Column:
    """Sum of -p log2 p, over the rows of a group."""
    return F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
