"""Column helpers: rounding, arrays of shares and curves, bins and guarded statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as doubles; null if b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: ColumnLike, low, high) -> Column:
    """x held within [low, high]."""
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def rescale_rank(rank: ColumnLike, k: ColumnLike, m: int) -> Column:
    """Rank 1..k on a scale 1..m, halves to even; a single rank goes to the middle."""
    k = col(k)
    line = F.rint(1 + (col(rank) - 1) * F.lit(float(m - 1)) / F.nullif(k - 1, F.lit(0)))
    return F.when(k <= 1, F.rint(F.lit((m + 1) / 2))).otherwise(line).cast("int")


def linspace(n: int) -> Column:
    """n equally spaced points from 0 to 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / F.lit(float(max(n - 1, 1))))


def running_sum(values: ColumnLike) -> Column:
    """Cumulative sums of an array<double>."""
    empty = F.array().cast("array<double>")
    return F.aggregate(col(values), empty, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def curve(shares: ColumnLike, n: int = 20) -> Column:
    """The cumulative curve of ordered shares at n points of normalised rank.

    Shares are renormalised.  Ranks are equally spaced, so the point i falls
    into segment i (k - 1) div (n - 1).  No shares give the uniform line; one
    share gives 1 everywhere.
    """
    shares = col(shares)
    total = array_sum(shares)
    cum = running_sum(F.transform(shares, lambda x: x / F.nullif(total, F.lit(0.0))))
    k = F.size(cum)

    def point(i: Column) -> Column:
        at = i * (k - 1)
        j = F.least(F.floor(at / F.lit(n - 1)).cast("int"), k - 2)
        part = (at - j * F.lit(n - 1)) / F.lit(float(n - 1))
        low, high = F.try_element_at(cum, j + 1), F.try_element_at(cum, j + 2)
        return low + part * (high - low)

    points = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)
    ones = F.array_repeat(F.lit(1.0), F.lit(n))
    return F.when(F.coalesce(k, F.lit(0)) <= 0, linspace(n)).when(k == 1, ones).otherwise(points)


def mean_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """Mean absolute difference of two arrays of one length."""
    return array_sum(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y))) / F.size(col(a))


def max_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """Largest absolute difference of two arrays of one length."""
    return F.array_max(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


def left_rank(cuts: ColumnLike, p: ColumnLike) -> Column:
    """1 + the number of cut points below p, held within the cuts."""
    cuts = col(cuts)
    return F.least(F.size(F.filter(cuts, lambda c: c < col(p))) + 1, F.size(cuts))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Inner product in doubles, summed in order."""
    return array_sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def unit(v: ColumnLike) -> Column:
    """v over its length; null for a zero vector."""
    v = col(v)
    length = F.sqrt(array_sum(F.transform(v, lambda x: x.cast("double") * x)))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), length))


def safe_corr(x: ColumnLike, y: ColumnLike, least_rows: int = 3, least_sd: float = 1e-12) -> Column:
    """Pearson correlation; null for fewer than three pairs or a constant column."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(x) >= least_rows) & (sx > least_sd) & (sy > least_sd), F.try_divide(F.covar_pop(x, y), sx * sy))


def scale_position(j: ColumnLike, k: ColumnLike, low: float = 1.0, high: float = 7.0) -> Column:
    """Position of option j (from 0) of k, equally spaced on [low, high]."""
    return F.lit(low) + col(j) * F.lit(high - low) / F.greatest(col(k) - 1, F.lit(1))
