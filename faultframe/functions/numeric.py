"""Column expressions for guarded arithmetic."""

from pyspark.sql import Column, functions as F


def missing_to_null(x) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x), x)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == F.lit(float("inf"))


def finite_or_zero(x: Column) -> Column:
    """NULL, NaN and both infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | is_infinite(x), F.lit(0.0)).otherwise(x)


def unit_if_zero(std: Column) -> Column:
    return F.when(std == 0, F.lit(1.0)).otherwise(std)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def severity_level(x: Column) -> Column:
    """Nearest level 0..3, halves to the even level; NULL and NaN have none."""
    x = missing_to_null(x.cast("double"))
    clipped = F.when(x < 0, F.lit(0.0)).when(x > 3, F.lit(3.0)).otherwise(x)
    return F.bround(clipped, 0).cast("int")


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; NULL for fewer than two rows or a constant side."""
    cov = n * sxy - sx * sy
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    # A constant side leaves rounding noise far below the size of its own square sum.
    flat = (n < 2) | (vx <= F.lit(1e-12) * n * sxx) | (vy <= F.lit(1e-12) * n * syy)
    return F.when(~flat, ratio(cov, F.sqrt(vx * vy)))
