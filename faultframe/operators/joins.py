"""Joins of a row-heavy side with a side that has one row per key."""

from pyspark.sql import DataFrame, functions as F

from ..settings import BROADCAST_ROWS

# Keys that may each have more than one in HEAVY of all rows: there are fewer than HEAVY of them.
HEAVY = 10_000


def attach(big: DataFrame, small: DataFrame, on, how="inner", bound=None, spread=(), salts=32) -> DataFrame:
    """Join `small` (unique per key) onto `big`.

    `bound` is the number of rows `small` cannot exceed, known from the schema or a parameter; up to
    BROADCAST_ROWS it is broadcast. Without such a bound the key is salted by a hash of `spread`, so that
    one key with a large share of the rows is split over `salts` tasks.
    """
    on = [on] if isinstance(on, str) else list(on)
    if bound is not None and bound <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    if not spread:
        return big.join(small, on, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def attach_counted(big: DataFrame, small: DataFrame, on, total: int, how="inner", count="n") -> DataFrame:
    """Join `small` (unique per key) onto `big` where `small` knows in `count` how many rows of `big` have the key.

    `total` is the number of rows of `big`. Fewer than HEAVY keys can each have more than total / HEAVY of the rows; these
    are broadcast, however large the tables are. All other keys are shuffled, and none of them has more than that share.
    `big` is read twice and should be a stored table.
    """
    on = [on] if isinstance(on, str) else list(on)
    heavy, light = F.col(count) * HEAVY > total, F.col(count) * HEAVY <= total
    met = big.join(F.broadcast(small.where(heavy)), on)
    rest = big.join(F.broadcast(small.where(heavy).select(*on)), on, "left_anti").join(small.where(light), on, how)
    return met.unionByName(rest)
