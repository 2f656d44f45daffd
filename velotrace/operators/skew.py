"""Joins of sides of unknown size: broadcast under a checked count, and hot keys split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast, of about 100 bytes each.
MOST_BROADCAST = 500_000
#: Keys above this share of all rows are split, all of them; there can't be more of them than this. Their table is broadcast (16 bytes a row).
MOST_HOT = 1_000_000


def is_small(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether df has at most so many rows. They are counted where they are: a limit would bring up to so many of each task together."""
    return df.count() <= most


def hot_keys(counted: DataFrame, key: str, rows_per_split: int) -> DataFrame:
    """_key, _splits of every key with more than rows_per_split rows, or than 1 / MOST_HOT of all rows if that is more.

    So at most MOST_HOT keys come out, by arithmetic, and none is left out. Counted with map-side combine. Null keys don't count.
    """
    counts = counted.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    most = counts.agg(F.greatest(F.lit(float(rows_per_split)), F.coalesce(F.sum("_c"), F.lit(0)) / MOST_HOT).alias("_most"))
    return counts.join(F.broadcast(most), F.col("_c") > F.col("_most")).select("_key", F.ceil(F.col("_c") / F.col("_most")).cast("int").alias("_splits"))


def spread(left: DataFrame, right: DataFrame, key: str, by: Column, rows_per_split: int, salt: str = "salt") -> tuple[DataFrame, DataFrame]:
    """Adds salt to both sides of an equi-join on key: rows of left with a hot key are dealt out by a hash of `by`, right is repeated as often.

    It all is part of the plan: nothing runs before the query does.
    """
    small = F.broadcast(hot_keys(left.select(key), key, rows_per_split))
    splits = F.coalesce(F.col("_splits"), F.lit(1))
    salted = left.join(small, F.col(key) == F.col("_key"), "left").withColumn(salt, F.pmod(F.xxhash64(by), splits).cast("int")).drop("_key", "_splits")
    copies = right.join(small, F.col(key) == F.col("_key"), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), splits - 1))).drop("_key", "_splits")
    return salted, copies


def joined_by(left: DataFrame, right: DataFrame, keys: list[str], hot: str, by: Column, rows_per_split: int = 200_000, how: str = "inner") -> DataFrame:
    """Equi-join of a growing left with right: right is broadcast if it is small, else the sides are merged with the hot values of one key split."""
    if is_small(right):
        return left.join(F.broadcast(right), keys, how)
    a, b = spread(left, right, hot, by, rows_per_split, "_salt")
    return a.join(b.hint("merge"), [*keys, "_salt"], how).drop("_salt")
