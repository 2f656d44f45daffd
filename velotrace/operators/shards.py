"""Time shards of a source, and rides from shard summaries.

A source may hold a third of all rows, so no window here spans a whole source of readings.
Rows are partitioned by (source, shard); what must cross a shard's border travels in one
summary row per shard, and only these are ordered per source (a prefix scan whose length
is the covered time over the shard's width, whatever the number of rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotrace.functions.clean import floor_div, number

SECOND = 1_000_000


def usable(df: DataFrame, *more: Column) -> DataFrame:
    """Rows with lat, lon, createdAt and boxId, as (box, row_seq, t, num, ...); t in epoch microseconds.

    Other columns of the input are not touched, whatever their names. Copies (equal box
    and t) are still there; see dedup().
    """
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("createdAt").isNotNull() & F.col("boxId").isNotNull()
    return df.where(ok).select(
        F.col("boxId").alias("box"), F.col("row_seq").cast("long").alias("row_seq"), F.unix_micros("createdAt").alias("t"), number(F.col("value")).alias("num"), *more
    )


def sharded(df: DataFrame, width_us: int, t: str = "t") -> DataFrame:
    return df.withColumn("shard", floor_div(F.col(t), width_us))


def dedup(df: DataFrame, rest: tuple[str, ...] = ()) -> DataFrame:
    """Of rows equal in (box, t) the one with the lowest row_seq (null lowest), in one exchange by (box, shard).

    rest: columns that order rows with equal row_seq too, so that repeated rows give one defined result.
    """
    w = Window.partitionBy("box", "shard").orderBy("t", "row_seq", *rest)
    before = F.lag("t").over(w)
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("t"))).drop("_before")


def rides(pieces: DataFrame, gap_us: int, min_readings: int, by: str = "box") -> DataFrame:
    """Adds ride (its number per source, from 1), ride_t0, ride_t1, ride_n to summaries (t0, t1, n) of pieces.

    A piece must have no gap above gap_us inside. Rides of fewer than min_readings are dropped
    after numbering. Empty input gives an empty result.
    """
    order = Window.partitionBy(by).orderBy("t0")
    begins = F.lag("t1").over(order).isNull() | (F.col("t0") - F.lag("t1").over(order) > F.lit(gap_us))
    numbered = pieces.withColumn("_begins", begins.cast("long")).withColumn("ride", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(by, "ride")
    return (
        numbered.drop("_begins")
        .withColumn("ride_t0", F.min("t0").over(whole))
        .withColumn("ride_t1", F.max("t1").over(whole))
        .withColumn("ride_n", F.sum("n").over(whole))
        .where(F.col("ride_n") >= min_readings)
    )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Batches of rows sorted by keys, cut so that no group is divided; a group must fit in memory."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = changes(table, keys)
        cut = int(np.flatnonzero(last)[-1])
        if rest and all(rest[-1][k][-1].as_py() == table[k][0].as_py() for k in keys):
            if cut == 0:
                rest.append(table)
                continue
        yield_now = pa.concat_tables([*rest, table.slice(0, cut)]) if rest or cut else None
        rest = [table.slice(cut)]
        if yield_now is not None and yield_now.num_rows:
            yield yield_now.combine_chunks()
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def changes(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """True where a row's keys differ from those of the row before; the first is True."""
    out = np.zeros(table.num_rows, bool)
    out[0] = True
    for k in keys:
        a = table[k].combine_chunks()
        if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
            a = a.dictionary_encode()
            a = (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).indices
        v = a.to_numpy(zero_copy_only=False)
        out[1:] |= v[1:] != v[:-1]
    return out


def numpy_of(table: pa.Table, name: str) -> np.ndarray:
    """A column as numpy; nulls of doubles become NaN."""
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def spans(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches that begin where begins is true."""
    start = np.flatnonzero(begins)
    return start, np.r_[start[1:], len(begins)]
