"""Runs of alike successive items: a state machine over sorted shards, and the joining of runs across shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotrace.operators.shards import changes, numpy_of, rides, whole_groups
from velotrace.session import arrow_map, cut

RUN = "struct<t0:long,t1:long,n:long,v0:double,v1:double>"
PIECES = f"entity string, shard long, n long, t0 long, t1 long, head {RUN}, tail {RUN}, whole boolean, inner array<{RUN}>"


NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Alike:
    """When an item goes on with the run of the item before.

    Both are fit (not null, and lowest < |v| or lowest < v), differ by at most tolerance, and the later begins at
    most gap_us after the earlier's end (None: any time). least: items of a run that is reported.
    """

    tolerance: float
    gap_us: int | None
    least: int
    lowest: float | None = None
    absolute: bool = False

    def fit(self, v: np.ndarray) -> np.ndarray:
        ok = ~np.isnan(v)
        if self.lowest is not None:
            ok &= (np.abs(v) if self.absolute else v) > self.lowest
        return ok

    def goes_on(self, v: np.ndarray, v_before: np.ndarray, t: np.ndarray, t_before: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            ok = self.fit(v) & self.fit(v_before) & ~(np.abs(v - v_before) > self.tolerance)
        return ok if self.gap_us is None else ok & (t - t_before <= self.gap_us)


@dataclass(frozen=True)
class Runs:
    """Runs of the items of some shards: places of first and last item, count and shard, and whether the shard's first or last item is in them."""

    starts: np.ndarray
    ends: np.ndarray  # one behind the last item
    shard: np.ndarray
    opens: np.ndarray
    closes: np.ndarray
    first: np.ndarray  # of each shard the place of its first item, -1 if it has none
    last: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return self.ends - self.starts


def runs_of(alike: Alike, v: np.ndarray, begin: np.ndarray, end: np.ndarray, shard: np.ndarray, shards: int) -> Runs:
    """The state machine over items in order: value, begin, end and the number of the shard. Every fit item is in a run, maybe of its own."""
    m = len(v)
    same = np.r_[False, shard[1:] == shard[:-1]][:m]
    on = np.zeros(m, bool)
    if m > 1:
        on[1:] = same[1:] & alike.goes_on(v[1:], v[:-1], begin[1:], end[:-1])
    starts = np.flatnonzero(alike.fit(v) & ~on)
    # an unfit item ends a run, so that a run is the stretch from its start to the next start or unfit item
    stop = np.flatnonzero(~on)
    ends = np.r_[stop[1:], m][np.searchsorted(stop, starts)] if len(starts) else starts
    head = np.flatnonzero(~same)
    first, last = np.full(shards, -1), np.full(shards, -1)
    first[shard[head]], last[shard[head]] = head, (np.r_[head[1:], m] - 1 if m else head)
    at = shard[starts]
    return Runs(starts, ends, at, starts == first[at], ends - 1 == last[at], first, last)


def list_of(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def without_copies(table: pa.Table, keys: tuple[str, str]) -> tuple[pa.Table, np.ndarray]:
    """The first of rows equal in keys and t, and where groups of keys begin."""
    begins, t = changes(table, keys), numpy_of(table, "t")
    keep = begins | np.r_[True, t[1:] != t[:-1]]
    return table.filter(pa.array(keep)), begins[keep]


def edge_rows(run: Runs, which: np.ndarray, v: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.StructArray:
    """Of each shard the run that holds its first (which: first) or last item, as RUN; n is 0 if that item is in none; all is null if there is no item."""
    at = np.maximum(which, 0)
    held = np.searchsorted(run.starts, at, "right") - 1
    ok = held >= 0
    held = np.maximum(held, 0)
    some = len(run.starts) > 0
    inside = ok & (run.ends[held] > at) if some else ok & False
    pick = lambda inner, alone: np.where(inside, inner, alone)
    if len(v) == 0:
        empty = pa.nulls(len(which), pa.int64())
        return pa.StructArray.from_arrays([empty, empty, empty, pa.nulls(len(which), pa.float64()), pa.nulls(len(which), pa.float64())], ["t0", "t1", "n", "v0", "v1"])
    s = run.starts[held] if some else at
    e = run.ends[held] - 1 if some else at
    cols = [pick(begin[s], begin[at]), pick(end[e], end[at]), pick(e - s + 1, 0).astype(np.int64), pick(v[s], v[at]), pick(v[e], v[at])]
    none = which < 0
    return pa.StructArray.from_arrays([pa.array(c, mask=none) for c in cols], ["t0", "t1", "n", "v0", "v1"])


def machine(alike: Alike, copies: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (entity, shard, t, t_end, id, item, v) sorted by all but the last two, to one row per shard as in PIECES.

    head and tail: the runs of the shard's first and last item; whole: they are one. inner: the others that have enough
    items. copies: of rows equal in (entity, t) only the first counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("entity", "shard")):
            if copies:
                table, begins = without_copies(table, ("entity", "shard"))
            else:
                begins = changes(table, ("entity", "shard"))
            t, end, v, item = (numpy_of(table, k) for k in ("t", "t_end", "v", "item"))
            at = np.flatnonzero(begins)
            size = np.diff(np.r_[at, len(t)])
            k = np.flatnonzero(item)
            v, s, e = v[k], t[k], end[k]
            r = runs_of(alike, v, s, e, np.repeat(np.arange(len(at)), size)[k], len(at))
            kept = (r.count >= alike.least) & ~r.opens & ~r.closes
            a, b, where = r.starts[kept], r.ends[kept], r.shard[kept]
            inner = pa.StructArray.from_arrays([pa.array(s[a]), pa.array(e[b - 1]), pa.array((b - a).astype(np.int64)), pa.array(v[a]), pa.array(v[b - 1])], ["t0", "t1", "n", "v0", "v1"])
            whole = np.zeros(len(at), bool)
            whole[r.shard[r.opens & r.closes]] = True
            yield pa.RecordBatch.from_arrays(
                [
                    table["entity"].combine_chunks().take(pa.array(at)).cast(pa.string()), table["shard"].combine_chunks().take(pa.array(at)), pa.array(size.astype(np.int64)),
                    pa.array(t[at]), pa.array(t[at + size - 1]), edge_rows(r, r.first, v, s, e), edge_rows(r, r.last, v, s, e),
                    pa.array(whole | (r.first == r.last) & (r.first >= 0)), list_of(inner, np.bincount(where, minlength=len(at))),
                ],
                ["entity", "shard", "n", "t0", "t1", "head", "tail", "whole", "inner"],
            )

    return run


def pieces(rows: DataFrame, alike: Alike, copies: bool) -> DataFrame:
    """One row per shard (PIECES) of rows (entity, shard, t, t_end, id, item, v); a null id is NO_ID and comes first of equal times."""
    cols = rows.select("entity", "shard", "t", "t_end", F.coalesce("id", F.lit(NO_ID)).alias("id"), "item", "v")
    return arrow_map(cols.repartition("entity", "shard").sortWithinPartitions("entity", "shard", "t", "id", "t_end", "item", "v"), machine(alike, copies), PIECES)


def chained(slim: DataFrame, alike: Alike, by: str) -> DataFrame:
    """A row per run at the border of a shard (by, ride, shard, at: 0 head or 1 tail, and RUN), with its chain over borders.

    slim: (by, ride, shard, head, tail, whole). A head goes on with the tail of the shard before that has items, of the same ride. A
    shard of one run has only a head. Rows without a run (n 0) stand between runs and are no chain's part.
    """
    ends = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("at"), F.col("head").alias("r")))).otherwise(
        F.array(F.struct(F.lit(0).alias("at"), F.col("head").alias("r")), F.struct(F.lit(1).alias("at"), F.col("tail").alias("r")))
    )
    edge = slim.where(F.col("head.n").isNotNull()).select(by, "ride", "shard", F.explode(ends).alias("e")).select(by, "ride", "shard", "e.at", "e.r.*")
    order = Window.partitionBy(by).orderBy("shard", "at")
    before = lambda c: F.lag(c).over(order)
    links = (F.col("at") == 0) & (F.col("n") > 0) & (before("n") > 0) & (before("ride") == F.col("ride")) & (F.abs(F.col("v0") - before("v1")) <= alike.tolerance)
    if alike.gap_us is not None:
        links &= F.col("t0") - before("t1") <= alike.gap_us
    return edge.withColumn("chain", F.sum(F.when(F.coalesce(links, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("n") > 0)


def numbered(shards: DataFrame, ride_gap_us: int | None, min_rows: int, by: str) -> DataFrame:
    """Rides of shards, see rides(); ride_gap_us None: an entity is one ride."""
    return shards.withColumn("ride", F.lit(1).cast("long")) if ride_gap_us is None else rides(shards, ride_gap_us, min_rows, by=by)


def joined(shards: DataFrame, alike: Alike, ride_gap_us: int | None, min_rows: int) -> DataFrame:
    """Runs of at least alike.least items: entity, t0, t1, n, v0, v1. Runs go on over the borders of shards.

    Inner runs of a shard pass as they are; through the scan go only its first and last run (and the inner ones of a shard
    of fewer than min_rows rows, whose ride may be dropped), so a scanned row is small however many runs a shard has, and a
    run may be as long as a ride. The shards are written once, as both ways read them. ride_gap_us None: an entity is one ride.
    """
    shards = cut(shards)
    sure = F.lit(True) if ride_gap_us is None else F.col("n") >= min_rows
    run: list[Column | str] = ["r.t0", "r.t1", "r.n", "r.v0", "r.v1"]
    inner = shards.where(sure).select("entity", F.explode("inner").alias("r")).select("entity", *run)
    slim = numbered(shards.select("entity", "shard", "n", "t0", "t1", "head", "tail", "whole", F.when(~sure, F.col("inner")).alias("inner")), ride_gap_us, min_rows, "entity")
    edge = chained(slim, alike, "entity").groupBy("entity", "chain").agg(
        F.min("t0").alias("t0"), F.max_by("t1", "t0").alias("t1"), F.sum("n").alias("n"), F.min_by("v0", "t0").alias("v0"), F.max_by("v1", "t0").alias("v1")
    )
    parts = inner.unionByName(edge.drop("chain"))
    if ride_gap_us is not None and min_rows > alike.least + 2:  # an inner run has an item before and one after it
        parts = parts.unionByName(slim.select("entity", F.explode("inner").alias("r")).select("entity", *run))
    return parts.where(F.col("n") >= alike.least)
