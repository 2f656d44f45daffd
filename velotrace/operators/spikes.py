"""Impossible, stuck and far-off measurements, judged by what is usual for their source (problem 4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotrace.functions.clean import no_nan
from velotrace.functions.windows import medians
from velotrace.operators.runlength import NO_ID, RUN, Alike, chained, edge_rows, list_of, runs_of, without_copies
from velotrace.operators.shards import SECOND, changes, numpy_of, rides, sharded, usable, whole_groups
from velotrace.session import arrow_map, cut

SCALE = 1.4826  # of a normal distribution: usual deviation over median absolute deviation


def split_levels(v: np.ndarray, reach: int, jump: float) -> int:
    """Where the usual level of a source changes, 0 if it doesn't: the place between whose rolling medians before and after is the largest step.

    The step counts from `jump` usual deviations on, taken from the rolling medians of the side that spreads less.
    """
    n = len(v)
    i = np.arange(n)
    before, after = medians(v, np.maximum(i - reach, 0), i, reach), medians(v, i, np.minimum(i + reach, n), reach)
    unit = SCALE * min(np.nanmedian(np.abs(v - before)), np.nanmedian(np.abs(v - after)))
    step = np.where(np.minimum(i, n - i) >= min(reach // 2, n // 4), np.abs(before - after), 0.0)
    k = int(step.argmax())
    return k if step[k] > jump * unit and k else 0


def hampel(v: np.ndarray, reach: int = 100, least: int = 8, floor: float = 0.5, jump: float = 1.5) -> np.ndarray:
    """Deviations of each value of a source, in order, from its usual level, in usual deviations; NaN if there are not more than `least` values.

    The level is the rolling median of up to reach values to either side, which doesn't look over a change of level; after one, the other
    level is usual too and the smaller deviation holds. The unit is the scaled median absolute deviation of all values from their
    rolling medians: that of one window alone is too rough to part values near the limit.
    """
    n = len(v)
    if n <= least:
        return np.full(n, np.nan)
    i, k = np.arange(n), split_levels(v, reach, jump)
    low, high = np.where(i < k, 0, k), np.where(i < k, k, n)
    off = np.abs(v - medians(v, np.maximum(i - reach, low), np.minimum(i + reach + 1, high), 2 * reach + 1))
    unit = max(SCALE * float(np.median(off)), floor)
    if k:
        off = np.minimum(off, np.abs(v - np.where(i < k, np.median(v[k:]), np.median(v[:k]))))
    return off / unit


#: What is known of a number once its shard has been looked through: USUAL, BAD (out of bounds), STUCK; or that it is in the first or last run of
#: the shard, which neighbours may make a stuck one.
USUAL, BAD, STUCK, HEAD, TAIL = 0, 1, 2, 4, 8
NUMBERS = f"box string, shard long, n long, t0 long, t1 long, head {RUN}, tail {RUN}, whole boolean, sure long, in_head long, in_tail long, numbers array<struct<row_seq:long,num:double,kind:int>>"


def look_through(alike: Alike, lowest: float, highest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (box, shard, t, row_seq, num) sorted by these, copies among them, to one row per shard as in NUMBERS.

    numbers: those that are not 0 and have a row_seq, in order. sure, in_head, in_tail: how many of them are usual for certain, or if the
    first (last) run is not stuck.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("box", "shard")):
            table, begins = without_copies(table, ("box", "shard"))
            t, v = numpy_of(table, "t"), numpy_of(table, "num")
            at = np.flatnonzero(begins)
            size = np.diff(np.r_[at, len(t)])
            k = np.flatnonzero(~np.isnan(v))
            g, v, t1, ident = np.repeat(np.arange(len(at)), size)[k], v[k], t[k], numpy_of(table, "row_seq")[k]
            r = runs_of(alike, v, t1, t1, g, len(at))
            kind = np.where((v < lowest) | (v > highest), BAD, USUAL)
            mark = np.where(r.count >= alike.least, STUCK, np.where(r.opens, HEAD, np.where(r.closes, TAIL, USUAL)))
            # runs don't overlap, so marks are spread by where they begin and end
            step = np.zeros(len(v) + 1, np.int64)
            np.add.at(step, r.starts, mark)
            np.add.at(step, r.ends, -mark)
            kind = kind | np.cumsum(step)[: len(v)]
            named = (v != 0) & (ident != NO_ID)
            count = lambda kinds: pa.array(np.bincount(g[named & (kind == kinds)], minlength=len(at)).astype(np.int64))
            whole = np.zeros(len(at), bool)
            whole[r.shard[r.opens & r.closes]] = True
            numbers = pa.StructArray.from_arrays([pa.array(ident[named]), pa.array(v[named]), pa.array(kind[named].astype(np.int32))], ["row_seq", "num", "kind"])
            yield pa.RecordBatch.from_arrays(
                [
                    table["box"].combine_chunks().take(pa.array(at)).cast(pa.string()), table["shard"].combine_chunks().take(pa.array(at)), pa.array(size.astype(np.int64)), pa.array(t[at]), pa.array(t[at + size - 1]),
                    edge_rows(r, r.first, v, t1, t1), edge_rows(r, r.last, v, t1, t1), pa.array(whole | (r.first == r.last) & (r.first >= 0)), count(USUAL), count(HEAD), count(TAIL),
                    list_of(numbers, np.bincount(g[named], minlength=len(at))),
                ],
                [f.split()[0] for f in NUMBERS.split(", ")],
            )

    return run


def judge(how: Callable[[np.ndarray], np.ndarray], limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (box, block, rank) to row_seq and reason; usual numbers of neighbouring blocks (own false) only fill windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("box", "block")):
            at = np.flatnonzero(changes(table, ("box", "block")))
            v, own, kind, ident = (numpy_of(table, k) for k in ("num", "own", "kind", "row_seq"))
            far = np.zeros(len(v), bool)
            for a, b in zip(at, np.r_[at[1:], len(v)], strict=True):
                k = a + np.flatnonzero(kind[a:b] == USUAL)
                with np.errstate(invalid="ignore"):
                    far[k] = how(v[k]) > limit
            found = [(own & (kind & BAD > 0), "bounds"), (own & (kind & STUCK > 0), "stuck"), (own & far, "far_off")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ident[f] for f, _ in found])), pa.array(np.concatenate([np.full(f.sum(), why) for f, why in found]), pa.string())], ["row_seq", "reason"])

    return run


def judged(ranked: DataFrame, reach: int = 100, limit: float = 4.5, block: int = 4096, **how: float) -> DataFrame:
    """row_seq, reason of the numbers of ranked (box, rank, total, row_seq, num, kind). rank: how many usual numbers of the box are before.

    A box of any size is spread: it is cut into equal blocks of about `block` usual numbers, each with `reach` neighbours from the blocks before
    and after, and what is usual is told per block (a box of up to 1.5 blocks is one).
    """
    blocks = F.greatest(F.lit(1), F.round(F.col("total") / block).cast("long"))
    of = lambda rank: F.floor(F.greatest(F.lit(0), F.least(rank, F.col("total") - 1)) * blocks / F.col("total"))
    home = F.when(F.col("total") > 0, of(F.col("rank"))).otherwise(F.lit(0))
    usual = (F.col("kind") == USUAL) & (F.col("total") > 0)
    all_blocks = F.when(usual, F.array_distinct(F.array(home, of(F.col("rank") - reach), of(F.col("rank") + reach)))).otherwise(F.array(home))
    dealt = ranked.withColumn("block", F.explode(all_blocks)).withColumn("own", F.col("block") == home)
    ordered = dealt.select("box", "block", "rank", "row_seq", "num", "kind", "own").repartition("box", "block").sortWithinPartitions("box", "block", "rank", "row_seq")
    return arrow_map(ordered, judge(partial(hampel, reach=reach, **how), limit), "row_seq long, reason string")


def strange_readings(readings: DataFrame, lowest: float = 0.0, highest: float = 400.0, tolerance: float = 0.5, least_stuck: int = 20, gap_s: int = 600, limit: float = 4.5) -> DataFrame:
    """row_seq, reason (bounds, stuck or far_off) of readings that count; a reading can have several reasons.

    bounds: below lowest or above highest. stuck: in a run of least_stuck or more successive non-zero numbers
    of a ride, each within tolerance of the next. far_off: more than `limit` usual deviations from the usual level, see
    hampel(); bounds and stuck values are no part of what is usual, zeros neither. Text that is no number, nulls and
    copies don't count; a reading without row_seq can't be named and is left out. No rows give none.

    Readings are shuffled once, by box and stretch of time; a state machine goes over each stretch and marks its numbers.
    One slim row per stretch tells which runs at its border are stuck and how many usual numbers came before; with these, the numbers are
    ranked and judged in blocks. The marked numbers (not 0) are written once, as both ways read them.
    """
    gap = gap_s * SECOND
    rows = sharded(usable(readings), gap).select("box", "shard", "t", F.coalesce("row_seq", F.lit(NO_ID)).alias("row_seq"), "num")
    alike = Alike(tolerance=tolerance, gap_us=None, least=least_stuck, lowest=0.0, absolute=True)
    ordered = rows.repartition("box", "shard").sortWithinPartitions("box", "shard", "t", "row_seq", "num")
    shards = cut(arrow_map(ordered, look_through(alike, lowest, highest), NUMBERS))
    slim = rides(shards.drop("numbers"), gap, 1)
    chain = chained(slim, alike, "box").withColumn("stuck", F.sum("n").over(Window.partitionBy("box", "chain")) >= least_stuck)
    edges = chain.groupBy("box", "shard").agg(F.bool_or(F.col("stuck") & (F.col("at") == 0)).alias("head_stuck"), F.bool_or(F.col("stuck") & (F.col("at") == 1)).alias("tail_stuck"))
    flagged = slim.select("box", "shard", "sure", "in_head", "in_tail").join(edges, ["box", "shard"], "left")
    lost = lambda c: F.coalesce(F.col(c), F.lit(False))
    usual = F.col("sure") + F.when(lost("head_stuck"), 0).otherwise(F.col("in_head")) + F.when(lost("tail_stuck"), 0).otherwise(F.col("in_tail"))
    upto = Window.partitionBy("box").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = flagged.withColumn("c", usual).select(
        "box", "shard", lost("head_stuck").alias("head_stuck"), lost("tail_stuck").alias("tail_stuck"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("box")).alias("total")
    )
    both = shards.select("box", "shard", "numbers").where(F.size("numbers") > 0).join(counted, ["box", "shard"])
    edge = lambda k, bit, stuck: F.when(k.bitwiseAND(F.lit(bit)) > 0, k.bitwiseAND(F.lit(BAD)).bitwiseOR(F.when(F.col(stuck), F.lit(STUCK)).otherwise(F.lit(0)))).otherwise(k)
    settled = F.transform("numbers", lambda x: F.struct(x["row_seq"].alias("row_seq"), x["num"].alias("num"), edge(edge(x["kind"], HEAD, "head_stuck"), TAIL, "tail_stuck").alias("kind")))
    each = both.withColumn("numbers", settled).select("box", "shard", "base", "total", F.posexplode("numbers").alias("i", "x")).select("box", "shard", "base", "total", "i", "x.*")
    # of a stretch of ten minutes, so a window is small
    before = Window.partitionBy("box", "shard").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("base") + F.coalesce(F.sum((F.col("kind") == USUAL).cast("long")).over(before), F.lit(0))
    return judged(each.withColumn("rank", rank).select("box", "rank", "total", "row_seq", "num", "kind"), limit=limit)


def rate_bins(m: Column, per_doubling: int) -> Column:
    """A bin of a value >= 0: per_doubling of them to each doubling, 0 in one of its own."""
    return F.when(m > 0, F.floor(F.log2(m) * per_doubling)).otherwise(F.lit(-(1 << 40)))


def ordinary_limits(q: DataFrame, times: float, run_floor: float, per_doubling: int = 8) -> DataFrame:
    """box, high_run (highest run below run_floor), far_rate (the lowest far-off rate), null if there is none.

    q: box, run, rate, wrong_run. Rates are those of rides whose run is ordinary. The screen is a Hampel filter: what is within one usual deviation above
    the box's median is ordinary for certain, as a value `times` (> 2.5) the highest ordinary one can't be; both come from a histogram
    whose bins are narrow. Above the screen the first gap of the factor parts ordinary rates from far-off ones, which no bin hides. So a box's
    rides are never brought together: what is ordered per box are its bins, a few hundred at most.
    """
    run = F.when(~F.col("wrong_run") & (F.col("run") < run_floor), F.col("run"))
    plain = F.when((F.col("rate") >= 0) & (F.col("wrong_run") | F.col("run").isNull() | (F.col("run") < run_floor)), F.col("rate"))
    per = q.select("box", run.alias("run"), plain.alias("m"), rate_bins(plain, per_doubling).alias("bin")).groupBy("box", "bin").agg(
        F.max("run").alias("run"), F.count("m").alias("c"), F.min("m").alias("low"), F.max("m").alias("high")
    )
    box = Window.partitionBy("box")
    median = lambda c: F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col(c))).over(box)
    cumulated = lambda df, by: df.withColumn("upto", F.sum("c").over(box.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
    b = per.withColumn("high_run", F.max("run").over(box)).withColumn("all", F.sum("c").over(box))
    b = cumulated(b, "high").withColumn("middle", median("high")).withColumn("off", F.abs(F.col("high") - F.col("middle")))
    b = cumulated(b, "off").withColumn("screen", F.col("middle") + SCALE * median("off"))
    below = F.lag("high").over(box.orderBy("high"))
    far = (F.col("c") > 0) & (below > 0) & (F.col("low") >= times * below) & (F.col("low") > F.col("screen"))
    return b.withColumn("far_rate", F.when(far, F.col("low"))).groupBy("box").agg(F.first("high_run").alias("high_run"), F.min("far_rate").alias("far_rate"))


def strange_rides(quality: DataFrame, times: float = 3.0, run_floor: float = 25.0) -> DataFrame:
    """traj_id, reason of rides with an impossible or far-off longest_nonzero_run or raw_per_km.

    Impossible: negative, or a run above n_points. Far off: at least `times` the highest ordinary value of the box, see
    ordinary_limits(). Ordinary runs stay below run_floor, so the highest of those below is the measure for the others (run_floor if a
    box has none); rides of longer runs don't count for the ordinary rate. Null and NaN measures, and rows without traj_id,
    are not flagged; a null box is a box of its own; repeated rows count once.
    """
    q = quality.where(F.col("traj_id").isNotNull()).select(
        "traj_id", F.coalesce("boxId", F.lit("")).alias("box"), F.col("longest_nonzero_run").cast("double").alias("run"), F.col("n_points").alias("n"), no_nan(F.col("raw_per_km").cast("double")).alias("rate")
    ).distinct()
    q = q.withColumn("wrong_run", F.coalesce((F.col("run") < 0) | (F.col("run") > F.col("n")), F.lit(False)))
    # a box may have a third of all rides: AQE splits its part of this join
    q = q.join(ordinary_limits(q, times, run_floor), "box", "left")
    far_run = F.greatest(F.lit(run_floor), times * F.coalesce("high_run", F.lit(run_floor)))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("wrong_run"), F.lit("run_impossible")),
            F.when(~F.col("wrong_run") & (F.col("run") >= far_run), F.lit("run_far_off")),
            F.when(F.col("rate") < 0, F.lit("rate_impossible")),
            F.when(F.col("rate") >= F.col("far_rate"), F.lit("rate_far_off")),
        )
    )
    return q.select("traj_id", F.explode(reasons).alias("reason"))
