"""Percentiles from mergeable centroid digests, with a certified rank error (problem 6)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velotrace.operators.skew import joined_by
from velotrace.session import arrow_map, cut

DELTA = 400  # at most about this many centroids; a cluster in the middle holds 1 / 250 of the values
BUFFER = 1 << 16  # values of a group that wait before they are clustered
GROUPS_HELD = 4096  # groups a task holds before it emits all of them
FAN_IN = 64  # digests merged in one step
DIGEST = "digest_key string, n long, low double, high double, means array<double>, weights array<double>"


def scale(q: np.ndarray, delta: int) -> np.ndarray:
    """Grows by one per allowed cluster: steep at both ends, so clusters there are small."""
    return delta / (2 * math.pi) * np.arcsin(2 * np.clip(q, 0, 1) - 1)


def cluster(means: np.ndarray, weights: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Sorted centroids joined so that each cluster lies within one step of the scale."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    begin = np.r_[0.0, np.cumsum(weights)[:-1]] / total
    step = np.floor(scale(begin + weights / total / 2, delta))
    start = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
    w = np.add.reduceat(weights, start)
    m = np.add.reduceat(means * weights, start) / w
    return m, w


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, p: np.ndarray) -> np.ndarray:
    """Values at the shares p: a lone value's own (so small groups are exact), else in a straight line between the middles of neighbouring centroids, and the extremes at the ends."""
    upto = np.cumsum(weights)
    line = np.interp(p * upto[-1], np.r_[0.0, upto - weights / 2, upto[-1]], np.r_[low, np.clip(means, low, high), high])
    at = np.minimum(np.searchsorted(upto, p * upto[-1] - 1e-9), len(upto) - 1)
    return np.where(weights[at] == 1, means[at], line)


class Digest:
    """Values and centroids of one group, clustered when many have come."""

    def __init__(self, delta: int):
        self.delta, self.n, self.low, self.high = delta, 0, math.inf, -math.inf
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, means: np.ndarray, weights: np.ndarray, low: float, high: float, n: int) -> None:
        self.waiting.append((means, weights))
        self.size += len(means)
        self.low, self.high, self.n = min(self.low, low), max(self.high, high), self.n + n
        if self.size > BUFFER:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.waiting) > 1 or self.size > self.delta:
            self.waiting = [cluster(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)), self.delta)]
            self.size = len(self.waiting[0][0])
        return self.waiting[0]


def batch_of(held: dict[str, Digest]) -> pa.RecordBatch:
    done = {k: d.settle() for k, d in held.items()}
    ds = [*held.values()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*held], pa.string()), pa.array([d.n for d in ds], pa.int64()), pa.array([d.low for d in ds], pa.float64()), pa.array([d.high for d in ds], pa.float64()),
            pa.array([m for m, _ in done.values()], pa.list_(pa.float64())), pa.array([w for _, w in done.values()], pa.list_(pa.float64())),
        ],
        ["digest_key", "n", "low", "high", "means", "weights"],
    )


def values_to_digests(delta: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Digest] = {}
        for batch in batches:
            keys = batch.column("digest_key").dictionary_encode()
            code, v = keys.indices.to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            code, v = code[order], v[order]
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
            for a, b in zip(start, np.r_[start[1:], len(code)], strict=True):
                x = np.sort(v[a:b])
                held.setdefault(keys.dictionary[int(code[a])].as_py(), Digest(delta)).add(x, np.ones(len(x)), x[0], x[-1], len(x))
            if len(held) > GROUPS_HELD:
                yield batch_of(held)
                held.clear()
        if held:
            yield batch_of(held)

    return run


def digests_in(batch: pa.RecordBatch) -> Iterator[tuple[str, int, float, float, np.ndarray, np.ndarray]]:
    """Key, n, low, high, means and weights of the digests of a batch; the arrays are views of the batch."""
    lists = []
    for c in ("means", "weights"):
        column = batch.column(c)
        at = column.offsets.to_numpy()
        lists.append((column.values.to_numpy(zero_copy_only=False), at))
    (means, at), (weights, bt) = lists
    plain = [batch.column(c).to_pylist() for c in ("digest_key", "n", "low", "high")]
    for i, (key, n, low, high) in enumerate(zip(*plain, strict=True)):
        yield key, n, low, high, means[at[i] : at[i + 1]], weights[bt[i] : bt[i + 1]]


def digests_to_digests(delta: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digests sorted by digest_key to one per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Digest] = {}
        for batch in batches:
            for key, n, low, high, means, weights in digests_in(batch):
                if key not in held and len(held) >= 64:
                    yield batch_of(held)
                    held.clear()
                held.setdefault(key, Digest(delta)).add(means, weights, low, high, n)
        if held:
            yield batch_of(held)

    return run


def key_of(groups: list[str]) -> Column:
    """The group's columns as one text; nulls make groups of their own."""
    return F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})


def build(rows: DataFrame, value: str, groups: list[str], delta: int = DELTA) -> DataFrame:
    """Digests (DIGEST) of a numeric column per group, several per group: one per task. Nulls, NaN and infinities are left out.

    Can be written to a table per day or file; merge() joins digests from any of them.
    """
    v = F.col(value).cast("double")
    kept = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return arrow_map(kept.select(key_of(groups).alias("digest_key"), v.alias("v")), values_to_digests(delta), DIGEST)


def merge(digests: DataFrame, onto: Column | None = None, delta: int = DELTA) -> DataFrame:
    """One digest per digest_key (or per `onto`, a coarser key made from it) by re-clustering centroids.

    In two steps: the digests of a key are dealt to FAN_IN tasks first, so that a key of which there are very many is no one task's work.
    """
    key = onto if onto is not None else F.col("digest_key")
    d = digests.withColumn("digest_key", key).withColumn("deal", F.pmod(F.xxhash64("means", "n"), F.lit(FAN_IN)))
    some = arrow_map(d.repartition("digest_key", "deal").sortWithinPartitions("digest_key").drop("deal"), digests_to_digests(delta), DIGEST)
    return arrow_map(some.repartition("digest_key").sortWithinPartitions("digest_key"), digests_to_digests(delta), DIGEST)


def reader(shares: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    p = np.array(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            est = [quantile(means, weights, low, high, p) for _, _, low, high, means, weights in digests_in(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("digest_key"), batch.column("n"), pa.array(est, pa.list_(pa.float64()))], ["digest_key", "n", "estimates"])

    return run


def estimates(merged: DataFrame, shares: list[float]) -> DataFrame:
    """digest_key, n, estimates: an array of values, one per share."""
    return arrow_map(merged, reader(shares), "digest_key string, n long, estimates array<double>")


def certified(rows: DataFrame, value: str, groups: list[str], found: DataFrame, shares: list[float]) -> DataFrame:
    """groups..., p, n, estimate, rank_error: a second pass counts the values below and up to each estimate.

    rank_error: how far p is from the stretch of ranks that the estimate holds, as a share of n; 0 if it is a right percentile.
    found has one row per group and is written once; it is broadcast if there are few groups, so that values are counted where they are.
    """
    v = F.col(value).cast("double")
    kept = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(*groups, key_of(groups).alias("digest_key"), v.alias("_v"))
    both = joined_by(kept, cut(found), ["digest_key"], "digest_key", F.col("_v"), 1_000_000)
    e = F.col("estimates")
    counts = both.groupBy("digest_key", *groups).agg(
        F.first("n").alias("n"), F.first("estimates").alias("estimates"),
        *[F.count_if(F.col("_v") < e[i]).alias(f"_below{i}") for i in range(len(shares))], *[F.count_if(F.col("_v") <= e[i]).alias(f"_upto{i}") for i in range(len(shares))],
    )
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), e[i].alias("estimate"), F.col(f"_below{i}").alias("below"), F.col(f"_upto{i}").alias("upto")) for i, p in enumerate(shares)]))
    r = counts.select(*groups, "n", each.alias("r"))
    p = F.col("r.p")
    error = F.greatest(F.lit(0.0), F.col("r.below") / F.col("n") - p, p - F.col("r.upto") / F.col("n"))
    return r.select(*groups, p.alias("p"), "n", F.col("r.estimate").alias("estimate"), error.alias("rank_error"))


def percentiles(rows: DataFrame, value: str, groups: list[str], shares: list[float], delta: int = DELTA) -> DataFrame:
    """certified() percentiles per group. Groups without a number don't come out; a null group is one; no rows give none."""
    return certified(rows, value, groups, estimates(merge(build(rows, value, groups, delta)), shares), shares)
