"""Trips and stops from location pings (problem 5)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotrace.functions.clean import floor_div
from velotrace.functions.geo import with_utm32
from velotrace.functions.windows import medians
from velotrace.operators.shards import SECOND, changes, numpy_of, rides, spans, usable, whole_groups
from velotrace.session import arrow_map, cut


@dataclass(frozen=True)
class Dwelling:
    """What a stop and a trip are, and the neighbourhoods of the density clustering."""

    gap_s: int = 600  # a longer gap between readings ends a ride
    min_readings: int = 5
    stop_s: float = 120.0
    stop_m: float = 30.0
    trip_m: float = 200.0
    near_s: float = 30.0  # time neighbourhood of a ping, to both sides
    near_m: float = 15.0  # distance neighbourhood
    dense: float = 0.7  # share of the time neighbours that must be near for a ping to be core
    stray_m: float = 60.0  # farther from the median of the pings around: stray
    stray_pings: int = 7  # to both sides
    few: int = 3  # so many pings away from a stop don't end it
    slack_m: float = 10.0  # noise allowed for when a box leaves a stop
    shard_s: int = 1800
    halo_s: int = 90


PIECES = (
    "box string, shard long, n long, t0 long, t1 long, start_x double, start_y double, corner_x array<double>, corner_y array<double>, "
    "parts array<struct<stay:boolean,t0:long,t1:long,n:long,sx:double,sy:double,x0:double,x1:double,y0:double,y1:double,path:double,fx:double,fy:double,lx:double,ly:double>>"
)
FOUND = "box string, ride long, kind string, t0 long, t1 long, n_pings long, x double, y double, distance_m double, reach_m double"


def strays(x: np.ndarray, y: np.ndarray, piece: np.ndarray, how: Dwelling) -> np.ndarray:
    """True for pings far from the median position of the pings around them in their piece."""
    start, stop = spans(np.r_[True, piece[1:] != piece[:-1]])
    n, w = len(x), how.stray_pings
    i = np.arange(n)
    lo = np.maximum(i - w, np.repeat(start, stop - start))
    hi = np.minimum(i + w + 1, np.repeat(stop, stop - start))
    mx, my = (medians(v, lo, hi, 2 * w + 1) for v in (x, y))
    return ~(np.hypot(x - mx, y - my) <= how.stray_m)


def corners(x: np.ndarray, y: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Ascending indices of the corners of each group's convex hull. group: ascending.

    A point on or under the line between its neighbours in x is no upper corner. Of two neighbours one is dropped at a time,
    so a corner that is there twice stays.
    """
    order, found = np.lexsort((y, x, group)), []
    for up in (1.0, -1.0):
        k, turn, idle = order, 0, 0
        while idle < 2:
            dx, dy = np.diff(x[k]), up * np.diff(y[k])
            under = np.zeros(len(k), bool)
            under[1:-1] = (dx[:-1] * dy[1:] >= dy[:-1] * dx[1:]) & (group[k][2:] == group[k][:-2])
            under[turn % 2 :: 2] = False
            k, turn, idle = k[~under], turn + 1, 0 if under.any() else idle + 1
        found.append(k)
    return np.unique(np.concatenate(found))


def cores(t: np.ndarray, x: np.ndarray, y: np.ndarray, piece: np.ndarray, how: Dwelling) -> np.ndarray:
    """True for pings of whose neighbours in time enough are neighbours in place."""
    n = len(t)
    total, near = np.zeros(n, np.int32), np.zeros(n, np.int32)
    reach, far = how.near_s * SECOND, how.near_m**2
    for k in range(1, n):
        close = (t[k:] - t[:-k] <= reach) & (piece[k:] == piece[:-k])
        if not close.any():
            break
        here = close & ((x[k:] - x[:-k]) ** 2 + (y[k:] - y[:-k]) ** 2 <= far)
        total[k:] += close
        total[:-k] += close
        near[k:] += here
        near[:-k] += here
    return near >= how.dense * total


def clusters(t: np.ndarray, x: np.ndarray, y: np.ndarray, piece: np.ndarray, how: Dwelling) -> np.ndarray:
    """Cluster number of each ping, -1 outside: chains of core pings, and the pings next to them within stop_m of their middle."""
    n = len(t)
    core = cores(t, x, y, piece, how)
    step = np.hypot(np.diff(x, prepend=x[:1]), np.diff(y, prepend=y[:1]))
    new = np.r_[True, (piece[1:] != piece[:-1]) | (core[1:] != core[:-1])] | (core & (step > how.stop_m))
    start, stop = spans(new)
    run = np.repeat(np.arange(len(start)), stop - start)
    stay = core[start]
    size = stop - start
    cx, cy = (np.add.reduceat(v, start) / size for v in (x, y))
    label = np.where(stay[run], run, -1)
    first, last = piece[start], piece[stop - 1]
    for side in (-1, 1):
        other = run + side
        ok = (other >= 0) & (other < len(start))
        o = np.clip(other, 0, len(start) - 1)
        ok &= ~stay[run] & stay[o] & ((last if side < 0 else first)[o] == piece)
        away = ~ok | (np.hypot(x - cx[o], y - cy[o]) > how.stop_m)
        count = np.cumsum(away)
        before = np.repeat(np.r_[0, count][start], size)
        after = np.repeat(count[stop - 1], size)
        joins = (count - before == 0) if side < 0 else (after - count + away == 0)
        label = np.where((label < 0) & ok & joins, o, label)
    return label


def describe(how: Dwelling) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pings sorted by (box, shard, t, row_seq) to one row (PIECES) per ride and shard; pings of the halo (own false) only fill neighbourhoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("box", "shard")):
            begins, t = changes(table, ("box", "shard")), numpy_of(table, "t")
            keep = begins | np.r_[True, t[1:] != t[:-1]]
            table, begins, t = table.filter(pa.array(keep)), begins[keep], t[keep]
            x, y, own = (numpy_of(table, k) for k in ("x", "y", "own"))
            piece = np.cumsum(begins | np.r_[True, np.diff(t) > how.gap_s * SECOND]) - 1
            mine = np.flatnonzero(own)
            if not len(mine):
                continue
            # a ride's own pings in a shard
            at, upto = spans(np.r_[True, piece[mine][1:] != piece[mine][:-1]])
            head, tail = mine[at], mine[upto - 1]
            good = ~strays(x, y, piece, how)
            gt, gx, gy, gp, go = t[good], x[good], y[good], piece[good], own[good]
            label = clusters(gt, gx, gy, gp, how) if len(gt) else np.zeros(0, int)
            gt, gx, gy, gp, label = gt[go], gx[go], gy[go], gp[go], label[go]
            m = len(gt)
            slot = np.searchsorted(piece[head], gp)
            start, stop = spans(np.r_[True, (slot[1:] != slot[:-1]) | (label[1:] != label[:-1])][:m]) if m else (np.zeros(0, int), np.zeros(0, int))
            step = np.r_[0.0, np.hypot(np.diff(gx), np.diff(gy))][:m]
            step[start] = 0.0
            low, high, add = (lambda f: lambda v: f.reduceat(v, start) if m else np.zeros(0))(np.minimum), (lambda v: np.maximum.reduceat(v, start) if m else np.zeros(0)), (lambda v: np.add.reduceat(v, start) if m else np.zeros(0))
            parts = pa.StructArray.from_arrays(
                [pa.array(v) for v in (label[start] >= 0, gt[start], gt[stop - 1], (stop - start).astype(np.int64), add(gx), add(gy), low(gx), high(gx), low(gy), high(gy), add(step), gx[start], gy[start], gx[stop - 1], gy[stop - 1])],
                ["stay", "t0", "t1", "n", "sx", "sy", "x0", "x1", "y0", "y1", "path", "fx", "fy", "lx", "ly"],
            )
            of_part = np.bincount(slot[start], minlength=len(head)) if m else np.zeros(len(head), int)
            sx, sy, some = np.full(len(head), np.nan), np.full(len(head), np.nan), np.zeros(len(head), bool)
            hull = corners(gx, gy, slot)
            if m:
                a, b = spans(np.r_[True, slot[1:] != slot[:-1]])
                k = slot[a]
                some[k] = True
                # where a ride begins: the median of its first pings
                sx[k], sy[k] = (medians(v, a, np.minimum(a + 5, b), 5) for v in (gx, gy))
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(slot[hull], minlength=len(head)))].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    table["box"].combine_chunks().take(pa.array(head)).cast(pa.string()),
                    table["shard"].combine_chunks().take(pa.array(head)),
                    pa.array((upto - at).astype(np.int64)),
                    pa.array(t[head]),
                    pa.array(t[tail]),
                    pa.array(sx, mask=~some),
                    pa.array(sy, mask=~some),
                    *(pa.ListArray.from_arrays(offsets, pa.array(v[hull])) for v in (gx, gy)),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(of_part)].astype(np.int32)), parts),
                ],
                ["box", "shard", "n", "t0", "t1", "start_x", "start_y", "corner_x", "corner_y", "parts"],
            )

    return run


class Ride:
    """Parts of one ride in time order, joined to stops and moves."""

    def __init__(self, how: Dwelling):
        self.how, self.out = how, []
        self.stop, self.away, self.box, self.last, self.link = None, 0, None, None, 0.0
        self.moving: list = []

    def close(self) -> None:
        s = self.stop
        if s and s["t1"] - s["t0"] >= self.how.stop_s * SECOND:
            self.end_move()
            self.out.append(("stop", s["t0"], s["t1"], s["n"], s["sx"] / s["n"], s["sy"] / s["n"], s["path"]))
        elif s:
            self.moving.append((s["t0"], s["t1"], s["n"], s["path"]))
        self.stop, self.away, self.box = None, 0, None

    def end_move(self) -> None:
        if self.moving:
            m = self.moving
            self.out.append(("move", min(x[0] for x in m), max(x[1] for x in m), sum(x[2] for x in m), None, None, sum(x[3] for x in m)))
            self.moving = []

    def left(self) -> bool:
        """Whether the pings since the stop are many enough and far enough to have ended it."""
        if self.away <= self.how.few:
            return False
        s, (x0, x1, y0, y1) = self.stop, self.box
        cx, cy = s["sx"] / s["n"], s["sy"] / s["n"]
        return math.hypot(max(cx - x0, x1 - cx), max(cy - y0, y1 - cy)) > self.how.stop_m + self.how.slack_m

    def add(self, p: dict) -> None:
        path = p["path"] + (math.hypot(p["fx"] - self.last[0], p["fy"] - self.last[1]) if self.last else 0.0)
        self.last = (p["lx"], p["ly"])
        s = self.stop
        if not p["stay"]:
            self.pending = getattr(self, "pending", [])
            self.pending.append((p["t0"], p["t1"], p["n"], path))
            if s:
                self.away += p["n"]
                b = self.box
                self.box = (p["x0"], p["x1"], p["y0"], p["y1"]) if b is None else (min(b[0], p["x0"]), max(b[1], p["x1"]), min(b[2], p["y0"]), max(b[3], p["y1"]))
            return
        pending, self.pending = getattr(self, "pending", []), []
        joins = s and math.hypot(s["sx"] / s["n"] - p["sx"] / p["n"], s["sy"] / s["n"] - p["sy"] / p["n"]) <= self.how.stop_m and not self.left()
        if joins:
            s["t1"] = max(s["t1"], p["t1"])
            s["path"] += path + sum(x[3] for x in pending)
            for k in ("n", "sx", "sy"):
                s[k] += p[k]
            self.away, self.box = 0, None
            return
        self.close()
        self.moving += pending
        self.stop = {"t0": p["t0"], "t1": p["t1"], "n": p["n"], "sx": p["sx"], "sy": p["sy"], "path": path}

    def finish(self) -> list:
        self.close()
        self.moving += getattr(self, "pending", [])
        self.end_move()
        return self.out


def assemble(how: Dwelling) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (PIECES and ride) sorted by (box, ride, t0) to rows FOUND: the ride, its stops and its moves."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def summed(key: tuple, ride: Ride, head: dict) -> list[tuple]:
        rows = [(*key, kind, t0, t1, n, x, y, path, None) for kind, t0, t1, n, x, y, path in ride.finish()]
        total = sum(r[8] for r in rows)
        return [(*key, "ride", head["t0"], head["t1"], head["n"], head["x"], head["y"], total, head["far"]), *rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ride, head, out = None, None, None, []
        schema = pa.schema([("box", pa.string()), ("ride", pa.int64()), ("kind", pa.string()), ("t0", pa.int64()), ("t1", pa.int64()), ("n_pings", pa.int64()), *((k, pa.float64()) for k in names[6:])])

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            out_batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            out.clear()
            return out_batch

        for batch in batches:
            for row in batch.to_pylist():
                if (row["box"], row["ride"]) != key:
                    if key:
                        out += summed(key, ride, head)
                    key, ride = (row["box"], row["ride"]), Ride(how)
                    head = {"t0": row["t0"], "t1": row["t1"], "n": 0, "x": None, "y": None, "far": None}
                head["t1"], head["n"] = row["t1"], head["n"] + row["n"]
                if row["start_x"] is not None:
                    if head["x"] is None:
                        head["x"], head["y"], head["far"] = row["start_x"], row["start_y"], 0.0
                    head["far"] = max(head["far"], float(np.hypot(np.array(row["corner_x"]) - head["x"], np.array(row["corner_y"]) - head["y"]).max()))
                for p in row["parts"]:
                    ride.add(p)
            yield flush()
        if key:
            out += summed(key, ride, head)
            yield flush()

    return run


def trips_and_stops(readings: DataFrame, how: Dwelling | None = None) -> DataFrame:
    """FOUND: per ride one row of kind ride, and its stops and moves in time order.

    ride: a box's readings without a gap above gap_s, of min_readings at least; reach_m is how far it gets from
    where it began (the median of its first five pings), distance_m its path. stop: within stop_m of one place for
    stop_s or more. move: what is between. Times are epoch microseconds, x and y EPSG:25832.

    Pings are clustered by density in time and place, per box and shard of shard_s with the pings halo_s around it;
    clusters and the noise between them become parts, a few per shard, which are joined per ride. Stray pings are
    left out of stops, moves and reach, but count as readings. Null box, time, lat or lon: no reading; NaN
    positions: stray. Copies: the lowest row_seq. A ride of strays only has null reach. No rows give none.
    """
    how = how or Dwelling()
    rows = with_utm32(usable(readings, F.col("lat"), F.col("lon"))).drop("num", "lat", "lon")
    width, halo = how.shard_s * SECOND, how.halo_s * SECOND
    home = floor_div(F.col("t"), width)
    into = F.col("t") - home * width
    dealt = rows.withColumn("home", home).withColumn(
        "shard", F.explode(F.array_compact(F.array(home, F.when(into < halo, home - 1), F.when(into >= width - halo, home + 1))))
    ).withColumn("own", F.col("home") == F.col("shard")).drop("home")
    ordered = dealt.repartition("box", "shard").sortWithinPartitions("box", "shard", "t", "row_seq", "x", "y")
    pieces = cut(arrow_map(ordered.select("box", "shard", "t", "x", "y", "own"), describe(how), PIECES))
    # only slim rows go through the scan of a box; a shard has as many rows as rides
    numbers = rides(pieces.select("box", "shard", "n", "t0", "t1"), how.gap_s * SECOND, how.min_readings).select("box", "shard", "t0", "ride")
    whole = pieces.join(numbers, ["box", "shard", "t0"])
    return arrow_map(whole.select("box", "ride", "t0", "t1", "n", "start_x", "start_y", "corner_x", "corner_y", "parts").repartition("box", "ride").sortWithinPartitions("box", "ride", "t0"), assemble(how), FOUND)


def found_slots(segments: DataFrame, how: Dwelling | None = None, slot_s: int = 600) -> DataFrame:
    """box_id, kind (trip or stop), slot of the middle of first and last reading."""
    how = how or Dwelling()
    kind = F.when((F.col("kind") == "ride") & (F.col("reach_m") > how.trip_m), "trip").when(F.col("kind") == "stop", "stop")
    middle = floor_div(F.col("t0") + F.col("t1"), 2 * slot_s * SECOND)
    return segments.select(F.col("box").alias("box_id"), kind.alias("kind"), middle.alias("slot")).where(F.col("kind").isNotNull())
