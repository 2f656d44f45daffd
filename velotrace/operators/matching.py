"""Matching trajectories to the network: candidate edges, the nearest edge, and a hidden Markov path decoder."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velotrace.operators.shards import spans
from velotrace.operators.spatial_join import segments_near_points
from velotrace.session import arrow_map


@dataclass(frozen=True)
class Matching:
    """Bounds and noise of the matcher. Distances in metres."""

    max_dist: float = 50.0
    max_dist_init: float = 60.0
    noise: float = 15.0
    min_prob_norm: float = 0.001
    most_chords: int = 1_000_000  # a larger map is not sent to the workers, where a chord takes about 400 bytes


def straight_map(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, x0, y0, x1, y1: the straight line of every edge in both directions, once each. Edges with an unknown node are left out."""
    n = nodes.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min(F.struct("x", "y")).alias("at"))
    both = edges.select("u", "v").union(edges.select("v", "u")).where(F.col("u").isNotNull() & F.col("v").isNotNull()).distinct()
    at = lambda end, x, y: n.select(F.col("node_id").alias(end), F.col("at.x").alias(x), F.col("at.y").alias(y))
    return both.join(at("u", "x0", "y0"), "u").join(at("v", "x1", "y1"), "v").select("u", "v", "x0", "y0", "x1", "y1")


def candidates(points: DataFrame, chords: DataFrame, max_dist: float = Matching.max_dist) -> DataFrame:
    """point_id, x, y, u, v, ends, distance_m: directed chords within max_dist of each point."""
    p = points.select(F.col("point_id").alias("point"), *[c for c in points.columns if c not in ("point_id", "u", "v", "x0", "y0", "x1", "y1", "point", "cell", "salt", "distance_m")])
    return segments_near_points(p, chords, max_dist).withColumnRenamed("point", "point_id")


def nearest_edge(points: DataFrame, chords: DataFrame, max_dist: float = Matching.max_dist) -> DataFrame:
    """point_id, u, v, distance_m of the nearest chord (u <= v; ties: the lowest); points without one don't come out."""
    near = candidates(points, chords.where("u <= v"), max_dist)
    best = near.groupBy("point_id").agg(F.min(F.struct("distance_m", "u", "v")).alias("b"))
    return best.select("point_id", "b.u", "b.v", "b.distance_m")


#: Nodes whose distances a worker remembers, over all starts.
MOST_HELD = 1_000_000


class Roads:
    """Adjacency with lengths, and node distances, remembered per start as far as they were looked for."""

    def __init__(self, u: np.ndarray, v: np.ndarray, length: np.ndarray):
        self.next: dict[int, list[tuple[int, float]]] = {}
        self.parent: dict[int, int] = {}
        for a, b, d in zip(u.tolist(), v.tolist(), length.tolist(), strict=True):
            self.next.setdefault(a, []).append((b, d))
            self.parent[self.part(a)] = self.part(b)
        self.known: dict[int, tuple[dict[int, float], list[tuple[float, int]]]] = {}
        self.held = 0

    def part(self, node: int) -> int:
        """The same number for all nodes that hang together, whatever the direction."""
        parent = self.parent
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = node = parent.setdefault(up, up)
        return node

    def distances(self, start: int, goals: set[int]) -> dict[int, float]:
        """Node distances from start, of all goals that can be reached at least; the search has no limit and goes on where the last one ended."""
        if self.held > MOST_HELD:
            self.known.clear()
            self.held = 0
        done, queue = self.known.setdefault(start, ({}, [(0.0, start)]))
        part = self.part(start)
        missing = {g for g in goals if g not in done and self.part(g) == part}
        before = len(done)
        while missing and queue:
            d, a = heapq.heappop(queue)
            if a in done:
                continue
            done[a] = d
            missing.discard(a)
            for b, w in self.next.get(a, ()):
                if b not in done:
                    heapq.heappush(queue, (d + w, b))
        self.held += len(done) - before
        return done


class Grid:
    """The chords near points. A chord lies in all cells that its box, widened by reach_m, meets, so a point looks into its own cell only."""

    def __init__(self, u: np.ndarray, v: np.ndarray, ends: np.ndarray, reach_m: float):
        self.u, self.v, self.reach = u, v, reach_m
        self.x0, self.y0, self.dx, self.dy = ends[:, 0], ends[:, 1], ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1]
        self.length = np.hypot(self.dx, self.dy)
        low = np.floor((np.minimum(ends[:, :2], ends[:, 2:]) - reach_m) / reach_m).astype(np.int64)
        wide = np.floor((np.maximum(ends[:, :2], ends[:, 2:]) + reach_m) / reach_m).astype(np.int64) - low + 1
        many = wide.prod(axis=1)
        chord = np.repeat(np.arange(len(u)), many)
        k = np.arange(len(chord)) - np.repeat(np.cumsum(many) - many, many)
        key = self.key(low[chord, 0] + k % wide[chord, 0], low[chord, 1] + k // wide[chord, 0])
        order = np.argsort(key, kind="stable")
        self.chord = chord[order]
        self.cells, self.at = np.unique(key[order], return_index=True)
        self.at = np.r_[self.at, len(key)]

    @staticmethod
    def key(col: np.ndarray, row: np.ndarray) -> np.ndarray:
        return (row << 32) | (col & 0xFFFFFFFF)

    def near(self, x: np.ndarray, y: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs ordered by point, u and v: number of the point, chord, distance, and place along the chord. within: the distance that counts for each point."""
        known = np.isfinite(x) & np.isfinite(y) & (np.abs(x) < 1e9) & (np.abs(y) < 1e9)
        cell = lambda c: np.floor(np.where(known, c, 0.0) / self.reach).astype(np.int64)
        want = self.key(cell(x), cell(y))
        k = np.minimum(np.searchsorted(self.cells, want), max(len(self.cells) - 1, 0))
        hit = known & (self.cells[k] == want) if len(self.cells) else np.zeros(len(x), bool)
        many = np.where(hit, self.at[np.minimum(k + 1, len(self.at) - 1)] - self.at[k], 0)
        point = np.repeat(np.arange(len(x)), many)
        c = self.chord[np.repeat(self.at[k] - np.cumsum(many) + many, many) + np.arange(len(point))]
        px, py, length = x[point] - self.x0[c], y[point] - self.y0[c], self.length[c]
        with np.errstate(invalid="ignore", divide="ignore"):
            along = np.where(length > 0, np.clip((px * self.dx[c] + py * self.dy[c]) / length, 0.0, length), 0.0)
            far = np.where(length > 0, along / length, 0.0)
        d = np.hypot(px - far * self.dx[c], py - far * self.dy[c])
        ok = np.flatnonzero(d <= within[point])
        ok = ok[np.lexsort((self.v[c[ok]], self.u[c[ok]], point[ok]))]
        return point[ok], c[ok], d[ok], along[ok]


#: Matrices of distances between the nodes of two steps that a worker remembers.
MOST_STEPS = 20_000
#: Steps that wait before it is looked for how far back the path is certain.
WAITING = 512


class Decoder:
    """The most likely edge of each point of one trajectory after the other, point by point.

    Emission falls with the squared distance to the edge, transition with the difference of the straight and the network
    distance, which is looked for in the whole network: a step may pass any number of edges between two points, which
    stands for states without a point of their own. A path whose mean likelihood per point sinks under min_prob_norm ends there: the rest is null, as
    it is from a point on that no way leads to, and a trajectory whose first point has no candidate is null as a whole.

    Only the points on which the paths that are still possible differ are held, so a trajectory may be of any length.
    """

    def __init__(self, grid: Grid, roads: Roads, how: Matching):
        self.grid, self.roads, self.how = grid, roads, how
        self.spread, self.floor = 2 * how.noise**2, math.log(how.min_prob_norm)
        self.steps: dict[tuple[bytes, bytes], np.ndarray] = {}
        self.begin()

    def begin(self) -> None:
        self.n, self.over, self.score = 0, False, None
        self.held: list[tuple[np.ndarray, np.ndarray | None]] = []  # chords of a point, and for each the place of its best forerunner
        self.last: tuple[np.ndarray, np.ndarray, bytes, float, float] | None = None

    def ways(self, before: np.ndarray, now: np.ndarray, key: tuple[bytes, bytes]) -> np.ndarray:
        """Network distances from the ends of the chords before to the begins of those now."""
        found = self.steps.get(key)
        if found is None:
            if len(self.steps) >= MOST_STEPS:
                self.steps.clear()
            begins = self.grid.u[now].tolist()
            goals = set(begins)
            rows = {}
            for v in set(self.grid.v[before].tolist()):
                reach = self.roads.distances(v, goals)
                rows[v] = [reach.get(g, math.inf) for g in begins]
            found = self.steps[key] = np.array([rows[v] for v in self.grid.v[before].tolist()])
        return found

    def point(self, x: float, y: float, chords: np.ndarray, d: np.ndarray, along: np.ndarray) -> None:
        """The next point with its candidates; once the path is over, nothing is held any more."""
        self.n += 1
        if self.over:
            return
        if not len(chords):
            self.over = True
            return
        name = chords.tobytes()
        if self.last is None:
            self.score = -(d**2) / self.spread
            self.held.append((chords, None))
        else:
            c0, s0, name0, x0, y0 = self.last
            route = (self.grid.length[c0] - s0)[:, None] + self.ways(c0, chords, (name0, name)) + along
            back = along - s0[:, None]
            same = (c0[:, None] == chords) & (back >= -self.how.noise)
            route[same] = np.abs(back[same])
            total = self.score[:, None] - np.abs(route - math.hypot(x - x0, y - y0)) / self.how.noise
            best = total.argmax(axis=0)
            following = total[best, np.arange(len(chords))] - d**2 / self.spread
            top = following.max()
            if not top > -math.inf or top / self.n < self.floor:
                self.over = True
                return
            self.score = following
            self.held.append((chords, best))
        self.last = (chords, along, name, x, y)

    def trace(self, k: int, upto: int) -> list[int]:
        """Chords of the path that ends in candidate k of held point upto."""
        out = []
        for chords, best in reversed(self.held[: upto + 1]):
            out.append(int(chords[k]))
            k = 0 if best is None else int(best[k])
        return out[::-1]

    def certain(self) -> list[int]:
        """Chords of the held points before the last one on which all possible paths agree; they are held no longer."""
        ends = np.flatnonzero(self.score > -np.inf)
        for i in range(len(self.held) - 1, 0, -1):
            if len(ends) == 1:
                done = self.trace(int(ends[0]), i)[:i]
                # all paths go through one candidate of this point, whatever came before it
                self.held = [(self.held[i][0], None), *self.held[i + 1 :]]
                return done
            ends = np.unique(self.held[i][1][ends])
        return []

    def finish(self) -> list[int]:
        """Chords of all held points on the best path."""
        done = self.trace(int(self.score.argmax()), len(self.held) - 1) if self.held else []
        self.held = []
        return done


def path_decoder(how: Matching, network: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (traj_id, ordinal, point_id, x, y) sorted by trajectory and ordinal to traj_id, point_id, u, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, ends = network.value
        grid = Grid(u, v, ends, max(how.max_dist, how.max_dist_init))
        decoder, key = Decoder(grid, Roads(u, v, grid.length), how), None
        ids: list[tuple[pa.Array, pa.Array]] = []  # of points that wait for their edge
        found: list[int] = []
        waiting = 0

        def emit(n: int) -> Iterator[pa.RecordBatch]:
            """The first n waiting points, with the edges found for them, null for the others."""
            nonlocal ids, found, waiting
            if not n:
                return
            traj, point = (pa.concat_arrays([x[k] for x in ids]) for k in (0, 1))
            ids, waiting = ([(traj.slice(n), point.slice(n))] if n < waiting else []), waiting - n
            mine, found = np.array(found[:n] + [-1] * (n - len(found)), np.int64), found[n:]
            at = np.maximum(mine, 0)
            pick = lambda c: pa.array(c[at] if len(c) else np.zeros(n, np.int64), pa.int64(), mask=mine < 0)
            yield pa.RecordBatch.from_arrays([traj.slice(0, n), point.slice(0, n), pick(u), pick(v)], ["traj_id", "point_id", "u", "v"])

        for batch in batches:
            x, y, ordinal = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "ordinal"))
            point, chord, d, along = grid.near(x, y, np.where(ordinal == 0, how.max_dist_init, how.max_dist))
            at = np.searchsorted(point, np.arange(len(x) + 1))
            trajs = batch.column("traj_id")
            name = trajs.dictionary_encode()
            code = name.indices.to_numpy(zero_copy_only=False)
            for a, b in zip(*spans(np.r_[True, code[1:] != code[:-1]]), strict=True):
                this = name.dictionary[int(code[a])].as_py()
                if this != key:
                    found += decoder.finish()
                    yield from emit(waiting)
                    key = this
                    decoder.begin()
                ids.append((trajs.slice(a, b - a), batch.column("point_id").slice(a, b - a)))
                waiting += b - a
                for i in range(a, b):
                    decoder.point(x[i], y[i], chord[at[i] : at[i + 1]], d[at[i] : at[i + 1]], along[at[i] : at[i + 1]])
                    if len(decoder.held) >= WAITING and decoder.n % WAITING == 0:
                        found += decoder.certain()
                if decoder.over:
                    found += decoder.finish()
                    yield from emit(waiting)
            yield from emit(min(len(found), waiting))
        found += decoder.finish()
        yield from emit(waiting)

    return run


def match_paths(points: DataFrame, chords: DataFrame, how: Matching = Matching()) -> DataFrame:  # noqa: B008
    """traj_id, point_id, u, v: the most likely edge of every point of a trajectory, null where there is none.

    points: boxId, traj_id, point_id, ordinal, x, y. Points are shuffled once, by trajectory; the map goes to the workers if it has at
    most most_chords chords (else an error says so), where all chords within the distance of a point (max_dist_init for the one of
    ordinal 0) are looked up in a grid. Each trajectory is decoded on its own, see Decoder. Points without a place have no candidate.
    """
    spark = points.sparkSession
    local = chords.select("u", "v", "x0", "y0", "x1", "y1").limit(how.most_chords + 1).toArrow()
    if local.num_rows > how.most_chords:
        raise ValueError(f"the map has more than {how.most_chords} chords; match parts of the network one by one")
    u, v, *ends = (local[c].to_numpy() for c in local.column_names)
    network = spark.sparkContext.broadcast((u, v, np.stack(ends, axis=1).astype(float) if len(u) else np.zeros((0, 4))))
    p = points.select("boxId", "traj_id", "ordinal", "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ordered = p.repartition("boxId", "traj_id").sortWithinPartitions("boxId", "traj_id", "ordinal").select("traj_id", "ordinal", "point_id", "x", "y")
    return arrow_map(ordered, path_decoder(how, network), "traj_id string, point_id string, u long, v long")


def placed_share(matched: DataFrame) -> DataFrame:
    """Per trajectory: points, share of placed points, whether any is placed."""
    on = F.col("u").isNotNull()
    return matched.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg(on.cast("int")).alias("placed_share"), F.bool_or(on).alias("any_placed"))


def placed_overall(per_trajectory: DataFrame) -> DataFrame:
    return per_trajectory.agg(
        F.count(F.lit(1)).alias("n_trajectories"), F.count_if("any_placed").alias("n_matched"), (F.sum(F.col("placed_share") * F.col("n_points")) / F.sum("n_points")).alias("placed_share")
    )


def visited_edges(matched: DataFrame) -> DataFrame:
    """traj_id, u, v, first_at: edges of a trajectory by the time of their first point."""
    m = matched.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    return m.groupBy("traj_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("createdAt").alias("first_at"))


def visited_geometries(matched: DataFrame, edges: DataFrame) -> DataFrame:
    """visited_edges() with the geometry of the lowest (u, v, key) that joins the two nodes."""
    from velotrace.operators.events import pair

    e = pair(edges.select("u", "v", "key", "geometry")).where(F.col("_a").isNotNull() & F.col("geometry").isNotNull())
    shape = e.groupBy("_a", "_b").agg(F.min_by("geometry", F.struct("u", "v", "key")).alias("geometry"))
    return visited_edges(matched).join(shape, (F.col("u") == F.col("_a")) & (F.col("v") == F.col("_b"))).drop("_a", "_b")


