"""References to records that do not exist, are deleted or come later (problem 1)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velotrace.operators.skew import spread
from velotrace.session import arrow_map

NEVER = (1 << 63) - 1


def ranges_for(parents: DataFrame, keys_per_range: int) -> int:
    """A power of two of key ranges, so that a range's parents are at most about keys_per_range."""
    return 1 << max(0, math.ceil(math.log2(max(1, parents.count()) / keys_per_range)))


def range_of(key: Column, ranges: int) -> Column:
    """Range of a key on the line of its 64-bit hash; ranges are of equal width, so parents fall evenly into them."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - int(math.log2(ranges))).cast("long") if ranges > 1 else F.lit(0).cast("long")


def looked_up(parents: dict[str, np.ndarray | pa.Array], hashes: np.ndarray, keys: pa.Array, at: np.ndarray) -> np.ndarray:
    """Which of the keys are parents that are there at their time: a binary search for the hash, then the text of those of equal hash is compared."""
    found = np.zeros(len(hashes), bool)
    held = parents["hash"]
    place = np.searchsorted(held, hashes)
    left = np.flatnonzero(place < len(held))
    left = left[held[place[left]] == hashes[left]]
    while len(left):
        where = place[left]
        same = pc.equal(parents["key"].take(pa.array(where)), keys.take(pa.array(left))).to_numpy(zero_copy_only=False)
        hit, spot = left[same], where[same]
        found[hit] = (parents["since"][spot] <= at[hit]) & (parents["gone"][spot] > at[hit])
        # another text of the same hash stands next
        left = left[~same]
        place[left] += 1
        left = left[place[left] < len(held)]
        left = left[held[place[left]] == hashes[left]]
    return found


def probe() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (part, salt, side, hash), parents (side 0) first: misses among the references (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, parents = None, [], None
        for batch in batches:
            part, salt, side = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("part", "salt", "side"))
            edge = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (salt[1:] != salt[:-1]) | (side[1:] != side[:-1])])
            for a, b in zip(edge, np.r_[edge[1:], len(part)], strict=True):
                rows = batch.slice(a, b - a)
                if group != (int(part[a]), int(salt[a])):
                    group, waiting, parents = (int(part[a]), int(salt[a])), [], None
                if side[a] == 0:
                    waiting.append(rows.select(["hash", "key", "since", "gone"]))
                    continue
                if parents is None:
                    table = pa.Table.from_batches(waiting, rows.select(["hash", "key", "since", "gone"]).schema).combine_chunks()
                    parents = {k: table[k].combine_chunks() if k == "key" else table[k].to_numpy() for k in table.column_names}
                number = lambda k, r=rows: r.column(k).to_numpy(zero_copy_only=False)
                missing = pa.array(~looked_up(parents, number("hash"), rows.column("key"), number("at")))
                yield pa.RecordBatch.from_arrays([rows.column("ref").filter(missing)], ["ref"])

    return run


def orphans(references: DataFrame, parents: DataFrame, keys_per_range: int = 200_000, references_per_split: int = 500_000) -> DataFrame:
    """The `ref` of references whose parent is not there at their time.

    references: (ref, key string, at long); parents: (key string, since long, gone long), a parent is there from since
    (inclusive) until before gone; of several rows with a key the earliest since and the earliest gone
    hold. Null keys are no references and no parents; a key without since (null) is never there.

    Both sides are partitioned by ranges of hashed keys, whose number follows the number of parents. A
    range's parents arrive sorted by hash and become arrays; batches of references are looked up in them by
    binary search, and texts are compared only where hashes are equal. Ranges with very many references (a hot key) are split, their parents repeated.
    """
    one = parents.where(F.col("key").isNotNull()).groupBy("key").agg(F.coalesce(F.min("since"), F.lit(NEVER)).alias("since"), F.coalesce(F.min("gone"), F.lit(NEVER)).alias("gone"))
    ranges = ranges_for(parents, keys_per_range)
    left = references.where(F.col("key").isNotNull()).select("ref", "key", "at", range_of(F.col("key"), ranges).alias("part"))
    right = one.withColumn("part", range_of(F.col("key"), ranges))
    left, right = spread(left, right, "part", F.to_json("ref"), references_per_split)
    kind = left.schema["ref"].dataType
    h = F.xxhash64("key").alias("hash")
    both = right.select("part", "salt", F.lit(0).alias("side"), h, "key", "since", "gone", F.lit(None).cast("long").alias("at"), F.lit(None).cast(kind).alias("ref")).unionByName(
        left.select("part", "salt", F.lit(1).alias("side"), h, "key", F.lit(None).cast("long").alias("since"), F.lit(None).cast("long").alias("gone"), "at", "ref")
    )
    filled = both.fillna({"since": 0, "gone": 0, "at": 0})
    ordered = filled.repartition("part", "salt").sortWithinPartitions("part", "salt", "side", "hash")
    return arrow_map(ordered, probe(), f"ref {kind.simpleString()}")


def once(events: DataFrame) -> DataFrame:
    """Each event (uid) at its earliest loaded_at (null last); events without event_uid are told apart by what they refer to."""
    u = F.coalesce(F.col("event_uid"), F.concat_ws("|", F.lit("\u0000"), "closest_point_id", "u", "v", "start"))
    cols = events.select("event_uid", "closest_point_id", "u", "v", "start", F.unix_micros("loaded_at").alias("at"), u.alias("uid"))
    first = Window.partitionBy("uid").orderBy(F.col("at").asc_nulls_last(), "closest_point_id", "u", "v")
    return cols.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("at", F.coalesce("at", F.lit(NEVER - 1)))


def event_references(events: DataFrame) -> DataFrame:
    """All references of once(): ref (event_uid, ref_field, period, uid), key, at."""
    e = once(events)
    ref = lambda field: F.struct("event_uid", F.lit(field).alias("ref_field"), F.to_date("start").cast("string").alias("period"), "uid")
    pair = F.concat_ws("-", F.least("u", "v"), F.greatest("u", "v"))
    one = lambda field, key: F.struct(ref(field).alias("ref"), key.alias("key"))
    c = F.col("closest_point_id")
    return e.select(
        "at",
        F.explode(
            F.array(
                one("closest_point_id", F.when(c != "", F.concat(F.lit("p:"), c))),
                one("u", F.concat(F.lit("n:"), F.col("u").cast("string"))),
                one("v", F.concat(F.lit("n:"), F.col("v").cast("string"))),
                one("edge", F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.concat(F.lit("e:"), pair))),
            )
        ).alias("r"),
    ).where(F.col("r.key").isNotNull()).select("r.ref", "r.key", "at")


REF_TABLES = {"closest_point_id": "matched_points", "edge": "muenster_edges_classified", "u": "network_nodes", "v": "network_nodes"}


def event_orphans(events: DataFrame, points: DataFrame, retracted: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """event_uid, ref_field, period of the dangling references of matched events.

    A point is there from its earliest load until its retraction (a point whose load time is null is never there, a
    retraction without time doesn't count); nodes and edges are there always. An
    edge is only looked for if both its nodes are there. An event without loaded_at is judged after
    all loads and retractions. Repeated rows count once; empty tables are tables without parents.
    """
    return _dangling(event_references(events), points, retracted, nodes, edges)


def _dangling(references: DataFrame, points: DataFrame, retracted: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    at = lambda key, since, gone=None: (key.alias("key"), since.cast("long").alias("since"), (F.lit(None) if gone is None else gone).cast("long").alias("gone"))
    p = lambda c: F.concat(F.lit("p:"), F.col(c))
    n = F.concat(F.lit("n:"), F.col("node_id").cast("string"))
    e = F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.concat(F.lit("e:"), F.concat_ws("-", F.least("u", "v"), F.greatest("u", "v"))))
    parents = (
        points.select(*at(p("point_id"), F.unix_micros("loaded_at")))
        .unionByName(retracted.select(*at(p("point_id"), F.lit(None), F.unix_micros("retracted_at"))))
        .unionByName(nodes.select(*at(n, F.lit(-NEVER))))
        .unionByName(edges.select(*at(e, F.lit(-NEVER))))
    )
    missing = orphans(references, parents).select("ref.*")
    # an edge between nodes of which one is missing is no finding of its own
    per_event = Window.partitionBy("uid")
    ends = F.max(F.col("ref_field").isin("u", "v").cast("int")).over(per_event)
    return missing.withColumn("_ends", ends).where((F.col("ref_field") != "edge") | (F.col("_ends") == 0)).drop("_ends", "uid")


def orphan_report(found: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Per referred table, field and day of the event's start (null if it has none): dangling references and, if all references
    (event_references()) are given, how many there are and the share that dangles. Periods without a dangling one come out too then, with 0."""
    table = F.col("ref_field")
    for field, name in REF_TABLES.items():
        table = F.when(F.col("ref_field") == field, F.lit(name)).otherwise(table)
    keys = [table.alias("ref_table"), "ref_field", "period"]
    if references is None:
        return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_orphans"))
    both = references.select("ref.ref_field", "ref.period", F.lit(1).alias("all"), F.lit(0).alias("lost")).unionByName(found.select("ref_field", "period", F.lit(0).alias("all"), F.lit(1).alias("lost")))
    g = both.groupBy(*keys).agg(F.sum("all").alias("n_references"), F.sum("lost").alias("n_orphans"))
    return g.withColumn("orphan_share", F.col("n_orphans") / F.col("n_references"))
