from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import RAW, reading
from velotrace.operators.points import journeys, load_points
from velotrace.operators.regular import regular_series
from velotrace.operators.skew import MOST_BROADCAST, is_small, joined_by, spread
from velotrace.operators.spikes import strange_readings
from velotrace.operators.stops import trips_and_stops


def test_every_hot_key_is_split(spark):
    left = spark.range(200_000).select((F.col("id") % 5000).alias("key"), "id")
    right = spark.range(6000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    a, b = spread(left, right, "key", F.col("id"), 10)
    salts = a.groupBy("key").agg(F.count_distinct("salt").alias("n"))
    assert salts.count() == 5000 and salts.where("n < 3").count() == 0
    both = a.join(b, ["key", "salt"])
    assert both.count() == 200_000 and both.where("twice != 2 * key").count() == 0


def test_joins_are_the_same_either_way(spark, monkeypatch):
    left = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (None, 5), (9, 6)], "key long, id long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "key long, v string")
    got = {}
    for most in (10, 1):
        monkeypatch.setattr("velotrace.operators.skew.is_small", lambda df, most=most: is_small(df, most))
        for how in ("inner", "left"):
            got[most, how] = sorted(map(str, joined_by(left, right, ["key"], "key", F.col("id"), 2, how).collect()))
    assert got[10, "inner"] == got[1, "inner"] and got[10, "left"] == got[1, "left"]
    assert len(got[1, "inner"]) == 7 and len(got[1, "left"]) == 9
    assert is_small(right.limit(0)) and MOST_BROADCAST * 100 <= 64 << 20


def windows(plan):
    """Number of partition keys, and types of the columns that go through, of each window of a plan."""
    out = []
    if plan.nodeName() == "Window":
        cols = plan.children().apply(0).output()
        out.append((plan.partitionSpec().size(), [cols.apply(i).dataType().typeName() for i in range(cols.size())]))
    for i in range(plan.children().size()):
        out += windows(plan.children().apply(i))
    return out


@pytest.mark.parametrize("what", [regular_series, strange_readings, trips_and_stops, lambda r: journeys(load_points(r)).cells])
def test_only_slim_rows_are_ordered_per_box(spark, what):
    df = what(spark.createDataFrame([reading(i, 5 * i, str(i % 40)) for i in range(600)], RAW))
    seen = [w for w in windows(df._jdf.queryExecution().optimizedPlan()) if w[0] == 1]
    assert seen and all("array" not in types for _, types in seen)
