from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.helpers import LON, M_LON, RAW, reading
from velotrace.operators import points as pt


def test_clip_counts_rows_on_the_way(spark):
    raw = spark.createDataFrame([reading(i, i, lon=LON + (90_000 * M_LON if i > 6 else 0)) for i in range(10)], RAW)
    one = pt.load_points(raw.where("row_seq = 0"))
    ext = pt.node_extent(one.select(F.lit(1).alias("node_id"), "x", "y"))
    seen = Observation("clip")
    assert pt.load_points(raw, ext, seen).count() == 7
    assert seen.get == {"rows": 10, "kept": 7}
