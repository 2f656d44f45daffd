"""Readers and writers of the formats that trajectories and networks come in.

Parquet holds every table; CSV and JSON lines hold flat ones, GraphML holds networks. Schemas are
given, never inferred, and columns that a file lacks come as nulls of their type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velotrace.functions.geo import utm32

RAW = T.StructType(
    [
        T.StructField("createdAt", T.StringType()), T.StructField("value", T.StringType()), T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()), T.StructField("boxId", T.StringType()), T.StructField("boxName", T.StringType()),
    ]
)
QUALITY = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("traj_id", "boxId", "boxName")), T.StructField("keep", T.BooleanType()), T.StructField("n_flags", T.IntegerType()),
        T.StructField("flag_reasons", T.StringType()), T.StructField("n_points", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("length_km", "mean_speed_kmh", "nonzero_share")),
        T.StructField("longest_nonzero_run", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("raw_per_km", "value_max")), T.StructField("n_nonzero", T.LongType()),
        *(T.StructField(c, T.BooleanType()) for c in ("f_speed", "f_nz_share", "f_long_run", "f_rate", "f_too_short")),
    ]
)
# Attributes of street edges that are kept, the usual ones and those that tell about cycling.
USUAL_TAGS = [
    "access", "area", "bridge", "est_width", "highway", "junction", "landuse", "lanes", "maxspeed", "name", "oneway", "ref", "service", "tunnel", "width",
]
EXTRA_TAGS = [
    "cycleway", "cycleway:left", "cycleway:right", "cycleway:both",
    "bicycle", "cyclestreet", "bicycle_road",
    "oneway:bicycle", "traffic_calming",
    "maxspeed", "surface", "lanes",
    "is_sidepath", "segregated", "footway",
]
EDGE_TAGS = sorted({*USUAL_TAGS, *EXTRA_TAGS})


def complete(df: DataFrame, schema: T.StructType, *more: Column) -> DataFrame:
    """The columns of schema in order, and more; missing ones null, others left away."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], *more)


def file_order() -> Column:
    """A number that grows from row to row of a file, for a frame that reads files: where its block begins, and the row's number in the task.

    A task reads no more bytes than a block has, and a row has a byte at least, so numbers of a block stay below those of the next. Files are told apart by
    the highest bits, from their names.
    """
    block, name = F.col("_metadata.file_block_start"), F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1 << 15))
    return F.shiftleft(name.cast("long"), 48) + block + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def read_raw_csv(spark: SparkSession, path: str | list[str], row_order: Column | None = None) -> DataFrame:
    """Raw points with row_seq. A createdAt that is no time raises; a value that is no number stays text until load_points().

    row_order makes row_seq; by default the order in the file, see file_order().
    """
    names = spark.read.option("header", True).csv(path).columns
    present = T.StructType([T.StructField(n, RAW[n].dataType if n in RAW.names else T.StringType()) for n in names])
    read = spark.read.schema(present).option("header", True).option("enforceSchema", False).csv(path)
    rows = complete(read, RAW, (row_order if row_order is not None else file_order()).alias("row_seq"))
    return rows.withColumn("createdAt", F.to_timestamp("createdAt"))


def read_quality_csv(spark: SparkSession, path: str) -> DataFrame:
    return complete(spark.read.schema(QUALITY).option("header", True).csv(path), QUALITY)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat columns as they are, arrays of text joined by `;`, other nested columns as JSON."""
    flat = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        flat.append((F.array_join(c, ";") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c).alias(f.name))
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if schema is None else complete(df, schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# GraphML -----------------------------------------------------------------

#: Attributes that a graph may declare.
MOST_KEYS = 10_000
DATA = "data array<struct<_VALUE:string,_key:string>>"


def _graphml(spark: SparkSession, path: str, tag: str, fields: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(f"{fields}, {DATA}").load(path)


def graphml_keys(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """For nodes and edges, attribute name to key id; a graph declares tens of them, so they are read to the driver (an error says so if there are over MOST_KEYS)."""
    rows = spark.read.format("xml").option("rowTag", "key").schema("`_id` string, `_for` string, `_attr.name` string").load(path).distinct().limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"{path} declares more than {MOST_KEYS} attributes")
    out: dict[str, dict[str, str]] = {"node": {}, "edge": {}}
    for r in rows:
        for kind in ("node", "edge") if r["_for"] == "all" else (r["_for"],):
            if kind in out:
                out[kind][r["_attr.name"]] = r["_id"]
    return out


def _datum(key: str | None) -> Column:
    if key is None:
        return F.lit(None).cast("string")
    return F.try_element_at(F.filter("data", lambda d: d["_key"] == key), F.lit(1))["_VALUE"]


def values_of(text: Column) -> Column:
    """A tag as an array: a written list `['a', 'b']` by its parts, other text alone, null as null."""
    parts = F.transform(F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1)), lambda s: s)
    return F.when(text.startswith("[") & text.endswith("]"), parts).when(text.isNotNull(), F.array(text))


def line_of(wkt: Column) -> Column:
    """LINESTRING text to array<struct<x,y>>; null for other text."""
    pairs = F.split(F.regexp_extract(wkt, r"LINESTRING\s*\(([^)]*)\)", 1), r"\s*,\s*")
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"))
    return F.when(wkt.startswith("LINESTRING"), F.transform(pairs, point))


def read_network(spark: SparkSession, path: str, metric: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y) and edges (u, v, key, length, tags as arrays, geometry) of a GraphML file.

    metric False: coordinates are WGS84 degrees and are projected. An edge without geometry is straight from u to v.
    """
    keys = graphml_keys(spark, path)
    nk, ek = keys["node"], keys["edge"]
    raw = _graphml(spark, path, "node", "`_id` string").select(F.col("_id").cast("long").alias("node_id"), _datum(nk.get("x")).cast("double").alias("x"), _datum(nk.get("y")).cast("double").alias("y"))
    x, y = (F.col("x"), F.col("y")) if metric else utm32(F.col("y"), F.col("x"))
    nodes = raw.select("node_id", x.alias("x"), y.alias("y"))
    e = _graphml(spark, path, "edge", "`_source` string, `_target` string, `_id` string")
    shape = line_of(_datum(ek.get("geometry")))
    if not metric:
        shape = F.transform(shape, lambda p: F.struct(*[c.alias(n) for c, n in zip(utm32(p["y"], p["x"]), ("x", "y"), strict=True)]))
    edges = e.select(
        F.col("_source").cast("long").alias("u"), F.col("_target").cast("long").alias("v"), F.coalesce(F.col("_id").try_cast("int"), F.lit(0)).alias("key"),
        _datum(ek.get("length")).cast("double").alias("length"), *[values_of(_datum(ek.get(t))).alias(t) for t in EDGE_TAGS], shape.alias("geometry"),
    )
    at = lambda end, name: nodes.select(F.col("node_id").alias(end), F.struct("x", "y").alias(name))
    both = edges.join(at("u", "_a"), "u", "left").join(at("v", "_b"), "v", "left")
    straight = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.array("_a", "_b"))
    return nodes, both.withColumn("geometry", F.coalesce("geometry", straight)).drop("_a", "_b").select(*edges.columns)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML document (in a folder) of nodes (node_id, x, y) and edges (u, v, key, length, tags, geometry), as read_network() reads it.

    Tags are the EDGE_TAGS that edges have: one value as it is, several as a written list. Nulls are left out. The lines are made where the rows are; a
    document has one order, so one task writes it.
    """
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    datum = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f'<data key="{key}">'), safe(c.cast("string")), F.lit("</data>")))
    quoted = lambda c: F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))
    tags = [t for t in EDGE_TAGS if t in edges.columns and edges.schema[t].dataType.typeName() in ("array", "string")]
    text = lambda t: F.when(F.size(F.col(f"`{t}`")) == 1, F.col(f"`{t}`")[0]).otherwise(quoted(F.col(f"`{t}`"))) if edges.schema[t].dataType.typeName() == "array" else F.col(f"`{t}`")
    keys = {"x": ("node", "double"), "y": ("node", "double"), "length": ("edge", "double"), "geometry": ("edge", "string")} | {t: ("edge", "string") for t in tags}
    ids = {k: f"d{i}" for i, k in enumerate(keys)}
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id="{ids[k]}" for="{f}" attr.name="{k}" attr.type="{kind}"/>' for k, (f, kind) in keys.items()), '<graph edgedefault="directed">']
    spark = nodes.sparkSession
    first = spark.createDataFrame([(0, i, "", line) for i, line in enumerate(head)] + [(3, 0, "", "</graph></graphml>")], "part int, a long, b string, value string")
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("a"), F.lit("").alias("b"), F.concat(F.lit('<node id="'), F.col("node_id").cast("string"), F.lit('">'), F.concat_ws("", datum(ids["x"], F.col("x")), datum(ids["y"], F.col("y"))), F.lit("</node>")).alias("value"))
    wkt = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("geometry", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    data = F.concat_ws("", datum(ids["length"], F.col("length")), *[datum(ids[t], text(t)) for t in tags], datum(ids["geometry"], wkt))
    tail = [F.lit(f'" {k}="') if k else F.lit('">') for k in ("target", "id", "")]
    e = edges.select(
        F.lit(2).alias("part"), F.col("u").alias("a"), F.format_string("%s %s", "v", "key").alias("b"),
        F.concat(F.lit('<edge source="'), F.col("u").cast("string"), tail[0], F.col("v").cast("string"), tail[1], F.col("key").cast("string"), tail[2], data, F.lit("</edge>")).alias("value"),
    )
    lines = first.unionByName(n).unionByName(e).where(F.col("value").isNotNull())
    lines.repartition(1).sortWithinPartitions("part", "a", "b").select("value").write.mode("overwrite").text(path)
