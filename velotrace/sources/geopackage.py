"""GeoPackage files: SQLite tables whose geometries are WKB behind a small header.

A layer is read from any number of files, each by one task, and written as one file per partition.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from velotrace.session import arrow_map

LINE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
# Fixed values: "GPKG" as the application id, version 1.3, bytes of the envelope by its indicator, and WKB numbers of shapes.
APPLICATION, VERSION = 0x47504B47, 10300
ENVELOPES = [0, 32, 48, 48, 64]
POINT, LINESTRING, MULTI = 1, 2, (4, 5)
KINDS = {"bigint": "INTEGER", "int": "MEDIUMINT", "double": "REAL", "string": "TEXT", "boolean": "BOOLEAN", "timestamp": "DATETIME", "date": "DATE"}
ROWS = 20_000


def places(wkb: memoryview) -> tuple[np.ndarray, int]:
    """Corners of a point, line, or several of these in a row, and the bytes read."""
    order = "<" if wkb[0] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", wkb, 1)
    z, kind = kind // 1000 in (1, 3) or bool(kind & 0x80000000), kind % 1000 & 0xFF
    m = False
    width = 2 + z + m
    if kind == POINT:
        return np.frombuffer(wkb, order + "f8", width, 5)[None, :2], 5 + 8 * width
    (n,) = struct.unpack_from(order + "I", wkb, 5)
    if kind == LINESTRING:
        return np.frombuffer(wkb, order + "f8", n * width, 9).reshape(n, width)[:, :2], 9 + 8 * width * n
    if kind in MULTI:
        at, parts = 9, []
        for _ in range(n):
            p, size = places(wkb[at:])
            parts.append(p)
            at += size
        return (np.concatenate(parts) if parts else np.zeros((0, 2))), at
    raise ValueError(f"geometries of WKB kind {kind} are not read")


def corners_of(blob: bytes | None) -> list[dict[str, float]] | None:
    """A GeoPackage geometry as corners; null for null and empty ones."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("no GeoPackage geometry")
    flags = blob[3]
    if flags & 0x10:
        return None
    xy, _ = places(memoryview(blob)[8 + ENVELOPES[flags >> 1 & 7] :])
    return [{"x": x, "y": y} for x, y in xy.tolist()]


def blob_of(xy: list[dict[str, float]] | None, srs: int, point: bool) -> bytes | None:
    if not xy:
        return None
    flat = [c for p in xy for c in (p["x"], p["y"])]
    head = b"GP" + struct.pack("<BBi", 0, 1, srs)
    if point:
        return head + struct.pack("<BI2d", 1, POINT, *flat[:2])
    return head + struct.pack(f"<BII{len(flat)}d", 1, LINESTRING, len(xy), *flat)


def moment(text: str | None) -> datetime | None:
    if text is None:
        return None
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def reader(schema: T.StructType, layer: str | None, shape: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    out = to_arrow_schema(schema)
    kinds = {f.name: f.dataType.simpleString() for f in schema}

    def cast(name: str, values: list) -> list:
        kind = kinds[name]
        if kind == "timestamp":
            return [moment(v) for v in values]
        if kind == "boolean":
            return [None if v is None else bool(v) for v in values]
        if kind == "array<string>":
            return [None if v is None else v.split(";") for v in values]
        return [None if v is None else str(v) for v in values] if kind == "string" else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                db = sqlite3.connect(":memory:")
                db.deserialize(content.as_py())
                found = [r for r in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns") if layer in (None, r[0])]
                if not found:
                    raise ValueError(f"no layer {layer or ''}")
                table, geometry = found[0]
                have = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
                source = {n: geometry if n == shape else n for n in out.names}
                cols = ", ".join(f'"{c}"' if c in have else "NULL" for c in source.values())
                rows = db.execute(f'SELECT {cols} FROM "{table}"')
                while some := rows.fetchmany(ROWS):
                    data = {n: [r[i] for r in some] for i, n in enumerate(out.names)}
                    arrays = [pa.array([corners_of(v) for v in data[f.name]] if f.name == shape else cast(f.name, data[f.name]), f.type) for f in out]
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)
                db.close()

    return run


def read_gpkg(spark: SparkSession, path: str, schema: T.StructType | str, layer: str | None = None, shape: str = "geometry") -> DataFrame:
    """The columns of schema from a layer (the first by default) of GeoPackage files; missing ones null, others left away.

    shape is the name that the geometry gets, as array<struct<x,y>>: a line's corners, the one place of a point. Text of lists (`a;b`) becomes
    an array where the schema says so. A file is read by one task, in memory, so it may have up to 2 GB; a folder of files is spread.
    """
    s = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if shape not in s.names:
        s = T.StructType([*s.fields, T.StructField(shape, LINE)])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gpkg").load(path)
    return arrow_map(files.select("content"), reader(s, layer, shape), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s))


def create(db: sqlite3.Connection, layer: str, columns: list[tuple[str, str]], shape: str, point: bool, srs: int) -> None:
    db.execute(f"PRAGMA application_id = {APPLICATION}")
    db.execute(f"PRAGMA user_version = {VERSION}")
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
    db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", [("undefined cartesian", -1, "NONE", -1), ("undefined geographic", 0, "NONE", 0), ("WGS 84", 4326, "EPSG", 4326)] + ([(f"EPSG:{srs}", srs, "EPSG", srs)] if srs != 4326 else []))
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
    db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, last_change, srs_id) VALUES (?, 'features', ?, '2000-01-01T00:00:00.000Z', ?)", (layer, layer, srs))
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, ?, ?, 0, 0)", (layer, shape, "POINT" if point else "LINESTRING", srs))
    cols = ", ".join(f'"{n}" {k}' for n, k in columns)
    db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, "{shape}" {"POINT" if point else "LINESTRING"}{", " + cols if cols else ""})')


def writer(folder: str, layer: str, columns: list[tuple[str, str]], shape: str, point: bool, srs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def value(v: object) -> object:
        if isinstance(v, datetime):
            return v.astimezone(timezone.utc).isoformat(timespec="microseconds").replace("+00:00", "Z")
        return v if v is None or isinstance(v, int | float | str) else str(v) if not isinstance(v, list | dict) else json.dumps(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.gpkg"
        part = f"{path}.{TaskContext.get().taskAttemptId()}"
        db, n, box = sqlite3.connect(part, isolation_level=None), 0, None
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("BEGIN")
        create(db, layer, columns, shape, point, srs)
        insert = f'INSERT INTO "{layer}" ("{shape}"{"".join(f", {chr(34)}{c}{chr(34)}" for c, _ in columns)}) VALUES (?{", ?" * len(columns)})'
        for batch in batches:
            data = batch.to_pydict()
            db.executemany(insert, [(blob_of(g, srs, point), *map(value, rest)) for g, *rest in zip(data[shape], *(data[c] for c, _ in columns), strict=True)])
            n += batch.num_rows
            xy = [(p["x"], p["y"]) for g in data[shape] if g for p in (g[:1] if point else g)]
            if xy:
                a = np.array(xy)
                low, high = a.min(axis=0), a.max(axis=0)
                box = (low, high) if box is None else (np.minimum(low, box[0]), np.maximum(high, box[1]))
        if box is not None:
            db.execute("UPDATE gpkg_contents SET min_x = ?, min_y = ?, max_x = ?, max_y = ?", (*box[0].tolist(), *box[1].tolist()))
        db.execute("COMMIT")
        db.close()
        # a task that is run again gives the same file under the same name
        os.replace(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_rows"])

    return run


def write_gpkg(df: DataFrame, folder: str, layer: str, shape: str = "geometry", point: bool = False, srs: int = 25832, files: int | None = None) -> int:
    """Writes a layer into a folder that all executors share, a file per partition (or so many files), and gives the number of rows.

    shape: array<struct<x,y>>; with point, its first place is written. Arrays of text are joined by `;`; other nested columns become JSON. Null and
    empty shapes are null. Files of an earlier write into the folder are removed first.
    """
    os.makedirs(folder, exist_ok=True)
    for f in os.listdir(folder):
        if f.startswith("part-"):
            os.remove(f"{folder}/{f}")
    flat, columns = [], []
    for f in df.schema:
        if f.name == shape:
            continue
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        nested = kind.startswith(("array", "struct", "map"))
        flat.append((F.array_join(c, ";") if kind == "array<string>" else F.to_json(c) if nested else c).alias(f.name))
        columns.append((f.name, "TEXT" if nested else KINDS.get(kind, "TEXT")))
    rows = df.select(F.col(f"`{shape}`").alias(shape), *flat)
    rows = rows if files is None else rows.repartition(files)
    written = arrow_map(rows, writer(folder, layer, columns, shape, point, srs), "path string, n_rows long")
    return written.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
