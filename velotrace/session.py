"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("velotrace")
        .config("spark.driver.memory", os.environ.get("VELOTRACE_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session (spark.checkpoint.dir).

    A folder of our own is set only where the session has none and all runs on this machine, as in local tests; on a
    cluster the executors don't share a local folder, so that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="velotrace-"))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per session, as they may run where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_velotrace_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="velotrace-code-")) / "velotrace.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._velotrace_shipped = True  # noqa: SLF001


def arrow_map(df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """mapInArrow, with this package where the kernel runs."""
    ship(df.sparkSession)
    return df.mapInArrow(kernel, schema)
