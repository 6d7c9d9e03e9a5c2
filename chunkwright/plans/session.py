"""A session for local work, and the package for executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, with adaptive execution and UTC."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("chunkwright")
        .config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def with_package(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_chunkwright", False):
        return spark
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    handle, path = tempfile.mkstemp(prefix="chunkwright-", suffix=".zip")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("chunkwright", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._chunkwright = True
    return spark
