"""Sessions, and tables that cut a lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "shoebox", **config: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings by name override."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=settings | config).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which may not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="shoebox")) / "shoebox_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; only without one, in local mode as in tests, a local one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not (folder := getattr(shared_folder, "own", None)):
        folder = shared_folder.own = tempfile.mkdtemp(prefix="shoebox_shared")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: the lineage ends there, and a lost executor costs nothing.

    The files go when `forget` is called, or with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shoebox/{os.getpid()}-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    out.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(out)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
