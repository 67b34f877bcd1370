"""Catalogue tables as Parquet folders, and the small key-value state beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import SCHEMAS


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its declared schema; columns that older files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def write(df: DataFrame, root: str, name: str, sort_by: str | None = None) -> None:
    """Overwrite a snapshot; sorted, so that Parquet statistics prune ranges."""
    want = StructType.fromDDL(SCHEMAS[name])
    have = {f.name: f for f in df.schema.fields}
    if missing := [f.name for f in want if f.name not in have]:
        df = df.withColumns({m: F.lit(None).cast(want[m].dataType) for m in missing})
    df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want))
    if sort_by:
        df = df.repartitionByRange(F.desc(sort_by)).sortWithinPartitions(F.desc(sort_by))
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def get_meta(spark: SparkSession, root: str) -> dict[str, str]:
    """Key-value state: a few rows, the last value of a key counts."""
    try:
        rows = spark.read.schema("key string, value string, seq bigint").json(f"{root}/meta")
        return {r["key"]: r["value"] for r in rows.groupBy("key").agg(F.max_by("value", "seq").alias("value")).collect() if r["value"] is not None}
    except Exception as e:  # no state yet
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise


def set_meta(spark: SparkSession, root: str, seq: int, **values: str | None) -> None:
    """Set keys; None deletes."""
    rows = [(k, v, seq) for k, v in values.items()]
    spark.createDataFrame(rows, "key string, value string, seq bigint").coalesce(1).write.mode("append").json(f"{root}/meta")
