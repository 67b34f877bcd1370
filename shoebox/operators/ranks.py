"""Numbers and running sums over a whole table in an order, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

PART = "__part"


def dealt(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with the number of the range of the order that each is in.

    Ranges are written down, as the bounds that Spark samples may differ from run to run.
    """
    return saved(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "ranges")


def offsets(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Per range, the sum of an aggregate over all ranges before it: as many rows as ranges."""
    own = rows.groupBy(PART).agg(value.alias("__own"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return own.select(PART, F.coalesce(F.sum("__own").over(before), F.lit(0)).alias(name))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place in the order, from 1; the order has no ties."""
    rows = dealt(rows, *order)
    own = rows.withColumn(name, F.row_number().over(Window.partitionBy(PART).orderBy(*order)))
    return own.join(F.broadcast(offsets(rows, F.count("*"), "__shift")), PART).withColumn(name, (F.col(name) + F.col("__shift")).cast("long")).drop(PART, "__shift")


def summed_before(rows: DataFrame, value: str, name: str, *order: Column) -> DataFrame:
    """rows with the sum of a whole-number column over all rows before each."""
    rows = dealt(rows, *order)
    w = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn(name, F.coalesce(F.sum(F.col(value).cast("long")).over(w), F.lit(0)))
    return own.join(F.broadcast(offsets(rows, F.sum(F.col(value).cast("long")), "__shift")), PART).withColumn(name, (F.col(name) + F.col("__shift")).cast("long")).drop(PART, "__shift")


def numbered_within(rows: DataFrame, name: str, group: str, *order: Column) -> DataFrame:
    """rows with their place, from 1, in the order among the rows of their group, however large a group is.

    A range holds parts of other ranges' groups at its ends alone, so the counts that are
    carried over are at most two a range.
    """
    rows = dealt(rows, F.asc(group), *order)
    own = rows.withColumn(name, F.row_number().over(Window.partitionBy(PART, group).orderBy(*order)))
    counts = rows.groupBy(PART, group).agg(F.count("*").alias("__own"))
    spans = counts.groupBy(F.col(group).alias("__group")).agg(F.min(PART).alias("__a"), F.max(PART).alias("__b")).where("__a < __b").select("__group")
    several = counts.join(spans, F.col(group).eqNullSafe(F.col("__group")))
    before = F.coalesce(F.sum("__own").over(Window.partitionBy("__group").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = several.select(F.col(PART).alias("__at"), "__group", before.alias("__shift"))
    both = own.join(F.broadcast(shift), (F.col(PART) == F.col("__at")) & F.col(group).eqNullSafe(F.col("__group")), "left")
    return both.withColumn(name, (F.col(name) + F.coalesce("__shift", F.lit(0))).cast("long")).drop(PART, "__at", "__group", "__shift")
