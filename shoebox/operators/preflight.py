"""What a print shop would find wrong with laid-out pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAD_DPI, SOFT_DPI = 150, 220
# Name, width mm, height mm, dpi, bleed mm, safe mm, gutter mm.
PROFILES = [
    ("a4-landscape", 297.0, 210.0, 300, 3.0, 5.0, 0.0),
    ("a4-portrait", 210.0, 297.0, 300, 3.0, 5.0, 0.0),
    ("square-210", 210.0, 210.0, 300, 3.0, 5.0, 0.0),
    ("square-300", 300.0, 300.0, 300, 3.0, 5.0, 0.0),
    ("a4-spread", 420.0, 297.0, 300, 3.0, 8.0, 12.0),
    ("screen", 340.0, 191.0, 96, 0.0, 0.0, 0.0),
]


def profiles(spark: SparkSession) -> DataFrame:
    d = spark.createDataFrame(PROFILES, "profile string, page_w_mm double, page_h_mm double, dpi int, bleed_mm double, safe_mm double, gutter_mm double")
    px = lambda c: F.bround(F.col(c) / 25.4 * F.col("dpi")).cast("long")
    return d.withColumn("page_w_px", px("page_w_mm")).withColumn("page_h_px", px("page_h_mm")).withColumn("bleed_px", px("bleed_mm"))


def effective_dpi(source_px, slot_px, page_px, page_mm, dpi):
    """Real pixels per inch that a picture brings to its slot."""
    inches = slot_px / page_px * page_mm / 25.4
    return F.when((slot_px <= 0) | (page_px <= 0) | (inches <= 0), dpi.cast("double")).otherwise(source_px / inches)


def findings(slots: DataFrame) -> DataFrame:
    """page, id, kind, severity, dpi. slots: page, id, x, y, w, h, laid_w, laid_h, source_px, faces (fractions of the frame), and a profile's columns.

    An unmeasured picture is only to be looked at.  Of a slot's faces the first that the
    trim may take, or that lies in the spine, is the one finding.
    """
    s = slots.withColumn("slot_px", F.bround(F.greatest(F.lit(1), F.col("w")) / F.col("laid_w") * F.col("page_w_px")))
    s = s.withColumn("dpi_there", effective_dpi(F.col("source_px"), F.col("slot_px"), F.col("page_w_px"), F.col("page_w_mm"), F.col("dpi")))
    low = F.when(F.coalesce("source_px", F.lit(0)) <= 0, "look").when(F.col("dpi_there") < BAD_DPI, "stop").when(F.col("dpi_there") < SOFT_DPI, "look")
    sharp = s.select("page", "id", F.lit("resolution").alias("kind"), low.alias("severity"), F.when(F.col("source_px") > 0, F.col("dpi_there")).alias("dpi")).where("severity is not null")
    f = s.where("source_px > 0").select("page", "id", "profile", "x", "y", "w", "h", "laid_w", "laid_h", "safe_mm", "gutter_mm", "page_w_mm", "page_h_mm", F.posexplode("faces").alias("k", "b"))
    at = lambda o, size, laid, i: F.col(o) / F.col(laid) + F.col("b")[i] * F.greatest(F.lit(1), F.col(size)) / F.col(laid)
    x0, y0, x1, y1 = at("x", "w", "laid_w", 0), at("y", "h", "laid_h", 1), at("x", "w", "laid_w", 2), at("y", "h", "laid_h", 3)
    sx, sy, g = F.col("safe_mm") / F.col("page_w_mm"), F.col("safe_mm") / F.col("page_h_mm"), F.col("gutter_mm") / F.col("page_w_mm") / 2
    kind = F.when((x0 < sx) | (y0 < sy) | (x1 > 1 - sx) | (y1 > 1 - sy), "trim").when((F.col("gutter_mm") > 0) & (x0 < 0.5 + g) & (x1 > 0.5 - g), "gutter")
    hit = f.withColumn("kind", kind).where("kind is not null").withColumn("rn", F.row_number().over(Window.partitionBy("page", "id").orderBy("k"))).where("rn = 1")
    faces = hit.select("page", "id", "kind", F.when(F.col("kind") == "trim", "stop").otherwise("look").alias("severity"), F.lit(None).cast("double").alias("dpi"))
    return sharp.unionByName(faces)


def book(found: DataFrame, pages: int, multiple_of: int = 0, minimum: int = 0) -> DataFrame:
    """One row: pages, stop, look, ready."""
    extra = int(bool(minimum and pages < minimum)) + int(bool(multiple_of and pages % multiple_of))
    out = found.agg((F.count_if(F.col("severity") == "stop") + extra).alias("stop"), F.count_if(F.col("severity") == "look").alias("look"))
    return out.select(F.lit(pages).cast("long").alias("pages"), "stop", "look", (F.col("stop") == 0).alias("ready"))
