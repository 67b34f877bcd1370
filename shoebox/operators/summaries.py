"""Counts and listings of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(parents: DataFrame, children: DataFrame, on: str, name: str = "n") -> DataFrame:
    """Parents with the number of their children, zero where there are none; children are counted before the join."""
    n = children.groupBy(on).agg(F.count("*").alias(name))
    return parents.join(n, on, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def asset_counts(assets: DataFrame) -> DataFrame:
    """Hidden and missing ones count too."""
    return assets.agg(F.count("*").alias("assets"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "movie").alias("movies"), F.count_if(F.col("missing_since").isNotNull()).alias("missing"))


def counts(assets: DataFrame, albums: DataFrame, collections: DataFrame, people_: DataFrame) -> DataFrame:
    """One row: assets, images, movies, missing, albums, collections and live people."""
    n = lambda d, name: F.broadcast(d.agg(F.count("*").alias(name)))  # noqa: E731  one row
    return asset_counts(assets).join(n(albums, "albums")).join(n(collections, "collections")).join(n(people_.where("not deleted"), "people"))


def variant_counts(variants: DataFrame) -> DataFrame:
    """Versions by asset, of assets that have any."""
    return variants.groupBy("asset_id").agg(F.count("*").alias("n"))


def collections(collections_: DataFrame, items: DataFrame) -> DataFrame:
    """Collections with their numbers of items, oldest first."""
    own = items.withColumnRenamed("collection", "name").select("name")
    return counted(collections_, own, "name", "count").orderBy("created", "name")


def books(books_: DataFrame, pages: DataFrame) -> DataFrame:
    """Books with their numbers of pages, by name."""
    return counted(books_, pages.select(F.col("book").alias("name")), "name", "pages").orderBy("name")


def record_counts(records: DataFrame) -> DataFrame:
    return records.where("not deleted").groupBy(F.coalesce("type", F.lit("tombstone")).alias("type")).agg(F.count("*").alias("n"))


def people(people_: DataFrame, crops: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """People with live crops and, given faces, distinct photographs; unnamed ones last, then by crops and name."""
    live = crops.where("not deleted").groupBy("person_id").agg(F.count("*").alias("crops"))
    out = people_.where("not deleted").join(live, F.col("id") == F.col("person_id"), "left").drop("person_id").withColumn("crops", F.coalesce("crops", F.lit(0).cast("long")))
    if faces is not None:
        photos = faces.where("person_id is not null").groupBy("person_id").agg(F.countDistinct("asset_id").alias("photos"))
        out = out.join(photos, F.col("id") == F.col("person_id"), "left").drop("person_id").withColumn("photos", F.coalesce("photos", F.lit(0).cast("long")))
    return out.orderBy(F.col("name").isNull(), F.desc("crops"), "name", "id")


def usage(cache: DataFrame, budget: int | None = None) -> DataFrame:
    out = cache.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("pinned"), F.col("bytes"))), F.lit(0)).alias("pinned_bytes"))
    return out if budget is None else out.withColumn("budget", F.lit(budget)).withColumn("free", F.greatest(F.lit(budget) - F.col("bytes"), F.lit(0)))


def usage_by_version(cache: DataFrame) -> DataFrame:
    return cache.groupBy("version").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.sum(F.when(F.col("pinned"), F.col("bytes")).otherwise(0)).cast("long").alias("pinned_bytes"))


def index_counts(state: DataFrame, faces: DataFrame, assets: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: indexed, images (that are not missing), faces, faces_named, seeds, seeded_people."""
    a = state.agg(F.count("*").alias("indexed"))
    b = assets.agg(F.count_if((F.col("kind") == "image") & F.col("missing_since").isNull()).alias("images"))
    c = faces.agg(F.count("*").alias("faces"), F.count("person_id").alias("faces_named"))
    d = seeds.agg(F.count("*").alias("seeds"), F.countDistinct("person_id").alias("seeded_people"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(d))  # one row each


def top_per_group(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first n rows of each group, with their rank rn; Spark limits groups before it shuffles them."""
    from pyspark.sql import Window

    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rn") <= n)


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each group's most frequent value, the smallest of equals, by two aggregations."""
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    best = n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(value).alias("value"))).alias("best"))
    return best.select(group, F.col("best.value").alias(value), (-F.col("best.minus")).alias("n"))
