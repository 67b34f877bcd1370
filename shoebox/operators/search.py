"""Search over assets: composable predicates, keyset pages, lookups."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_like, decode_cursor, encode_cursor, safe_name
from ..model import RENDITION


@dataclass(frozen=True)
class Filters:
    """All are ANDed; None doesn't filter. until is exclusive; ids=() admits nothing."""

    text: str | None = None
    since: datetime | str | None = None
    until: datetime | str | None = None
    kind: str | None = None
    favorite: bool | None = None
    live: bool | None = None
    located: bool | None = None
    screenshots: bool | None = None
    album: str | None = None
    collection: str | None = None
    person: object = None
    people: tuple | None = None
    ids: tuple | None = None
    include_missing: bool = False
    include_hidden: bool = False


def membership(assets: DataFrame, members: DataFrame, key: str = "asset_id", id_: str = "id") -> DataFrame:
    """The assets that a relation names."""
    return assets.join(members.select(F.col(key).alias("__member")), F.col(id_) == F.col("__member"), "left_semi")


def apply_filters(assets: DataFrame, f: Filters, relations: dict[str, DataFrame] | None = None) -> DataFrame:
    """The one place that builds predicates, so that search, count and dates agree.

    Row predicates come before the semi-joins, so they reach the scan.  A null filename
    is neither a screenshot nor not one.  Missing and hidden assets are left out unless
    they are asked for; a table without the column of either has none.
    """
    rel = relations or {}
    where = []
    if not f.include_missing and "missing_since" in assets.columns:
        where.append(F.col("missing_since").isNull())
    if not f.include_hidden and "hidden" in assets.columns:
        where.append(~F.col("hidden"))
    if f.text is not None:
        where.append(contains_like(F.col("filename"), f.text) | contains_like(F.col("caption"), f.text))
    if f.since is not None:
        where.append(F.col("taken") >= F.lit(f.since))
    if f.until is not None:
        where.append(F.col("taken") < F.lit(f.until))
    if f.kind is not None:
        where.append(F.col("kind") == f.kind)
    for name in ("favorite", "live"):
        if (want := getattr(f, name)) is not None:
            where.append(F.col(name) == F.lit(want))
    if f.located is not None:
        where.append(F.col("latitude").isNotNull() if f.located else F.col("latitude").isNull())
    if f.screenshots is not None:
        png = F.upper("filename").like("%.PNG")
        where.append(png if f.screenshots else ~png)
    if f.ids is not None:
        where.append(F.col("id").isin(list(f.ids)) if f.ids else F.lit(False))
    for w in where:
        assets = assets.where(w)
    if f.album is not None:
        albums = rel["albums"].where((F.col("id") == f.album) | (F.col("name") == f.album) | (F.col("fullname") == f.album)).select(F.col("id").alias("album_id"))
        assets = membership(assets, rel["album_assets"].join(albums, "album_id"))
    if f.collection is not None:
        assets = membership(assets, rel["collection_assets"].where(F.col("collection") == f.collection))
    if f.person is not None:
        assets = membership(assets, rel["faces"].where(F.col("person_id") == F.lit(f.person)))
    if f.people is not None:
        assets = membership(assets, rel["faces"].where(F.col("person_id").isin(list(f.people)) if f.people else F.lit(False)))
    return assets


def after(taken, ident):
    """Rows below a cursor in the order taken descending, id descending, null dates last."""
    if taken is None:
        return F.col("taken").isNull() & (F.col("id") < F.lit(ident))
    t = F.to_timestamp_ntz(F.lit(str(taken)))
    return (F.col("taken") < t) | ((F.col("taken") == t) & (F.col("id") < F.lit(ident))) | F.col("taken").isNull()


def newest(assets: DataFrame, n: int, cursor: str | None = None) -> DataFrame:
    """The next n rows, by a top-k that never sorts the whole table."""
    if cursor:
        assets = assets.where(after(*decode_cursor(cursor)))
    return assets.orderBy(F.desc_nulls_last("taken"), F.desc("id")).limit(n)


def page(assets: DataFrame, n: int, cursor: str | None = None) -> tuple[list, str | None]:
    """n rows and the cursor of the next page; None where there is none."""
    rows = newest(assets, n + 1, cursor).collect()
    return rows[:n], encode_cursor(rows[n - 1]["taken"], rows[n - 1]["id"]) if len(rows) > n else None


def dates(assets: DataFrame) -> DataFrame:
    return assets.select("id", "taken").orderBy(F.asc_nulls_last("taken"), "id")


def lookup(assets: DataFrame, ids: list) -> DataFrame:
    """The assets in the order of the ids; an unknown id is an error."""
    spark = assets.sparkSession
    asked = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], f"__k long, __id {assets.schema['id'].dataType.simpleString()}")
    rows = F.broadcast(asked).join(assets, F.col("__id") == F.col("id"), "left")
    if bad := rows.where(F.col("id").isNull()).select("__id").limit(1).collect():
        raise KeyError(bad[0][0])
    return rows.orderBy("__k").drop("__k", "__id")


def asset(assets: DataFrame, ident) -> DataFrame:
    """The asset with an id, or nothing; the predicate reaches the scan."""
    return assets.where(F.col("id") == F.lit(ident)).limit(1)


def ids(assets: DataFrame) -> DataFrame:
    """The set of ids: one column of the scan."""
    return assets.select("id").distinct()


def of_master(assets: DataFrame, master) -> DataFrame:
    """The asset of a master, the smallest id of several."""
    return assets.where(F.col("master_id") == F.lit(master)).orderBy("id").limit(1)


def decoded(assets: DataFrame) -> DataFrame:
    """Rows as callers see them: null flags are false, null versions empty, missing instead of its time, no fingerprint."""
    out = assets.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("live", "favorite", "hidden")})
    out = out.withColumn("versions", F.coalesce("versions", F.map_from_entries(F.array().cast(f"array<struct<key: string, value: {RENDITION}>>"))))
    return out.withColumn("missing", F.col("missing_since").isNotNull()).drop("missing_since", "fingerprint")


def by_entry(assets: DataFrame, entry: str) -> DataFrame:
    """The asset that a sanitised name stands for, exact ids first."""
    exact = F.when(F.col("id") == entry, 0).otherwise(1)
    return assets.where((F.col("id") == entry) | (safe_name(F.col("id")) == entry)).orderBy(exact, "id").limit(1)


def unindexed(assets: DataFrame, state: DataFrame, clip_model: str, face_model: str, limit: int | None = None) -> DataFrame:
    """Images that either model's current version hasn't read, newest first."""
    s = state.select(F.col("asset_id"), "clip_model", "face_model")
    out = assets.where("kind = 'image' and missing_since is null").join(s, F.col("id") == F.col("asset_id"), "left")
    out = out.where(~F.col("clip_model").eqNullSafe(clip_model) | ~F.col("face_model").eqNullSafe(face_model)).drop("asset_id", "clip_model", "face_model")
    return out.orderBy(F.desc_nulls_last("taken"), F.desc("id")).limit(limit) if limit else out


def never_indexed(assets: DataFrame, state: DataFrame) -> DataFrame:
    """Visible images without any index state, whatever its version."""
    return assets.where("kind = 'image' and missing_since is null and not hidden").join(state, F.col("id") == F.col("asset_id"), "left_anti")


def info(assets: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """Assets with their cached versions, albums, collections and faces as nested lists."""
    out = assets
    nested = {
        "cached": (relations["cache"], ("version", "bytes", "pinned")),
        "albums": (relations["album_assets"].join(relations["albums"].withColumnRenamed("id", "album_id"), "album_id"), ("album_id", "name")),
        "collections": (relations["collection_assets"], ("collection", "position")),
        "faces": (relations["faces"].withColumnRenamed("id", "face_id"), ("face_id", "person_id", "det")),
    }
    for name, (rel, cols) in nested.items():
        lists = rel.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(lists, out.id == lists.asset_id, "left").drop("asset_id").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out
