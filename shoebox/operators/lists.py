"""Bounded caches, collections, books and jobs: tables whose rows have places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import numbered_within, summed_before

#: Parts of the time between the first and the last use, and rows of one that a task sorts.
BUCKETS, LARGE = 4096, 1 << 20


class CacheFull(Exception):
    """What would have to stay doesn't fit the budget."""


def _place(cache: DataFrame, used: str) -> Column | None:
    """The order's first column as a whole number, if it is a time or a number."""
    kind = cache.schema[used].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(used).cast("timestamp"))
    return F.col(used).cast("long") if isinstance(kind, T.IntegralType) else None


def eviction_plan(cache: DataFrame, needed: int, budget: int, keep: tuple | None = None, used: str = "used", size: str = "bytes", large: int = LARGE) -> DataFrame:
    """Rows to evict, least recently used first, until `needed` more fit: those before which too much is still held.

    freed_before is how much the rows before each free.  Pinned rows and the entry being
    written are never evicted.  A histogram of the bytes over the time of use says up to
    which bucket rows go; only these are sorted, each bucket on its own.  Buckets of more
    than `large` rows, as of very many rows of one time, are sorted range by range.
    """
    free = cache.where(~F.col("pinned"))
    if keep:
        free = free.where(~((F.col("asset_id") == F.lit(keep[0])) & (F.col("version") == F.lit(keep[1]))))
    order = (F.asc_nulls_first(used), F.asc("asset_id"), F.asc("version"))
    amount, at = F.col(size).cast("long"), _place(cache, used)
    held = cache.agg(F.coalesce(F.sum(amount), F.lit(0)).alias("total"), *([F.min(at).alias("lo"), F.max(at).alias("hi")] if at is not None else [])).first()
    excess = held.total + needed - budget
    if excess <= 0:
        return free.limit(0).withColumn("freed_before", F.lit(0).cast("long"))
    if at is None:
        return summed_before(free, size, "freed_before", *order).where(F.col("freed_before") < excess)
    width = ((held.hi or 0) - (held.lo or 0)) // BUCKETS + 1
    free = free.withColumn("__bucket", F.coalesce(1 + F.floor((at - (held.lo or 0)) / width).cast("long"), F.lit(0).cast("long")))
    shift, big, gone, in_big = [], [], 0, 0
    for r in free.groupBy("__bucket").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("own"), F.count("*").alias("n")).orderBy("__bucket").collect():  # at most BUCKETS + 2 rows
        if gone >= excess:
            break
        # rows of large buckets are summed together, so what they hold themselves is taken off
        shift.append((r["__bucket"], gone - (in_big if r.n > large else 0)))
        if r.n > large:
            big.append(r["__bucket"])
            in_big += r.own
        gone += r.own
    some = free.join(F.broadcast(cache.sparkSession.createDataFrame(shift, "__bucket long, __over long")), "__bucket")
    w = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = some.where(~F.col("__bucket").isin(big)).withColumn("freed_before", F.coalesce(F.sum(amount).over(w), F.lit(0).cast("long")))
    if big:
        rows = rows.unionByName(summed_before(some.where(F.col("__bucket").isin(big)), size, "freed_before", *order))
    return rows.withColumn("freed_before", F.col("freed_before") + F.col("__over")).where(F.col("freed_before") < excess).drop("__bucket", "__over")


def make_room(cache: DataFrame, needed: int, budget: int, keep: tuple | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(evicted, left, fits). What is evicted stays evicted even if it doesn't fit."""
    out = eviction_plan(cache, needed, budget, keep)
    left = cache.join(out.select("asset_id", "version"), ["asset_id", "version"], "left_anti")
    used = left.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return out, left, used + needed <= budget


def cache_put(cache: DataFrame, row: DataFrame) -> DataFrame:
    """Upsert; an entry that was pinned stays so."""
    old = cache.select("asset_id", "version", F.col("pinned").alias("__pinned"))
    new = row.join(old, ["asset_id", "version"], "left").withColumn("pinned", F.col("pinned") | F.coalesce("__pinned", F.lit(False))).drop("__pinned")
    return cache.join(row.select("asset_id", "version"), ["asset_id", "version"], "left_anti").unionByName(new)


def cache_touch(cache: DataFrame, asset, version, now) -> DataFrame:
    own = (F.col("asset_id") == F.lit(asset)) & (F.col("version") == F.lit(version))
    return cache.withColumn("used", F.when(own, F.lit(now)).otherwise(F.col("used")))


def cache_pin(cache: DataFrame, asset, version=None, pinned: bool = True) -> DataFrame:
    own = F.col("asset_id") == F.lit(asset)
    if version is not None:
        own &= F.col("version") == F.lit(version)
    return cache.withColumn("pinned", F.when(own, F.lit(pinned)).otherwise(F.col("pinned")))


def cached(cache: DataFrame, asset, version, files: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(the entry if its file is there, the cache after looking): an entry that is there has been used now, one whose file is gone goes. files: path."""
    own = (F.col("asset_id") == F.lit(asset)) & (F.col("version") == F.lit(version))
    dead = cache.where(own).join(files.select("path"), "path", "left_anti").select("path", F.lit(True).alias("__dead"))  # a row at most
    left = cache.join(F.broadcast(dead), "path", "left").where(~own | F.col("__dead").isNull()).select(*cache.columns)
    after = cache_touch(left, asset, version, now)
    return after.where(own), after


def peek(cache: DataFrame, asset, version, files: DataFrame) -> DataFrame:
    """The entry if its file is there; the cache stays as it is."""
    own = (F.col("asset_id") == F.lit(asset)) & (F.col("version") == F.lit(version))
    return cache.where(own).join(files.select("path"), "path", "left_semi")


def cache_rows(cache: DataFrame, asset=None, unpinned_only: bool = False, oldest_first: bool = False) -> DataFrame:
    """Entries, of one asset if asked for, by asset and version or by the time of use."""
    rows = cache if asset is None else cache.where(F.col("asset_id") == F.lit(asset))
    rows = rows.where(~F.col("pinned")) if unpinned_only else rows
    return rows.orderBy(*(["used"] if oldest_first else []), "asset_id", "version")


def evict(cache: DataFrame, asset=None, version=None, include_pinned: bool = False) -> DataFrame:
    """What is left."""
    gone = F.lit(True)
    if asset is not None:
        gone &= F.col("asset_id") == F.lit(asset)
    if version is not None:
        gone &= F.col("version") == F.lit(version)
    if not include_pinned:
        gone &= ~F.col("pinned")
    return cache.where(~gone)


def verified(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file is there."""
    return cache.join(files.select("path").distinct(), "path", "left_semi")


def rendition(versions, size: str, kind, small: int = 4 << 20):
    """Which rendition to show: the asked one, else a small original, else the thumb; movies show stills."""
    still = F.when(kind == "movie", F.lit(f"{size}_image")).otherwise(F.lit(size))
    thumb = F.when(kind == "movie", F.lit("thumb_image")).otherwise(F.lit("thumb"))
    original = versions["original"]
    return F.when(versions[still].isNotNull(), still).when((kind == "image") & (original["bytes"] <= small), F.lit("original")).otherwise(thumb)


def analysed(versions, limit: int = 8 << 20, source: str = "thumb"):
    """Which rendition a model reads: the pass's own, else medium, else an original that is small and not raw; null if none."""
    original = versions["original"]
    small = (F.coalesce(original["bytes"], F.lit(0)) <= limit) & ~F.coalesce(original["type"], F.lit("")).contains("raw")
    return F.when(versions[source].isNotNull(), source).when(versions["medium"].isNotNull(), "medium").when(small, "original")


def missing_originals(assets: DataFrame, cache: DataFrame, budget: int) -> DataFrame:
    """One row: files and bytes of the originals that aren't cached, what the budget has left, and whether they fit; nothing needed always fits."""
    held = cache.where("version = 'original'").select(F.col("asset_id").alias("id")).distinct()
    need = assets.join(held, "id", "left_anti").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    used = cache.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("used"))
    left = F.greatest(F.lit(0).cast("long"), F.lit(budget) - F.col("used"))
    both = need.join(F.broadcast(used))  # one row each
    return both.select("files", "bytes", left.alias("left"), ((F.col("bytes") == 0) | (F.col("used") + F.col("bytes") <= budget)).alias("fits"))


def create(parents: DataFrame, row: DataFrame, key: str = "name") -> DataFrame:
    """parents and the row, unless one of its name is there."""
    return parents.unionByName(row.join(parents.select(key), key, "left_anti"), allowMissingColumns=True)


def delete(parents: DataFrame, items: DataFrame, value, owner: str, key: str = "name") -> tuple[DataFrame, DataFrame]:
    """Parents and items without those of one parent."""
    return parents.where(F.col(key) != F.lit(value)), items.where(F.col(owner) != F.lit(value))


def change(rows: DataFrame, key: str, value, **fields) -> DataFrame:
    """Columns of the row with a key set to values; the others stay."""
    own = F.col(key) == F.lit(value)
    return rows.withColumns({c: F.when(own, F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in fields.items()})


def queue(table: DataFrame, row: DataFrame, ident: str = "id", **fields) -> DataFrame:
    """The table with one more row, whose id is the next."""
    last = table.agg(F.coalesce(F.max(ident), F.lit(0)).alias("__last"))
    new = row.join(F.broadcast(last)).withColumn(ident, (F.col("__last") + 1).cast("long")).drop("__last")  # one row each
    for c, v in fields.items():
        new = new.withColumn(c, F.lit(v))
    return table.unionByName(new, allowMissingColumns=True)


def add_page(pages: DataFrame, row: DataFrame, ident: str = "id") -> DataFrame:
    """The page behind its book's last one, with the next id. row: book and the page's columns."""
    last = pages.groupBy("book").agg(F.max("position").alias("__at"))
    new = row.join(last, "book", "left").withColumn("position", (F.coalesce("__at", F.lit(0)) + 1).cast("long")).drop("__at")
    return queue(pages, new, ident)


def remove_page(pages: DataFrame, book, at: int) -> DataFrame:
    """Pages without the one at a place; if there was one, its book is numbered anew."""
    own = F.col("book") == F.lit(book)
    left = pages.where(~(own & (F.col("position") == at)))
    hit = pages.where(own & (F.col("position") == at)).limit(1).count()
    return left.where(~own).unionByName(renumber(left.where(own))) if hit else pages


def append(items: DataFrame, new: DataFrame, owner: str = "collection", item: str = "asset_id", place: str = "position") -> DataFrame:
    """items and the new ones behind them. new: owner, item and its order `n` from 1; an item that is there already uses up its place."""
    last = items.groupBy(owner).agg(F.max(place).alias("__last"))
    first = new.groupBy(owner, item).agg(F.min("n").alias("n"))
    fresh = first.join(items.select(owner, item), [owner, item], "left_anti").join(last, owner, "left").withColumn(place, (F.coalesce("__last", F.lit(0)) + F.col("n")).cast("long"))
    return items.unionByName(fresh.drop("n", "__last"), allowMissingColumns=True)


def fill(items: DataFrame, new: DataFrame, value, replace: bool = False, owner: str = "collection") -> DataFrame:
    """items with new ones of one owner behind its own, or instead of them."""
    return append(items.where(F.col(owner) != F.lit(value)) if replace else items, new, owner)


def remove(items: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(gone.select(*keys), keys, "left_anti")


def collection_items(items: DataFrame, assets: DataFrame, name: str) -> DataFrame:
    """In order; hidden and missing assets too, unknown ones not."""
    return items.where(F.col("collection") == name).join(assets, F.col("asset_id") == F.col("id")).orderBy("position")


def renumber(pages: DataFrame, owner: str = "book", place: str = "position", ident: str = "id") -> DataFrame:
    """Places 1..n in each owner, in the old order."""
    return numbered_within(pages.withColumnRenamed(place, "__old"), place, owner, F.asc("__old"), F.asc(ident)).select(*pages.columns)


def move(pages: DataFrame, owner_value, at: int, to: int, owner: str = "book", place: str = "position", ident: str = "id") -> DataFrame:
    """The page at a place taken out and put in so that it is at another; the places between shift by one. Out of range nothing moves."""
    own = F.col(owner) == F.lit(owner_value)
    n = pages.where(own).count()
    if not (1 <= at <= n and 1 <= to <= n):
        return pages
    p = F.col(place)
    if at < to:
        new = F.when(p == at, F.lit(to)).when((p > at) & (p <= to), p - 1).otherwise(p)
    else:
        new = F.when(p == at, F.lit(to)).when((p >= to) & (p < at), p + 1).otherwise(p)
    return pages.withColumn(place, F.when(own, new).otherwise(p).cast("long"))


def jobs(rows: DataFrame, states: tuple[str, ...] = (), limit: int = 50) -> DataFrame:
    """The newest jobs, of all states if none is named."""
    return (rows.where(F.col("state").isin(*states)) if states else rows).orderBy(F.desc("id")).limit(limit)


def children(rows: DataFrame, parent: str, value, *order) -> DataFrame:
    return rows.where(F.col(parent) == F.lit(value)).orderBy(*order)
