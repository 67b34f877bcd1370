"""The catalogue as the tables of another photo application."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_name
from ..operators.ranks import numbered, numbered_within
from ..session import saved

# File suffixes of raw pictures.
RAW = "3fr arw cr2 cr3 crw dcr dng erf iiq kdc mdc mef mos mrw nef nrw orf pef raf raw rw2 rwl sr2 srf srw".split()
# Labels of formats that have several suffixes.
LABELS = {"JPEG": "JPG", "JPE": "JPG", "JFIF": "JPG", "TIF": "TIFF", "MPG": "MPEG", "M4V": "MP4"}


def file_type(kind, suffix):
    """1 picture, 2 anything that isn't one, a null kind too, 3 raw picture."""
    return F.when(~kind.eqNullSafe("image"), 2).when(F.lower(suffix).isin(*RAW), 3).otherwise(1).cast("long")


def format_label(suffix):
    """The suffix in capitals, or the common label of its format; null without one."""
    label = F.upper(suffix)
    for old, new in LABELS.items():
        label = F.when(F.upper(suffix) == old, new).otherwise(label)
    return F.when(suffix != "", label)


def files(assets: DataFrame, open_version: str = "medium", scanned: int | None = None) -> DataFrame:
    """A row per visible asset: folder by month in UTC, the chosen rendition, name, type, label and dates in seconds.

    A medium rendition is a JPEG whatever the original was.  scanned is the run's number
    of milliseconds, by which rows of earlier runs are known as stale.
    """
    seen = assets.where("missing_since is null and not hidden")
    when = F.coalesce(F.col("taken"), F.col("added"))
    v = F.col("versions")
    chosen = F.when(v[open_version].isNotNull(), F.lit(open_version)).when(v["medium"].isNotNull(), "medium").otherwise("original")
    filename = F.coalesce(F.when(F.col("filename") != "", F.col("filename")), F.concat(F.col("id"), F.lit(".jpg")))
    own = F.regexp_extract(filename, r"^.+(\.[^.]+)$", 1)
    d = seen.withColumn("version", chosen).withColumn("suffix", F.when(F.col("version") == "medium", ".jpg").otherwise(own))
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]+$", "")
    bare = F.substring(F.col("suffix"), 2, 100)
    return d.select(
        "id", F.coalesce(F.date_format(when, "yyyy/MM"), F.lit("1970/01")).alias("folder"), F.concat(safe_name(F.col("id")), F.lit("@"), stem, F.col("suffix")).alias("name"),
        file_type(F.col("kind"), bare).alias("file_type"), format_label(bare).alias("format_label"), F.coalesce(F.unix_timestamp(when), F.lit(0)).alias("taken_at"), "version",
        F.col("versions")[F.col("version")]["width"].alias("width"), F.col("versions")[F.col("version")]["height"].alias("height"), "bytes", "favorite", "latitude", "longitude",
        F.lit(scanned).cast("long").alias("scanned"),
    )


def shown_names(people: DataFrame, faces: DataFrame, exported: DataFrame) -> DataFrame:
    """person: the shown names of people with a face in an exported file."""
    named = people.where("coalesce(name, '') <> ''").select(F.col("id").alias("person_id"), F.coalesce("display_name", "name").alias("person"))
    seen = faces.join(exported.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").select("person_id").distinct()
    return named.join(seen, "person_id", "left_semi").select("person").distinct()


def persons(people: DataFrame, faces: DataFrame, exported: DataFrame) -> DataFrame:
    """person_id and person: the shown names, numbered by name."""
    return numbered(shown_names(people, faces, exported), "person_id", F.asc("person"))


def thumbs(exported: DataFrame, cache: DataFrame, kinds: DataFrame) -> DataFrame:
    """id, path, error: cached thumbs; a movie with nothing cached has an error row, an image without a thumb none. kinds: id, kind."""
    held = cache.select(F.col("asset_id").alias("id"), F.col("version").alias("held"), "path")
    thumb = held.where("held = 'thumb'").groupBy("id").agg(F.min("path").alias("path"))
    file = held.select("id", F.col("held").alias("version")).distinct().withColumn("__file", F.lit(True))
    d = exported.select("id", "version").join(kinds, "id").join(thumb, "id", "left").join(file, ["id", "version"], "left")
    lost = F.col("path").isNull() & F.col("__file").isNull() & ~F.col("kind").eqNullSafe("image")
    return d.where(F.col("path").isNotNull() | lost).select("id", "path", lost.alias("error"))


def merged(old: DataFrame, new: DataFrame, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows after an export, rows that went): new rows replace those of their folder and name; a whole run drops what it didn't write."""
    key = ["folder", "name"]
    left = old.join(new.select(*key), key, "left_anti")
    return (new, left) if whole else (left.unionByName(new, allowMissingColumns=True), left.limit(0))


def without_orphans(rows: DataFrame, exported: DataFrame, key: str = "asset_id") -> DataFrame:
    """Thumbs or faces whose file row is still there."""
    return rows.join(exported.select(F.col("id").alias(key)), key, "left_semi")


def folders(exported: DataFrame) -> DataFrame:
    n = exported.groupBy("folder").agg(F.count("*").alias("files"))
    return n.withColumn("folder_id", F.row_number().over(Window.orderBy("folder")).cast("long"))  # a row a month


def has_faces(exported: DataFrame, state: DataFrame, faces: DataFrame) -> DataFrame:
    """1 with faces, 2 indexed without any, 0 not indexed."""
    f = faces.select(F.col("asset_id").alias("id")).distinct().withColumn("__f", F.lit(True))
    s = state.select(F.col("asset_id").alias("id")).distinct().withColumn("__s", F.lit(True))
    return exported.join(f, "id", "left").join(s, "id", "left").withColumn("has_faces", F.when(F.col("__f"), 1).when(F.col("__s"), 2).otherwise(0)).drop("__f", "__s")


def face_rows(faces: DataFrame, people: DataFrame, exported: DataFrame, scale: DataFrame) -> DataFrame:
    """Boxes scaled to the exported rendition, with the person's shown name. scale: id, ratio."""
    named = people.select(F.col("id").alias("person_id"), F.coalesce("display_name", "name").alias("person")).where("person is not null")
    d = faces.join(exported.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").join(scale.withColumnRenamed("id", "asset_id"), "asset_id")
    return d.join(named, "person_id", "left").select("id", "asset_id", F.expr("transform(box, v -> cast(bround(v * ratio) as int))").alias("box"), "person")


def covers(faces: DataFrame) -> DataFrame:
    """Each person's largest face, the smallest id of equals."""
    area = (F.col("box")[2] - F.col("box")[0]) * (F.col("box")[3] - F.col("box")[1])
    return faces.where("person is not null").groupBy("person").agg(F.max_by("id", F.struct(area.alias("a"), (-F.col("id")).alias("i"))).alias("cover"))


def collection_rows(items: DataFrame, exported: DataFrame, now: int) -> DataFrame:
    """Items in order with added_at = now + place; items that weren't exported have no row."""
    d = items.join(exported.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    return numbered_within(d, "added_at", "collection", F.asc("position"), F.asc("asset_id")).withColumn("added_at", F.col("added_at") + now - 1)


# --- the eight tables, with keys that last ------------------------------------------------


def keyed(names: dict[str, DataFrame], known: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """By kind, known (name, id) with the new ones of `names` numbered behind the largest id, by name; a name keeps its id when it goes and comes again.

    All kinds are numbered in one pass and written as one table, in order of kind.
    """
    of = lambda tables, *c: reduce(DataFrame.unionByName, [t.select(F.lit(k).alias("kind"), *c) for k, t in sorted(tables.items())])
    new, held = of(names, "name").distinct(), of({k: known[k] for k in names}, "name", "id")
    new = new.join(held, (new["kind"] == held["kind"]) & (new["name"] == held["name"]), "left_anti")
    last = held.groupBy("kind").agg(F.max("id").alias("__last"))
    fresh = numbered_within(new, "id", "kind", F.asc("name")).join(F.broadcast(last), "kind", "left").select("kind", "name", (F.col("id") + F.coalesce("__last", F.lit(0))).alias("id"))  # a row a kind
    rows = saved(held.unionByName(fresh), "keys")
    return {k: rows.where(F.col("kind") == k).select("name", "id") for k in names}


#: Tables of names and their ids that the next export needs.
KEYS = ("folders", "files", "thumbs", "persons", "faces", "collections")


def _pictured(catalogue: dict[str, DataFrame]) -> DataFrame:
    """Images, which alone have faces, and their renditions."""
    return catalogue["assets"].where("kind = 'image'").select(F.col("id").alias("asset_id"), "versions")


def named(catalogue: dict[str, DataFrame], root: str, ms: int, known: dict[str, DataFrame] | None, open_version: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What an export numbers, and the ids by name (`KEYS`), with those of `known`."""
    spark = catalogue["assets"].sparkSession
    none = spark.createDataFrame([], "name string, id long")
    known = {k: (known or {}).get(k, none) for k in KEYS}
    of = lambda kind, name, id_: keys[kind].select(F.col("name").alias(name), F.col("id").alias(id_))
    shown = files(catalogue["assets"], open_version, scanned=ms)
    shown = shown.withColumn("path", F.concat(F.lit(f"{root}/"), F.col("folder"))).withColumn("__file", F.concat_ws("/", "path", "name"))
    months = shown.select("path").distinct()
    paths = months.unionByName(months.select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))).unionByName(spark.createDataFrame([(root,)], "path string")).distinct()
    shown_people = shown_names(catalogue["people"], catalogue["faces"], shown.select("id")).select(F.col("person").alias("name"))
    own_faces = catalogue["faces"].join(shown.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").join(_pictured(catalogue), "asset_id", "left_semi")
    keys = keyed({"folders": paths.withColumnRenamed("path", "name"), "files": shown.select(F.col("__file").alias("name")), "persons": shown_people, "faces": own_faces.select(F.col("id").cast("string").alias("name")), "collections": catalogue["collections"].select("name")}, known)
    ided = saved(shown.withColumnRenamed("id", "asset_id").join(of("files", "__file", "id"), "__file").join(of("folders", "path", "folder_id"), "path"), "exported")
    of_asset = ided.select("asset_id", F.col("id").alias("file_id"))
    held = saved(thumbs(ided.select(F.col("asset_id").alias("id"), "version"), catalogue["cache"], catalogue["assets"].select("id", "kind")).withColumnRenamed("id", "asset_id").join(of_asset, "asset_id"), "thumbs")
    keys |= keyed({"thumbs": held.select(F.col("file_id").cast("string").alias("name"))}, known)
    return {"paths": paths, "persons": shown_people, "faces": own_faces, "files": ided, "thumbs": held}, keys


def library(catalogue: dict[str, DataFrame], album: str, root: str, now: datetime, known: dict[str, DataFrame] | None = None, open_version: str = "original") -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The eight tables of the other application's library, and the ids by name that the next export needs (`KEYS`).

    `catalogue` has assets, cache, faces, people, index_state, collections and
    collection_assets.  Ids of `known` stay, so a second export gives what has the same
    name the same id; rows of what is gone are not among the tables, and so neither are
    thumbs, faces and items that hang on them.  Folders are the album's, one a year and one
    a month in UTC.
    """
    ms = int(now.timestamp() * 1000)
    found, keys = named(catalogue, root, ms, known, open_version)
    ided, held, own_faces = found["files"], found["thumbs"], found["faces"]
    of = lambda kind, name, id_: keys[kind].select(F.col("name").alias(name), F.col("id").alias(id_))
    of_asset = ided.select("asset_id", F.col("id").alias("file_id"))
    pictured = _pictured(catalogue)
    size = lambda version: F.col("versions")[version]
    seen = F.coalesce(F.col("source"), F.lit("thumb"))
    whole = lambda side: F.when((size(F.col("version"))["width"] > 0) & (size(F.col("version"))["height"] > 0) & (size(seen)["width"] > 0) & (size(seen)["height"] > 0), size(F.col("version"))[side] / size(seen)[side]).otherwise(1.0)
    sized = catalogue["faces"].join(ided.select("asset_id", F.col("id").alias("file_id"), "version").join(pictured, "asset_id"), "asset_id").withColumns({"sx": whole("width"), "sy": whole("height")})
    people = catalogue["people"].where("coalesce(name, '') <> ''").select(F.col("id").alias("person_id"), F.coalesce("display_name", "name").alias("person"))
    box = lambda k, s: F.col("box")[k] * F.col(s)
    bbox = F.to_json(F.struct(box(0, "sx").alias("x"), box(1, "sy").alias("y"), ((F.col("box")[2] - F.col("box")[0]) * F.col("sx")).alias("width"), ((F.col("box")[3] - F.col("box")[1]) * F.col("sy")).alias("height"), F.coalesce("det", F.lit(0.0)).alias("confidence")))
    face = sized.withColumn("name", F.col("id").cast("string")).drop("id").join(keys["faces"], "name").join(people, "person_id", "left").join(of("persons", "person", "__person"), "person", "left")
    face = saved(face.select("id", "file_id", bbox.alias("bbox"), "embedding", F.col("__person").alias("person_id"), F.lit(ms // 1000).alias("created_at"), "box", "sx", "sy"), "faces")
    area = (F.col("box")[2] - F.col("box")[0]) * F.col("sx") * (F.col("box")[3] - F.col("box")[1]) * F.col("sy")
    cover = face.where("person_id is not null").groupBy("person_id").agg(F.max_by("id", F.struct(area.alias("a"), (-F.col("id")).alias("i"))).alias("cover_face_id")).withColumnRenamed("person_id", "id")
    flags = has_faces(ided.select(F.col("asset_id").alias("id")), catalogue["index_state"], own_faces).withColumnRenamed("id", "asset_id")
    source = catalogue["assets"].select(F.col("id").alias("asset_id"), F.col("caption").alias("comments"), F.col("width").alias("__w"), F.col("height").alias("__h"))
    afiles = ided.join(flags, "asset_id").join(source, "asset_id").select(
        "id", "folder_id", "name", F.coalesce("bytes", F.lit(0)).alias("size"), "file_type", "format_label", F.col("taken_at").alias("created_at"), F.col("taken_at").alias("modified_at"), F.col("taken_at").alias("taken_date"), F.col("__w").alias("width"), F.col("__h").alias("height"),
        F.col("favorite").cast("int").alias("is_favorite"), "comments", F.col("latitude").alias("gps_latitude"), F.col("longitude").alias("gps_longitude"), "has_faces", F.col("scanned").alias("last_scan_time"), "asset_id",
    )
    part = F.regexp_extract("path", "[^/]*$", 0)
    items = numbered_within(catalogue["collection_assets"].join(of_asset, "asset_id"), "__n", "collection", F.asc("position"), F.asc("asset_id"))
    first = Window.partitionBy("collection_id", "file_id").orderBy("__n")  # repeats of one item
    total = ided.agg(F.count("*").alias("total"))
    out = {
        "albums": total.select(F.lit(1).cast("long").alias("id"), F.lit(album).alias("name"), F.lit(root).alias("path"), "total", F.lit(1).alias("indexed"), F.lit(ms).alias("last_scan_time"), F.lit(ms // 1000).alias("modified_at")),
        "afolders": found["paths"].join(of("folders", "path", "id"), "path").select("id", F.lit(1).cast("long").alias("album_id"), part.alias("name"), "path", (~F.col("path").rlike("/[0-9]{4}/[0-9]{2}$")).cast("int").alias("has_subfolders")),
        "afiles": afiles, "athumbs": held.withColumn("name", F.col("file_id").cast("string")).join(keys["thumbs"], "name").select("id", "file_id", F.col("error").cast("int").alias("error_code"), F.col("path").alias("thumb_path"), F.lit(ms // 1000).alias("updated_at")),
        "persons": found["persons"].join(keys["persons"], "name").join(cover, "id", "left").select("id", "name", "cover_face_id"), "faces": face.drop("box", "sx", "sy"),
        "acollections": catalogue["collections"].join(keys["collections"], "name").select("id", "name", F.unix_timestamp("created").alias("created_at"), F.lit(ms // 1000).alias("updated_at")),
        "acollections_files": items.join(of("collections", "collection", "collection_id"), "collection").withColumn("__k", F.row_number().over(first)).where("__k = 1").select("collection_id", "file_id", (F.lit(ms // 1000) + F.col("__n") - 1).alias("added_at")),
    }
    return out, keys


def first_keys(catalogue: dict[str, DataFrame], root: str, now: datetime, known: dict[str, DataFrame] | None = None, open_version: str = "original") -> dict[str, DataFrame]:
    """The ids by name of an export whose tables nobody reads."""
    return named(catalogue, root, int(now.timestamp() * 1000), known, open_version)[1]


def write_library(tables: dict[str, DataFrame], keys: dict[str, DataFrame], path: str) -> None:
    """Write tables and keys below a folder of this export; `read_keys` gives the keys to the next one."""
    for kind, own in (("tables", tables), ("keys", keys)):
        for name, df in own.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}/{name}")


def read_keys(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {k: spark.read.schema("name string, id long").parquet(f"{path}/keys/{k}") for k in KEYS}
