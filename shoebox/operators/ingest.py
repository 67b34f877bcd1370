"""Folding a change feed to current state.

The feed's position `seq` is the only order that counts; `modified` is data.  Folds are
aggregations by key, so they combine before the shuffle, and folding folds with new
records gives what folding all records would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decoded_text

# The record types that are kept, as the feed names them.
TYPES = MASTER, ASSET, RELATION, PERSON, CROP = ("CPLMaster", "CPLAsset", "CPLContainerRelation", "CPLPerson", "CPLFaceCrop")


def last(column: str, seq: str = "seq"):
    """The latest value that isn't null."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(seq)))


def fold(records: DataFrame, key: str | list[str], fields: list[str], flags: list[str] = ()) -> DataFrame:
    """Fields keep an older value where the newer one is null; flags take the newest record's.  seq is the newest position.

    To fold again, each field keeps the position of its value in <field>_seq.
    """
    aggs = []
    for f in fields:
        at = F.coalesce(F.col(f"{f}_seq"), F.col("seq")) if f"{f}_seq" in records.columns else F.col("seq")
        at = F.when(F.col(f).isNotNull(), at)
        aggs += [F.max_by(F.col(f), at).alias(f), F.max(at).alias(f"{f}_seq")]
    aggs += [F.max_by(F.col(f), F.col("seq")).alias(f) for f in flags]
    return records.groupBy(key).agg(*aggs, F.max("seq").alias("seq"))


def kept():
    """Records of the types that are kept, and tombstones, which have none."""
    return F.col("type").isin(*TYPES) | F.col("type").isNull()


def fold_records(records: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """Current feed records by name; tombstones stay, with deleted set and the last payload. beside: columns that follow from the name."""
    return fold(records.where(kept()), [*beside, "name"], ["type", "modified", "master_ref", "json", "zone"], ["deleted"])


def missing_since(records: DataFrame, key: str, deleted: str = "deleted") -> DataFrame:
    """Per key, whether it is deleted and the position of the first tombstone since the last live record."""
    live = records.groupBy(key).agg(F.max(F.when(~F.col(deleted), F.col("seq"))).alias("__live"))
    since = records.where(F.col(deleted)).join(live, key).where(F.col("__live").isNull() | (F.col("seq") > F.col("__live"))).groupBy(key).agg(F.min("seq").alias("missing_since"))
    return live.select(key).join(since, key, "left").select(key, F.col("missing_since").isNotNull().alias("deleted"), "missing_since")


def pair(folded: DataFrame) -> DataFrame:
    """Live assets with their live masters, whichever came first."""
    masters = folded.where(f"type = '{MASTER}' and not deleted").select(F.col("name").alias("master_id"), F.col("json").alias("master_json"))
    return folded.where(f"type = '{ASSET}' and not deleted").join(masters, F.col("master_ref") == F.col("master_id"))


def fingerprint(fields: list[str]):
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def upsert_status(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key of either side: new, changed, same or absent (not among the new rows)."""
    a = old.select(F.col(key), fingerprint(fields).alias("__old"))
    b = new.select(F.col(key), fingerprint(fields).alias("__new"))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "absent").when(F.col("__old") == F.col("__new"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, status.alias("status"))


def upsert_assets(old: DataFrame, new: DataFrame, now, status: str | None = None) -> DataFrame:
    """Current assets after a batch of derived ones; `new` has id, fingerprint, zone, deleted and data columns.

    An unchanged asset only gets a new last_seen; one that came back unchanged stays
    missing.  first_seen stays; a null zone keeps the old one.  The column `status`, if
    named, says new, changed or same, and is null for an asset that isn't among the new ones.
    """
    data = [c for c in new.columns if c not in ("id", "zone", "deleted")]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full")
    here, there = F.col("n.id").isNotNull(), F.col("o.id").isNotNull()
    same = there & here & F.col("o.fingerprint").eqNullSafe(F.col("n.fingerprint"))
    take = here & ~same
    now = F.lit(now)
    cols = [F.coalesce("o.id", "n.id").alias("id")]
    cols += [F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in data]
    cols += [
        F.when(take, F.coalesce("n.zone", "o.zone")).otherwise(F.col("o.zone")).alias("zone"),
        F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(here, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(~take, F.col("o.missing_since")).when(F.col("n.deleted"), F.coalesce("o.missing_since", now)).alias("missing_since"),
    ]
    if status:
        cols.append(F.when(here & ~there, "new").when(take, "changed").when(here, "same").alias(status))
    return both.select(*cols)


def value(name: str, kind: str = "string", json: str = "json"):
    """A field's value in a record's payload."""
    return F.try_variant_get(F.try_parse_json(json), f"$.fields.{name}.value", kind)


def text(name: str, json: str = "json"):
    """A field that is text, or base64 of it."""
    return F.coalesce(decoded_text(value(name, json=json)), value(name, json=json))


def moment(name: str, json: str = "json"):
    """A field in milliseconds since 1970."""
    return F.timestamp_millis(value(name, "long", json))


def flag(name: str, json: str = "json"):
    return F.coalesce(value(name, "long", json), F.lit(0)) != 0


# Field prefixes of the renditions that a master's payload names.
RENDITIONS = {"original": "resOriginal", "medium": "resJPEGMed", "thumb": "resJPEGThumb", "original_video": "resOriginalVidCompl", "thumb_image": "resJPEGThumbPoster"}


def _rendition(prefix: str):
    size = F.try_variant_get(F.try_parse_json("master_json"), f"$.fields.{prefix}Res.value.size", "long")
    m = "master_json"
    return F.struct(
        size.alias("bytes"), value(f"{prefix}Width", "int", m).alias("width"), value(f"{prefix}Height", "int", m).alias("height"), value(f"{prefix}FileType", json=m).alias("type"), F.lit(None).cast("string").alias("filename"),
    )


def derived_assets(paired: DataFrame) -> DataFrame:
    """Asset rows of assets with their masters (name, json, zone, master_id, master_json): payload to columns, with fingerprint and deleted.

    A master whose item type is a movie is one; all else is an image.  Sizes are those of
    the original.  Fields that a payload lacks are null, flags false.
    """
    m = "master_json"
    rows = [F.struct(F.lit(k).alias("key"), _rendition(p).alias("value")) for k, p in RENDITIONS.items()]
    versions = F.map_from_entries(F.filter(F.array(*rows), lambda e: e["value"]["bytes"].isNotNull() | e["value"]["type"].isNotNull()))
    d = paired.select(
        F.col("name").alias("id"), "master_id", "zone", text("filenameEnc", m).alias("filename"),
        F.when(F.coalesce(value("itemType", json=m), F.lit("")).rlike("(?i)movie|video|mpeg-4"), "movie").otherwise("image").alias("kind"),
        value("resOriginalVidComplFileType", json=m).isNotNull().alias("live"), moment("assetDate").alias("taken"), moment("addedDate").alias("added"),
        value("resOriginalWidth", "int", m).alias("width"), value("resOriginalHeight", "int", m).alias("height"), F.try_variant_get(F.try_parse_json(m), "$.fields.resOriginalRes.value.size", "long").alias("bytes"),
        flag("isFavorite").alias("favorite"), flag("isHidden").alias("hidden"), flag("isDeleted").alias("deleted"), text("captionEnc").alias("caption"),
        F.try_variant_get(F.try_parse_json("json"), "$.fields.location.value.lat", "double").alias("latitude"), F.try_variant_get(F.try_parse_json("json"), "$.fields.location.value.lon", "double").alias("longitude"), versions.alias("versions"),
    )
    return d.withColumn("fingerprint", fingerprint([c for c in d.columns if c != "zone"]))


def people_of(folded: DataFrame) -> DataFrame:
    """People of the feed; a tombstone keeps the columns and sets deleted."""
    d = folded.where(f"type = '{PERSON}' and json is not null")
    return d.select(F.col("name").alias("id"), text("personFullNameEnc").alias("name"), text("displayName").alias("display_name"), flag("verifiedType").alias("verified"), value("personType", "int").alias("kind"), "modified", "deleted")


def crops_of(folded: DataFrame) -> DataFrame:
    """Face crops of the feed with the people they show."""
    person = F.try_variant_get(F.try_parse_json("json"), "$.fields.personRef.value.recordName", "string")
    d = folded.where(f"type = '{CROP}' and json is not null")
    return d.select(F.col("name").alias("id"), person.alias("person_id"), value("type", "int").alias("kind"), value("resFaceCropFileSize", "long").alias("bytes"), "modified", "deleted")


def relations(folded: DataFrame) -> DataFrame:
    """album_id, asset_id of the memberships whose relation is live."""
    live = folded.where(f"type = '{RELATION}' and not deleted")
    return live.select(value("containerId").alias("album_id"), value("itemId").alias("asset_id")).distinct()


def replace_albums(albums: DataFrame, listed: DataFrame) -> DataFrame:
    """The albums that were listed now, and no others."""
    return listed.select(*(F.col(c) if c in listed.columns else F.lit(None).cast(albums.schema[c].dataType).alias(c) for c in albums.columns))


def replace_members(members: DataFrame, albums: DataFrame, album, ids: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Members with those of one album replaced by `ids` (asset_id), and albums with its time of syncing."""
    kept = members.where(F.col("album_id") != F.lit(album))
    new = ids.select(F.lit(album).cast(members.schema["album_id"].dataType).alias("album_id"), "asset_id").distinct()
    synced = F.when(F.col("id") == F.lit(album), F.lit(now).cast(albums.schema["synced"].dataType)).otherwise(F.col("synced"))
    return kept.unionByName(new), albums.withColumn("synced", synced)


def run_statistics(records: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """One row of a run's counts: records, tombstones, relations, people, face_crops, zones; with the assets before and after it also new, changed, same and missing.

    The kind of a tombstone without a type is that of the record it ends, so only live
    records count by kind.  missing counts the assets that the run marked so.
    """
    live = ~F.col("deleted")
    of = lambda kind: F.count_if(live & (F.col("type") == kind))
    out = records.agg(
        F.count("*").alias("records"), F.count_if(F.col("deleted")).alias("tombstones"), of(RELATION).alias("relations"), of(PERSON).alias("people"), of(CROP).alias("face_crops"), F.countDistinct("zone").alias("zones"),
    )
    if after is None:
        return out
    o = before.select("id", F.col("fingerprint").alias("__old"), F.lit(True).alias("__was"), F.col("missing_since").alias("__gone"))
    touched = records.where(f"type = '{ASSET}' and not deleted").select(F.col("name").alias("id")).distinct().withColumn("__in", F.lit(True))
    d = after.join(o, "id", "left").join(touched, "id", "left")
    seen = F.coalesce("__in", F.lit(False))
    counts = d.agg(
        F.count_if(F.col("__was").isNull()).alias("new"), F.count_if(F.col("__was") & (F.col("__old") != F.col("fingerprint"))).alias("changed"), F.count_if(seen & F.col("__was") & (F.col("__old") == F.col("fingerprint"))).alias("same"),
        F.count_if(F.col("missing_since").isNotNull() & F.col("__gone").isNull()).alias("missing"),
    )
    return out.join(F.broadcast(counts))  # one row each


def mark_missing(assets: DataFrame, folded: DataFrame, now) -> DataFrame:
    """Assets whose record is a tombstone, of whatever kind it was, are missing from now on unless they were before."""
    gone = folded.where(F.col("deleted") & (F.col("type").isNull() | (F.col("type") == ASSET))).select(F.col("name").alias("id"), F.lit(True).alias("__gone"))
    d = assets.join(gone, "id", "left")
    return d.withColumn("missing_since", F.when(F.col("__gone"), F.coalesce("missing_since", F.lit(now).cast("timestamp"))).otherwise(F.col("missing_since"))).drop("__gone")


def touched(folded: DataFrame, names: DataFrame) -> DataFrame:
    """The folded records that a run's names concern: those of the names, the assets of a named master, and the masters of all these."""
    own = folded.join(names.select("name").distinct(), "name", "left_semi")
    masters = own.where(f"type = '{MASTER}'").select(F.col("name").alias("master_ref"))
    more = folded.where(f"type = '{ASSET}'").join(masters, "master_ref", "left_semi")
    assets = own.where(f"type = '{ASSET}'").unionByName(more).dropDuplicates(["name"])
    rest = folded.where(f"type = '{MASTER}'").join(assets.select(F.col("master_ref").alias("name")).distinct(), "name", "left_semi")
    return assets.unionByName(rest).unionByName(own.where(f"type is null or type not in ('{ASSET}', '{MASTER}')"))


def sync_assets(old: DataFrame, folded: DataFrame, now, status: str | None = None) -> DataFrame:
    """Current assets after a run: payloads of live pairs merged into the old rows, tombstones marked."""
    new = derived_assets(pair(folded))
    data = [c for c in new.columns if c not in ("deleted", "zone")]
    old = old.select(*data, *(c for c in ("zone", "first_seen", "last_seen", "missing_since")))
    return mark_missing(upsert_assets(old, new, now, status), folded, now)
