"""Queries over the catalogue's state: lists, caches, people, counts, syncing and export.

The same stand-ins as in `queries`; feed records are built from customers (masters,
people) and orders (assets, crops, memberships) with payloads as JSON.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import faces, ingest, layout, lists, search, summaries, vectors
from ..sources import export
from ..sources.feed import OWN
from .queries import _FACES, _PHOTOS, ASSETS, _albums, _cache, _faces, _photos, _seeds, assets, query, table, vecs

NOW = dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)
NONE = "cast(null as string)"

# --- search, lookups, counts ----------------------------------------------------------


def _library(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as assets of all columns that filters and counts read."""
    return assets(spark, sf).select(
        "id", "taken", "filename", "caption", "bytes", "owner", F.when(F.col("kind") == "F", "movie").otherwise("image").alias("kind"), (F.col("filename") == "5-LOW").alias("hidden"),
        F.when(F.col("kind") == "P", F.col("taken")).alias("missing_since"), (F.col("id") % 3 == 0).alias("favorite"), (F.col("owner") % 2 == 0).alias("live"), F.when(F.col("id") % 4 > 0, F.col("bytes") / 10.0).alias("latitude"),
    )


_LIBRARY = f"(select id, taken, filename, bytes, owner, case when kind = 'F' then 'movie' else 'image' end as kind, filename = '5-LOW' as hidden, case when kind = 'P' then taken end as missing_since from {ASSETS})"


@query(f"select id, kind from {_LIBRARY} where not hidden and missing_since is null")
def search_visible(spark: SparkSession, sf: str) -> DataFrame:
    return search.apply_filters(_library(spark, sf), search.Filters()).select("id", "kind")


@query(f"select id, 'items' as how from {ASSETS} where id in (select l_orderkey from lineitem where l_partkey = 5) union all select id, 'person' from {ASSETS} where id in (select asset_id from {_FACES} where person_id = 3)")
def search_collection_person(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("collection"), F.col("l_orderkey").alias("asset_id"))
    rel = {"collection_assets": items, "faces": _faces(spark, sf)}
    one, two = (search.apply_filters(assets(spark, sf), f, rel).select("id", F.lit(how).alias("how")) for how, f in (("items", search.Filters(collection="5")), ("person", search.Filters(person=3))))
    return one.unionByName(two)


@query(f"select id, 'id' as how from {ASSETS} where id = 7 union all select min(id), 'master' from {ASSETS} where owner = (select max(owner) from {ASSETS}) union all select count(distinct id), 'ids' from {ASSETS}")
def asset_lookups(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf).withColumn("master_id", F.col("owner"))
    last = a.agg(F.max("owner")).first()[0]
    parts = (search.asset(a, 7).select("id", F.lit("id").alias("how")), search.of_master(a, last).select("id", F.lit("master").alias("how")), search.ids(a).agg(F.count("*").alias("id")).withColumn("how", F.lit("ids")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select o_orderkey as id, o_orderkey % 3 = 0 as favorite, false as live, o_orderstatus = 'P' as missing, 0::bigint as renditions from orders")
def rows_decoded(spark: SparkSession, sf: str) -> DataFrame:
    a = _library(spark, sf).withColumns({"favorite": F.when(F.col("favorite"), True), "live": F.lit(None).cast("boolean"), "fingerprint": F.lit("x"), "versions": F.lit(None).cast("map<string, struct<bytes: bigint, width: int, height: int, type: string, filename: string>>")})
    return search.decoded(a).select("id", "favorite", "live", "missing", F.size("versions").cast("long").alias("renditions"))


@query("select (select count(*) from orders) assets, (select count(*) from orders where o_orderstatus <> 'F') images, (select count(*) from orders where o_orderstatus = 'F') movies, (select count(*) from orders where o_orderstatus = 'P') missing, 25::bigint albums, (select count(*) from part) collections, (select count(*) from customer where c_acctbal > 0) people")
def catalogue_counts(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select((F.col("c_acctbal") <= 0).alias("deleted"))
    return summaries.counts(_library(spark, sf), table(spark, sf, "nation"), table(spark, sf, "part"), people)


@query(f"select (select count(*) from supplier) indexed, (select count(*) from {_LIBRARY} where kind = 'image' and missing_since is null) images, (select count(*) from {_FACES}) faces, (select count(person_id) from {_FACES}) faces_named, (select count(*) from embeddings) seeds, (select count(distinct label) from embeddings) seeded_people")
def index_counts(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "embeddings").select(F.col("label").alias("person_id"))
    return summaries.index_counts(table(spark, sf, "supplier"), _faces(spark, sf), _library(spark, sf), seeds)


@query("select p_partkey as name, p_retailprice as created, count(l_orderkey) as count from part left join lineitem on l_partkey = p_partkey group by 1, 2")
def collection_listing(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_retailprice").alias("created"))
    return summaries.collections(p, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("collection")))


@query("select c_custkey as name, count(o_orderkey) as pages from customer left join orders on o_custkey = c_custkey group by 1")
def book_listing(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.books(table(spark, sf, "customer").select(F.col("c_custkey").alias("name")), table(spark, sf, "orders").select(F.col("o_custkey").alias("book")))


@query("select l_orderkey as asset_id, count(*) as n from lineitem group by 1")
def variant_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.variant_counts(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("asset_id")))


# --- caches, collections, books, jobs -------------------------------------------------


@query(f"select id as asset_id, kind as version, case when id <= 20 then 1 else bytes end as bytes, filename = '1-URGENT' or id <= 10 as pinned from {ASSETS} union all select -1, 'new', 5, false")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = _cache(spark, sf).select("asset_id", "version", "bytes", "pinned")
    new = c.where("asset_id <= 20").select("asset_id", "version", F.lit(1).cast("long").alias("bytes"), (F.col("asset_id") <= 10).alias("pinned"))
    one = spark.createDataFrame([(-1, "new", 5, False)], new.schema)
    return lists.cache_put(c, new.unionByName(one))


@query(f"select id as asset_id, case when id = 7 then timestamp '2000-01-01' else taken end as used, filename = '1-URGENT' or id = 3 as pinned from {ASSETS}")
def cache_touch_pin(spark: SparkSession, sf: str) -> DataFrame:
    c = _cache(spark, sf)
    kind = c.where("asset_id = 7").first()["version"]
    return lists.cache_pin(lists.cache_touch(c, 7, kind, NOW.replace(tzinfo=None)), 3).select("asset_id", "used", "pinned")


@query(f"select id as asset_id, 'some' as how from {ASSETS} where kind <> 'F' or filename = '1-URGENT' union all select id, 'all' from {ASSETS} where kind <> 'F' union all select id, 'files' from {ASSETS} where id % 3 = 0")
def cache_evict_verify(spark: SparkSession, sf: str) -> DataFrame:
    c = _cache(spark, sf).withColumn("path", F.concat(F.lit("p"), F.col("asset_id")))
    files = assets(spark, sf).where("id % 3 = 0").select(F.concat(F.lit("p"), F.col("id")).alias("path"))
    parts = {"some": lists.evict(c, version="F"), "all": lists.evict(c, version="F", include_pinned=True), "files": lists.verified(c, files)}
    one, two, three = (d.select("asset_id", F.lit(k).alias("how")) for k, d in parts.items())
    return one.unionByName(two).unionByName(three)


@query(f"select count(*) as files, sum(bytes)::bigint as bytes, 1000000 as left, false as fits from {ASSETS} where kind <> 'P'")
def cache_guard(spark: SparkSession, sf: str) -> DataFrame:
    c = _cache(spark, sf).withColumn("version", F.when(F.col("version") == "P", "original").otherwise("medium"))
    used = c.agg(F.sum("bytes")).first()[0]
    return lists.missing_originals(assets(spark, sf), c, used + 1_000_000).withColumn("left", F.col("left").cast("int"))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with renditions by their numbers: originals of all, medium ones of every second, stills of movies."""
    p = table(spark, sf, "part")
    one = lambda size, kind: F.struct(size.cast("long").alias("bytes"), F.lit(1).alias("width"), F.lit(1).alias("height"), kind.alias("type"), F.lit(None).cast("string").alias("filename"))
    k = F.col("p_partkey")
    e = lambda name, when, size, kind=F.lit("jpeg"): F.when(when, F.struct(F.lit(name).alias("key"), one(size, kind).alias("value")))
    rows = F.array(e("original", k % 11 > 0, k % 13 * 1_000_000, F.when(k % 5 == 0, "raw-image").otherwise("heic")), e("medium", k % 2 == 0, k), e("medium_image", k % 6 == 3, k), e("thumb", k % 7 == 0, k))
    return p.select(k.alias("id"), F.when(k % 3 == 0, "movie").otherwise("image").alias("kind"), F.map_from_entries(F.filter(rows, lambda x: x.isNotNull())).alias("versions"))


@query(
    "select p_partkey as id, case when p_partkey % 3 = 0 then (case when p_partkey % 6 = 3 then 'medium_image' else 'thumb_image' end) when p_partkey % 2 = 0 then 'medium' when p_partkey % 11 > 0 and p_partkey % 13 * 1000000 <= 4194304 then 'original' else 'thumb' end as shown,"
    " case when p_partkey % 7 = 0 then 'thumb' when p_partkey % 2 = 0 then 'medium' when p_partkey % 11 = 0 or (p_partkey % 13 * 1000000 <= 8388608 and p_partkey % 5 <> 0) then 'original' end as read from part"
)
def rendition_choice(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("versions")
    return _versions(spark, sf).select("id", lists.rendition(v, "medium", F.col("kind")).alias("shown"), lists.analysed(v).alias("read"))


@query(f"select id, position from (select id, row_number() over (order by id) as position from {ASSETS} where kind = 'P' and owner < 1000000) where id in (select id from {ASSETS} where bytes > 1000)")
def collection_items(spark: SparkSession, sf: str) -> DataFrame:
    items = assets(spark, sf).where("kind = 'P'").select(F.lit("c").alias("collection"), F.col("id").alias("asset_id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).cast("long").alias("position"))
    other = items.withColumn("collection", F.lit("d"))
    return lists.collection_items(items.unionByName(other), assets(spark, sf).where("bytes > 1000"), "c").select("id", "position")


@query("select p_partkey as id, p_name as prompt from part where p_size < 20 order by p_partkey desc limit 30")
def job_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"), F.when(F.col("p_size") < 20, "queued").otherwise("done").alias("state"))
    return lists.jobs(q, ("queued",), 30).select("id", "prompt")


@query("select p_partkey as id, case when p_partkey = 5 then 'done' when p_size < 20 then 'queued' else 'held' end as state from part union all select max(p_partkey) + 1, 'queued' from part")
def job_add_set(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 20, "queued").otherwise("held").alias("state"))
    return lists.queue(lists.change(q, "id", 5, state="done"), spark.createDataFrame([("x",)], "prompt string").drop("prompt"), state="queued")


@query("select name, created from (select 'NEW' as name, 0::bigint as created union all select n_name, n_nationkey::bigint from nation) where name <> 'FRANCE' and name <> 'CHINA' union all select 'CHINA', 9::bigint from nation where n_name = 'CHINA'")
def collection_create_delete(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("created"))
    items = table(spark, sf, "nation").select(F.col("n_name").alias("collection"), F.col("n_nationkey").alias("asset_id"))
    row = spark.createDataFrame([("NEW", 0), ("GERMANY", 7)], n.schema).where("name = 'NEW'")
    more = lists.create(lists.create(n, row), row)
    left, _ = lists.delete(more, items, "FRANCE", "collection")
    return lists.change(left, "name", "CHINA", created=9)


@query(
    f"with p as (select owner as book, id, row_number() over (partition by owner order by id) as position from {ASSETS}), b as (select min(book) as book from (select book from p group by book having count(*) >= 4)),"
    " q as (select * from p where not (book = (select book from b) and position = 2)) select book, id, row_number() over (partition by book order by position, id) as position from q"
    " union all select b.book, (select max(id) + 1 from p), (select count(*) from p where p.book = b.book) from b"
)
def page_add_remove(spark: SparkSession, sf: str) -> DataFrame:
    pages = assets(spark, sf).select(F.col("owner").alias("book"), "id").withColumn("position", F.row_number().over(Window.partitionBy("book").orderBy("id")).cast("long"))
    one = pages.groupBy("book").count().where("count >= 4").agg(F.min("book")).first()[0]
    more = lists.add_page(pages, spark.createDataFrame([(one,)], "book long"))
    return lists.remove_page(more, one, 2).select("book", "id", "position")


# --- faces ----------------------------------------------------------------------------


@query(f"select f.id, asset_id, similarity, o_orderdate as taken from {_FACES} f join orders on o_orderkey = asset_id where person_id is null and det >= 20000 order by similarity desc nulls last, f.id limit 100")
def unassigned_faces(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken"), F.col("o_orderpriority").alias("filename"))
    return faces.unassigned(_faces(spark, sf), a, 20_000, 100).select("id", "asset_id", "similarity", "taken")


@query(f"select f.id, person_id, s_name as person_name from {_FACES} f left join supplier on s_suppkey = person_id where asset_id = (select min(l_orderkey) from lineitem where l_returnflag = 'R')")
def faces_of_asset(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "lineitem").where("l_returnflag = 'R'").agg(F.min("l_orderkey")).first()[0]
    people = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return faces.faces_of(_faces(spark, sf), people, one).select("id", "person_id", "person_name")


@query("select c_custkey as id, c_custkey % 7 as person_id, first as embedding_of, det from (select c_custkey from customer where c_custkey % 5 > 0 and c_custkey % 7 in (1, 2, 3)) join (select l_suppkey * 10 + l_linenumber as crop, min(l_orderkey) filter (l_extendedprice = top) as first, max(top) as det from (select *, max(l_extendedprice) over (partition by l_suppkey, l_linenumber) as top from lineitem) group by 1) on crop = c_custkey where c_custkey % 11 > 0")
def seeds_of_crops(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    crops = table(spark, sf, "customer").select(k.alias("id"), (k % 7).alias("person_id"), (k % 5 == 0).alias("deleted"))
    people = spark.createDataFrame([(1, "a", None, False), (2, None, "b", False), (3, "c", "d", False), (4, None, None, False), (5, "e", None, True)], "id long, name string, display_name string, deleted boolean")
    line = table(spark, sf, "lineitem")
    found = line.select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("crop_id"), F.col("l_orderkey").alias("face_no"), F.col("l_orderkey").alias("embedding"), F.col("l_extendedprice").alias("det"))
    seeds = crops.where("id % 11 = 0").select("id")
    return faces.seed_people(crops, people, found, seeds).select("id", "person_id", F.col("embedding").alias("embedding_of"), "det")


@query(f"select id, asset_id, person_id from {_FACES} where asset_id % 5 > 0 or person_id % 2 = 0 union all select -asset_id, asset_id, null from (select distinct asset_id from {_FACES} where asset_id % 5 = 0)")
def faces_replaced(spark: SparkSession, sf: str) -> DataFrame:
    f = _faces(spark, sf).select("id", "asset_id", "person_id", F.when(F.col("person_id") % 2 == 0, "user").when(F.col("person_id").isNotNull(), "auto").alias("assigned"))
    new = f.where("asset_id % 5 = 0").select((-F.col("asset_id")).alias("id"), "asset_id").distinct()
    return faces.put_faces(f, new).select("id", "asset_id", "person_id")


@query(f"select id, case when id = (select min(id) from {_FACES}) then 99 else person_id end as person_id from {_FACES} union all select -1, 99")
def face_assigned(spark: SparkSession, sf: str) -> DataFrame:
    f = _faces(spark, sf).select("id", "person_id", F.lit(None).cast("string").alias("assigned"), F.array(F.lit(1.0)).alias("embedding"), "det")
    one = f.agg(F.min("id")).first()[0]
    none = spark.createDataFrame([], "id string, person_id int, embedding array<double>, det double, origin string")
    out, seeds = faces.assign(f, none, one, 99)
    return out.select("id", "person_id").unionByName(seeds.where(F.col("id") == f"face:{one}").select(F.lit(-1).alias("id"), "person_id"))


@query("select c_custkey as id, c_name as name from customer where c_custkey in (3, 9)")
def person_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("display_name"), (F.col("c_custkey") == 5).alias("deleted"))
    hits = faces.find_person(c, "3").unionByName(faces.find_person(c, "CUSTOMER#000000009")).unionByName(faces.find_person(c, "Customer#000000005"))
    return hits.select(F.col("id").cast("long").alias("id"), "name")


@query("select (select count(*) from part) as faces, (select count(*) from lineitem) as links, (select count(distinct p_size) from part where p_size > 10) as clusters, (select count(*) from part where p_size > 10) as grouped, (select count(*) from part where p_size <= 10) as loose, 0.62::double as threshold")
def group_statistics(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return faces.build_statistics(p, p.where("p_size > 10").select(F.col("p_size").alias("cluster")), table(spark, sf, "lineitem"), 0.62).withColumn("threshold", F.col("threshold").cast("double"))


@query("select vec_id as id, label::bigint as label from embeddings where vec_id >= 10 union all select vec_id, 100 from embeddings where vec_id < 10 union all select vec_id, -1 from embeddings where vec_id = 3")
def vectors_put(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf).select("id", "embedding", F.col("person").cast("long").alias("label"))
    new = v.where("id < 10").withColumn("label", F.lit(100).cast("long"))
    after = vectors.put(v, new, "id")
    return after.select("id", "label").unionByName(vectors.of(after, 3, "id").select("id", F.lit(-1).cast("long").alias("label")))


# --- syncing --------------------------------------------------------------------------


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Masters and assets, people, crops and memberships with payloads; orders of status P, customers in debt and a third of the memberships end as tombstones."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    v = lambda x: F.struct(x.alias("value"))
    payload = lambda **f: F.to_json(F.struct(F.struct(*(v(x).alias(k) for k, x in f.items())).alias("fields")))
    b64 = lambda x: F.base64(F.encode(x, "UTF-8"))
    row = lambda d, name, kind, ref, json, seq, deleted=F.lit(False): d.select(
        name.alias("name"), F.lit(kind).alias("type"), deleted.alias("deleted"), F.lit(None).cast("timestamp").alias("modified"), ref.alias("master_ref"), json.alias("json"), F.lit(OWN).alias("zone"), seq.cast("long").alias("seq"),
    )
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    name = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    size = F.struct(F.floor("o_totalprice").cast("long").alias("size"))
    master = payload(filenameEnc=b64(F.concat(F.lit("IMG_"), key.cast("string"))), itemType=F.when(F.col("o_orderstatus") == "F", "quicktime-movie").otherwise("public.jpeg"), resOriginalRes=size, resOriginalWidth=F.lit(40), resOriginalHeight=F.lit(30))
    asset = payload(isFavorite=(key % 3 == 0).cast("int"), isHidden=(key % 4 == 0).cast("int"), assetDate=F.unix_millis(F.col("o_orderdate").cast("timestamp")), captionEnc=b64("o_orderpriority"))
    rel = payload(containerId=F.col("o_custkey").cast("string"), itemId=name("A", key))
    person = payload(personFullNameEnc=b64("c_name"), verifiedType=(F.col("c_custkey") % 2).cast("int"), personType=F.lit(1))
    crop = payload(personRef=F.struct(name("P", F.col("o_custkey")).alias("recordName")), type=F.lit(5), resFaceCropFileSize=F.floor("o_totalprice").cast("long"))
    parts = [
        row(o, name("A", key), ingest.ASSET, name("M", key), asset, key * 10), row(o, name("M", key), ingest.MASTER, none, master, key * 10 + 1), row(o, name("R", key), ingest.RELATION, none, rel, key * 10 + 2), row(o, name("F", key), ingest.CROP, none, crop, key * 10 + 3),
        row(c, name("P", F.col("c_custkey")), ingest.PERSON, none, person, F.col("c_custkey")), row(o, name("X", key), "OtherRecord", none, none, key * 10 + 4),
        row(o.where("o_orderstatus = 'P'"), name("A", key), None, none, none, key * 10 + 5, F.lit(True)), row(o.where("o_orderkey % 3 = 0"), name("R", key), None, none, none, key * 10 + 6, F.lit(True)), row(c.where("c_acctbal < 0"), name("P", F.col("c_custkey")), None, none, none, F.col("c_custkey") + 10**12, F.lit(True)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SYNCED = "select 'A' || o_orderkey as id, 'M' || o_orderkey as master_id, 'IMG_' || o_orderkey as filename, case when o_orderstatus = 'F' then 'movie' else 'image' end as kind, o_orderdate as taken, floor(o_totalprice)::bigint as bytes, o_orderkey % 3 = 0 as favorite, o_orderkey % 4 = 0 as hidden, o_orderpriority as caption, 40 as width"


@query(f"{_SYNCED} from orders where o_orderstatus <> 'P'")
def assets_derived(spark: SparkSession, sf: str) -> DataFrame:
    d = ingest.derived_assets(ingest.pair(ingest.fold_records(_log(spark, sf))))
    return d.select("id", "master_id", "filename", "kind", F.col("taken").cast("timestamp_ntz").alias("taken"), "bytes", "favorite", "hidden", "caption", "width")


@query("select 'A' || o_orderkey as id, case when o_orderkey % 2 = 0 then true else o_orderkey % 3 = 0 end and not (o_orderstatus <> 'P' and o_orderkey % 3 > 0) as favorite, o_orderkey % 2 = 0 as old, o_orderstatus = 'P' as missing from orders where o_orderkey % 2 = 0 or o_orderstatus <> 'P'")
def sync_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Old rows of even orders, all favourites, meet the log: live ones change, ended ones are marked."""
    folded = ingest.fold_records(_log(spark, sf))
    new = ingest.derived_assets(ingest.pair(folded))
    early = F.lit(NOW - dt.timedelta(days=1)).cast("timestamp")
    o = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("id"))
    data = {f.name: F.lit(None).cast(f.dataType) for f in new.schema.fields if f.name not in ("id", "deleted")}
    old = o.withColumns(data | {"favorite": F.lit(True), "fingerprint": F.lit("old"), "first_seen": early, "last_seen": early, "missing_since": F.lit(None).cast("timestamp")})
    out = ingest.sync_assets(old, folded, NOW)
    return out.select("id", "favorite", (F.col("first_seen") < F.lit(NOW)).alias("old"), F.col("missing_since").isNotNull().alias("missing"))


@query("select 'P' || c_custkey as id, c_name as name, c_custkey % 2 = 1 as verified, 1 as kind, c_acctbal < 0 as deleted from customer")
def people_synced(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.people_of(ingest.fold_records(_log(spark, sf))).select("id", "name", "verified", "kind", "deleted")


@query("select 'F' || o_orderkey as id, 'P' || o_custkey as person_id, 5 as kind, floor(o_totalprice)::bigint as bytes from orders")
def crops_synced(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.crops_of(ingest.fold_records(_log(spark, sf))).select("id", "person_id", "kind", "bytes")


@query("select o_custkey::varchar as album_id, 'A' || o_orderkey as asset_id from orders where o_orderkey % 3 > 0")
def relations_synced(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.relations(ingest.fold_records(_log(spark, sf)))


@query("with n as (select (select count(*) from orders) o, (select count(*) from customer) c, (select count(*) from customer where c_acctbal < 0) d, (select count(*) from orders where o_orderstatus = 'P') p, (select count(*) from orders where o_orderkey % 3 = 0) t) select 5 * o + c + d + p + t as records, d + p + t as tombstones, o as relations, c as people, o as face_crops, 1::bigint as zones from n")
def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.run_statistics(_log(spark, sf))


@query("select c_nationkey::varchar as album_id, o_orderkey as asset_id from orders join customer on o_custkey = c_custkey where c_nationkey <> 3 union select '3', o_orderkey from orders where o_orderkey <= 10")
def album_members_replaced(spark: SparkSession, sf: str) -> DataFrame:
    rel = _albums(spark, sf)
    albums = rel["albums"].withColumn("synced", F.lit(None).cast("timestamp"))
    ids = table(spark, sf, "orders").where("o_orderkey <= 10").select(F.col("o_orderkey").alias("asset_id"))
    members, albums = ingest.replace_members(rel["album_assets"], albums, "3", ids, NOW)
    return members.join(albums.where("synced is not null or id <> '3'").select("id"), F.col("album_id") == F.col("id"), "left_semi").distinct()


# --- pages and export -----------------------------------------------------------------


@query(f"select page, id, x::bigint as x, w::bigint as w, 4000 as page_w, 2667 as page_h, 40::bigint as px from (select *, round_even(i * ((4000.0::double - 8 * (n - 1)) / n + 8), 0) as x, round_even((4000.0::double - 8 * (n - 1)) / n, 0) as w from (select *, count(*) over (partition by page) n, row_number() over (partition by page order by id) - 1 as i from {_PHOTOS}))")
def page_plan(spark: SparkSession, sf: str) -> DataFrame:
    p = _photos(spark, sf).withColumnsRenamed({"pw": "width", "ph": "height"})
    plan = layout.plan(p, "filmstrip", "page", "id")
    return plan.select("page", "id", "x", "w", "page_w", "page_h", layout.source_px(F.lit(40), F.col("crop.w"), F.col("crop.w")).alias("px"))


_SUFFIXES = ["3fr", "ARW", "cr2", "cr3", "crw", "dcr", "dng", "erf", "iiq", "kdc", "mdc", "mef", "mos", "mrw", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "rwl", "sr2", "srf", "Srw", "jpeg", "JPE", "jfif", "tif", "heic", "ptx", "fff", "x3f", ""]


@query(
    "select s as suffix, case when k >= 25 then 1 else 3 end as as_image, 2 as as_other, case upper(s) when 'JPEG' then 'JPG' when 'JPE' then 'JPG' when 'JFIF' then 'JPG' when 'TIF' then 'TIFF' else nullif(upper(s), '') end as label"
    f" from (values {', '.join(f'({k}, {chr(39)}{s}{chr(39)})' for k, s in enumerate(_SUFFIXES))}) t(k, s)"
)
def export_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(s, "image", None) for s in _SUFFIXES], "suffix string, kind string, other string")
    return d.select("suffix", export.file_type(F.col("kind"), F.col("suffix")).cast("int").alias("as_image"), export.file_type(F.col("other"), F.col("suffix")).cast("int").alias("as_other"), export.format_label(F.col("suffix")).alias("label"))


@query("select folder, count(*) as files, row_number() over (order by folder) as folder_id from (select strftime(o_orderdate, '%Y/%m') as folder from orders) group by folder")
def export_folders(spark: SparkSession, sf: str) -> DataFrame:
    return export.folders(table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy/MM").alias("folder")))


@query("select o_orderkey as id, case when exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then 1 when exists (select 1 from customer where c_custkey = o_orderkey) then 2 else 0 end as has_faces from orders")
def export_has_faces(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("asset_id"))
    return export.has_faces(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf, "customer").select(F.col("c_custkey").alias("asset_id")), f)


@query("select l_orderkey * 10 + l_linenumber as id, l_orderkey as asset_id, round_even(l_quantity * 1.5, 0)::int as right, s_name as person from lineitem join orders on o_orderkey = l_orderkey left join supplier on s_suppkey = l_suppkey and s_suppkey % 2 = 0 where o_orderstatus = 'F'")
def export_face_rows(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    f = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("asset_id"), F.array(F.lit(0), F.lit(0), q, q).alias("box"), F.col("l_suppkey").alias("person_id"))
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("display_name"))
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return export.face_rows(f, p, done, done.withColumn("ratio", F.lit(1.5))).select("id", "asset_id", F.col("box")[2].alias("right"), "person")


@query(f"select l_partkey as collection, l_orderkey as asset_id, 1000 + row_number() over (partition by l_partkey order by position) - 1 as added_at from (select distinct l_partkey, l_orderkey, l_orderkey as position from lineitem) where l_orderkey in (select id from {ASSETS} where kind <> 'P')")
def export_collections(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("collection"), F.col("l_orderkey").alias("asset_id"), F.col("l_orderkey").alias("position")).distinct()
    return export.collection_rows(items, assets(spark, sf).where("kind <> 'P'").select("id"), 1000).select("collection", "asset_id", "added_at")


@query(f"select row_number() over (order by person) as person_id, person from (select distinct s_name as person from supplier where s_suppkey % 2 = 0 and s_suppkey in (select person_id from {_FACES} where asset_id % 4 = 1))")
def export_persons(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("display_name"))
    return export.persons(p, _faces(spark, sf), assets(spark, sf).where("id % 4 = 1").select("id"))


@query(f"select id, case when id % 2 = 0 then 't' || id end as path, id % 2 = 1 as error from {ASSETS} where id % 2 = 0 or (id % 3 = 0 and kind = 'F')")
def export_thumbs(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf)
    thumb = a.where("id % 2 = 0").select(F.col("id").alias("asset_id"), F.lit("thumb").alias("version"), F.concat(F.lit("t"), F.col("id")).alias("path"))
    held = a.where("id % 3 > 0").select(F.col("id").alias("asset_id"), F.lit("medium").alias("version"), F.lit("m").alias("path"))
    kinds = a.select("id", F.when(F.col("kind") == "F", "movie").otherwise("image").alias("kind"))
    return export.thumbs(a.select("id", F.lit("medium").alias("version")), thumb.unionByName(held), kinds)


@query("select o_orderkey as id, 'kept' as how from orders where o_orderkey % 2 = 0 union all select o_orderkey, 'stale' from orders where o_orderkey % 2 = 1 union all select l_orderkey * 10 + l_linenumber, 'face' from lineitem where l_orderkey % 2 = 0")
def export_stale(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy/MM").alias("folder"), F.col("o_orderkey").cast("string").alias("name"))
    kept, stale = export.merged(old, old.where("id % 2 = 0"))
    live = export.without_orphans(_faces(spark, sf), kept)
    parts = [d.select("id", F.lit(how).alias("how")) for d, how in ((kept, "kept"), (stale, "stale"), (live, "face"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
