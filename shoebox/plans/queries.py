"""The engine's operators on the driver's tables, each with SQL that says the same.

Orders stand for assets (date, status as kind, priority as file name, price as bytes),
embeddings for vectors and faces (label as person), events for a change feed (user as
key, `error` as tombstone), parts for picture sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import faces as faces_
from ..operators import ingest, layout, lists, preflight, ranks, search, selection, summaries, vectors
from ..sources import export

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def assets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("filename"), F.col("o_orderpriority").alias("caption"),
        F.floor("o_totalprice").cast("long").alias("bytes"), F.col("o_custkey").alias("owner"),
    )


#: The same for the oracles.
ASSETS = "(select o_orderkey id, o_orderdate taken, o_orderstatus kind, o_orderpriority filename, floor(o_totalprice)::bigint bytes, o_custkey owner from orders)"


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("person"))


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    return vecs(spark, sf).where("id = 0").select("embedding").first()[0]


# --- search and paging ---------------------------------------------------------------

_PAGE_WHERE = "taken >= timestamp '1996-01-01' and taken < timestamp '1997-01-01' and kind = 'O' and owner in (select c_custkey from customer join nation on c_nationkey = n_nationkey where n_name in ('FRANCE', 'GERMANY', 'CHINA') or n_nationkey in (6, 7))"


def _album_page(spark: SparkSession, sf: str) -> DataFrame:
    f = search.Filters(since=S.parse_date("1996").replace(tzinfo=None), until=S.parse_date("1996", end=True).replace(tzinfo=None), kind="O")
    members = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("n_name").isin("FRANCE", "GERMANY", "CHINA") | F.col("n_nationkey").isin(6, 7))
    return search.membership(search.apply_filters(assets(spark, sf), f), members, "c_custkey", "owner")


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _newest() -> tuple:
    return F.desc_nulls_last("taken"), F.desc("id")


@query(f"select id, taken, bytes, row_number() over (order by taken desc nulls last, id desc) rn from {ASSETS} where {_PAGE_WHERE} order by taken desc nulls last, id desc limit 50")
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(search.newest(_album_page(spark, sf), 50), *_newest()).select("id", "taken", "bytes", "rn")


@query(
    f"with a as (select * from {ASSETS} where kind = 'O'), c as (select taken, id from a order by taken desc nulls last, id desc limit 1 offset 29)"
    " select a.id, a.taken, row_number() over (order by a.taken desc nulls last, a.id desc) rn from a, c where a.taken < c.taken or (a.taken = c.taken and a.id < c.id) or a.taken is null order by a.taken desc nulls last, a.id desc limit 30"
)
def search_next_page(spark: SparkSession, sf: str) -> DataFrame:
    a = search.apply_filters(assets(spark, sf), search.Filters(kind="O"))
    _, cursor = search.page(a.select("id", "taken"), 30)
    return _ranked(search.newest(a, 30, cursor), *_newest()).select("id", "taken", "rn")


@query("select doc_id, n_chars from documents where translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%license%' or translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%license%'")
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumnsRenamed({"text": "caption", "source": "filename"})
    return search.apply_filters(d, search.Filters(text="LICENSE")).select("doc_id", "n_chars")


@query(f"select date_trunc('month', taken)::timestamp as period, count(*) n, sum(bytes)::bigint bytes from {ASSETS} where taken >= timestamp '1995-03-01' and taken < timestamp '1996-03-01' group by 1")
def search_date_window(spark: SparkSession, sf: str) -> DataFrame:
    f = search.Filters(since=S.parse_date("1995-03").replace(tzinfo=None), until=S.parse_date("1996-02", end=True).replace(tzinfo=None))
    return search.apply_filters(assets(spark, sf), f).groupBy(F.date_trunc("month", "taken").cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


_TRI = "documents d left join labels l on d.doc_id = l.doc_id"


@query(f"select d.doc_id, 'marked' as state from {_TRI} where toxic = 1 union all select d.doc_id, 'plain' from {_TRI} where toxic = 0 and quality = 1 union all select d.doc_id, 'unknown' from {_TRI} where toxic is null union all select d.doc_id, 'known' from {_TRI} where toxic is not null")
def search_tri_state(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    d = d.select("doc_id", (F.col("toxic") == 1).alias("favorite"), (F.col("quality") == 1).alias("live"), F.col("toxic").cast("double").alias("latitude"))
    asked = {"marked": search.Filters(favorite=True), "plain": search.Filters(favorite=False, live=True), "unknown": search.Filters(located=False), "known": search.Filters(located=True)}
    parts = [search.apply_filters(d, f).select("doc_id", F.lit(name).alias("state")) for name, f in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _albums(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Nations as albums of the orders of their customers, in folders by region."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    albums = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.concat("r_name", F.lit("/"), "n_name").alias("fullname"))
    members = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("album_id"), F.col("o_orderkey").alias("asset_id"))
    return {"albums": albums, "album_assets": members}


@query(f"select id, bytes, 'name' as how from {ASSETS} where owner in (select c_custkey from customer join nation on c_nationkey = n_nationkey where n_name = 'FRANCE') union all select id, bytes, 'folder' from {ASSETS} where owner in (select c_custkey from customer join nation on c_nationkey = n_nationkey where n_name = 'CHINA') union all select id, bytes, 'id' from {ASSETS} where owner in (select c_custkey from customer where c_nationkey = 3)")
def search_album(spark: SparkSession, sf: str) -> DataFrame:
    a, rel = assets(spark, sf), _albums(spark, sf)
    asked = (("name", "FRANCE"), ("folder", "ASIA/CHINA"), ("id", "3"))
    one, two, three = (search.apply_filters(a, search.Filters(album=v), rel).select("id", "bytes", F.lit(how).alias("how")) for how, v in asked)
    return one.unionByName(two).unionByName(three)


@query(f"select id, kind from {ASSETS} where id in (select l_orderkey from lineitem where l_suppkey in (1, 3, 5))")
def search_people_any(spark: SparkSession, sf: str) -> DataFrame:
    rel = {"faces": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_suppkey").alias("person_id"))}
    return search.apply_filters(assets(spark, sf), search.Filters(people=(1, 3, 5)), rel).select("id", "kind")


@query(f"select count(*) n from {ASSETS} where false")
def search_ids_empty(spark: SparkSession, sf: str) -> DataFrame:
    return search.apply_filters(assets(spark, sf), search.Filters(ids=())).agg(F.count("*").alias("n"))


_NAMED = "(select p_partkey, case when p_partkey % 3 = 0 then p_name || '.png' when p_partkey % 3 = 1 then p_name || '.jpg' end as filename from part)"


@query(f"select p_partkey, false as shot from {_NAMED} where upper(filename) not like '%.PNG' union all select p_partkey, true from {_NAMED} where upper(filename) like '%.PNG'")
def not_suffix_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    d = table(spark, sf, "part").select("p_partkey", F.when(k == 0, F.concat("p_name", F.lit(".png"))).when(k == 1, F.concat("p_name", F.lit(".jpg"))).alias("filename"))
    one, two = (search.apply_filters(d, search.Filters(screenshots=want)).select("p_partkey", F.lit(want).alias("shot")) for want in (False, True))
    return one.unionByName(two)


@query(f"select id, taken, row_number() over (order by taken asc nulls last, id) rn from {ASSETS} where kind = 'P'")
def dates_ascending(spark: SparkSession, sf: str) -> DataFrame:
    d = search.dates(search.apply_filters(assets(spark, sf), search.Filters(kind="P")))
    return ranks.numbered(d, "rn", F.asc_nulls_last("taken"), F.asc("id"))


@query("select k.i as place, o_orderkey as id, o_totalprice as total from orders join (values (1, 7), (2, 1), (3, 4)) k(i, x) on o_orderkey = k.x")
def many_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    return search.lookup(rows, [7, 1, 4]).select(F.when(F.col("id") == 7, 1).when(F.col("id") == 1, 2).otherwise(3).alias("place"), "id", "total")


@query("select c_name as id, c_custkey from customer where c_name in ('Customer#000000007', 'Customer#000000009')")
def sanitised_lookup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_name").alias("id"), "c_custkey")
    return search.by_entry(c, "Customer_000000007").unionByName(search.by_entry(c, "Customer#000000009"))


@query("select d.doc_id as id, d.lang from documents d left join embeddings e on d.doc_id = e.vec_id where d.lang <> 'fr' and d.doc_id % 7 <> 0 and (e.label is distinct from 3 or e.vec_id % 2 = 0)")
def unindexed(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.when(F.col("doc_id") % 7 == 0, F.lit("gone"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.when(F.col("lang") == "fr", "movie").otherwise("image").alias("kind"), gone.alias("missing_since"))
    state = table(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("label").cast("string").alias("clip_model"), F.when(F.col("vec_id") % 2 == 1, "f").alias("face_model"))
    return search.unindexed(d, state, "3", "f").select("id", "lang")


@query("select lang, count(*) n from documents d where lang <> 'fr' and doc_id % 7 <> 0 and doc_id % 5 <> 0 and not exists (select 1 from embeddings e where e.vec_id = d.doc_id) group by lang")
def refresh_todo(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.when(F.col("doc_id") % 7 == 0, F.lit("gone"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.when(F.col("lang") == "fr", "movie").otherwise("image").alias("kind"), gone.alias("missing_since"), (F.col("doc_id") % 5 == 0).alias("hidden"))
    state = table(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"))
    return search.never_indexed(d, state).groupBy("lang").agg(F.count("*").alias("n"))


# --- joins and aggregations ----------------------------------------------------------


@query(f"select count(*) assets, count(*) filter (kind = 'O') open, count(*) filter (kind = 'F') done, count(distinct owner) owners, coalesce(sum(bytes), 0)::bigint bytes from {ASSETS}")
def count_assets(spark: SparkSession, sf: str) -> DataFrame:
    return assets(spark, sf).agg(F.count("*").alias("assets"), F.count_if(F.col("kind") == "O").alias("open"), F.count_if(F.col("kind") == "F").alias("done"), F.countDistinct("owner").alias("owners"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


@query("select n_nationkey::bigint as n_nationkey, n_name, count(c_custkey) filter (c_acctbal > 9000) as n from nation left join customer on c_nationkey = n_nationkey group by 1, 2")
def album_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return summaries.counted(n, table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("n_nationkey")), "n_nationkey")


@query("select c_custkey id, c_name as name, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus <> 'P') crops, (select count(distinct l_orderkey) from orders join lineitem on l_orderkey = o_orderkey where o_custkey = c_custkey) photos from customer")
def people_listing(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(False).alias("deleted"))
    o = table(spark, sf, "orders")
    crops = o.select(F.col("o_custkey").alias("person_id"), (F.col("o_orderstatus") == "P").alias("deleted"))
    photos = o.join(table(spark, sf, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("asset_id"))
    return summaries.people(people, crops, photos).select("id", "name", "crops", "photos")


@query(f"select kind as version, count(*) files, sum(bytes)::bigint bytes, sum(case when filename = '1-URGENT' then bytes else 0 end)::bigint pinned_bytes from {ASSETS} group by kind")
def usage_by_version(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.usage_by_version(_cache(spark, sf))


_FACES = "(select l_orderkey * 10 + l_linenumber as id, l_orderkey as asset_id, l_partkey as cluster, case when l_returnflag <> 'N' then l_suppkey end as person_id, l_extendedprice as det, case when l_linenumber % 2 = 0 then round(l_discount * 10, 1) end as similarity from lineitem)"


def _faces(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as faces: the order is the picture, the part the group, the supplier the person."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("asset_id"), F.col("l_partkey").alias("cluster"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("person_id"), F.col("l_extendedprice").alias("det"),
        F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("l_discount") * 10, 1)).alias("similarity"),
    )


@query(
    f"with f as (select f.*, o_orderdate as taken from {_FACES} f join orders on o_orderkey = asset_id), g as (select cluster, count(*) as size, count(person_id) as named, min(taken) as first, max(taken) as last from f group by cluster having count(*) >= 5),"
    " p as (select cluster, person_id from (select cluster, person_id, row_number() over (partition by cluster order by count(*) desc, person_id) r from f where person_id is not null group by 1, 2) where r = 1),"
    " s as (select cluster, string_agg(id::varchar, ',' order by det desc, id) as sample from (select *, row_number() over (partition by cluster order by det desc, id) r from f) where r <= 3 group by cluster)"
    " select g.cluster, size, named, first, last, person_id, sample from g left join p using (cluster) left join s using (cluster) where person_id is not null order by size desc, cluster limit 100"
)
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken"))
    return faces_.groups(_faces(spark, sf), a, 100, named=True, min_size=5, sample=3).withColumn("sample", F.array_join(F.col("sample").cast("array<string>"), ","))


@query("select grp, person, n from (select c_nationkey::bigint as grp, o_orderpriority as person, count(*) n, row_number() over (partition by c_nationkey order by count(*) desc, o_orderpriority) rn from orders join customer on o_custkey = c_custkey group by 1, 2, c_nationkey) where rn = 1")
def group_majority(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return summaries.most_frequent(d.select(F.col("c_nationkey").cast("long").alias("grp"), F.col("o_orderpriority").alias("person")), "grp", "person")


@query("select grp, id, rn from (select o_custkey as grp, o_orderkey as id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn <= 8")
def group_samples(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return summaries.top_per_group(d, "grp", 8, F.desc("o_totalprice"), "id").select("grp", "id", "rn")


@query(
    "select o_orderkey as id, (select string_agg(l_linenumber || ':' || l_quantity::bigint || ':' || (l_returnflag = 'R'), ' ' order by l_linenumber, l_quantity::bigint, l_returnflag = 'R') from lineitem where l_orderkey = o_orderkey) as cached, n_nationkey || '=' || n_name as albums, case when o_orderstatus = 'P' then o_orderpriority || ':' || o_orderkey end as collections,"
    " (select count(*) from lineitem where l_orderkey = o_orderkey and l_returnflag <> 'N') as named_faces from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey"
)
def info_nested(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    cache = line.select(F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("version"), F.col("l_quantity").cast("long").alias("bytes"), (F.col("l_returnflag") == "R").alias("pinned"))
    items = assets(spark, sf).where("kind = 'P'").select(F.col("filename").alias("collection"), F.col("id").alias("asset_id"), F.col("id").alias("position"))
    rel = _albums(spark, sf) | {"cache": cache, "collection_assets": items, "faces": _faces(spark, sf)}
    d = search.info(assets(spark, sf).select("id"), rel)
    joined = lambda name, form, by: F.when(F.size(name) > 0, F.array_join(F.transform(name, form), by))
    text = lambda *c: F.concat_ws(":", *(x.cast("string") for x in c))
    return d.select(
        "id", joined("cached", lambda x: text(x.version, x.bytes, x.pinned), " ").alias("cached"), joined("albums", lambda x: F.concat_ws("=", x.album_id, x["name"]), " ").alias("albums"),
        joined("collections", lambda x: text(x.collection, x.position), " ").alias("collections"), F.size(F.filter("faces", lambda x: x.person_id.isNotNull())).cast("long").alias("named_faces"),
    )


@query("select event_type, sum((json_extract_string(props, '$.k'))::bigint)::bigint as k, count(*) n from events group by event_type")
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))


@query("select c_custkey, c_name as decoded, upper(c_mktsegment) as segment from customer")
def nested_decode(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("enc", F.base64(F.encode("c_name", "UTF-8")))
    return c.select("c_custkey", S.decoded_text(F.col("enc")).alias("decoded"), F.upper("c_mktsegment").alias("segment"))


# --- change feed -------------------------------------------------------------------------


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """A field is null where a record doesn't carry it: value on clicks alone, props on every third record."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"), F.when(F.col("event_type") == "click", F.col("value")).alias("value"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("props"),
    )


FEED = "(select user_id as key, event_id as seq, event_type = 'error' as deleted, case when event_type = 'click' then value end as value, case when event_id % 3 = 0 then props end as props from events)"
_FOLD_SQL = f"select key, max_by(deleted, seq) deleted, max_by(value, seq) filter (value is not null) as value, max_by(props, seq) filter (props is not null) as props, max(seq) seq from {FEED} group by key"


@query(_FOLD_SQL)
def fold_records(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.fold(feed(spark, sf), "key", ["value", "props"], ["deleted"]).select("key", "deleted", "value", "props", "seq")


@query(_FOLD_SQL)
def batch_split_invariance(spark: SparkSession, sf: str) -> DataFrame:
    f = feed(spark, sf)
    old = ingest.fold(f.where("seq % 2 = 0"), "key", ["value", "props"], ["deleted"])
    new = f.where("seq % 2 = 1").withColumns({"value_seq": F.col("seq"), "props_seq": F.col("seq")})
    return ingest.fold(old.unionByName(new), "key", ["value", "props"], ["deleted"]).select("key", "deleted", "value", "props", "seq")


@query(
    f"with f as {FEED}, l as (select key, max(seq) filter (not deleted) live from f group by key)"
    " select l.key, count(f.seq) > 0 as deleted, min(f.seq) as missing_since from l left join f on f.key = l.key and f.deleted and (l.live is null or f.seq > l.live) group by l.key"
)
def tombstones(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.missing_since(feed(spark, sf), "key")


_HALF = "(select max(event_id) // 2 from events)"


@query(
    f"with o as (select key, max_by(value, seq) filter (value is not null) v from {FEED} where seq < {_HALF} group by key having count(*) filter (value is not null) > 0), n as (select key, max_by(value, seq) filter (value is not null) v from {FEED} where seq >= {_HALF} - 200 group by key having count(*) filter (value is not null) > 0)"
    " select coalesce(o.key, n.key) as key, case when o.key is null then 'new' when n.key is null then 'absent' when o.v = n.v then 'same' else 'changed' end as status from o full join n on o.key = n.key"
)
def upsert_status(spark: SparkSession, sf: str) -> DataFrame:
    f = feed(spark, sf)
    half = F.broadcast(table(spark, sf, "events").agg(F.floor(F.max("event_id") / 2).alias("half")))  # one row
    old = ingest.fold(f.join(half, F.col("seq") < F.col("half")), "key", ["value"]).where("value is not null")
    new = ingest.fold(f.join(half, F.col("seq") >= F.col("half") - 200), "key", ["value"]).where("value is not null")
    return ingest.upsert_status(old, new, "key", ["value"])


@query("select event_type as type, count(*) n from events where event_type <> 'error' group by event_type")
def record_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.record_counts(table(spark, sf, "events").select(F.col("event_type").alias("type"), (F.col("event_type") == "error").alias("deleted")))


@query("select o_orderkey as asset, c_custkey as master, c_name as master_name from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'P' and c_acctbal > 0")
def pair_assets(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("a"), "o_orderkey").alias("name"), F.lit(ingest.ASSET).alias("type"), (F.col("o_orderstatus") == "P").alias("deleted"), F.concat(F.lit("m"), "o_custkey").alias("master_ref"), F.lit(None).cast("string").alias("json"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("m"), "c_custkey").alias("name"), F.lit(ingest.MASTER).alias("type"), (F.col("c_acctbal") <= 0).alias("deleted"), F.lit(None).cast("string").alias("master_ref"), F.col("c_name").alias("json"))
    p = ingest.pair(o.unionByName(c))
    return p.select(F.substring("name", 2, 30).cast("long").alias("asset"), F.substring("master_id", 2, 30).cast("long").alias("master"), F.col("master_json").alias("master_name"))


# --- vectors and faces ----------------------------------------------------------------

_DOT = "round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6)"


@query(f"select id, score, row_number() over (order by score desc, id) rn from (select b.vec_id id, {_DOT} score from embeddings a, embeddings b where a.vec_id = 0) order by score desc, id limit 200")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(vectors.nearest(vecs(spark, sf), first_vector(spark, sf), 200, "id"), F.desc("score"), "id").select("id", "score", "rn")


@query(f"select id, score from (select id, score from (select b.vec_id id, {_DOT} score from embeddings a, embeddings b where a.vec_id = 0) order by score desc, id limit 200) where id in (select doc_id from documents where lang = 'en') order by score desc, id limit 20")
def knn_then_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return vectors.knn_then_filter(vecs(spark, sf), first_vector(spark, sf), 20, rows, "id").select("id", "score")


@query(f"select id, score from (select b.vec_id id, {_DOT} score from embeddings a, embeddings b where a.vec_id = 0) where id in (select doc_id from documents where lang = 'de') order by score desc, id limit 20")
def filter_then_knn(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"))
    return vectors.filter_then_knn(vecs(spark, sf), first_vector(spark, sf), 20, rows, "id").select("id", "score")


@query(f"select id, score from (select b.vec_id id, {_DOT} score from embeddings a, embeddings b where a.vec_id = 17) order by score desc, id limit 10")
def similar_to(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.similar_to(vecs(spark, sf), 17, 10, "id").select("id", "score")


_EDGES = f"(select a.vec_id a, b.vec_id b, {_DOT} score from embeddings a join embeddings b on a.vec_id < b.vec_id where {_DOT} >= 0.4)"


@query(f"select * from {_EDGES}")
def sim_edges(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.sim_edges(vecs(spark, sf), 0.4, "id")


_CAPPED = f"(select * from (select *, row_number() over (partition by source order by score desc, target) rn from (select a source, b target, score from {_EDGES} union all select b, a, score from {_EDGES})) where rn <= 2)"


@query(f"select * from {_CAPPED}")
def capped_edges(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.capped(vectors.sim_edges(vecs(spark, sf), 0.4, "id"), 2)


@query(
    f"with recursive e as materialized (select source u, target v from (select *, row_number() over (partition by source order by score desc, target) rn from (select a source, b target, score from {_EDGES} union all select b, a, score from {_EDGES})) where rn <= 24),"
    " b as materialized (select u, v from e union select v, u from e), r(x, y) as (select u, u from b union select r.x, b.v from r join b on r.y = b.u),"
    " l as (select x as id, min(y) as label from r group by x), s as (select label, count(*) as size from l group by label having count(*) >= 2),"
    " n as (select label, size, row_number() over (order by size desc, label) as cluster from s) select id, cluster, size from l join n using (label)"
)
def face_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return faces_.build(vecs(spark, sf), threshold=0.4).select("id", "cluster", "size")


_SEEDS = "(select vec_id::varchar sid, embedding, label from (select *, row_number() over (partition by label order by vec_id) r from embeddings) where r <= 3)"


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    top = summaries.top_per_group(vecs(spark, sf), "person", 3, "id")
    return top.select(F.col("id").cast("string").alias("id"), F.col("person").alias("person_id"), "embedding")


_MATCH = f"(select id, case when score >= 0.3 then label end::bigint as person_id, score as similarity from (select b.vec_id id, a.label, {_DOT} score, row_number() over (partition by b.vec_id order by {_DOT} desc, a.sid) r from {_SEEDS} a, embeddings b) where r = 1)"


@query(f"select * from {_MATCH}")
def seed_match(spark: SparkSession, sf: str) -> DataFrame:
    return faces_.match(vecs(spark, sf), _seeds(spark, sf), 0.3)


@query(f"select count(*) as changed from {_MATCH} m join embeddings e on e.vec_id = m.id where e.label <> 3 and m.person_id is distinct from (case when e.label < 6 then e.label end)")
def rematch_changed(spark: SparkSession, sf: str) -> DataFrame:
    f = vecs(spark, sf).select("id", "embedding", F.when(F.col("person") < 6, F.col("person")).alias("person_id"), F.lit(None).cast("double").alias("similarity"), F.when(F.col("person") == 3, "user").when(F.col("person") < 6, "auto").alias("assigned"))
    return faces_.rematch(f, _seeds(spark, sf), 0.3)[1]


@query("select grp, id from (select o_custkey as grp, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate asc nulls last, o_orderkey) - 1 as k, greatest(1, count(*) over (partition by o_custkey) // 12) as step from orders) where k % step = 0 and k // step < 12")
def seed_stride(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return faces_.stride(d, 12, F.asc_nulls_last("o_orderdate"), "id", group="grp").select("grp", "id")


@query("select p_partkey id, greatest(0, floor(a - 0.35 * m))::bigint x, greatest(0, floor(b - 0.35 * m))::bigint y from (select p_partkey, p_size * 10.0::double a, p_size * 7.0::double b, greatest(p_size * 4, 40)::double m from part)")
def face_crop(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    a, b, m = F.col("p_size") * 10.0, F.col("p_size") * 7.0, F.greatest(F.col("p_size") * 4, F.lit(40)).cast("double")
    box = p.select(F.col("p_partkey").alias("id"), F.array(a, b, a + m, b + m / 2).alias("box"))
    c = faces_.crop(F.col("box"), F.lit(4000.0), F.lit(3000.0))
    return box.select("id", c["x"].alias("x"), c["y"].alias("y"))


# --- selection ------------------------------------------------------------------------


@query(
    f"with r as (select id, taken, row_number() over (order by taken asc nulls last, id) as rn, count(*) over () as n from {ASSETS} where kind = 'O'), w as (select i, least((i * (select max(n) from r)) // 240, (select max(n) from r) - 1) + 1 as at from range(240) t(i))"
    " select r.id, min(w.i) + 1 as pool_rn from r join w on r.rn = w.at group by r.id"
)
def pool_strided(spark: SparkSession, sf: str) -> DataFrame:
    return selection.pool_strided(search.apply_filters(assets(spark, sf), search.Filters(kind="O")).select("id", "taken"), 240).select("id", "pool_rn")


@query(
    f"with a as (select id, taken, strftime(taken, '%Y-%m') b from {ASSETS} where kind = 'O'), k as (select *, row_number() over (partition by b order by taken desc, id desc) k from a),"
    " o as (select b, row_number() over (order by taken desc, id desc) o from k where k = 1), t as (select id, k, o from k join o using (b) order by k, o limit 270) select id, row_number() over (order by k, o) as pool_rn from t"
)
def pool_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return selection.pool_round_robin(search.apply_filters(assets(spark, sf), search.Filters(kind="O")).select("id", "taken"), 270, "month").select("id", "pool_rn")


@query("select d.doc_id, round(0.45 * (1 / (1 + exp(-(log10(greatest(n_chars, 1)) - 2.08) * 3.2))) + 0.55 * (case when l.quality = 1 then 1.0 else 0.0 end), 9) as q from documents d left join labels l on d.doc_id = l.doc_id")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.round(S.quality(F.col("n_chars").cast("double"), F.col("quality") == 1), 9).alias("q"))


@query("select event_id as id, sum(case when gap is null or gap > 90 * 1000000 then 1 else 0 end) over (partition by user_id order by ts, event_id)::bigint as session from (select *, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as gap from events)")
def session_ids(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", "user_id")
    return selection.sessions(e, "ts", by="user_id").select("id", "session")


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with the time of the event of their number, in pool order."""
    t = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("taken"), (F.col("event_type") == "click").alias("favorite"), F.col("value").alias("sharpness"))
    d = vecs(spark, sf).join(t, "id").withColumn("embedding", F.col("embedding").cast("array<double>"))
    d = d.withColumn("q", S.quality(F.col("sharpness"), F.col("favorite")))
    return ranks.numbered(d, "pool_rn", F.desc("taken"), F.desc("id"))


_BASE = "(select vec_id as id, ts as taken, event_type = 'click' as favorite, embedding::double[] as e, 0.45 * (1 / (1 + exp(-(log10(greatest(value, 1.0)) - 2.08) * 3.2))) + 0.55 * (case when event_type = 'click' then 1.0 else 0.0 end) as q from embeddings join events on event_id = vec_id)"


def _mmr_sql(n: int) -> str:
    """One step a pick; no two vectors of the tables are so near that a burst collapses."""
    sql = (
        f"with pool as materialized (select * from (select id, e, strftime(taken, '%Y-%m-%d') as day, 0.75 * cos + 0.25 * q as rel, row_number() over (order by cos desc, taken desc, id desc) as rk"
        f" from (select b.*, round(list_dot_product(b.e, a.embedding::double[]), 6) as cos from {_BASE} b, embeddings a where a.vec_id = 0) where cos >= 0) where rk <= {selection.pool_size(n)})"
    )
    for k in range(n):
        seen = " union all ".join(f"select * from p{j}" for j in range(k))
        like = f"(select max(list_dot_product(pool.e, s.e)) from ({seen}) s)" if k else "0"
        again = f"(select count(*) from ({seen}) s where s.day = pool.day)" if k else "0"
        free = f" where id not in (select id from ({seen}))" if k else ""
        sql += f", p{k} as materialized (select id, e, day, rel, {k} as place from pool{free} order by 0.55 * rel - 0.45 * {like} - 0.5 * {again} desc, rk limit 1)"
    return sql + " select id, place, round(rel, 4) as score from (" + " union all ".join(f"select * from p{j}" for j in range(n)) + ")"


@query(_mmr_sql(12))
def mmr_pick(spark: SparkSession, sf: str) -> DataFrame:
    d = _pool(spark, sf).select("id", "taken", "favorite", "sharpness")
    picks, _, _ = selection.run(d, vecs(spark, sf), d, 12, selection.Controls(spread="day"), anchor=first_vector(spark, sf))
    return picks


@query(
    f"with f as (select *, strftime(taken, '%Y-%m-%d') as b from {_BASE} where not favorite), k as (select *, row_number() over (partition by b order by taken desc, id desc) as k from f), o as (select b, row_number() over (order by taken desc, id desc) as o from k where k = 1),"
    f" p as (select * from k join o using (b) order by k, o limit {selection.pool_size(8)}), n as (select count(*) as n, count(*) filter (q >= {selection.SOFT}) as sharp from p), m as (select n, case when sharp > 0 then sharp else n end as left_ from n)"
    f" select 0::bigint as place, 'library' as stage, count(*) as kept from {_BASE} union all select 1, 'filters', count(*) from f union all select 2, 'pool', n from m union all select 3, 'near-duplicates', n from m union all select 4, 'sharp only', left_ from m union all select 5, 'variety', least(8, left_) from m"
)
def funnel_stages(spark: SparkSession, sf: str) -> DataFrame:
    d = _pool(spark, sf).select("id", "taken", "favorite", "sharpness")
    _, stages, _ = selection.run(d, vecs(spark, sf), d.where("not favorite"), 8, selection.Controls(spread="day", sharp_only=True))
    return spark.createDataFrame([(k, n, c) for k, (n, c, _) in enumerate(stages)], "place long, stage string, kept long")


# --- caches, lists, books -------------------------------------------------------------


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    return assets(spark, sf).select(F.col("id").alias("asset_id"), F.col("kind").alias("version"), "bytes", F.col("taken").alias("used"), (F.col("filename") == "1-URGENT").alias("pinned"))


@query(
    f"with c as (select id, kind, bytes, taken, filename = '1-URGENT' pinned from {ASSETS}), t as (select sum(bytes) total from c),"
    " w as (select *, coalesce(sum(bytes) over (order by taken asc nulls first, id, kind rows between unbounded preceding and 1 preceding), 0) as freed from c where not pinned)"
    " select id as asset_id, freed::bigint as freed_before from w, t where total - freed + 1000000 > total // 2"
)
def eviction_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = _cache(spark, sf)
    half = c.agg(F.floor(F.sum("bytes") / 2)).first()[0]
    return lists.eviction_plan(c, 1_000_000, half).select("asset_id", F.col("freed_before").cast("long").alias("freed_before"))


@query(
    f"with i as (select owner as collection, id as asset_id, row_number() over (partition by owner order by id) as position from {ASSETS} where kind = 'F'), n as (select owner as collection, id as asset_id, row_number() over (partition by owner order by id desc) as n from {ASSETS} where filename in ('1-URGENT', '2-HIGH'))"
    " select * from i union all select n.collection, n.asset_id, coalesce((select max(position) from i where i.collection = n.collection), 0) + n.n from n where not exists (select 1 from i where i.collection = n.collection and i.asset_id = n.asset_id)"
)
def collection_append(spark: SparkSession, sf: str) -> DataFrame:
    a = assets(spark, sf).select(F.col("owner").alias("collection"), F.col("id").alias("asset_id"), "kind", "filename")
    w = Window.partitionBy("collection")
    items = a.where("kind = 'F'").withColumn("position", F.row_number().over(w.orderBy("asset_id")).cast("long")).select("collection", "asset_id", "position")
    new = a.where("filename in ('1-URGENT', '2-HIGH')").withColumn("n", F.row_number().over(w.orderBy(F.desc("asset_id"))).cast("long")).select("collection", "asset_id", "n")
    return lists.append(items, new)


@query(f"select owner as book, id, row_number() over (partition by owner order by bytes, id) as position from {ASSETS} where kind <> 'P'")
def page_renumber(spark: SparkSession, sf: str) -> DataFrame:
    pages = assets(spark, sf).where("kind <> 'P'").select(F.col("owner").alias("book"), "id", F.col("bytes").alias("position"))
    return lists.renumber(pages)


@query(
    f"with p as (select owner as book, id, row_number() over (partition by owner order by id) as position from {ASSETS}), b as (select min(book) as book from (select book from p group by book having count(*) >= 6))"
    " select p.book, id, case when p.book <> b.book then position when position = 5 then 2 when position >= 2 and position < 5 then position + 1 else position end as position from p, b"
)
def page_move(spark: SparkSession, sf: str) -> DataFrame:
    pages = assets(spark, sf).select(F.col("owner").alias("book"), "id").withColumn("position", F.row_number().over(Window.partitionBy("book").orderBy("id")).cast("long"))
    one = pages.groupBy("book").count().where("count >= 6").agg(F.min("book")).first()[0]
    return lists.move(pages, one, 5, 2)


# --- layout, print, export --------------------------------------------------------------


def _photos(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of nine pictures or fewer; sizes from the parts' numbers."""
    p = table(spark, sf, "part")
    return p.select(F.floor(F.col("p_partkey") / 9).cast("long").alias("page"), F.col("p_partkey").alias("id"), (F.col("p_size") * 40 + 500).cast("double").alias("pw"), (F.col("p_partkey") % 7 * 300 + 600).cast("double").alias("ph"))


_PHOTOS = "(select p_partkey // 9 as page, p_partkey as id, (p_size * 40 + 500)::double as pw, (p_partkey % 7 * 300 + 600)::double as ph from part)"


def _grid_sql(photos: str, width: str, height: str, gap: str) -> str:
    return (
        f"with p as (select *, count(*) over (partition by page) n, row_number() over (partition by page order by id) - 1 as i from {photos}),"
        " s as (select distinct n from p), c as (select n, c, row_number() over (partition by n order by e, c) r from (select n, c, abs(c / ceil(n / c) - "
        f"({width}) / ({height}) * 0.82) + 0.9 * (c * ceil(n / c) - n) / n as e from s, range(1, 1000) t(c) where c <= n)), d as (select p.*, c.c as cols, ceil(p.n / c.c) as rows from p join c on c.n = p.n and c.r = 1),"
        f" f as (select *, ({width} - {gap} * (cols - 1)) / cols as w, ({height} - {gap} * (rows - 1)) / rows as h from d)"
        f" select page, id, round(({width} - (least(cols, n - i // cols * cols) * w + {gap} * (least(cols, n - i // cols * cols) - 1))) / 2 + (i % cols) * (w + {gap}), 6) x, round((i // cols) * (h + {gap}), 6) y, round(w, 6) w, round(h, 6) h from f"
    )


def _slots(df: DataFrame) -> DataFrame:
    return df.select("page", "id", *(F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")))


@query(_grid_sql(_PHOTOS, "1400.0::double", "933.0::double", "8.0::double"))
def grid_layout(spark: SparkSession, sf: str) -> DataFrame:
    return _slots(layout.grid(_photos(spark, sf), "page", "id", 1400.0, 933.0, 8.0))


@query(f"select page, id, round(i * ((1400.0::double - 8 * (n - 1)) / n + 8), 6) as x, 0.0::double as y, round((1400.0::double - 8 * (n - 1)) / n, 6) as w, 933.0::double as h from (select *, count(*) over (partition by page) n, row_number() over (partition by page order by id) - 1 as i from {_PHOTOS})")
def filmstrip_layout(spark: SparkSession, sf: str) -> DataFrame:
    return _slots(layout.filmstrip(_photos(spark, sf), "page", "id", 1400.0, 933.0, 8.0))


_FIRST = f"(select *, row_number() over (partition by page order by id) k, count(*) over (partition by page) m from {_PHOTOS})"


@query(
    f"select page, id, 0.0::double as x, 0.0::double as y, 861.0::double as w, 933.0::double as h from {_FIRST} where k = 1 and m > 1 union all select page, id, round(x + 869, 6), y, w, h from ({_grid_sql(f'(select page, id from {_FIRST} where k > 1)', '531.0::double', '933.0::double', '8.0::double')})"
    f" union all select page, id, x, y, w, h from ({_grid_sql(f'(select page, id from {_FIRST} where m = 1)', '1400.0::double', '933.0::double', '8.0::double')})"
)
def hero_layout(spark: SparkSession, sf: str) -> DataFrame:
    return _slots(layout.hero(_photos(spark, sf), "page", "id", 1400.0, 933.0, 8.0))


def _justified_sql(photos: str, width: str, height: str, gap: str) -> str:
    """Rows end where the sum of aspects reaches their share; of all numbers of rows the one whose heights need least stretching, the fewest of equals."""
    before = "rows between unbounded preceding and 1 preceding"
    return (
        f"(with p as (select page, id, pw / ph as a, row_number() over (partition by page order by id) - 1 as i, count(*) over (partition by page) as n from {photos}),"
        " s as (select *, sum(a) over (partition by page order by id rows unbounded preceding) as s, sum(a) over (partition by page) as t from p), r as (select page, n, r from (select distinct page, n from p), range(1, 100) x(r) where r <= n),"
        " f as (select r.page, r.r, k, min(i) as i from r, range(0, 100) y(k), s where k < r.r - 1 and s.page = r.page and s.s >= (k + 1) * s.t / r.r - 1e-12 group by all),"
        " e as (select f.page, f.r, f.k, least(max(f.i - f.k) over (partition by f.page, f.r order by f.k) + f.k, r.n - f.r + f.k) as e from f join r on r.page = f.page and r.r = f.r),"
        " w as (select s.page, s.id, s.i, s.a, r.r, (select count(*) from e where e.page = s.page and e.r = r.r and e.e < s.i) as row from s join r on r.page = s.page),"
        f" l as (select page, r, row, count(*) as m, sum(a) as sa, ({width} - {gap} * (count(*) - 1)) / sum(a) as tall from w group by all),"
        f" o as (select page, r, sum(tall) as tall, row_number() over (partition by page order by round(abs(sum(tall) + {gap} * (r - 1) - {height}), 9), r) as best from l group by page, r),"
        f" h as (select l.*, l.tall * (({height} - {gap} * (l.r - 1)) / o.tall) as high from l join o on o.page = l.page and o.r = l.r and o.best = 1),"
        f" y as (select *, coalesce(sum(high + {gap}) over (partition by page order by row {before}), 0) as y from h),"
        f" z as (select w.page, w.id, y.y, y.high, y.row, ({width} - {gap} * (y.m - 1)) * (w.a / y.sa) as wide from w join y on y.page = w.page and y.r = w.r and y.row = w.row)"
        f" select page, id, coalesce(sum(wide + {gap}) over (partition by page, row order by id {before}), 0) as x, y, wide as w, high as h from z)"
    )


_ROUNDED = "round(x, 6) as x, round(y, 6) as y, round(w, 6) as w, round(h, 6) as h"
_HALVES = f"(select page, id, pw, ph, n, case when i <= (n + 1) // 2 then 0 else 1 end as half from (select *, row_number() over (partition by page order by id) i, count(*) over (partition by page) n from {_PHOTOS}))"


def _kernel(spark: SparkSession, sf: str, template: str) -> DataFrame:
    p = _photos(spark, sf).withColumn("aspect", F.col("pw") / F.col("ph"))
    return layout.by_page(p, template, "page", "id", "aspect", 1400.0, 933.0, 8.0)


@query(f"select page, id, {_ROUNDED} from {_justified_sql(_PHOTOS, '1400.0::double', '933.0::double', '8.0::double')}")
def justified_layout(spark: SparkSession, sf: str) -> DataFrame:
    return _slots(_kernel(spark, sf, "justified"))


@query(
    f"select page // 2 as page, id, {_ROUNDED} from (select page, id, x + case when page % 2 = 1 then 724.5::double else 0 end as x, y, w, h from {_justified_sql(f'(select page * 2 + half as page, id, pw, ph from {_HALVES} where n > 1)', '675.5::double', '933.0::double', '8.0::double')})"
    f" union all select page, id, {_ROUNDED} from {_justified_sql(f'(select page, id, pw, ph from {_HALVES} where n = 1)', '1400.0::double', '933.0::double', '8.0::double')}"
)
def spread_layout(spark: SparkSession, sf: str) -> DataFrame:
    """The gutter is 49 pixels: 3.5 % of the page."""
    return _slots(_kernel(spark, sf, "spread"))


@query(None)
def scatter_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Its tilts are pseudo-random numbers, which SQL can't make."""
    return _kernel(spark, sf, "scatter")


@query(
    f"select id, case when pw / ph > 1.5::double then round_even(ph * 1.5, 0) else pw end::bigint as w, case when pw / ph > 1.5::double or abs(pw / ph - 1.5) < 1e-6 then ph else round_even(pw / 1.5::double, 0) end::bigint as h,"
    f" case when pw / ph > 1.5::double then round_even((1 - ph * 1.5 / pw) / 2 * pw, 0) else 0 end::bigint as x, case when pw / ph > 1.5::double or abs(pw / ph - 1.5) < 1e-6 then 0 else round_even((1 - pw / 1.5::double / ph) / 2 * ph, 0) end::bigint as y from {_PHOTOS}"
)
def crop_boxes(spark: SparkSession, sf: str) -> DataFrame:
    c = layout.crop_box(F.col("pw"), F.col("ph"), F.lit(1.5))
    return _photos(spark, sf).select("id", *(c[k].alias(k) for k in ("w", "h", "x", "y")))


@query(
    f"with s as (select page, id, pw, round_even(700.0::double / 1400 * 3508, 0) slot from {_PHOTOS}), d as (select *, pw / (slot / 3508 * 297.0 / 25.4) as dpi from s)"
    " select page, id, 'resolution' as kind, case when dpi < 150 then 'stop' else 'look' end as severity, round(dpi, 6) as dpi from d where dpi < 220"
    f" union all select page, id, 'trim', 'stop', null from {_PHOTOS} where id % 5 = 0 and (id % 4) * 0.25 * 0.5 < 5.0 / 297"
)
def preflight_findings(spark: SparkSession, sf: str) -> DataFrame:
    face = F.array((F.col("id") % 4).cast("double") * 0.25, F.lit(0.4), (F.col("id") % 4).cast("double") * 0.25 + 0.2, F.lit(0.6))
    slots = _photos(spark, sf).select(
        "page", "id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(700).alias("w"), F.lit(933).alias("h"), F.lit(1400).alias("laid_w"), F.lit(933).alias("laid_h"), F.col("pw").alias("source_px"),
        F.when(F.col("id") % 5 == 0, F.array(face)).otherwise(F.array().cast("array<array<double>>")).alias("faces"),
    )
    p = preflight.profiles(spark).where("profile = 'a4-landscape'")
    return preflight.findings(slots.join(F.broadcast(p))).withColumn("dpi", F.round("dpi", 6))  # one profile


@query("select o_orderkey as id, strftime(o_orderdate, '%Y/%m') as folder, o_orderkey || '@' || 'IMG_' || o_orderkey || '.' || case when o_orderstatus = 'P' then 'DNG' when o_orderstatus = 'F' then 'MOV' else 'JPG' end as name, case when o_orderstatus = 'F' then 2 when o_orderstatus = 'P' then 3 else 1 end::bigint as file_type, epoch(o_orderdate)::bigint as taken_at from orders where o_orderpriority <> '5-LOW'")
def export_files(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("o_orderstatus") == "P", "DNG").when(F.col("o_orderstatus") == "F", "MOV").otherwise("JPG")
    none = F.lit(None).cast("map<string, struct<bytes: bigint, width: int, height: int, type: string, filename: string>>")
    a = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("IMG_"), F.col("o_orderkey").cast("string"), F.lit("."), suffix).alias("filename"), F.when(F.col("o_orderstatus") == "F", "movie").otherwise("image").alias("kind"),
        F.col("o_orderdate").cast("timestamp").alias("taken"), F.lit(None).cast("timestamp").alias("added"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("x")).alias("missing_since"), F.lit(False).alias("hidden"), none.alias("versions"),
        F.lit(1).alias("bytes"), F.lit(False).alias("favorite"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
    )
    return export.files(a).select(F.col("id").cast("long").alias("id"), "folder", "name", "file_type", "taken_at")


@query("select l_suppkey as person, arg_max(l_orderkey * 10 + l_linenumber, (l_quantity::bigint * 1000000000 - (l_orderkey * 10 + l_linenumber))) as cover from lineitem group by l_suppkey")
def export_cover(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("person"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), q, F.lit(1).cast("long")).alias("box"))
    return export.covers(f)
